"""Small cases made by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions import geo, labels
from tracewright.operators import corridors as co
from tracewright.operators import profiles as pr
from tracewright.operators import selection as se
from tracewright.operators import sequence as sq
from tracewright.operators import similarity as si
from tracewright.operators import stats as st
from tracewright.operators import trips as tr
from tracewright.operators import graph
from tracewright.operators.graph import connected_components
from tracewright.plans import numbering, spread
from tracewright.sources import csv as src

DEG = 1 / 111_194.9  # a metre of latitude


def points(spark, rows):
    """(user, seq, second, metres north)"""
    return spark.createDataFrame([(u, s, t, 48.8 + m * DEG, 2.3) for u, s, t, m in rows], "USER_ID string, SEQ long, EPOCH_S long, LATITUDE double, LONGITUDE double")


def test_presample_links_chains_not_means(spark):
    rows = [("a", 0, 0, 0.0), ("a", 1, 2, 1.9), ("a", 2, 4, 3.8), ("a", 3, 7, 4.0), ("b", 0, 0, 0.0)]
    found = sq.presample(points(spark, rows), ["USER_ID"], "SEQ", "EPOCH_S").orderBy("USER_ID", "SEQ").collect()
    assert [(r["USER_ID"], r["SEQ"]) for r in found] == [("a", 2), ("a", 3), ("b", 0)]
    assert found[0]["LATITUDE"] == pytest.approx(48.8 + 1.9 * DEG, abs=1e-12)


def reference_spans(lat, lon, time, radius, least):
    spans, i = [], 0
    while i < len(lat):
        for j in range(i + 1, len(lat)):
            if tr._metres(lat[i], lon[i], lat[j], lon[j]) > radius:
                break
            if time[j] - time[i] >= least:
                spans.append((i, j))
                i = j
                break
        i += 1
    return spans


def test_stay_spans_equal_the_plain_scan():
    random.seed(3)
    for _ in range(200):
        n = random.randint(0, 60)
        time = np.cumsum([random.choice([0, 30, 120, 300, 700]) for _ in range(n)]).astype(float)
        lat = 48.8 + np.cumsum([random.choice([0, 0, 5, 40, 60, -40]) for _ in range(n)]) * DEG
        lon = np.full(n, 2.3)
        assert tr.stay_spans(lat, lon, time, 50.0, 600.0) == reference_spans(lat, lon, time, 50.0, 600.0)


def test_stay_needs_exactly_the_least_time(spark):
    rows = [("a", k, 60 * k, 100.0 * k) for k in range(10)] + [("a", 10, 1000, 2000.0), ("a", 11, 1600, 2010.0), ("a", 12, 1700, 3000.0)]
    seg = tr.segment_trips(points(spark, rows), "USER_ID", "SEQ", "EPOCH_S")
    stays = tr.staypoints(seg, "USER_ID", "EPOCH_S").collect()
    assert [(r["start_s"], r["end_s"]) for r in stays] == [(1000, 1600)]
    by = {r["SEQ"]: (r["TRIP_NO"], r["STAY_NO"]) for r in seg.collect()}
    assert by[10] == (1, 1) and by[11] == (None, 1) and by[12] == (2, None)


def test_merge_takes_the_first_near_place(spark):
    stays = spark.createDataFrame([("a", k, 48.8 + m * DEG, 2.3) for k, m in ((1, 0.0), (2, 150.0), (3, 90.0), (4, 140.0))], "USER_ID string, STAY_NO long, latitude double, longitude double")
    found = tr.merge_staypoints(stays, "USER_ID").orderBy("place").collect()
    assert [r["count"] for r in found] == [3, 1]  # 140 is within reach of the first place, whose centre moved to 45
    assert found[1]["latitude"] == pytest.approx(48.8 + 150 * DEG)


def test_trim_is_strict_and_takes_returns(spark):
    rows = [("a", k, k, m) for k, m in enumerate([0.0, 150.0, 50.0, 400.0, 1000.0])]
    kept = sq.trim_zones(points(spark, rows), ["USER_ID"], "SEQ", 100.0)
    assert sorted(r["SEQ"] for r in kept.collect()) == [1, 3]


def test_empty_inputs(spark):
    none = points(spark, []).withColumn("TRAJECTORY_UID", F.lit("x")).withColumn("POINT_INDEX", F.col("SEQ"))
    assert tr.refine_users(none.select("USER_ID", "SEQ", "EPOCH_S", "LATITUDE", "LONGITUDE")).count() == 0
    edges = spark.createDataFrame([], "src long, dst long")
    assert connected_components(edges).count() == 0


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(5, None), (7, 7)]
    label = {}
    for a, b in edges:
        if b is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(500):
        for a, b in edges:
            if b is not None and a != b:
                label[a] = label[b] = min(label[a], label[b])
    found = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r["node"]: r["component"] for r in found.collect()} == label


@pytest.mark.parametrize("few", [0, 30, 1 << 17])
def test_few_edges_are_united_without_rounds(spark, monkeypatch, few):
    """Before, each of the rounds of 40 edges started six shuffles and more."""
    rounds = []
    monkeypatch.setattr(graph, "_large_star", lambda *a, f=graph._large_star: rounds.append(a) or f(*a))
    edges = [(k + 1, k) for k in range(-5, 30)] + [(90, 70), (80, 90), (60, 80), (-(1 << 62), 1 << 62), (7, None), (8, 8)]
    found = connected_components(spark.createDataFrame(edges, "src long, dst long"), few=few)
    want = {k: -5 for k in range(-5, 31)} | dict.fromkeys((60, 70, 80, 90), 60) | dict.fromkeys((-(1 << 62), 1 << 62), -(1 << 62))
    assert sorted(map(tuple, found.collect())) == sorted(want.items()) and bool(rounds) == (few < len(edges) - 2)
    assert connected_components(spark.createDataFrame([], "src long, dst long"), few=few).count() == 0


@pytest.mark.parametrize("thin", [4, 1 << 18])
def test_components_with_a_hub_and_other_kinds_of_nodes(spark, monkeypatch, thin):
    monkeypatch.setattr(graph, "THIN_ROWS", thin)
    monkeypatch.setattr(spread, "HOT_ROWS", 20)
    monkeypatch.setattr(spread, "MOST_HOT", 4)
    edges = [(0, k) for k in range(1, 200)] + [(300 + k, 301 + k) for k in range(40)] + [(199, 500)]
    for kind, name in (("long", lambda k: k), ("string", lambda k: f"{k:04d}"), ("struct<g:string,k:long>", lambda k: (None if k < 300 else "g", k))):
        rows = spark.createDataFrame([(name(a), name(b)) for a, b in edges], f"src {kind}, dst {kind}")
        found = {r["node"]: r["component"] for r in connected_components(rows).collect()}
        assert len(found) == 242
        want = {name(k): name(0) if k < 200 or k == 500 else name(300) for e in edges for k in e}
        if kind == "struct<g:string,k:long>":
            found = {tuple(k): tuple(v) for k, v in found.items()}
        assert found == want


def test_a_hub_is_dealt_to_many_tasks(spark):
    rows = spark.range(1, 100_001).selectExpr("0L as u", "id as v")
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = spread.join_each(rows, least, ["u"], F.col("v"), 20_000).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in parts) == 100_000 and max(r["count"] for r in parts) < 45_000  # of four tasks


def test_spanning_edges_connect_at_every_weight(spark):
    random.seed(2)
    edges = [(random.randrange(30), random.randrange(30), float(random.randrange(10))) for _ in range(300)]
    kept = [tuple(r) for r in graph.spanning_edges(spark.createDataFrame(edges, "l long, r long, w double").repartition(3), "l", "r", "w").collect()]
    assert len(kept) <= 3 * 29 and set(kept) <= set(edges)
    def parts(rows, least):
        label = list(range(30))
        for _ in range(30):
            for a, b, w in rows:
                if w >= least:
                    label[a] = label[b] = min(label[a], label[b])
        return label
    assert all(parts(kept, w) == parts(edges, w) for w in range(10))


def features(spark, sets):
    rows = [(u, u, sorted(c), len(c), len(c), sorted(c)[0], sorted(c)[-1]) for u, c in sets.items()]
    return spark.createDataFrame(rows, "TRAJECTORY_UID string, USER_ID string, CELL_SET array<string>, N_CELLS long, N_POINTS long, START_CELL string, END_CELL string")


def test_jaccard_keeps_exact_thresholds_and_links_chains(spark):
    grid = [f"{k:03d}" for k in range(300)]
    sets = {"a": set(grid[:55]), "b": set(grid[:100]), "c": set(grid[60:160]), "d": set(grid[200:204])}
    pairs = {(r["l"], r["r"]): r["score"] for r in si.jaccard_pairs(features(spark, sets), 0.55, 1).collect()}
    assert pairs == {("a", "b"): 0.55}
    found = si.cluster_trajectories(features(spark, sets), 0.25, 1).collect()
    assert {r["TRAJECTORY_UID"]: r["CLUSTER_ID"] for r in found} == {"a": 0, "b": 0, "c": 0, "d": 1}
    with pytest.raises(ValueError):
        si.jaccard_pairs(features(spark, sets), 0.5, 0)


def test_jaccard_pairs_are_written_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(si, "BLOCK", 7)
    monkeypatch.setattr(si, "TASK_PAIRS", 200)
    near = {"a": set("vwxyz"), "b": set("wxyz"), "c": set("pqrst")}
    sets = {f"{kind}{k:02}": cells for kind, cells in near.items() for k in range(30)}
    found = si.jaccard_pairs(features(spark, sets), 0.3, 2, digits=2)
    brute = {(x, y, len(sets[x] & sets[y]), round(len(sets[x] & sets[y]) / len(sets[x] | sets[y]), 2)) for x in sets for y in sets if x < y and sets[x] & sets[y]}
    rows = [tuple(r) for r in found.select("l", "r", "shared", "score").collect()]
    assert len(rows) == len(brute) == 3 * 435 + 900 and set(rows) == brute
    by_task = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(by_task) > 4 and max(by_task) < 800


def test_medoid_ties_go_to_the_first(spark):
    clusters = features(spark, {"b": {"1", "2"}, "a": {"1", "2"}}).withColumn("CLUSTER_ID", F.lit(0))
    assert si.medoids(clusters).first()["TRAJECTORY_UID"] == "a"


def edges_of(spark, path, weight):
    cell = "struct<gx:long,gy:long>"
    rows = [((a, b) if a < b else (b, a), w) for a, b, w in zip(path, path[1:], weight, strict=False)]
    return spark.createDataFrame(rows, f"edge struct<a:{cell},b:{cell}>, weight long")


def test_corridor_goes_straight_on(spark):
    line = [(k, 0) for k in range(12)]
    side = [(6, 0), (6, 1), (6, 2)]
    edges = edges_of(spark, line, [3] * 11).unionAll(edges_of(spark, side, [4] * 2))
    found = co.corridors(edges).collect()
    assert [r["length_cells"] for r in found] and max(r["length_cells"] for r in found) >= 8
    none = co.corridors(edges_of(spark, [(k, 0) for k in range(7)], [3] * 6)).collect()
    assert none == []  # seven cells are too few


def plain_trace(edges, least_weight=2, least_cells=8):
    """The walk over all edges at once, one edge after the other: seeds by weight, then edge; straight on and heavy; ties to the smaller cell."""
    weight = {e: w for e, w in edges.items() if w >= least_weight}
    heaviest, used, out = max(weight.values(), default=1), set(), []
    near = {}
    for a, b in weight:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)

    def key(a, b):
        return (a, b) if a < b else (b, a)

    def follow(path, weights):
        while len(path) < 5000:
            before, here = path[-2:]
            options = []
            for there in sorted(near[here]):
                if there != before and key(here, there) not in used:
                    x, y, u, v = here[0] - before[0], here[1] - before[1], there[0] - here[0], there[1] - here[1]
                    cosine = (x * u + y * v) / (math.hypot(x, y) * math.hypot(u, v))
                    options.append((cosine + 0.35 * weight[key(here, there)] / heaviest, cosine, there))
            best = max(options, key=lambda o: o[0], default=None)
            if best is None or best[1] < -0.2:
                return
            used.add(key(here, best[2]))
            weights.append(weight[key(here, best[2])])
            path.append(best[2])

    for a, b in sorted(weight, key=lambda e: (-weight[e], e)):
        if (a, b) in used:
            continue
        used.add((a, b))
        path, weights = [a, b], [weight[a, b]]
        follow(path, weights)
        path.reverse()
        follow(path, weights)
        path.reverse()
        if len(path) >= least_cells:
            out.append((path, sum(weights) / len(weights), max(weights), min(weights)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_corridors_equal_a_plain_trace(spark, seed):
    random.seed(seed)
    edges = {}
    for part in range(3):  # three grids apart, some of whose edges are missing
        for x in range(12):
            for y in range(5):
                for u, v in ((x + 1, y), (x, y + 1), (x + 1, y + 1)):
                    if random.random() < 0.6:
                        edges[(x + 100 * part, y), (u + 100 * part, v)] = random.randint(1, 6)
    cell = "struct<gx:long,gy:long>"
    found = co.corridors(spark.createDataFrame([((a, b), w) for (a, b), w in edges.items()], f"edge struct<a:{cell},b:{cell}>, weight long")).orderBy("corridor_id").collect()
    mine = [([(c["gx"], c["gy"]) for c in r["cells"]], r["weight_mean"], r["weight_max"], r["weight_min"]) for r in found]
    want = plain_trace(edges)
    assert sorted(mine) == sorted(want) and len(want) > 2
    order = [(-r["display_score"], -r["weight_mean"], -r["length_cells"]) for r in found]
    assert order == sorted(order) and [r["corridor_id"] for r in found] == list(range(1, len(found) + 1))


def test_overlapping_corridors_are_left_out(spark):
    rows = [(1, [(0.0, float(k)) for k in range(10)]), (2, [(0.0, float(k)) for k in range(4, 14)]), (3, [(1.0, float(k)) for k in range(5)])]
    shown = spark.createDataFrame(rows, "corridor_id long, cells array<struct<lat:double,lon:double>>")
    assert sorted(r["corridor_id"] for r in co.without_overlap(shown).collect()) == [1, 3]


def test_zone_falls_back_to_the_largest_size(spark):
    users = spark.createDataFrame([(str(k), 10, 1 + k, 48.8 + k, 2.3) for k in range(3)], "USER_ID string, N_POINTS long, N_TRAJECTORIES long, MEAN_LAT double, MEAN_LON double")
    found = pr.zone_selection(users, 2, 500).collect()
    assert [(r["USER_ID"], r["ZONE_CELL_SIZE_M"]) for r in found] == [("2", 16000)]


def test_balanced_pick_fills_after_the_first_two(spark):
    rows = [("c", "u1", f"a{k}", k, 1) for k in range(5)] + [("c", "u2", "b0", 1, 1)]
    clusters = spark.createDataFrame(rows, "CLUSTER_ID string, USER_ID string, TRAJECTORY_UID string, N_CELLS long, N_POINTS long")
    picked = se.balanced_pick(clusters, 2, 4).orderBy("PICK").collect()
    assert [r["TRAJECTORY_UID"] for r in picked] == ["a0", "a1", "b0", "a2"]


def test_labels(spark):
    df = spark.createDataFrame([(17.9, "TRUE ", 0.0), (18.0, "0", 1.0), (None, None, None), (65.0, "yes", 3.0)], "age double, b string, n double")
    rows = df.select(labels.age_group(F.col("age")), labels.bool_label(F.col("b")), labels.nb_car_group(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [("<18", "Yes", "0 car"), ("18-24", "No", "1 car"), ("Unknown", "Unknown", "Unknown"), ("65+", "Yes", "2+ cars")]


def test_snap_halves_go_to_the_even_node(spark):
    lat = 2.5 * 30 / geo.M_PER_DEGREE
    node = spark.range(1).select(geo.snap_grid(F.lit(lat), F.lit(0.0), 30, F.lit(0.0)).alias("n")).first()["n"]
    assert node["gy"] == round(lat * geo.M_PER_DEGREE / 30)  # halves to even, as here


def test_stays_with_times_that_go_back():
    random.seed(4)
    for _ in range(200):
        n = random.randint(0, 40)
        time = np.cumsum([random.choice([-200, 0, 120, 300, 700]) for _ in range(n)]).astype(float)
        lat = 48.8 + np.cumsum([random.choice([0, 0, 5, 40, 60, -40]) for _ in range(n)]) * DEG
        assert tr.stay_spans(lat, np.full(n, 2.3), time, 50.0, 600.0) == reference_spans(lat, np.full(n, 2.3), time, 50.0, 600.0)


def test_running_sums_and_numbers(spark):
    random.seed(7)
    rows = [(random.choice(["a", "b", None]), random.randrange(50), k) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, x long, k long").repartition(5)
    got = {r["k"]: (r["place"], r["before"]) for r in numbering.running_sum(numbering.numbered(df, [F.col("g"), F.col("x").desc(), F.col("k")], "place"), [F.col("g"), F.col("x").desc(), F.col("k")], F.col("x"), "before").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", -r[1], r[2]))
    assert got == {r[2]: (n, sum(q[1] for q in order[:n])) for n, r in enumerate(order)}
    assert numbering.numbered(df.limit(0), [F.col("x")], "place").count() == 0


def test_describe_by_section_and_limits(spark):
    random.seed(8)
    rows = [(s, random.choice([1.0, 2.0, random.random()])) for s in ("a", "b", "b") for _ in range(101)] + [("c", 4.0), ("d", None)]
    found = {r["s"]: r for r in st.describe(spark.createDataFrame(rows, "s string, x double"), ["s"]).collect()}
    for s in "abc":
        own = [x for t, x in rows if t == s]
        assert [found[s][f"p{p}"] for p in st.PERCENTILES] == pytest.approx([float(np.percentile(own, p)) for p in st.PERCENTILES])
        assert (found[s]["n"], found[s]["least"], found[s]["largest"]) == (len(own), min(own), max(own))
    assert "d" not in found
    limits = st.axis_limits(spark.createDataFrame([(2.0,), (4.0,)], "x double"), "x", 0.5).first()
    assert tuple(limits) == (1.0, 5.0) and tuple(st.axis_limits(spark.createDataFrame([], "x double"), "x").first()) == (0.0, 1.0)
    assert tuple(st.axis_limits(spark.createDataFrame([(2.0,)], "x double"), "x", 1.0).first()) == (2.0 - 1e-6, 2.0 + 1e-6)
    shares = {(r["section"], r["limit_value"]): r["share"] for r in st.coverage(spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 9.0)], "section string, x double"), {"a": [1, 5], "z": [1]}).collect()}
    assert shares == {("a", 1.0): 0.5, ("a", 5.0): 1.0, ("z", 1.0): None}
    steps = sorted(tuple(r) for r in st.ecdf(spark.createDataFrame([(1.0,), (1.0,), (5.0,), (None,)], "x double")).collect())
    assert steps == [(1.0, pytest.approx(1 / 3)), (1.0, pytest.approx(2 / 3)), (5.0, 1.0)]


def test_draws_are_the_standard_library_s(spark):
    rows = [(f"u{k:02d}", f"u{k:02d}.csv", s) for k in range(20) for s in range(2)] + [(None, None, 0)]
    df = spark.createDataFrame(rows, "USER_ID string, SOURCE_FILE string, SEQ long")
    names = [f"u{k:02d}" for k in range(20)]
    assert {r["USER_ID"] for r in se.random_users(df, 5, 42).collect()} == set(random.Random(42).sample(names, 5))
    files = [f"{n}.csv" for n in names]
    random.Random(42).shuffle(files)
    assert {r["SOURCE_FILE"] for r in se.shuffled_files(df, 7).collect()} == set(files[:7])
    assert se.random_users(df, 50).count() == 40 and se.random_users(df.limit(0), 5).count() == 0


def test_viewer_and_render(spark):
    rows = [(f"{n}.csv", s) for n in (1, 15, 16, 40, 130) for s in range(n)]
    df = spark.createDataFrame(rows, "SOURCE_FILE string, SEQ long")
    listed = {r["SOURCE_FILE"]: (r["id"], r["raw_count"], r["shown_count"], r["color"]) for r in se.viewer_list(df).collect()}
    assert listed == {"130.csv": (1, 130, 9, se.COLORS[0]), "16.csv": (2, 16, 2, se.COLORS[1]), "40.csv": (3, 40, 3, se.COLORS[2])}
    assert [r["SEQ"] for r in se.viewer_heat(df).where("SOURCE_FILE = '130.csv'").orderBy("SEQ").collect()] == [0, 100]
    shown = se.viewer_list(df)
    assert {r["SOURCE_FILE"] for r in se.viewer_search(shown, " 3 ").collect()} == {"40.csv", "130.csv"}
    assert {r["SOURCE_FILE"] for r in se.viewer_search(shown, "3", exact=True).collect()} == {"40.csv", "130.csv"}
    assert {r["SOURCE_FILE"] for r in se.viewer_search(shown, "2", exact=True).collect()} == {"16.csv"}
    kept = se.render_points(df, ["SOURCE_FILE"], "SEQ", 30).groupBy("SOURCE_FILE").count().collect()
    assert {r["SOURCE_FILE"]: r["count"] for r in kept} == {"15.csv": 15, "16.csv": 16, "40.csv": 2, "130.csv": 5}
    assert sq.thin_long(df, ["SOURCE_FILE"], "SEQ", 16).where("SOURCE_FILE = '40.csv'").count() == 14


def test_report_lines_are_bounded(spark):
    points_ = spark.createDataFrame([(f"t{k}", s) for k in range(6) for s in range(k + 1)], "TRAJECTORY_UID string, POINT_INDEX long")
    clusters = spark.createDataFrame([(f"t{k}", k % 2) for k in range(6)], "TRAJECTORY_UID string, CLUSTER_ID int")
    top = spark.createDataFrame([(1,)], "CLUSTER_ID int")
    found = se.report_lines(points_, clusters, top, most_points=3, most_lines=2).collect()
    assert sorted((r["TRAJECTORY_UID"], r["POINT_INDEX"]) for r in found) == [("t1", 0), ("t1", 1), ("t3", 0), ("t3", 1), ("t3", 2)]


def test_hot_cells_and_equal_sets(spark, monkeypatch):
    """A cell in every trajectory, many equal sets, sets too small to link: all pairs against brute force, with and without salts."""
    random.seed(9)
    sets = {f"t{k:03d}": {"hot"} | set(random.sample([f"{c:02d}" for c in range(14)], random.randint(1, 7))) for k in range(90)}
    sets |= {f"u{k:03d}": sets[f"t{k:03d}"] for k in range(30)}
    want = {}
    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n >= 3 and n / len(sets[a] | sets[b]) >= 0.6:
                want[a, b] = (n, n / len(sets[a] | sets[b]))
    for hot in (1 << 14, 8):
        monkeypatch.setattr(spread, "HOT_ROWS", hot)
        found = {(r["l"], r["r"]): (r["shared"], r["score"]) for r in si.jaccard_pairs(features(spark, sets), 0.6, 3).collect()}
        assert found == want
        label = {u: u for u in sets}
        for _ in range(40):
            for a, b in want:
                label[a] = label[b] = min(label[a], label[b])
        number = {u: k for k, u in enumerate(sorted(set(label.values())))}
        clusters = {r["TRAJECTORY_UID"]: r["CLUSTER_ID"] for r in si.cluster_trajectories(features(spark, sets), 0.6, 3).collect()}
        assert clusters == {u: number[label[u]] for u in sets}


def test_files_with_other_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("LATITUDE,LONGITUDE,UTC_DATE,UTC_TIME\n48.8,2.3,2022-03-27,02:30:00\n")
    (tmp_path / "b.csv").write_text("\ufeffUTC_TIME,LONGITUDE,LATITUDE,UTC_DATE,MORE\n08:00:00,2.3,48.8,2022-10-17,x\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("A,B\n1,2\n")
    (tmp_path / "d.csv").write_text("")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")  # has no 02:30 that day
    try:
        with pytest.raises(ValueError, match="c.csv"):
            src.read_raw_points(spark, str(tmp_path))
        good, bad = src.read_points_of_good_files(spark, str(tmp_path))
        found = src.clean_points(good).select("USER_ID", "LATITUDE", "LONGITUDE", F.col("DATETIME").cast("string").alias("at")).orderBy("USER_ID").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [tuple(r) for r in found] == [("a", 48.8, 2.3, "2022-03-27 02:30:00"), ("b", 48.8, 2.3, "2022-10-17 08:00:00")]
    assert {r["source_file"]: r["error"] for r in bad.collect()} == {n: "missing columns: LATITUDE, LONGITUDE" for n in ("c.csv", "d.csv")}
    assert src.read_points_of_good_files(spark, [str(tmp_path / "c.csv")])[0].count() == 0


def test_other_sources(spark, tmp_path):
    (tmp_path / "edges.csv").write_text("lat1,lon1,lat2,lon2,weight\n48.1,2.1,48.2,2.2,3\n48.2,2.2,48.100000001,2.1,5.0\n1,1,1,1,9\nx,1,2,3,4\n")
    found = src.read_segment_edges(spark, str(tmp_path / "edges.csv")).collect()
    assert [(r["edge"]["a"]["lat"], r["edge"]["b"]["lat"], r["weight"]) for r in found] == [(48.1, 48.2, 5)]
    (tmp_path / "corridors.csv").write_text("corridor_id,weight_mean,latitudes,longitudes\n7,2.5,48.8;48.9; ,2.3;2.3\n")
    row = src.read_corridors(spark, str(tmp_path / "corridors.csv")).first()
    assert len(row["coords"]) == 2 and row["length_km"] == pytest.approx(11.119, abs=1e-3) and row["sinuosity"] == 1.0
    (tmp_path / "report.csv").write_text("NAME,N,X\na,3.9,1.5\nb,none,\nc,1,2\n")
    rows = src.read_numbers(spark, str(tmp_path / "report.csv"), {"N": "bigint", "X": "double"}, most=2).collect()
    assert [tuple(r) for r in rows] == [("a", 3, 1.5), ("b", 0, 0.0)]
    line = src.layer(spark.createDataFrame([("t", 1, 2.5, 48.5), ("t", 0, 2.0, 48.0)], "k string, at long, LONGITUDE double, LATITUDE double"), "k", "at").first()
    assert line["geometry"] == '{"type":"LineString","coordinates":[[2.0,48.0],[2.5,48.5]]}'


def test_first_trajectories(spark, tmp_path):
    (tmp_path / "r.csv").write_text("USER_ID,TRAJECTORY_UID,LATITUDE,LONGITUDE\na,a_2,1,2\na,a_1,1,2\nb,b_1,,2\nb,b_1,1,2\n")
    assert {r["TRAJECTORY_UID"] for r in src.read_refined(spark, str(tmp_path / "r.csv"), 2).collect()} == {"a_1", "a_2"}
    assert src.read_refined(spark, str(tmp_path / "r.csv")).count() == 3


def test_csv_sources(spark, tmp_path):
    for user, body in (("10_1", "48.8,2.3,2022-10-17,08:00:00\n91,2.3,2022-10-17,08:00:00\n48.8,2.3,x,y\nbad,2.3,2022-10-17,08:00:00\n"), ("10_2", "48.9,2.4,2022-10-17,09:00:00\n")):
        (tmp_path / f"{user}.csv").write_text("LATITUDE,LONGITUDE,UTC_DATE,UTC_TIME\n" + body)
    paths = src.input_paths(spark, str(tmp_path))
    assert len(paths) == 2 and src.input_paths(spark, str(tmp_path / "10_1"))[0].endswith("10_1.csv")
    found = src.clean_points(src.read_raw_points(spark, paths)).select("USER_ID", "SOURCE_FILE", "LATITUDE").orderBy("USER_ID").collect()
    assert [tuple(r) for r in found] == [("10_1", "10_1.csv", 48.8), ("10_2", "10_2.csv", 48.9)]
    assert src.read_raw_points(spark, paths, 1).select("USER_ID").distinct().count() == 1
    with pytest.raises(ValueError):
        src.read_columns(spark, paths, {"A": "string"}, ("A",))
    with pytest.raises(ValueError):
        src.clean_points(src.read_raw_points(spark, paths).drop("UTC_DATE"))
    df = spark.createDataFrame([("t", ["1:2", "3:4"])], "TRAJECTORY_UID string, CELL_SET array<string>")
    src.write_table(df, str(tmp_path / "out"), "csv")
    assert src.read_features(spark, str(tmp_path / "out")).first()["CELL_SET"] == ["1:2", "3:4"]


def test_overlap_goes_on_after_a_block(spark):
    random.seed(5)
    rows = []
    for k in range(120):  # every third one is new, the others lie on it
        at = k // 3 if k < 60 else k
        rows.append((k, [(at * 10 + j, random.randint(0, 1) if k % 3 else 0) for j in range(6)]))
    shown = spark.createDataFrame(rows, "corridor_id long, cells array<struct<gx:long,gy:long>>")
    taken, kept = set(), []
    for k, own in rows:
        if len(set(own) & taken) / len(set(own)) <= 0.35 and len(kept) < 50:
            kept.append(k)
            taken |= set(own)
    for block in (7, 1000):
        found = co.without_overlap(shown, most=50, block=block)
        assert sorted(r["corridor_id"] for r in found.collect()) == kept
    assert co.without_overlap(shown.limit(0)).count() == 0
    assert [r["corridor_id"] for r in co.without_overlap(shown.where("corridor_id < 3"), most=1, block=1).collect()] == [0]


def test_overlap_looks_past_twenty_times_the_most(spark):
    rows = [(k, [(0, 0), (1, 1)]) for k in range(100)] + [(100, [(5, 5)])]
    shown = spark.createDataFrame(rows, "corridor_id long, cells array<struct<gx:long,gy:long>>")
    assert sorted(r["corridor_id"] for r in co.without_overlap(shown, most=2, block=40).collect()) == [0, 100]
