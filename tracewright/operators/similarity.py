"""Trajectory pairs by cell-set Jaccard similarity, clusters, summaries and medoids.

Features have one row a trajectory (and value of ``within``) and a CELL_SET
without repeats or nulls. Trajectories of one cell set are compared once. Ties go
to the smaller TRAJECTORY_UID. No features give no pairs, clusters or medoids.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.numbering import numbered
from ..plans.spread import hot_from, join_each
from ..plans.storage import stored
from .graph import connected_components, spanning_edges

UID, USER = "TRAJECTORY_UID", "USER_ID"
#: Members of a class in a block when its pairs are written out, and about how many pairs a task writes.
BLOCK, TASK_PAIRS = 512, 1 << 22


def cell_classes(features: DataFrame, within: list[str] | None = None) -> DataFrame:
    """``within..., CELL_SET, rep, m, n``: trajectories of one cell set are one class, known by its first one; their number, and that of the cells."""
    classes = features.groupBy(*(within or []), "CELL_SET").agg(F.min(UID).alias("rep"), F.count(F.lit(1)).alias("m"))
    return classes.withColumn("n", F.size("CELL_SET").cast("long"))


def class_pairs(classes: DataFrame, threshold: float, min_shared: int, within: list[str] | None = None) -> DataFrame:
    """``within..., l, r, ml, mr, shared, score`` (l < r): classes with enough shared cells and similarity.

    Cells are ordered from the rarest on. Two similar sets share one of the first
    cells of both, as many as the threshold leaves to miss, and from the first
    shared one on both have enough cells left; so a cell that most trajectories
    pass brings hardly any pairs together. What meets is verified on the sets.
    """
    if min_shared < 1:
        raise ValueError("min_shared is at least 1")
    within = within or []
    share = Fraction(str(threshold))
    num, den = F.lit(share.numerator).cast("long"), F.lit(share.denominator).cast("long")

    def rounded_up(a: Column, b: Column) -> Column:
        return F.floor((a + b - 1) / b).cast("long")

    needed = F.greatest(F.lit(min_shared).cast("long"), rounded_up(F.col("n") * num, den))  # of cells shared with any other set
    each = classes.where(F.col("n") >= min_shared).select(*within, "rep", "n", F.explode("CELL_SET").alias("cell"))
    often = each.groupBy(*within, "cell").agg(F.count(F.lit(1)).alias("df")).withColumn("rows", F.col("df"))
    most = hot_from(each.count())
    ranked = join_each(each, often, [*within, "cell"], F.col("rep"), most, "rows")
    ranked = ranked.groupBy(*within, "rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "cell"))).alias("c"))
    first = (F.col("n") - needed + 1).cast("int")
    prefix = ranked.where(first > 0).select(*within, "rep", "n", F.posexplode(F.slice("c", F.lit(1), first)).alias("at", "c"))
    prefix = stored(prefix.select(*within, "rep", "n", "c.cell", (F.col("n") - F.col("at")).alias("rem")), "prefixes")
    other = prefix.select(*within, "cell", *[F.col(c).alias(f"{c}0") for c in ("rep", "n", "rem")])
    left = F.least("rem", "rem0")
    fits = (left >= min_shared) & (left * (num + den) >= num * (F.col("n") + F.col("n0")))
    met = prefix.join(other, [*within, "cell"]).where((F.col("rep") < F.col("rep0")) & fits)
    pairs = stored(met.select(*within, F.col("rep").alias("l"), F.col("rep0").alias("r")).distinct(), "candidate-pairs")
    most = hot_from(pairs.count())
    for side, across in (("l", "r"), ("r", "l")):
        own = pairs.groupBy(*within, side).agg(F.count(F.lit(1)).alias("rows"))
        sets = classes.select(*within, F.col("rep").alias(side), F.col("CELL_SET").alias(f"s{side}"), F.col("m").alias(f"m{side}"), F.col("n").alias(f"n{side}"))
        pairs = join_each(pairs, sets.join(own, [*within, side]), [*within, side], F.col(across), most, "rows")
    pairs = pairs.withColumn("shared", F.size(F.array_intersect("sl", "sr")).cast("long")).where(F.col("shared") >= min_shared)
    score = F.col("shared") / (F.col("nl") + F.col("nr") - F.col("shared"))
    return pairs.withColumn("score", score).where(F.col("score") >= threshold).select(*within, "l", "r", "ml", "mr", "shared", "score")


def jaccard_pairs(features: DataFrame, threshold: float, min_shared: int, within: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """``within..., l, r, shared, score`` (l < r): pairs of trajectories with enough shared cells and similarity.

    Classes of one cell set are compared, and then written out: members are put
    in blocks, and what is dealt to tasks are pairs of blocks, so that tasks
    write about ``TASK_PAIRS`` rows each, however large a class is. ``within``
    are further columns that both sides share, such as both ends; their nulls
    match nothing. ``digits`` rounds scores. No features give no pairs.
    """
    within = within or []
    classes = stored(cell_classes(features, within), "cell-classes")
    alike = classes.where((F.col("n") >= min_shared) & (F.col("m") > 1) & F.lit(threshold <= 1))
    alike = alike.select(*within, *[F.col(c).alias(a) for c, a in (("rep", "l"), ("rep", "r"), ("m", "ml"), ("m", "mr"), ("n", "shared"))], F.lit(1.0).alias("score"))
    pairs = stored(class_pairs(classes, threshold, min_shared, within).unionAll(alike), "class-pairs")
    total = pairs.agg(F.sum(F.col("ml").cast("double") * F.col("mr"))).first()[0] or 0
    most = hot_from(features.count())
    members = join_each(features.select(*within, "CELL_SET", UID), classes.select(*within, "CELL_SET", "rep", "m", F.col("m").alias("rows")), [*within, "CELL_SET"], F.col(UID), most, "rows")

    def blocks(m: str) -> Column:
        return F.ceil(F.col(m) / BLOCK).cast("long")

    held = stored(members.groupBy(*within, "rep", F.pmod(F.xxhash64(UID), blocks("m")).alias("b")).agg(F.collect_list(UID).alias("u")), "blocks")
    for side in "lr":
        pairs = pairs.withColumn(f"b{side}", F.explode(F.sequence(F.lit(0).cast("long"), blocks(f"m{side}") - 1)))
    dealt = pairs.where("l <> r or bl <= br").drop("ml", "mr")
    if digits is not None:
        dealt = dealt.withColumn("score", F.round("score", digits))
    dealt = stored(dealt, "block-pairs")
    most = hot_from(dealt.count())
    for side, across in (("l", "r"), ("r", "l")):
        keys = [*within, side, f"b{side}"]
        own = held.withColumnsRenamed({"rep": side, "b": f"b{side}", "u": f"u{side}"})
        if most is not None:
            own = own.join(dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")), keys)
        pairs = join_each(dealt if side == "l" else pairs, own, keys, F.xxhash64(across, f"b{across}"), most, "rows")
    # few rows become many: so many tasks, which adaptive execution does not join
    pairs = pairs.repartition(int(total // TASK_PAIRS) + 1, *within, "l", "r", "bl", "br")
    pairs = pairs.withColumn("ul", F.explode("ul")).withColumn("ur", F.explode("ur"))
    once = (F.col("ul") < F.col("ur")) | ((F.col("ul") > F.col("ur")) & ((F.col("l") != F.col("r")) | (F.col("bl") != F.col("br"))))
    return pairs.where(once).select(*within, F.least("ul", "ur").alias("l"), F.greatest("ul", "ur").alias("r"), "shared", "score")


def _node(within: list[str], uid: Column) -> Column:
    return F.struct(*[F.col(c).cast("string").alias(c) for c in within], uid.alias("uid"))


def similar_components(features: DataFrame, threshold: float, min_shared: int, within: list[str] | None = None, bucket: list[str] | None = None) -> DataFrame:
    """``features`` with ``first_``: the first trajectory of those that similar pairs connect, within ``within``.

    Only trajectories of one ``bucket`` are compared. One components run over
    classes of one cell set serves all values of ``within``.
    """
    within, bucket = within or [], bucket or []
    keys = [*within, *bucket]
    classes = stored(cell_classes(features, keys), "cell-classes")
    pairs = class_pairs(classes, threshold, min_shared, keys)
    found = connected_components(pairs.select(_node(within, F.col("l")).alias("src"), _node(within, F.col("r")).alias("dst")))
    own = classes.withColumn("node", _node(within, F.col("rep"))).join(found, "node", "left")
    # sets too small to be similar to any stay alone
    own = own.select(*keys, "CELL_SET", F.when(F.col("n") >= min_shared, F.coalesce(F.col("component")["uid"], F.col("rep"))).alias("first_"), F.col("m").alias("rows"))
    rows = join_each(features, own, [*keys, "CELL_SET"], F.col(UID), hot_from(features.count()), "rows")
    return rows.select(*features.columns, F.coalesce("first_", UID).alias("first_"))


def number_clusters(rows: DataFrame, within: list[str] | None = None, name: str = "CLUSTER_ID") -> DataFrame:
    """``rows`` with a 0-based cluster number in place of ``first_``, by its order within ``within``."""
    within = within or []
    firsts = numbered(rows.groupBy(*within, "first_").agg(F.count(F.lit(1)).alias("rows_")), [F.col(c) for c in (*within, "first_")], "place_")
    if within:  # a group's numbers start at its first place
        firsts = firsts.join(firsts.groupBy(*within).agg(F.min("place_").alias("start_")), within).withColumn("place_", F.col("place_") - F.col("start_")).drop("start_")
    firsts = firsts.select(*within, "first_", F.col("place_").alias(name), "rows_")
    return join_each(rows, firsts, [*within, "first_"], F.col(UID), hot_from(rows.count()), "rows_").select(*[c for c in rows.columns if c != "first_"], name)


def cluster_trajectories(features: DataFrame, threshold: float = 0.42, min_shared: int = 5, same_ends: bool = False) -> DataFrame:
    """Features with CLUSTER_ID: connected components of similar pairs; alone, a trajectory is its own cluster."""
    bucket = ["START_CELL", "END_CELL"] if same_ends else []
    return number_clusters(stored(similar_components(features, threshold, min_shared, bucket=bucket), "components"))


def cluster_summary(clusters: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row a cluster; null keys are left out, and the ends are those of its first trajectory."""
    keys = [*(keys or []), "CLUSTER_ID"]
    rows = clusters.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys)
    return rows.agg(F.count_distinct(UID).alias("N_TRAJECTORIES"), F.count_distinct(USER).alias("N_USERS"), F.avg("N_POINTS").alias("AVG_POINTS"), F.avg("N_CELLS").alias("AVG_CELLS"), F.min_by("START_CELL", UID).alias("START_CELL"), F.min_by("END_CELL", UID).alias("END_CELL"))


def with_summary(clusters: DataFrame, summary: DataFrame) -> DataFrame:
    """Each trajectory's cluster and what the summary says of it."""
    each = summary.withColumn("rows_", F.col("N_TRAJECTORIES"))
    return join_each(clusters.select(UID, "CLUSTER_ID"), each, ["CLUSTER_ID"], F.col(UID), hot_from(clusters.count()), "rows_")


def medoids(clusters: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The trajectory of each cluster with the largest sum of similarities to all members, and a little for its cells; of equals the first.

    Members of one cell set have one sum, so sets are compared, and counted as often as they occur.
    """
    keys = [*(keys or []), "CLUSTER_ID"]
    classes = cell_classes(clusters, keys)
    cells = classes.select(*keys, "rep", "m", "n", F.explode("CELL_SET").alias("cell"))
    a = cells.select(*keys, "cell", F.col("rep").alias("l"), F.col("n").alias("nl"))
    b = cells.select(*keys, "cell", F.col("rep").alias("r"), F.col("n").alias("nr"), F.col("m").alias("mr"))
    shared = a.join(b, [*keys, "cell"]).groupBy(*keys, "l", "r", "nl", "nr", "mr").agg(F.count(F.lit(1)).alias("s"))
    total = shared.groupBy(*keys, "l", "nl").agg(F.sum(F.col("mr") * F.col("s") / (F.col("nl") + F.col("nr") - F.col("s"))).alias("t"))
    score = F.round(F.col("t") + 0.001 * F.col("nl"), 9)
    order = Window.partitionBy(*keys).orderBy(F.desc("SCORE"), "l")
    ranked = total.withColumn("SCORE", score).withColumn("k", F.row_number().over(order)).where("k = 1")
    return ranked.select(*keys, F.col("l").alias(UID), "SCORE")


def threshold_sweep(features: DataFrame, thresholds: list[float], min_shared: int = 5, collective: tuple[int, int] = (2, 3)) -> DataFrame:
    """One row a threshold: pairs kept, clusters, singletons, collective clusters and coverage, from one pair table.

    Classes of one cell set are compared once, at the lowest threshold. Of their
    pairs only those that connect something at some threshold, about one a
    class, go into the components run, once for every threshold.
    """
    spark = features.sparkSession
    steps = F.broadcast(spark.createDataFrame([(float(t),) for t in thresholds], "threshold double"))
    classes = stored(cell_classes(features), "cell-classes")
    pairs = stored(class_pairs(classes, min(thresholds), min_shared), "class-pairs")
    alike = classes.where(F.col("n") >= min_shared).select(F.lit(1.0).alias("score"), (F.col("m") * (F.col("m") - 1) / 2).cast("long").alias("w"))
    weights = pairs.select("score", (F.col("ml") * F.col("mr")).alias("w")).unionAll(alike).groupBy("score").agg(F.sum("w").alias("w"))
    edges = steps.join(weights, F.col("score") >= F.col("threshold")).groupBy("threshold").agg(F.sum("w").alias("candidate_edges"))
    kept = stored(spanning_edges(pairs, "l", "r", "score"), "spanning-pairs").join(steps, F.col("score") >= F.col("threshold"))
    found = connected_components(kept.select(_node(["threshold"], F.col("l")).alias("src"), _node(["threshold"], F.col("r")).alias("dst")))
    of = classes.select("CELL_SET", F.when(F.col("n") >= min_shared, F.col("rep")).alias("rep"), F.col("m").alias("rows"))
    members = join_each(features.select("CELL_SET", UID, USER), of, ["CELL_SET"], F.col(UID), hot_from(features.count()), "rows")
    members = members.groupBy(F.coalesce("rep", UID).alias("uid"), USER).agg(F.count(F.lit(1)).alias("k"))
    placed = members.crossJoin(steps).withColumn("node", _node(["threshold"], F.col("uid"))).join(found, "node", "left")
    groups = placed.groupBy("threshold", F.coalesce(F.col("component")["uid"], F.col("uid")).alias("first")).agg(F.sum("k").alias("n"), F.count_distinct(USER).alias("u"))
    wide = (F.col("u") >= collective[0]) & (F.col("n") >= collective[1])
    size = F.struct((-F.col("n")).alias("n"), "first")  # the first of the largest
    pick = F.struct("n", "u")
    counts = [F.count(F.lit(1)).alias("clusters_total"), F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(wide).alias("collective_clusters")]
    inside = F.coalesce(F.sum(F.when(wide, F.col("n"))), F.lit(0)).alias("trajectories_in_collective")
    tops = [F.min_by(pick, size).alias("a"), F.min_by(F.when(wide, pick), F.when(wide, size)).alias("b")]
    found = groups.groupBy("threshold").agg(*counts, inside, F.sum("n").alias("n"), *tops, F.round(F.avg(F.when(wide, F.col("u"))), 2).alias("avg_collective_users"))
    found = found.join(edges, "threshold", "left").na.fill(0, ["candidate_edges"]).na.fill(0.0, ["avg_collective_users"])
    share = F.round(100 * F.col("trajectories_in_collective") / F.col("n"), 2).alias("collective_coverage_pct")
    zero = F.lit(0).cast("long")
    tops = [F.col("a.n").alias("largest_cluster_trajectories"), F.col("a.u").alias("largest_cluster_users"), F.coalesce("b.n", zero).alias("largest_collective_trajectories"), F.coalesce("b.u", zero).alias("largest_collective_users")]
    return found.select("threshold", "candidate_edges", "clusters_total", "singletons", "collective_clusters", "trajectories_in_collective", share, *tops, "avg_collective_users")
