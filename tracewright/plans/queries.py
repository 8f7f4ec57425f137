"""One query an operator over the fixture views, each with the DuckDB SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, labels
from ..operators import corridors as co
from ..operators import features as fe
from ..operators import profiles as pr
from ..operators import selection as se
from ..operators import sequence as sq
from ..operators import similarity as si
from ..operators import stats as st
from ..operators import trips as tr
from ..sources import csv as src
from . import fixtures as fx
from .storage import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

POINT, BY, AT, SEC = "USER_ID, SEQ", ["USER_ID"], "SEQ", "EPOCH_S"
TRIP, IDX = ["TRAJECTORY_UID"], "POINT_INDEX"
GPS, TRIPS, PEOPLE, MOVES, DIRTY = (fx.duck(t) for t in (fx.GPS, fx.TRIPS, fx.INDIVIDUALS, fx.DISPLACEMENTS, fx.DIRTY))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def hav(a: str, b: str, c: str, d: str) -> str:
    x = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"({2 * geo.EARTH_M!r}::DOUBLE * atan2(sqrt({x}), sqrt(1 - {x})))"


def cell(size: float, lat: str = "LATITUDE", lon: str = "LONGITUDE") -> str:
    return f"(floor({lat} * {geo.M_PER_DEGREE!r}::DOUBLE / {float(size)!r}::DOUBLE)::BIGINT || ':' || floor({lon} * {geo.M_PER_DEGREE_EAST!r}::DOUBLE / {float(size)!r}::DOUBLE)::BIGINT)"


def rounded(df: DataFrame, *names: str, places: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def r9(*names: str) -> str:
    return ", ".join(f"round({n}, 9) AS {n.split('.')[-1]}" for n in names)


# ---- points ----

@query(f"""SELECT USER_ID, SEQ, LATITUDE, LONGITUDE, (UTC_DATE || ' ' || UTC_TIME) AS at_text FROM {DIRTY}
WHERE LATITUDE BETWEEN 48.10::DOUBLE AND 49.25::DOUBLE AND LONGITUDE BETWEEN 1.40::DOUBLE AND 3.60::DOUBLE AND try_cast(UTC_DATE || ' ' || UTC_TIME AS TIMESTAMP) IS NOT NULL""")
def clean_points(spark, sf):
    rows = src.clean_points(fx.view(spark, sf, fx.DIRTY))
    return rows.select("USER_ID", "SEQ", "LATITUDE", "LONGITUDE", F.date_format("DATETIME", "yyyy-MM-dd HH:mm:ss").alias("at_text"))


@query(f"""SELECT USER_ID, SEQ, round({hav("LATITUDE", "LONGITUDE", "48.8566::DOUBLE", "2.3522::DOUBLE")}, 3) AS metres FROM {GPS}""")
def haversine(spark, sf):
    return fx.gps_points(spark, sf).select("USER_ID", "SEQ", F.round(geo.haversine(F.col("LATITUDE"), F.col("LONGITUDE"), F.lit(48.8566), F.lit(2.3522)), 3).alias("metres"))


@query(f"""SELECT USER_ID, SEQ, {cell(350)} AS c350, {cell(500)} AS c500 FROM {GPS}""")
def cell_id(spark, sf):
    a, b = F.col("LATITUDE"), F.col("LONGITUDE")
    return fx.gps_points(spark, sf).select("USER_ID", "SEQ", geo.cell_id(a, b, 350).alias("c350"), geo.cell_id(a, b, 500).alias("c500"))


@query(f"""SELECT DISTINCT c, round((split_part(c, ':', 1)::DOUBLE + 0.5) * 350 / {geo.M_PER_DEGREE!r}::DOUBLE, 9) AS lat, round((split_part(c, ':', 2)::DOUBLE + 0.5) * 350 / {geo.M_PER_DEGREE_EAST!r}::DOUBLE, 9) AS lon FROM (SELECT {cell(350)} AS c FROM {GPS})""")
def cell_center(spark, sf):
    cells = fx.gps_points(spark, sf).select(geo.cell_id(F.col("LATITUDE"), F.col("LONGITUDE"), 350).alias("c")).distinct()
    return rounded(cells.select("c", geo.cell_center(F.col("c"), 350).alias("x")).select("c", "x.lat", "x.lon"), "lat", "lon")


def snapped(lat: str, lon: str) -> tuple[str, str]:
    east = f"round_even({lon} * ({geo.M_PER_DEGREE!r}::DOUBLE * cos(radians(ref_lat))) / 30, 0)::BIGINT"
    return east, f"round_even({lat} * {geo.M_PER_DEGREE!r}::DOUBLE / 30, 0)::BIGINT"


@query(f"""WITH g AS (SELECT *, avg(LATITUDE) OVER () AS ref_lat FROM {GPS}) SELECT USER_ID, SEQ, {snapped("LATITUDE", "LONGITUDE")[0]} AS gx, {snapped("LATITUDE", "LONGITUDE")[1]} AS gy FROM g""")
def snap_grid(spark, sf):
    points = fx.gps_points(spark, sf)
    rows = points.crossJoin(F.broadcast(points.agg(F.avg("LATITUDE").alias("ref_lat"))))
    return rows.select("USER_ID", "SEQ", geo.snap_grid(F.col("LATITUDE"), F.col("LONGITUDE"), 30, F.col("ref_lat")).alias("n")).select("USER_ID", "SEQ", "n.*")


AGE_SQL = "CASE WHEN AGE IS NULL THEN 'Unknown' WHEN AGE < 18 THEN '<18' WHEN AGE < 25 THEN '18-24' WHEN AGE < 35 THEN '25-34' WHEN AGE < 45 THEN '35-44' WHEN AGE < 55 THEN '45-54' WHEN AGE < 65 THEN '55-64' ELSE '65+' END"
CAR_SQL = "CASE WHEN NB_CAR IS NULL THEN 'Unknown' WHEN NB_CAR <= 0 THEN '0 car' WHEN NB_CAR = 1 THEN '1 car' ELSE '2+ cars' END"


def yes_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'Unknown' WHEN lower(trim({c})) IN ('true', '1', 'yes') THEN 'Yes' ELSE 'No' END"


@query(f"SELECT ID, {AGE_SQL} AS AGE_GROUP FROM {PEOPLE}")
def age_group(spark, sf):
    return fx.individuals(spark, sf).select("ID", labels.age_group(F.col("AGE")).alias("AGE_GROUP"))


@query(f"SELECT ID, {CAR_SQL} AS NB_CAR_GROUP FROM {PEOPLE}")
def nb_car_group(spark, sf):
    return fx.individuals(spark, sf).select("ID", labels.nb_car_group(F.col("NB_CAR")).alias("NB_CAR_GROUP"))


@query(f"SELECT ID, {yes_sql('NAVIGO_SUB')} AS navigo, {yes_sql('DRIVING_LICENCE')} AS licence FROM {PEOPLE}")
def bool_label(spark, sf):
    return fx.individuals(spark, sf).select("ID", labels.bool_label(F.col("NAVIGO_SUB")).alias("navigo"), labels.bool_label(F.col("DRIVING_LICENCE")).alias("licence"))


STEPS = f"SELECT *, EPOCH_S - lag(EPOCH_S) OVER w AS delta_t, {hav('lag(LATITUDE) OVER w', 'lag(LONGITUDE) OVER w', 'LATITUDE', 'LONGITUDE')} AS dist_m FROM {GPS} WINDOW w AS (PARTITION BY USER_ID ORDER BY SEQ)"
TRIP_STEPS = STEPS.replace(GPS, TRIPS).replace("PARTITION BY USER_ID ORDER BY SEQ", "PARTITION BY TRAJECTORY_UID ORDER BY POINT_INDEX")
RUNS = f"SELECT *, sum(CASE WHEN dist_m <= 2 AND delta_t <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY USER_ID ORDER BY SEQ) AS run FROM ({STEPS})"
THIN = f"SELECT USER_ID, avg(LATITUDE) AS LATITUDE, avg(LONGITUDE) AS LONGITUDE, max(SEQ) AS SEQ, max(EPOCH_S) AS EPOCH_S FROM ({RUNS}) GROUP BY USER_ID, run"


@query(f"SELECT USER_ID, SEQ, delta_t, round(dist_m, 3) AS dist_m, round(dist_m / delta_t, 3) AS speed_mps FROM ({STEPS}) WHERE delta_t > 0")
def step_metrics(spark, sf):
    return rounded(sq.step_metrics(fx.gps_points(spark, sf), BY, AT, SEC).where("delta_t > 0").select("USER_ID", "SEQ", "delta_t", "dist_m", "speed_mps"), "dist_m", "speed_mps", places=3)


@query(f"SELECT USER_ID, SEQ, EPOCH_S, {r9('LATITUDE', 'LONGITUDE')} FROM ({THIN})")
def presample(spark, sf):
    return rounded(sq.presample(fx.gps_points(spark, sf), BY, AT, SEC).select("USER_ID", "SEQ", "EPOCH_S", "LATITUDE", "LONGITUDE"), "LATITUDE", "LONGITUDE")


# ---- staypoints and trips: the jump from anchor to anchor by recursion ----

STAYS = f"""thin AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY USER_ID ORDER BY SEQ) AS i, count(*) OVER (PARTITION BY USER_ID) AS n FROM ({THIN})),
ends AS MATERIALIZED (
  SELECT a.USER_ID, a.i, min(CASE WHEN {hav("a.LATITUDE", "a.LONGITUDE", "b.LATITUDE", "b.LONGITUDE")} > 50 THEN b.i END) AS far, min(CASE WHEN b.EPOCH_S - a.EPOCH_S >= 600 THEN b.i END) AS late
  FROM thin a JOIN thin b ON a.USER_ID = b.USER_ID AND b.i > a.i GROUP BY ALL),
nxt AS MATERIALIZED (SELECT t.USER_ID, t.i, t.n, CASE WHEN late IS NOT NULL AND (far IS NULL OR late < far) THEN late END AS j FROM thin t LEFT JOIN ends USING (USER_ID, i)),
walk AS (
  SELECT USER_ID, i, j, n FROM nxt WHERE i = 1
  UNION ALL SELECT x.USER_ID, x.i, x.j, x.n FROM walk w JOIN nxt x ON x.USER_ID = w.USER_ID AND x.i = coalesce(w.j, w.i) + 1),
stay AS MATERIALIZED (SELECT USER_ID, i, j, row_number() OVER (PARTITION BY USER_ID ORDER BY i) AS k FROM walk WHERE j IS NOT NULL),
tagged AS MATERIALIZED (
  SELECT t.*, s.k AS stay_no, CASE WHEN s.k IS NOT NULL AND t.i > s.i THEN NULL ELSE 1 + (SELECT count(*) FROM stay q WHERE q.USER_ID = t.USER_ID AND q.i < t.i) END AS trip_no
  FROM thin t LEFT JOIN stay s ON s.USER_ID = t.USER_ID AND t.i BETWEEN s.i AND s.j)"""


def segmented(spark, sf):
    return tr.segment_trips(sq.presample(fx.gps_points(spark, sf), BY, AT, SEC), "USER_ID", AT, SEC)


@query(f"""WITH RECURSIVE {STAYS} SELECT USER_ID, stay_no AS STAY_NO, round(avg(LATITUDE), 9) AS latitude, round(avg(LONGITUDE), 9) AS longitude, min(EPOCH_S) AS start_s, max(EPOCH_S) AS end_s, round((max(EPOCH_S) - min(EPOCH_S)) / 60, 9) AS duration_min
FROM tagged WHERE stay_no IS NOT NULL GROUP BY ALL""")
def staypoints(spark, sf):
    return rounded(tr.staypoints(segmented(spark, sf), "USER_ID", SEC), "latitude", "longitude", "duration_min")


@query(f"""WITH RECURSIVE {STAYS} SELECT USER_ID, trip_no AS TRIP_NO, count(*) AS n_points, min(SEQ) AS first_seq, max(SEQ) AS last_seq FROM tagged WHERE trip_no IS NOT NULL GROUP BY ALL HAVING count(*) >= 10""")
def trip_segments(spark, sf):
    rows = segmented(spark, sf).where("TRIP_NO is not null").groupBy("USER_ID", "TRIP_NO")
    return rows.agg(F.count(F.lit(1)).alias("n_points"), F.min("SEQ").alias("first_seq"), F.max("SEQ").alias("last_seq")).where("n_points >= 10")


PLACES = f"""{STAYS},
st AS MATERIALIZED (SELECT USER_ID, stay_no, avg(LATITUDE) AS lat, avg(LONGITUDE) AS lon FROM tagged WHERE stay_no IS NOT NULL GROUP BY ALL),
fold AS (
  SELECT USER_ID, 1::BIGINT AS k, [{{'lat': lat, 'lon': lon, 'n': 1::BIGINT}}] AS places FROM st WHERE stay_no = 1
  UNION ALL SELECT USER_ID, k + 1, CASE WHEN spot = 0 THEN list_append(places, {{'lat': lat, 'lon': lon, 'n': 1::BIGINT}})
    ELSE list_transform(places, lambda p, i: CASE WHEN i = spot THEN {{'lat': (p.lat * p.n + lat) / (p.n + 1), 'lon': (p.lon * p.n + lon) / (p.n + 1), 'n': p.n + 1}} ELSE p END) END
  FROM (SELECT f.*, s.lat, s.lon, coalesce(list_position(list_transform(f.places, lambda p: {hav("p.lat", "p.lon", "s.lat", "s.lon")} <= 100), true), 0) AS spot FROM fold f JOIN st s ON s.USER_ID = f.USER_ID AND s.stay_no = f.k + 1)),
places AS MATERIALIZED (SELECT USER_ID, unnest(list_transform(arg_max(places, k), lambda p, i: {{'place': i, 'p': p}})) AS x FROM fold GROUP BY USER_ID)"""


@query(f"WITH RECURSIVE {PLACES} SELECT USER_ID, x.place::BIGINT AS place, round(x.p.lat, 9) AS latitude, round(x.p.lon, 9) AS longitude, x.p.n AS count FROM places")
def merge_staypoints(spark, sf):
    return rounded(tr.merge_staypoints(tr.staypoints(segmented(spark, sf), "USER_ID", SEC), "USER_ID"), "latitude", "longitude")


REFINED = f"""{STAYS},
long AS (SELECT *, first(LATITUDE) OVER w AS a, first(LONGITUDE) OVER w AS b, last(LATITUDE) OVER w AS c, last(LONGITUDE) OVER w AS d FROM tagged WHERE trip_no IS NOT NULL
  WINDOW w AS (PARTITION BY USER_ID, trip_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) QUALIFY count(*) OVER (PARTITION BY USER_ID, trip_no) >= 10),
cut AS (SELECT * FROM long WHERE {hav("a", "b", "LATITUDE", "LONGITUDE")} > 100 AND {hav("c", "d", "LATITUDE", "LONGITUDE")} > 100 QUALIFY count(*) OVER (PARTITION BY USER_ID, trip_no) >= 10),
fine AS (SELECT *, dense_rank() OVER (PARTITION BY USER_ID ORDER BY trip_no) AS TRAJECTORY_ID, row_number() OVER (PARTITION BY USER_ID, trip_no ORDER BY i) - 1 AS POINT_INDEX FROM cut)"""


@query(f"WITH RECURSIVE {REFINED} SELECT USER_ID, SEQ, TRAJECTORY_ID, USER_ID || '_' || TRAJECTORY_ID AS TRAJECTORY_UID, POINT_INDEX, {r9('LATITUDE', 'LONGITUDE')} FROM fine")
def refine(spark, sf):
    rows = tr.refine(segmented(spark, sf), "USER_ID", AT)
    return rounded(rows.select("USER_ID", "SEQ", "TRAJECTORY_ID", "TRAJECTORY_UID", "POINT_INDEX", "LATITUDE", "LONGITUDE"), "LATITUDE", "LONGITUDE")


@query(f"""WITH RECURSIVE {REFINED}, {PLACES.removeprefix(STAYS + ",")},
s AS (SELECT USER_ID, count(DISTINCT stay_no) AS staypoints FROM tagged GROUP BY 1),
m AS (SELECT USER_ID, count(*) AS k FROM places GROUP BY 1),
tt AS (SELECT USER_ID, count(*) AS k FROM (SELECT USER_ID, trip_no FROM tagged WHERE trip_no IS NOT NULL GROUP BY ALL HAVING count(*) >= 10) GROUP BY 1),
f AS (SELECT USER_ID, count(DISTINCT TRAJECTORY_ID) AS k, count(*) AS p FROM fine GROUP BY 1),
h AS (SELECT USER_ID, count(*) AS k FROM thin GROUP BY 1)
SELECT g.USER_ID, g.USER_ID || '.csv' AS source_file, count(*) AS valid_points, max(h.k) AS points_after_presampling, count(*) - max(h.k) AS presampling_removed_points, coalesce(max(tt.k), 0) AS trajectory_segments,
  coalesce(max(f.k), 0) AS trajectories_kept, coalesce(max(s.staypoints), 0) AS staypoints, coalesce(max(m.k), 0) AS merged_staypoints, coalesce(max(f.p), 0) AS refined_points, '' AS error
FROM {GPS} g LEFT JOIN h USING (USER_ID) LEFT JOIN s USING (USER_ID) LEFT JOIN m USING (USER_ID) LEFT JOIN tt USING (USER_ID) LEFT JOIN f USING (USER_ID) GROUP BY g.USER_ID""")
def file_stats(spark, sf):
    points = fx.gps_points(spark, sf)
    thin = sq.presample(points, BY, AT, SEC)
    seg = stored(tr.segment_trips(thin, "USER_ID", AT, SEC), "segmented")
    places = tr.merge_staypoints(tr.staypoints(seg, "USER_ID", SEC), "USER_ID")
    return tr.file_stats(points, thin, seg, tr.refine(seg, "USER_ID", AT), places, "USER_ID")


ENDS = f"SELECT *, first(LATITUDE) OVER w AS a, first(LONGITUDE) OVER w AS b, last(LATITUDE) OVER w AS c, last(LONGITUDE) OVER w AS d, first(EPOCH_S) OVER w AS t0, last(EPOCH_S) OVER w AS t1 FROM {TRIPS} WINDOW w AS (PARTITION BY TRAJECTORY_UID ORDER BY POINT_INDEX ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
FROM_START, FROM_END = hav("a", "b", "LATITUDE", "LONGITUDE"), hav("c", "d", "LATITUDE", "LONGITUDE")


@query(f"SELECT TRAJECTORY_UID, POINT_INDEX, round({FROM_START}, 3) AS distance_from_start, round({FROM_END}, 3) AS distance_from_end FROM (SELECT *, count(*) OVER (PARTITION BY TRAJECTORY_UID) AS n FROM ({ENDS})) WHERE n < 2 OR ({FROM_START} > 100 AND {FROM_END} > 100)")
def trim_zones(spark, sf):
    rows = sq.trim_zones(fx.trips(spark, sf), TRIP, IDX, 100.0)
    return rounded(rows.select("TRAJECTORY_UID", "POINT_INDEX", "distance_from_start", "distance_from_end"), "distance_from_start", "distance_from_end", places=3)


@query(f"SELECT TRAJECTORY_UID, POINT_INDEX FROM {TRIPS} WHERE POINT_INDEX % 5 = 0")
def sample_every_k(spark, sf):
    return sq.every_kth(fx.trips(spark, sf), TRIP, IDX, 5).select("TRAJECTORY_UID", "POINT_INDEX")


@query(f"SELECT USER_ID, SEQ FROM (SELECT *, count(*) OVER (PARTITION BY USER_ID) AS n FROM {GPS}) WHERE SEQ % greatest(1, n // 20) = 0")
def adaptive_sample(spark, sf):
    return sq.adaptive_sample(fx.gps_points(spark, sf), BY, AT, 20).select("USER_ID", "SEQ")


@query(f"SELECT * FROM (SELECT USER_ID, SEQ, sum(CASE WHEN delta_t > 200 OR dist_m > 130 OR delta_t IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY USER_ID ORDER BY SEQ)::BIGINT AS piece FROM ({STEPS})) QUALIFY count(*) OVER (PARTITION BY USER_ID, piece) >= 2")
def gap_split(spark, sf):
    return sq.gap_split(fx.gps_points(spark, sf), BY, AT, SEC, 200, 130).select("USER_ID", "SEQ", "piece")


BOX = (48.85, 48.88, 2.30, 2.33)
INSIDE = "LATITUDE BETWEEN 48.85::DOUBLE AND 48.88::DOUBLE AND LONGITUDE BETWEEN 2.30::DOUBLE AND 2.33::DOUBLE"


@query(f"SELECT USER_ID, SEQ, piece FROM (SELECT *, sum(CASE WHEN {INSIDE} THEN 0 ELSE 1 END) OVER (PARTITION BY USER_ID ORDER BY SEQ)::BIGINT AS piece FROM {GPS}) WHERE {INSIDE} QUALIFY count(*) OVER (PARTITION BY USER_ID, piece) >= 2")
def region_split(spark, sf):
    return sq.region_split(fx.gps_points(spark, sf), BY, AT, BOX).select("USER_ID", "SEQ", "piece")


STOPS = f"SELECT USER_ID, run, (max(EPOCH_S) - min(EPOCH_S)) / 60 AS duration_min FROM (SELECT *, sum(CASE WHEN dist_m / delta_t < 1 THEN 0 ELSE 1 END) OVER (PARTITION BY USER_ID ORDER BY SEQ)::BIGINT AS run FROM ({STEPS}) WHERE delta_t > 0) WHERE dist_m / delta_t < 1 GROUP BY ALL HAVING max(EPOCH_S) > min(EPOCH_S)"


@query(f"SELECT USER_ID, run, round(duration_min, 9) AS duration_min FROM ({STOPS})")
def stop_runs(spark, sf):
    return rounded(sq.stop_runs(fx.gps_points(spark, sf), BY, AT, SEC), "duration_min")


#: Radii (m) and minutes of the trim study, steps of the sampling study, speeds (m/s) and length shares of the edge study.
RADII, MINUTES, STEP_SIZES = [50, 80, 120, 150, 200], [0, 1, 2, 3, 5], [1, 5, 10, 20, 50, 100]
SPEEDS, SHARES = [0.5, 1.0, 1.5, 2.0], [0.02, 0.05, 0.1]
EARLY, LATE = "(m > 0 AND EPOCH_S <= t0 + m * 60)", "(m > 0 AND EPOCH_S >= t1 - m * 60)"


@query(f"SELECT TRAJECTORY_UID, POINT_INDEX, ({FROM_START} <= 300 OR {EARLY}) AS in_start, ({FROM_END} <= 300 OR {LATE}) AS in_end FROM ({ENDS}) CROSS JOIN (SELECT 4 AS m)")
def local_zone_trim(spark, sf):
    return sq.local_zone_trim(fx.trips(spark, sf), TRIP, IDX, SEC, 300.0, 4).select("TRAJECTORY_UID", "POINT_INDEX", "in_start", "in_end")


@query(f"""SELECT r AS radius_m, m AS minutes, count(*) AS before, count(*) FILTER (WHERE x) AS removed, count(*) - count(*) FILTER (WHERE x) AS kept, round(100 * count(*) FILTER (WHERE x) / count(*), 4) AS pct
FROM (SELECT r, m, ({FROM_START} <= r OR {EARLY} OR {FROM_END} <= r OR {LATE}) AS x FROM ({ENDS}) CROSS JOIN (SELECT unnest({RADII}) AS r) CROSS JOIN (SELECT unnest({MINUTES}) AS m)) GROUP BY ALL""")
def trim_compare(spark, sf):
    grid = F.array(*[F.struct(F.lit(r).alias("radius_m"), F.lit(m).alias("minutes")) for r in RADII for m in MINUTES])
    points = fx.trips(spark, sf).withColumn("params", F.explode(grid)).select("*", "params.*")
    rows = sq.local_zone_trim(points, [*TRIP, "radius_m", "minutes"], IDX, SEC, F.col("radius_m"), F.col("minutes"))
    found = rows.groupBy("radius_m", "minutes").agg(F.count(F.lit(1)).alias("before"), F.count_if("removed").alias("removed"))
    return found.withColumn("kept", F.col("before") - F.col("removed")).withColumn("pct", F.round(100 * F.col("removed") / F.col("before"), 4))


@query(f"SELECT step, count(*) AS before, count(*) FILTER (WHERE SEQ % step = 0) AS after, count(*) FILTER (WHERE SEQ % step <> 0) AS removed, round(100 * count(*) FILTER (WHERE SEQ % step = 0) / count(*), 4) AS kept_pct FROM {GPS} CROSS JOIN (SELECT unnest({STEP_SIZES}) AS step) GROUP BY step")
def sampling_compare(spark, sf):
    steps = F.array(*[F.lit(k) for k in STEP_SIZES])
    rows = fx.gps_points(spark, sf).withColumn("row", F.row_number().over(sq.ordered(BY, AT)) - 1).withColumn("step", F.explode(steps))
    found = rows.groupBy("step").agg(F.count(F.lit(1)).alias("before"), F.count_if(F.col("row") % F.col("step") == 0).alias("after"))
    return found.withColumn("removed", F.col("before") - F.col("after")).withColumn("kept_pct", F.round(100 * F.col("after") / F.col("before"), 4))


def edge_sql(speeds: str, factors: str) -> str:
    w = "(PARTITION BY TRAJECTORY_UID, s, f ORDER BY POINT_INDEX"
    return f"""base AS (SELECT *, dist_m / CASE WHEN delta_t > 0 THEN delta_t END AS speed FROM ({TRIP_STEPS})),
p AS (SELECT *, sum(dist_m) OVER {w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS total, first(LATITUDE) OVER {w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a, first(LONGITUDE) OVER {w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS b,
  last(LATITUDE) OVER {w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS c, last(LONGITUDE) OVER {w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS d
  FROM base CROSS JOIN (SELECT unnest({speeds}) AS s) CROSS JOIN (SELECT unnest({factors}) AS f)),
q AS (SELECT *, least(300, greatest(50, total * f)) AS radius FROM p),
z AS (SELECT *, CASE WHEN {FROM_START} <= radius AND speed <= s THEN 1 ELSE 0 END AS x, CASE WHEN {FROM_END} <= radius AND speed <= s THEN 1 ELSE 0 END AS y FROM q),
v AS (SELECT *, min(x) OVER {w}) AS head, min(y) OVER {w} DESC) AS tail FROM z),
u AS (SELECT *, greatest(1, sum(head) OVER (PARTITION BY TRAJECTORY_UID, s, f)) AS h, greatest(1, sum(tail) OVER (PARTITION BY TRAJECTORY_UID, s, f)) AS t, row_number() OVER {w}) AS i, count(*) OVER (PARTITION BY TRAJECTORY_UID, s, f) AS n FROM v),
trim AS (SELECT TRAJECTORY_UID, s, f, max(radius) AS radius_m, max(total) AS total_m, max(n) AS n, max(h)::BIGINT AS h, max(t)::BIGINT AS t, coalesce(sum(dist_m) FILTER (WHERE i <= h), 0) + coalesce(sum(dist_m) FILTER (WHERE i > n - t), 0) AS gone FROM u GROUP BY ALL)"""


def trimmed_edges(spark, sf, speeds, factors):
    grid = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(f).alias("f")) for s in speeds for f in factors])
    points = sq.step_metrics(fx.trips(spark, sf), TRIP, IDX, SEC).withColumn("params", F.explode(grid)).select("*", "params.*")
    return sq.edge_trim(points, [*TRIP, "s", "f"], IDX, SEC, F.col("s"), F.col("f"))


@query(f"WITH {edge_sql('[1.2::DOUBLE]', '[0.05::DOUBLE]')} SELECT TRAJECTORY_UID, round(radius_m, 3) AS radius_m, n AS total_points, h AS start_removed_points, t AS end_removed_points, greatest(0, n - h - t) AS kept_points, round(gone, 3) AS total_removed_distance_m FROM trim WHERE total_m IS NOT NULL")
def edge_trim(spark, sf):
    rows = trimmed_edges(spark, sf, [1.2], [0.05]).where("total_distance_m is not null")
    return rounded(rows.select("TRAJECTORY_UID", "radius_m", "total_points", "start_removed_points", "end_removed_points", "kept_points", "total_removed_distance_m"), "radius_m", "total_removed_distance_m", places=3)


def doubles(values: list[float]) -> str:
    return "[" + ", ".join(f"{v!r}::DOUBLE" for v in values) + "]"


@query(f"WITH {edge_sql(doubles(SPEEDS), doubles(SHARES))} SELECT s AS speed, f AS factor, round(avg((h + t) / n), 4) AS removed_ratio, round(avg(CASE WHEN total_m > 0 THEN gone / total_m ELSE 0 END), 4) AS removed_distance_ratio, round(avg(gone), 4) AS total_removed_distance_m, round(avg(radius_m), 4) AS radius_m FROM trim WHERE total_m IS NOT NULL GROUP BY ALL")
def trim_grid_means(spark, sf):
    rows = trimmed_edges(spark, sf, SPEEDS, SHARES).where("total_distance_m is not null").groupBy(F.col("s").alias("speed"), F.col("f").alias("factor"))
    return rows.agg(*[F.round(F.avg(c), 4).alias(c) for c in ("removed_ratio", "removed_distance_ratio", "total_removed_distance_m", "radius_m")])


@query(f"SELECT USER_ID, SEQ FROM (SELECT *, count(*) OVER (PARTITION BY USER_ID) AS n FROM {GPS}) WHERE SEQ % ceil(n / 30)::BIGINT = 0")
def thin_long(spark, sf):
    return sq.thin_long(fx.gps_points(spark, sf), BY, AT, 30).select("USER_ID", "SEQ")


@query(f"SELECT TRAJECTORY_UID, POINT_INDEX FROM (SELECT *, count(*) OVER (PARTITION BY TRAJECTORY_UID) AS n FROM {TRIPS}) WHERE n >= 2 AND (n <= 25 OR POINT_INDEX % 25 = 0)")
def render_points(spark, sf):
    return se.render_points(fx.trips(spark, sf), TRIP, IDX, 25).select("TRAJECTORY_UID", "POINT_INDEX")


# ---- features, segments, similarity ----

CELLS = f"SELECT TRAJECTORY_UID, USER_ID, POINT_INDEX, LATITUDE, LONGITUDE, {{c}} AS c, lag({{c}}) OVER w AS p, lag(LATITUDE) OVER w AS plat, lag(LONGITUDE) OVER w AS plon FROM {TRIPS} WINDOW w AS (PARTITION BY TRAJECTORY_UID ORDER BY POINT_INDEX)"


def features_sql(size: float, least: int) -> str:
    return f"""SELECT TRAJECTORY_UID, USER_ID, count(*) AS N_POINTS, count(DISTINCT c) AS N_CELLS, arg_min(c, POINT_INDEX) AS START_CELL, arg_max(c, POINT_INDEX) AS END_CELL,
  string_agg(c, ' ' ORDER BY POINT_INDEX) FILTER (WHERE p IS NULL OR p <> c) AS CELL_SEQUENCE, list_sort(list_distinct(list(c))) AS CELL_SET FROM ({CELLS.format(c=cell(size))}) GROUP BY TRAJECTORY_UID, USER_ID HAVING count(DISTINCT c) >= {least}"""


FEATURES, COARSE = features_sql(350, 4), features_sql(500, 2)


def features(spark, sf, size=350, least=4):
    return fe.trajectory_features(fx.trips(spark, sf), size, least)


@query(f"SELECT TRAJECTORY_UID, USER_ID, N_POINTS, N_CELLS, START_CELL, END_CELL, CELL_SEQUENCE, list_aggregate(CELL_SET, 'string_agg', ' ') AS CELL_SET FROM ({FEATURES})")
def trajectory_features(spark, sf):
    rows = features(spark, sf)
    return rows.withColumn("CELL_SEQUENCE", F.array_join("CELL_SEQUENCE", " ")).withColumn("CELL_SET", F.array_join("CELL_SET", " ")).select("TRAJECTORY_UID", "USER_ID", "N_POINTS", "N_CELLS", "START_CELL", "END_CELL", "CELL_SEQUENCE", "CELL_SET")


def changes_sql(size: float) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY TRAJECTORY_UID, p, c ORDER BY POINT_INDEX) AS k FROM ({CELLS.format(c=cell(size))}) WHERE p <> c) WHERE k = 1"


SHARED = f"SELECT p || '->' || c AS SEGMENT_ID, p AS FROM_CELL, c AS TO_CELL, avg(plat) AS FROM_LAT, avg(plon) AS FROM_LON, avg(LATITUDE) AS TO_LAT, avg(LONGITUDE) AS TO_LON, count(DISTINCT USER_ID) AS N_USERS, count(DISTINCT TRAJECTORY_UID) AS N_TRAJECTORIES, string_agg(DISTINCT USER_ID, ' ' ORDER BY USER_ID) AS USERS FROM ({changes_sql(100)}) GROUP BY p, c"
MEANS = ("FROM_LAT", "FROM_LON", "TO_LAT", "TO_LON")


@query(f"SELECT SEGMENT_ID, FROM_CELL, TO_CELL, {r9(*MEANS)}, N_USERS, N_TRAJECTORIES, USERS FROM ({SHARED})")
def shared_segments(spark, sf):
    return rounded(fe.shared_segments(fx.trips(spark, sf)), *MEANS)


@query(f"SELECT SEGMENT_ID, N_USERS, N_TRAJECTORIES FROM ({SHARED}) WHERE N_USERS >= 2 AND N_TRAJECTORIES >= 3")
def segment_filter(spark, sf):
    return fe.shared_segments(fx.trips(spark, sf)).where("N_USERS >= 2 and N_TRAJECTORIES >= 3").select("SEGMENT_ID", "N_USERS", "N_TRAJECTORIES")


@query(f"SELECT SEGMENT_ID, N_USERS, N_TRAJECTORIES FROM ({SHARED}) ORDER BY N_USERS DESC, N_TRAJECTORIES DESC, SEGMENT_ID LIMIT 700")
def top_segments(spark, sf):
    return fe.shared_segments(fx.trips(spark, sf)).orderBy(F.desc("N_USERS"), F.desc("N_TRAJECTORIES"), "SEGMENT_ID").limit(700).select("SEGMENT_ID", "N_USERS", "N_TRAJECTORIES")


@query(f"SELECT SEGMENT_ID, CASE WHEN m <= 1 THEN '#22d3ee' WHEN N_USERS / m >= 0.75 THEN '#ef4444' WHEN N_USERS / m >= 0.5 THEN '#f97316' WHEN N_USERS / m >= 0.3 THEN '#facc15' ELSE '#22d3ee' END AS color FROM (SELECT *, max(N_USERS) OVER () AS m FROM ({SHARED}))")
def weight_color(spark, sf):
    return with_largest(fe.shared_segments(fx.trips(spark, sf)), "N_USERS").select("SEGMENT_ID", labels.weight_color(F.col("N_USERS"), F.col("m")).alias("color"))


@query(f"SELECT SEGMENT_ID, round(2 + 8 * N_USERS / m, 6) AS weight, round(0.35 + 0.55 * N_USERS / m, 6) AS opacity FROM (SELECT *, max(N_USERS) OVER () AS m FROM ({SHARED}))")
def segment_style(spark, sf):
    share = F.col("N_USERS") / F.col("m")
    return with_largest(fe.shared_segments(fx.trips(spark, sf)), "N_USERS").select("SEGMENT_ID", F.round(2 + 8 * share, 6).alias("weight"), F.round(0.35 + 0.55 * share, 6).alias("opacity"))


def with_largest(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the column's largest value as ``m``: one row is sent to all, none moves."""
    return rows.crossJoin(F.broadcast(rows.agg(F.max(column).alias("m"))))


def pairs_sql(features_sql: str, least: float, shared: int, ends: bool = False) -> str:
    same = "AND a.START_CELL = b.START_CELL AND a.END_CELL = b.END_CELL" if ends else ""
    return f"""SELECT l, r, shared, shared / (nl + nr - shared) AS score FROM (
  SELECT a.TRAJECTORY_UID AS l, b.TRAJECTORY_UID AS r, len(list_intersect(a.CELL_SET, b.CELL_SET)) AS shared, a.N_CELLS AS nl, b.N_CELLS AS nr
  FROM ({features_sql}) a JOIN ({features_sql}) b ON a.TRAJECTORY_UID < b.TRAJECTORY_UID {same}) WHERE shared >= {shared} AND shared / (nl + nr - shared) >= {least}"""


def closure_sql(nodes: str, pairs: str) -> str:
    """CTEs e, c: components by recursion; c has uid and first (the least uid reached)."""
    return f"""nodes AS MATERIALIZED ({nodes}), e AS MATERIALIZED (SELECT l AS x, r AS y FROM ({pairs}) UNION SELECT r, l FROM ({pairs})),
reach AS (SELECT TRAJECTORY_UID AS x, TRAJECTORY_UID AS y FROM nodes UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
c AS MATERIALIZED (SELECT x AS uid, min(y) AS first FROM reach GROUP BY x),
clusters AS MATERIALIZED (SELECT n.*, dense_rank() OVER (ORDER BY c.first) - 1 AS CLUSTER_ID FROM nodes n JOIN c ON c.uid = n.TRAJECTORY_UID)"""


CLUSTERS = closure_sql(FEATURES, pairs_sql(FEATURES, 0.42, 5))
SUMMARY = "summary AS (SELECT CLUSTER_ID, count(DISTINCT TRAJECTORY_UID) AS N_TRAJECTORIES, count(DISTINCT USER_ID) AS N_USERS, avg(N_POINTS) AS AVG_POINTS, avg(N_CELLS) AS AVG_CELLS, arg_min(START_CELL, TRAJECTORY_UID) AS START_CELL, arg_min(END_CELL, TRAJECTORY_UID) AS END_CELL FROM clusters GROUP BY CLUSTER_ID)"


@query(f"SELECT l, r, shared, round(score, 9) AS score FROM ({pairs_sql(FEATURES, 0.42, 5)})")
def jaccard_pairs(spark, sf):
    return si.jaccard_pairs(stored(features(spark, sf), "features"), 0.42, 5, digits=9)


@query(f"SELECT l, r, shared, round(score, 9) AS score FROM ({pairs_sql(COARSE, 0.45, 3, True)})")
def jaccard_pairs_same_ends(spark, sf):
    return si.jaccard_pairs(stored(features(spark, sf, 500, 2), "features"), 0.45, 3, ["START_CELL", "END_CELL"], digits=9).select("l", "r", "shared", "score")


def clustered(spark, sf):
    return stored(si.cluster_trajectories(stored(features(spark, sf), "features")), "clusters")


@query(f"WITH RECURSIVE {CLUSTERS} SELECT TRAJECTORY_UID, USER_ID, CLUSTER_ID FROM clusters")
def clusters(spark, sf):
    return clustered(spark, sf).select("TRAJECTORY_UID", "USER_ID", "CLUSTER_ID")


@query(f"WITH RECURSIVE {CLUSTERS}, {SUMMARY} SELECT CLUSTER_ID, N_TRAJECTORIES, N_USERS, {r9('AVG_POINTS', 'AVG_CELLS')}, START_CELL, END_CELL FROM summary")
def cluster_summary(spark, sf):
    return rounded(si.cluster_summary(clustered(spark, sf)), "AVG_POINTS", "AVG_CELLS")


@query(f"WITH RECURSIVE {CLUSTERS}, {SUMMARY} SELECT CLUSTER_ID, N_TRAJECTORIES, N_USERS FROM summary WHERE N_TRAJECTORIES >= 3 AND N_USERS >= 2 ORDER BY N_USERS DESC, N_TRAJECTORIES DESC, AVG_CELLS DESC, CLUSTER_ID LIMIT 20")
def top_clusters(spark, sf):
    return se.top_clusters(si.cluster_summary(clustered(spark, sf))).select("CLUSTER_ID", "N_TRAJECTORIES", "N_USERS")


@query(f"WITH RECURSIVE {CLUSTERS}, {SUMMARY} SELECT CLUSTER_ID, N_TRAJECTORIES, N_USERS FROM summary WHERE N_TRAJECTORIES >= 3 AND N_USERS >= 2 ORDER BY N_USERS DESC, N_TRAJECTORIES DESC, AVG_CELLS DESC, CLUSTER_ID LIMIT 10")
def focused_top_clusters(spark, sf):
    rows = si.cluster_summary(clustered(spark, sf)).where("N_USERS >= 2 and N_TRAJECTORIES >= 3")
    return rows.orderBy(F.desc("N_USERS"), F.desc("N_TRAJECTORIES"), F.desc("AVG_CELLS"), "CLUSTER_ID").limit(10).select("CLUSTER_ID", "N_TRAJECTORIES", "N_USERS")


@query(f"""WITH RECURSIVE {CLUSTERS} SELECT CLUSTER_ID, TRAJECTORY_UID, PICK FROM (
SELECT *, row_number() OVER (PARTITION BY CLUSTER_ID ORDER BY CASE WHEN mine > 2 THEN 1 ELSE 0 END, USER_ID, N_CELLS, N_POINTS, TRAJECTORY_UID) AS PICK FROM (
SELECT *, row_number() OVER (PARTITION BY CLUSTER_ID, USER_ID ORDER BY N_CELLS, N_POINTS, TRAJECTORY_UID) AS mine FROM clusters)) WHERE PICK <= 30""")
def balanced_pick(spark, sf):
    return se.balanced_pick(clustered(spark, sf)).select("CLUSTER_ID", "TRAJECTORY_UID", "PICK")


@query(f"""WITH RECURSIVE {CLUSTERS}, m AS (
SELECT a.CLUSTER_ID, a.TRAJECTORY_UID, round(sum(len(list_intersect(a.CELL_SET, b.CELL_SET)) / len(list_distinct(list_concat(a.CELL_SET, b.CELL_SET)))) + 0.001 * max(a.N_CELLS), 9) AS SCORE
FROM clusters a JOIN clusters b ON a.CLUSTER_ID = b.CLUSTER_ID GROUP BY ALL)
SELECT CLUSTER_ID, TRAJECTORY_UID, round(SCORE, 9) AS SCORE FROM m QUALIFY row_number() OVER (PARTITION BY CLUSTER_ID ORDER BY SCORE DESC, TRAJECTORY_UID) = 1""")
def medoid(spark, sf):
    return rounded(si.medoids(clustered(spark, sf)), "SCORE")


@query(f"""WITH RECURSIVE {CLUSTERS} SELECT p AS FROM_CELL, x.c AS TO_CELL, coalesce(k.CLUSTER_ID, -1)::BIGINT AS CLUSTER_ID, round(avg(plat), 9) AS FROM_LAT, round(avg(plon), 9) AS FROM_LON, round(avg(LATITUDE), 9) AS TO_LAT, round(avg(LONGITUDE), 9) AS TO_LON, count(DISTINCT x.USER_ID) AS N_USERS, count(DISTINCT x.TRAJECTORY_UID) AS N_TRAJECTORIES
FROM ({changes_sql(90)}) x LEFT JOIN clusters k USING (TRAJECTORY_UID) GROUP BY 1, 2, 3""")
def weighted_segments(spark, sf):
    return rounded(fe.weighted_segments(fx.trips(spark, sf), clustered(spark, sf)), *MEANS)


THRESHOLDS = [0.25, 0.30, 0.35, 0.38, 0.40, 0.42, 0.45, 0.48, 0.50, 0.55, 0.60]
_T = f"SELECT unnest({THRESHOLDS})::DOUBLE AS t"


@query(f"""WITH RECURSIVE f AS MATERIALIZED ({FEATURES}), p AS MATERIALIZED ({pairs_sql('SELECT * FROM f', 0.25, 5)}),
k AS MATERIALIZED (SELECT t, l, r FROM p JOIN ({_T}) ON score >= t), e AS MATERIALIZED (SELECT t, l AS x, r AS y FROM k UNION SELECT t, r, l FROM k),
reach AS (SELECT t, TRAJECTORY_UID AS x, TRAJECTORY_UID AS y FROM f CROSS JOIN ({_T}) UNION SELECT reach.t, reach.x, e.y FROM reach JOIN e ON reach.t = e.t AND reach.y = e.x),
c AS (SELECT t, x, min(y) AS first FROM reach GROUP BY t, x),
g AS (SELECT c.t, first, count(*) AS n, count(DISTINCT USER_ID) AS u FROM c JOIN f ON f.TRAJECTORY_UID = c.x GROUP BY ALL)
SELECT t AS threshold, (SELECT count(*) FROM k WHERE k.t = g.t) AS candidate_edges, count(*) AS clusters_total, count(*) FILTER (WHERE n = 1) AS singletons, count(*) FILTER (WHERE u >= 2 AND n >= 3) AS collective_clusters,
  coalesce(sum(n) FILTER (WHERE u >= 2 AND n >= 3), 0)::BIGINT AS trajectories_in_collective, round(100 * coalesce(sum(n) FILTER (WHERE u >= 2 AND n >= 3), 0) / sum(n), 2) AS collective_coverage_pct,
  max(n) AS largest_cluster_trajectories, arg_max(u, (n, -pos)) AS largest_cluster_users, coalesce(max(n) FILTER (WHERE u >= 2 AND n >= 3), 0) AS largest_collective_trajectories, coalesce(arg_max(u, (n, -pos)) FILTER (WHERE u >= 2 AND n >= 3), 0) AS largest_collective_users, coalesce(round(avg(u) FILTER (WHERE u >= 2 AND n >= 3), 2), 0) AS avg_collective_users
FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY first) AS pos FROM g) g GROUP BY t""")
def threshold_sweep(spark, sf):
    return si.threshold_sweep(stored(features(spark, sf), "features"), THRESHOLDS)


@query("SELECT t AS threshold, CASE WHEN t < 0.40 THEN 'trop large' WHEN t > 0.50 THEN 'trop strict' WHEN t = 0.42 THEN 'retenu' ELSE 'acceptable' END AS label FROM (" + _T + ")")
def threshold_label(spark, sf):
    steps = spark.createDataFrame([(t,) for t in THRESHOLDS], "threshold double")
    return steps.select("threshold", labels.threshold_label(F.col("threshold")).alias("label"))


# ---- corridors ----

EDGES = f"""g AS (SELECT *, (SELECT avg(LATITUDE) FROM {TRIPS}) AS ref_lat, lead(LATITUDE) OVER w AS lat2, lead(LONGITUDE) OVER w AS lon2 FROM {TRIPS} WINDOW w AS (PARTITION BY TRAJECTORY_UID ORDER BY POINT_INDEX)),
s AS (SELECT TRAJECTORY_UID, {snapped("LATITUDE", "LONGITUDE")[0]} AS x1, {snapped("LATITUDE", "LONGITUDE")[1]} AS y1, {snapped("lat2", "lon2")[0]} AS x2, {snapped("lat2", "lon2")[1]} AS y2 FROM g WHERE {hav("LATITUDE", "LONGITUDE", "lat2", "lon2")} BETWEEN 10 AND 1000),
o AS (SELECT DISTINCT TRAJECTORY_UID, CASE WHEN (x1, y1) <= (x2, y2) THEN x1 ELSE x2 END AS ax, CASE WHEN (x1, y1) <= (x2, y2) THEN y1 ELSE y2 END AS ay, CASE WHEN (x1, y1) <= (x2, y2) THEN x2 ELSE x1 END AS bx, CASE WHEN (x1, y1) <= (x2, y2) THEN y2 ELSE y1 END AS by_ FROM s WHERE (x1, y1) <> (x2, y2)),
edges AS (SELECT ax, ay, bx, by_, count(*) AS weight FROM o GROUP BY ALL)"""


def edges_of(spark, sf):
    return stored(fe.corridor_edges(fx.trips(spark, sf)), "corridor-edges")


@query(f"WITH {EDGES} SELECT ax, ay, bx, by_, weight FROM edges")
def corridor_edges(spark, sf):
    return edges_of(spark, sf).select(F.col("edge.a.gx").alias("ax"), F.col("edge.a.gy").alias("ay"), F.col("edge.b.gx").alias("bx"), F.col("edge.b.gy").alias("by_"), "weight")


@query(f"WITH {EDGES} SELECT ax, ay, bx, by_, CASE WHEN weight >= 0.66 * m THEN 'red' WHEN weight >= 0.33 * m THEN 'orange' ELSE 'blue' END AS intensity, round(2 + 10 * weight / m, 6) AS width FROM (SELECT *, max(weight) OVER () AS m FROM edges)")
def corridor_intensity(spark, sf):
    rows = with_largest(corridor_edges(spark, sf), "weight")
    return rows.select("ax", "ay", "bx", "by_", labels.corridor_intensity(F.col("weight"), F.col("m")).alias("intensity"), F.round(2 + 10 * F.col("weight") / F.col("m"), 6).alias("width"))


@query(f"WITH s AS (SELECT round(LATITUDE, 8) AS a, round(LONGITUDE, 8) AS b, lead(round(LATITUDE, 8)) OVER w AS c, lead(round(LONGITUDE, 8)) OVER w AS d, SEQ % 7 AS weight FROM {GPS} WINDOW w AS (PARTITION BY USER_ID ORDER BY SEQ)) SELECT least((a, b), (c, d))[1] AS lat1, least((a, b), (c, d))[2] AS lon1, greatest((a, b), (c, d))[1] AS lat2, greatest((a, b), (c, d))[2] AS lon2, max(weight) AS weight FROM s WHERE c IS NOT NULL AND (a, b) <> (c, d) GROUP BY ALL")
def segment_edges(spark, sf):
    w = sq.ordered(BY, AT)
    rows = fx.gps_points(spark, sf).select(F.col("LATITUDE").alias("lat1"), F.col("LONGITUDE").alias("lon1"), F.lead("LATITUDE").over(w).alias("lat2"), F.lead("LONGITUDE").over(w).alias("lon2"), (F.col("SEQ") % 7).alias("weight")).where("lat2 is not null")
    return fe.segment_edges(rows).select(F.col("edge.a.lat").alias("lat1"), F.col("edge.a.lon").alias("lon1"), F.col("edge.b.lat").alias("lat2"), F.col("edge.b.lon").alias("lon2"), "weight")


WALK = f"""{EDGES},
x AS MATERIALIZED (SELECT row_number() OVER (ORDER BY weight DESC, ax, ay, bx, by_) AS id, ax * 10000000 + ay AS a, bx * 10000000 + by_ AS b, weight AS w FROM edges WHERE weight >= 2),
adj AS MATERIALIZED (SELECT id, a AS c, b AS nb, w FROM x UNION ALL SELECT id, b, a, w FROM x),
top AS MATERIALIZED (SELECT max(w) AS m FROM x),
walk AS (
  SELECT 0 AS step, 0 AS phase, []::BIGINT[] AS used, []::BIGINT[] AS path, []::BIGINT[] AS wts, NULL::BIGINT[] AS done
  UNION ALL
  SELECT step + 1,
    CASE WHEN phase = 0 THEN 1 WHEN n IS NOT NULL THEN phase WHEN phase = 1 THEN 2 ELSE 0 END,
    CASE WHEN phase = 0 THEN list_append(used, seed.id) WHEN n IS NOT NULL THEN list_append(used, n.id) ELSE used END,
    CASE WHEN phase = 0 THEN [seed.a, seed.b] WHEN n IS NOT NULL THEN list_append(path, n.nb) ELSE list_reverse(path) END,
    CASE WHEN phase = 0 THEN [seed.w] WHEN n IS NOT NULL THEN list_append(wts, n.w) ELSE wts END,
    CASE WHEN phase = 2 AND n IS NULL THEN list_reverse(path) END
  FROM (
    SELECT s.*, CASE WHEN phase = 0 THEN (SELECT arg_min(x, x.id) FROM x WHERE NOT list_contains(s.used, x.id)) END AS seed,
      CASE WHEN phase > 0 AND len(path) < 5000 THEN (
        SELECT CASE WHEN arg_max(cosine, (cosine + 0.35::DOUBLE * w / m, -nb)) >= -0.2 THEN arg_max({{'id': id, 'nb': nb, 'w': w}}, (cosine + 0.35::DOUBLE * w / m, -nb)) END
        FROM (SELECT adj.*, m, ((h // 10000000 - p // 10000000) * (nb // 10000000 - h // 10000000) + (h % 10000000 - p % 10000000) * (nb % 10000000 - h % 10000000))
            / (sqrt(pow(h // 10000000 - p // 10000000, 2) + pow(h % 10000000 - p % 10000000, 2)) * sqrt(pow(nb // 10000000 - h // 10000000, 2) + pow(nb % 10000000 - h % 10000000, 2))) AS cosine
          FROM adj CROSS JOIN top CROSS JOIN (SELECT s.path[-2] AS p, s.path[-1] AS h) WHERE adj.c = s.path[-1] AND adj.nb <> s.path[-2] AND NOT list_contains(s.used, adj.id))) END AS n
    FROM walk s)
  WHERE phase > 0 OR seed IS NOT NULL)"""
REGION = "lat BETWEEN 48.10::DOUBLE AND 49.25::DOUBLE AND lon BETWEEN 1.45::DOUBLE AND 3.60::DOUBLE"
DRAWN = f"""{WALK},
paths AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY weight_mean * ln(1 + length_cells) DESC, weight_mean DESC, length_cells DESC, path) AS corridor_id FROM (
  SELECT done AS path, list_sum(wts)::DOUBLE / len(wts) AS weight_mean, list_max(wts) AS weight_max, list_min(wts) AS weight_min, len(done) AS length_cells FROM walk WHERE len(done) >= 8)),
steps AS MATERIALIZED (SELECT corridor_id, i, c % 10000000 * 30.0::DOUBLE / {geo.M_PER_DEGREE!r}::DOUBLE AS lat, c // 10000000 * 30.0::DOUBLE / ({geo.M_PER_DEGREE!r}::DOUBLE * cos(radians(ref))) AS lon
  FROM (SELECT corridor_id, unnest(path) AS c, generate_subscripts(path, 1) AS i FROM paths) CROSS JOIN (SELECT avg(LATITUDE) AS ref FROM {TRIPS})),
legs AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM steps WINDOW w AS (PARTITION BY corridor_id ORDER BY i)),
ends AS (SELECT corridor_id, sum({hav("lat", "lon", "lat2", "lon2")}) / 1000 AS l, arg_min(lat, i) AS a, arg_min(lon, i) AS b, arg_max(lat, i) AS c, arg_max(lon, i) AS d FROM legs GROUP BY 1),
drawn AS MATERIALIZED (SELECT p.*, weight_mean * ln(1 + length_cells) AS display_score, round(l, 3) AS length_km, round({hav("a", "b", "c", "d")} / 1000, 3) AS direct_distance_km,
  round(CASE WHEN {hav("a", "b", "c", "d")} > 0 THEN l / ({hav("a", "b", "c", "d")} / 1000) ELSE 1 END, 3) AS sinuosity FROM paths p JOIN ends USING (corridor_id))"""


def drawn(spark, sf):
    ref = fx.trips(spark, sf).agg(F.avg("LATITUDE").alias("ref_lat"))
    rows = co.corridors(edges_of(spark, sf)).crossJoin(F.broadcast(ref))
    coords = F.transform("cells", lambda c: geo.grid_node(c, 30, F.col("ref_lat")))
    return stored(co.corridor_metrics(rows.withColumn("coords", coords).drop("ref_lat")), "corridors")


@query(f"WITH RECURSIVE {DRAWN} SELECT corridor_id, {r9('weight_mean')}, weight_max, weight_min, length_cells, {r9('display_score')}, length_km, direct_distance_km, sinuosity FROM drawn")
def corridors(spark, sf):
    rows = drawn(spark, sf)
    return rounded(rows.select("corridor_id", "weight_mean", "weight_max", "weight_min", "length_cells", "display_score", "length_km", "direct_distance_km", "sinuosity"), "weight_mean", "display_score")


@query(f"""WITH RECURSIVE {DRAWN},
own AS MATERIALIZED (SELECT corridor_id, list_distinct(list(round_even(lat, 3) || ' ' || round_even(lon, 3))) AS cells, row_number() OVER (ORDER BY corridor_id) AS k FROM steps GROUP BY 1 HAVING bool_or({REGION})),
fold AS (
  SELECT 0::BIGINT AS k, []::VARCHAR[] AS taken, NULL::BIGINT AS id
  UNION ALL SELECT k, CASE WHEN fits THEN list_concat(taken, cells) ELSE taken END, CASE WHEN fits THEN corridor_id END
  FROM (SELECT o.*, f.taken, len(list_intersect(o.cells, f.taken)) / len(o.cells) <= 0.35 AS fits FROM fold f JOIN own o ON o.k = f.k + 1))
SELECT corridor_id, length_cells FROM drawn WHERE corridor_id IN (SELECT id FROM fold WHERE id IS NOT NULL ORDER BY id LIMIT 500)""")
def corridor_overlap(spark, sf):
    rows = drawn(spark, sf).where(co.touches_region(F.col("coords"))).withColumn("shown_cells", co.display_cells(F.col("coords")))
    return co.without_overlap(rows, cells="shown_cells").select("corridor_id", "length_cells")


@query(f"""WITH RECURSIVE {DRAWN}, i AS (SELECT *, CASE WHEN weight_mean >= 0.66 * m THEN 'red' WHEN weight_mean >= 0.33 * m THEN 'orange' ELSE 'blue' END AS intensity FROM (SELECT *, max(weight_mean) OVER () AS m FROM drawn))
SELECT 'all' AS view, corridor_id, length_km, intensity FROM i WHERE weight_mean >= 2 AND length_km >= 1.0 UNION ALL SELECT 'red', corridor_id, length_km, intensity FROM i WHERE weight_mean >= 3 AND length_km >= 1.0 AND intensity = 'red'""")
def corridor_view(spark, sf):
    rows = drawn(spark, sf)
    parts = [co.corridor_view(rows, least, 1.0, intensity).select(F.lit(intensity or "all").alias("view"), "corridor_id", "length_km", "intensity") for least, intensity in ((2.0, None), (3.0, "red"))]
    return parts[0].unionAll(parts[1])


@query(f"""WITH c AS (SELECT TRAJECTORY_UID, LATITUDE, LONGITUDE, lead(LATITUDE) OVER w AS a, lead(LONGITUDE) OVER w AS b, POINT_INDEX FROM {TRIPS} WINDOW w AS (PARTITION BY TRAJECTORY_UID ORDER BY POINT_INDEX)),
s AS (SELECT TRAJECTORY_UID, coalesce(sum({hav("LATITUDE", "LONGITUDE", "a", "b")}), 0) / 1000 AS l, arg_min(LATITUDE, POINT_INDEX) AS a, arg_min(LONGITUDE, POINT_INDEX) AS b, arg_max(LATITUDE, POINT_INDEX) AS c, arg_max(LONGITUDE, POINT_INDEX) AS d, count(*) AS n FROM c GROUP BY 1)
SELECT TRAJECTORY_UID, round(l, 3) AS length_km, round({hav("a", "b", "c", "d")} / 1000, 3) AS direct_distance_km, round(CASE WHEN {hav("a", "b", "c", "d")} > 0 THEN l / ({hav("a", "b", "c", "d")} / 1000) ELSE 1 END, 3) AS sinuosity, round(3 * ln(1 + n), 2) AS display_score FROM s""")
def corridor_metrics(spark, sf):
    path = F.transform(F.array_sort(F.collect_list(F.struct("POINT_INDEX", "LATITUDE", "LONGITUDE"))), lambda x: F.struct(x["LATITUDE"].alias("lat"), x["LONGITUDE"].alias("lon")))
    rows = fx.trips(spark, sf).groupBy("TRAJECTORY_UID").agg(path.alias("coords")).withColumn("weight_mean", F.lit(3))
    return co.corridor_metrics(rows).select("TRAJECTORY_UID", "length_km", "direct_distance_km", "sinuosity", "display_score")


# ---- profiles ----

MODES = f"SELECT ID, Main_Mode AS DOMINANT_MODE FROM (SELECT ID, Main_Mode, count(*) AS n, min(POS) AS first FROM {MOVES} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY ID ORDER BY n DESC, first) = 1"
PROFILES = f"SELECT p.ID AS USER_ID, SEX, {AGE_SQL} AS AGE_GROUP, {yes_sql('NAVIGO_SUB')} AS NAVIGO_SUB, {yes_sql('DRIVING_LICENCE')} AS DRIVING_LICENCE, {CAR_SQL} AS NB_CAR_GROUP, coalesce(m.DOMINANT_MODE, 'Unknown') AS DOMINANT_MODE FROM {PEOPLE} p LEFT JOIN ({MODES}) m USING (ID)"
STACKED = " UNION ALL ".join(f"SELECT '{c}' AS CRITERION, {c} AS VALUE, USER_ID FROM ({PROFILES})" for c in pr.CRITERIA)


def profiles_of(spark, sf):
    users = fx.gps_points(spark, sf).select("USER_ID").distinct()
    return pr.user_profiles(users, fx.individuals(spark, sf), fx.displacements(spark, sf))


@query(MODES)
def dominant_mode(spark, sf):
    return pr.dominant_mode(fx.displacements(spark, sf))


@query(PROFILES)
def user_profiles(spark, sf):
    return profiles_of(spark, sf).select("USER_ID", *pr.CRITERIA)


@query(f"SELECT p.ID AS USER_ID, coalesce(m.DOMINANT_MODE, 'Unknown') AS DOMINANT_MODE FROM {PEOPLE} p LEFT JOIN ({MODES}) m USING (ID)")
def dominant_mode_join(spark, sf):
    return profiles_of(spark, sf).select("USER_ID", "DOMINANT_MODE")


@query(f"SELECT TRAJECTORY_UID, f.USER_ID, N_CELLS, SEX, AGE FROM ({FEATURES}) f LEFT JOIN {PEOPLE} p ON f.USER_ID = p.ID")
def features_with_profile(spark, sf):
    people = fx.individuals(spark, sf)
    return features(spark, sf).join(people, F.col("USER_ID") == F.col("ID"), "left").select("TRAJECTORY_UID", "USER_ID", "N_CELLS", "SEX", "AGE")


@query(f"SELECT CRITERION, VALUE, count(DISTINCT s.USER_ID) AS N_USERS, count(DISTINCT TRAJECTORY_UID) AS N_TRAJECTORIES, count(*) AS N_POINTS FROM ({STACKED}) s JOIN {TRIPS} t USING (USER_ID) GROUP BY ALL HAVING count(DISTINCT s.USER_ID) >= 7 AND count(DISTINCT TRAJECTORY_UID) >= 10")
def profile_summary(spark, sf):
    return pr.profile_summary(fx.trips(spark, sf), profiles_of(spark, sf))


@query(f"SELECT CRITERION, VALUE, N_USERS FROM (SELECT CRITERION, VALUE, count(DISTINCT USER_ID) AS N_USERS FROM ({STACKED}) GROUP BY ALL)")
def profile_bars(spark, sf):
    return pr.by_criterion(profiles_of(spark, sf)).groupBy("CRITERION", "VALUE").agg(F.count_distinct("USER_ID").alias("N_USERS"))


@query(f"SELECT t.USER_ID, TRAJECTORY_UID, POINT_INDEX FROM {TRIPS} t JOIN ({PROFILES}) p USING (USER_ID) WHERE p.AGE_GROUP = '25-34'")
def profile_points(spark, sf):
    return pr.profile_points(fx.trips(spark, sf), profiles_of(spark, sf), "AGE_GROUP", "25-34").select("USER_ID", "TRAJECTORY_UID", "POINT_INDEX")


GROUPS = ["SEX", "AGE_GROUP", "NAVIGO_SUB", "DRIVING_LICENCE", "NB_CAR"]
PEOPLE_GROUPED = f"(SELECT *, {AGE_SQL} AS AGE_GROUP FROM {PEOPLE})"


def groups_sql(rows: str, least_score: float, shared: int, ends: bool, least: int) -> str:
    """CTEs w (``rows`` with CRITERION and V), n, c, k: clusters within each value."""
    same = "AND a.START_CELL = b.START_CELL AND a.END_CELL = b.END_CELL" if ends else ""
    return f"""w AS MATERIALIZED ({rows}),
n AS MATERIALIZED (SELECT * FROM w QUALIFY count(*) OVER (PARTITION BY CRITERION, V) >= {least}),
e AS MATERIALIZED (SELECT CRITERION, V, x, y FROM (SELECT a.CRITERION, a.V, a.TRAJECTORY_UID AS x, b.TRAJECTORY_UID AS y, len(list_intersect(a.CELL_SET, b.CELL_SET)) AS s, a.N_CELLS + b.N_CELLS AS t FROM n a JOIN n b ON a.CRITERION = b.CRITERION AND a.V = b.V AND a.TRAJECTORY_UID <> b.TRAJECTORY_UID {same}) WHERE s >= {shared} AND s / (t - s) >= {least_score}),
reach AS (SELECT CRITERION, V, TRAJECTORY_UID AS x, TRAJECTORY_UID AS y FROM n UNION SELECT r.CRITERION, r.V, r.x, e.y FROM reach r JOIN e ON r.CRITERION = e.CRITERION AND r.V = e.V AND r.y = e.x),
c AS (SELECT CRITERION, V, x, min(y) AS first FROM reach GROUP BY ALL),
k AS MATERIALIZED (SELECT CRITERION, V AS CRITERION_VALUE, x AS TRAJECTORY_UID, dense_rank() OVER (PARTITION BY CRITERION, V ORDER BY first) - 1 AS CLUSTER_ID FROM c)"""


_STACKED = " UNION ALL ".join(f"SELECT '{c}' AS CRITERION, coalesce({c}::VARCHAR, 'nan') AS V, f.* FROM f LEFT JOIN {PEOPLE_GROUPED} p ON f.USER_ID = p.ID" for c in GROUPS)
_PC = f"f AS MATERIALIZED ({COARSE}), " + groups_sql(_STACKED, 0.45, 3, True, 10)


def profile_clustered(spark, sf):
    people = fx.individuals(spark, sf).withColumn("AGE_GROUP", labels.age_group(F.col("AGE")))
    return stored(pr.profile_clusters(stored(features(spark, sf, 500, 2), "features"), people, GROUPS), "profile-clusters")


@query(f"WITH RECURSIVE {_PC} SELECT CRITERION, CRITERION_VALUE, TRAJECTORY_UID, CLUSTER_ID, CRITERION || '=' || CRITERION_VALUE || '::' || CLUSTER_ID AS PROFILE_CLUSTER_ID FROM k")
def profile_clusters(spark, sf):
    return profile_clustered(spark, sf).select("CRITERION", "CRITERION_VALUE", "TRAJECTORY_UID", "CLUSTER_ID", "PROFILE_CLUSTER_ID")


@query(f"WITH RECURSIVE {_PC} SELECT k.CRITERION, CRITERION_VALUE, CLUSTER_ID, count(*) AS N_TRAJECTORIES, count(DISTINCT USER_ID) AS N_USERS, round(avg(N_CELLS), 9) AS AVG_CELLS FROM k JOIN f USING (TRAJECTORY_UID) WHERE CRITERION_VALUE <> 'nan' GROUP BY ALL")
def profile_cluster_summary(spark, sf):
    return rounded(pr.profile_cluster_summary(profile_clustered(spark, sf)), "AVG_CELLS").select("CRITERION", "CRITERION_VALUE", "CLUSTER_ID", "N_TRAJECTORIES", "N_USERS", "AVG_CELLS")


# ---- what maps and reports show of profiles and clusters ----

SHOWN = f"SELECT CRITERION, VALUE, count(DISTINCT s.USER_ID) AS N_USERS, count(DISTINCT TRAJECTORY_UID) AS N_TRAJECTORIES, count(*) AS N_POINTS FROM ({STACKED}) s JOIN {TRIPS} t USING (USER_ID) GROUP BY ALL HAVING count(DISTINCT s.USER_ID) >= 7 AND count(DISTINCT TRAJECTORY_UID) >= 10"
_WITH_PROFILE = f"SELECT s.CRITERION, coalesce(s.VALUE, 'nan') AS V, f.* FROM f JOIN ({STACKED}) s USING (USER_ID) JOIN shown ON shown.CRITERION = s.CRITERION AND shown.VALUE IS NOT DISTINCT FROM s.VALUE"
def records_sql(users: int, trajectories: int) -> str:
    return f"""f AS MATERIALIZED ({FEATURES}), shown AS MATERIALIZED ({SHOWN}), {groups_sql(_WITH_PROFILE, 0.42, 5, False, 1)},
u AS (SELECT k.CRITERION, CRITERION_VALUE AS VALUE, CLUSTER_ID, count(*) AS N_TRAJECTORIES, count(DISTINCT USER_ID) AS N_USERS, avg(N_CELLS) AS m FROM k JOIN f USING (TRAJECTORY_UID) GROUP BY ALL),
best AS MATERIALIZED (SELECT * FROM u WHERE N_USERS >= {users} AND N_TRAJECTORIES >= {trajectories} QUALIFY row_number() OVER (PARTITION BY CRITERION, VALUE ORDER BY N_USERS DESC, N_TRAJECTORIES DESC, m DESC, CLUSTER_ID) <= 2),
g AS MATERIALIZED (SELECT b.CRITERION, b.VALUE, b.CLUSTER_ID, f.TRAJECTORY_UID, f.CELL_SET, f.N_CELLS FROM best b JOIN k ON k.CRITERION = b.CRITERION AND k.CRITERION_VALUE = b.VALUE AND k.CLUSTER_ID = b.CLUSTER_ID JOIN f USING (TRAJECTORY_UID)),
score AS (SELECT a.CRITERION, a.VALUE, a.CLUSTER_ID, a.TRAJECTORY_UID, round(sum(len(list_intersect(a.CELL_SET, b.CELL_SET)) / len(list_distinct(list_concat(a.CELL_SET, b.CELL_SET)))) + 0.001 * max(a.N_CELLS), 9) AS s FROM g a JOIN g b ON a.CRITERION = b.CRITERION AND a.VALUE = b.VALUE AND a.CLUSTER_ID = b.CLUSTER_ID GROUP BY ALL),
medoid AS (SELECT * FROM score QUALIFY row_number() OVER (PARTITION BY CRITERION, VALUE, CLUSTER_ID ORDER BY s DESC, TRAJECTORY_UID) = 1),
records AS MATERIALIZED (SELECT b.CRITERION, b.VALUE, b.CLUSTER_ID, b.N_USERS, b.N_TRAJECTORIES, m.TRAJECTORY_UID AS REPRESENTATIVE FROM best b JOIN medoid m ON m.CRITERION = b.CRITERION AND m.VALUE = b.VALUE AND m.CLUSTER_ID = b.CLUSTER_ID)"""


RECORDS = records_sql(2, 4)


def records(spark, sf, users=2, trajectories=4):
    profiles = stored(profiles_of(spark, sf), "profiles")
    return pr.profile_representatives(stored(features(spark, sf), "features"), profiles, pr.profile_summary(fx.trips(spark, sf), profiles), min_users=users, min_trajectories=trajectories)


@query(f"WITH RECURSIVE {records_sql(1, 2)} SELECT * FROM records")
def profile_representatives(spark, sf):
    return records(spark, sf, 1, 2)  # also of lone users, whom the smallest tables have


def views_sql(asked: list[tuple[str, str]]) -> str:
    rows = ", ".join(f"('{c}', '{v}')" for c, v in asked)
    return f"""WITH RECURSIVE {RECORDS}, asked(CRITERION, VALUE) AS (VALUES {rows}),
given AS (SELECT a.CRITERION, a.VALUE, coalesce(max(r.VALUE) FILTER (WHERE r.VALUE = a.VALUE), min(r.VALUE)) AS SHOWN FROM asked a LEFT JOIN records r USING (CRITERION) GROUP BY ALL)
SELECT g.CRITERION, g.VALUE, g.SHOWN, count(r.VALUE) AS lines, coalesce(sum(r.N_TRAJECTORIES), 0)::BIGINT AS trips, coalesce(max(r.N_USERS), 0) AS most_users FROM given g LEFT JOIN records r ON r.CRITERION = g.CRITERION AND r.VALUE = g.SHOWN GROUP BY ALL"""


ASKED = [("SEX", "Man"), ("SEX", "Nobody"), ("AGE_GROUP", "35-44"), ("NOTHING", "x")]
#: The presets of the profile maps.
PRESETS = [("SEX", "Man"), ("SEX", "Woman"), ("DOMINANT_MODE", "WALKING"), ("DOMINANT_MODE", "SUBWAY"), ("DOMINANT_MODE", "BIKE"), ("AGE_GROUP", "35-44"), ("NAVIGO_SUB", "Yes"), ("NB_CAR_GROUP", "0 car")]


@query(views_sql(ASKED))
def profile_view(spark, sf):
    return pr.profile_views(stored(records(spark, sf), "records"), spark.createDataFrame(ASKED, "CRITERION string, VALUE string"))


@query(views_sql(PRESETS))
def profile_presets(spark, sf):
    return pr.profile_views(stored(records(spark, sf), "records"), spark.createDataFrame(PRESETS, "CRITERION string, VALUE string"))


@query(f"SELECT CRITERION, VALUE, N_USERS, N_TRAJECTORIES FROM ({SHOWN}) WHERE CRITERION IN ('SEX', 'DOMINANT_MODE', 'AGE_GROUP') QUALIFY row_number() OVER (PARTITION BY CRITERION ORDER BY N_TRAJECTORIES DESC, N_USERS DESC, VALUE NULLS FIRST) <= 2")
def report_top(spark, sf):
    rows = pr.profile_summary(fx.trips(spark, sf), profiles_of(spark, sf)).where("CRITERION in ('SEX', 'DOMINANT_MODE', 'AGE_GROUP')")
    return se.top_within(rows, ["CRITERION"], [F.desc("N_TRAJECTORIES"), F.desc("N_USERS"), F.col("VALUE")], 2).select("CRITERION", "VALUE", "N_USERS", "N_TRAJECTORIES")


BY_USERS = "ORDER BY N_USERS DESC, N_TRAJECTORIES DESC, AVG_CELLS DESC, CLUSTER_ID"


def by_users(summary: DataFrame, most: int) -> DataFrame:
    return summary.orderBy(F.desc("N_USERS"), F.desc("N_TRAJECTORIES"), F.desc("AVG_CELLS"), "CLUSTER_ID").limit(most)


@query(f"WITH RECURSIVE {CLUSTERS}, {SUMMARY} SELECT CLUSTER_ID, N_TRAJECTORIES, N_USERS, {r9('AVG_POINTS', 'AVG_CELLS')} FROM (SELECT * FROM summary {BY_USERS} LIMIT 8)")
def report_clusters(spark, sf):
    return rounded(by_users(si.cluster_summary(clustered(spark, sf)), 8).select("CLUSTER_ID", "N_TRAJECTORIES", "N_USERS", "AVG_POINTS", "AVG_CELLS"), "AVG_POINTS", "AVG_CELLS")


@query(f"""WITH RECURSIVE {CLUSTERS}, {SUMMARY}, top AS (SELECT CLUSTER_ID FROM summary {BY_USERS} LIMIT 5),
r AS (SELECT c.CLUSTER_ID, t.TRAJECTORY_UID, t.POINT_INDEX FROM {TRIPS} t JOIN clusters c USING (TRAJECTORY_UID) JOIN top USING (CLUSTER_ID)),
l AS (SELECT * FROM (SELECT CLUSTER_ID, TRAJECTORY_UID FROM r GROUP BY ALL HAVING count(*) >= 2) QUALIFY row_number() OVER (PARTITION BY CLUSTER_ID ORDER BY TRAJECTORY_UID) <= 14)
SELECT CLUSTER_ID, TRAJECTORY_UID, POINT_INDEX FROM r JOIN l USING (CLUSTER_ID, TRAJECTORY_UID) QUALIFY row_number() OVER (PARTITION BY TRAJECTORY_UID ORDER BY POINT_INDEX) <= 280""")
def report_lines(spark, sf):
    found = clustered(spark, sf)
    return se.report_lines(fx.trips(spark, sf), found, by_users(si.cluster_summary(found), 5)).select("CLUSTER_ID", "TRAJECTORY_UID", "POINT_INDEX")


SEGMENTS = f"SELECT p AS FROM_CELL, x.c AS TO_CELL, coalesce(k.CLUSTER_ID, -1)::BIGINT AS CLUSTER_ID, count(DISTINCT x.USER_ID) AS N_USERS, count(DISTINCT x.TRAJECTORY_UID) AS N_TRAJECTORIES FROM ({changes_sql(90)}) x LEFT JOIN clusters k USING (TRAJECTORY_UID) GROUP BY 1, 2, 3"


@query(f"WITH RECURSIVE {CLUSTERS} SELECT * FROM ({SEGMENTS}) ORDER BY N_USERS DESC, N_TRAJECTORIES DESC, FROM_CELL, TO_CELL, CLUSTER_ID LIMIT 550")
def report_segments(spark, sf):
    rows = fe.weighted_segments(fx.trips(spark, sf), clustered(spark, sf)).select("FROM_CELL", "TO_CELL", "CLUSTER_ID", "N_USERS", "N_TRAJECTORIES")
    return rows.orderBy(F.desc("N_USERS"), F.desc("N_TRAJECTORIES"), "FROM_CELL", "TO_CELL", "CLUSTER_ID").limit(550)


@query(f"SELECT low, high, CASE WHEN axis THEN 'lat' ELSE 'lon' END AS axis FROM (SELECT min(x) - greatest(max(x) - min(x), 1e-6::DOUBLE) * 0.04::DOUBLE AS low, max(x) + greatest(max(x) - min(x), 1e-6::DOUBLE) * 0.04::DOUBLE AS high, axis FROM (SELECT LATITUDE AS x, true AS axis FROM {GPS} UNION ALL SELECT LONGITUDE, false FROM {GPS}) GROUP BY axis)")
def axis_limits(spark, sf):
    points = fx.gps_points(spark, sf)
    parts = [st.axis_limits(points, c, 0.04).withColumn("axis", F.lit(name)) for c, name in (("LATITUDE", "lat"), ("LONGITUDE", "lon"))]
    return parts[0].unionAll(parts[1])


@query(f"WITH RECURSIVE {CLUSTERS}, {SUMMARY} SELECT k.TRAJECTORY_UID, k.CLUSTER_ID, s.N_USERS, s.N_TRAJECTORIES, s.START_CELL, s.END_CELL FROM clusters k JOIN summary s USING (CLUSTER_ID)")
def cluster_lines(spark, sf):
    found = clustered(spark, sf)
    return si.with_summary(found, si.cluster_summary(found)).select("TRAJECTORY_UID", "CLUSTER_ID", "N_USERS", "N_TRAJECTORIES", "START_CELL", "END_CELL")


MEAN_LAT, MEAN_LON = (f"sum({c}::DECIMAL(18,9))::DOUBLE / count({c})" for c in ("LATITUDE", "LONGITUDE"))  # exact sums: the same means in any order of rows
USERS = f"SELECT USER_ID, count(*) AS N_POINTS, count(DISTINCT TRAJECTORY_UID) AS N_TRAJECTORIES, min(LATITUDE) AS MIN_LAT, max(LATITUDE) AS MAX_LAT, {MEAN_LAT} AS MEAN_LAT, min(LONGITUDE) AS MIN_LON, max(LONGITUDE) AS MAX_LON, {MEAN_LON} AS MEAN_LON FROM {TRIPS} GROUP BY USER_ID"


@query(USERS)
def user_summary(spark, sf):
    return pr.user_summary(fx.trips(spark, sf))


def zone_sql(target: int, least: int) -> str:
    tried = " UNION ALL ".join(f"SELECT {k} AS k, {s} AS size_m, {cell(s, 'MEAN_LAT', 'MEAN_LON')} AS z, * FROM cand" for k, s in enumerate(pr.ZONE_SIZES))
    last = len(pr.ZONE_SIZES) - 1
    return f"""u AS ({USERS}), cand AS (SELECT * FROM u WHERE (SELECT count(*) FROM u WHERE N_POINTS >= {least}) < {target} OR N_POINTS >= {least}), tried AS ({tried}),
zones AS (SELECT k, z, count(DISTINCT USER_ID) AS n, sum(N_TRAJECTORIES) AS t, sum(N_POINTS) AS p FROM tried GROUP BY ALL),
best AS (SELECT k, z FROM zones WHERE n >= {target} OR k = {last} ORDER BY CASE WHEN n >= {target} THEN k ELSE {last + 1} END, n DESC, t DESC, p DESC, z LIMIT 1)
SELECT USER_ID, N_POINTS, N_TRAJECTORIES, z AS ZONE_CELL, size_m AS ZONE_CELL_SIZE_M FROM tried JOIN best USING (k, z) ORDER BY N_TRAJECTORIES DESC, N_POINTS DESC, USER_ID LIMIT {target}"""


@query("WITH " + zone_sql(20, 60))
def zone_selection(spark, sf):
    return pr.zone_selection(pr.user_summary(fx.trips(spark, sf)), 20, 60).select("USER_ID", "N_POINTS", "N_TRAJECTORIES", "ZONE_CELL", "ZONE_CELL_SIZE_M")


@query(f"SELECT USER_ID, TRAJECTORY_UID, POINT_INDEX FROM {TRIPS} WHERE USER_ID IN (SELECT USER_ID FROM (WITH {zone_sql(20, 60)}))")
def extract_selected(spark, sf):
    chosen = pr.zone_selection(pr.user_summary(fx.trips(spark, sf)), 20, 60)
    return fx.trips(spark, sf).join(F.broadcast(chosen), "USER_ID", "left_semi").select("USER_ID", "TRAJECTORY_UID", "POINT_INDEX")  # at most 20 users


@query(f"SELECT TRAJECTORY_UID, POINT_INDEX FROM (SELECT *, count(*) OVER (PARTITION BY TRAJECTORY_UID) AS n FROM {TRIPS} WHERE USER_ID IN (SELECT USER_ID FROM (WITH {zone_sql(20, 60)}))) WHERE POINT_INDEX % greatest(1, n // 10) = 0")
def demo_export(spark, sf):
    chosen = pr.zone_selection(pr.user_summary(fx.trips(spark, sf)), 20, 60)
    return src.demo_points(fx.trips(spark, sf), chosen, 10).select("TRAJECTORY_UID", "POINT_INDEX")


# ---- samples, ids, studies ----

@query(f"SELECT TRAJECTORY_UID, count(*) AS N_POINTS FROM {TRIPS} GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 100")
def longest_trajs(spark, sf):
    return se.longest_trajectories(fx.trips(spark, sf))


@query()
def random_users(spark, sf):
    return se.random_users(fx.gps_points(spark, sf), 10).select("USER_ID", "SEQ")


@query(f"SELECT TRAJECTORY_UID, dense_rank() OVER (ORDER BY SOURCE_FILE, TRAJECTORY_ID) AS GLOBAL_TRAJECTORY_ID FROM (SELECT DISTINCT TRAJECTORY_UID, SOURCE_FILE, TRAJECTORY_ID FROM {TRIPS})")
def global_traj_id(spark, sf):
    return tr.global_ids(fx.trips(spark, sf), "SOURCE_FILE").select("TRAJECTORY_UID", "GLOBAL_TRAJECTORY_ID").distinct()


@query(f"SELECT TRAJECTORY_UID, count(*) AS N_POINTS, ceil(count(*) / 5)::BIGINT AS N_SAMPLED FROM {TRIPS} GROUP BY 1 HAVING ceil(count(*) / 5) >= 2")
def sampled_trips(spark, sf):
    return se.sampled_trips(fx.trips(spark, sf))


@query(f"SELECT USER_ID, SEQ FROM (SELECT *, count(*) OVER (PARTITION BY USER_ID) AS n FROM {GPS}) WHERE n >= 16 AND SEQ % 15 = 0")
def viewer_trips(spark, sf):
    return se.viewer_trips(fx.gps_points(spark, sf), "USER_ID").select("USER_ID", "SEQ")


@query(f"SELECT USER_ID, SEQ FROM (SELECT *, count(*) OVER (PARTITION BY USER_ID) AS n FROM {GPS}) WHERE n >= 16 AND SEQ % 100 = 0")
def viewer_heat(spark, sf):
    return se.viewer_heat(fx.gps_points(spark, sf), "USER_ID").select("USER_ID", "SEQ")


LISTED = f"SELECT SOURCE_FILE, row_number() OVER (ORDER BY SOURCE_FILE) AS id, raw_count, ceil(raw_count / 15)::BIGINT AS shown_count FROM (SELECT USER_ID || '.csv' AS SOURCE_FILE, count(*) AS raw_count FROM {GPS} GROUP BY 1 HAVING count(*) >= 16)"


def listed(spark, sf):
    return se.viewer_list(fx.gps_points(spark, sf).withColumn("SOURCE_FILE", F.concat("USER_ID", F.lit(".csv"))))


@query(f"SELECT *, {list(se.COLORS)}[((id - 1) % {len(se.COLORS)} + 1)::INTEGER] AS color FROM ({LISTED})")
def viewer_list(spark, sf):
    return listed(spark, sf)


@query(f"SELECT 'in' AS how, SOURCE_FILE, id FROM ({LISTED}) WHERE contains(id::VARCHAR, '1') OR contains(lower(SOURCE_FILE), '1') UNION ALL SELECT 'is', SOURCE_FILE, id FROM ({LISTED}) WHERE id::VARCHAR = '2' OR contains(lower(SOURCE_FILE), '2')")
def viewer_search(spark, sf):
    shown = stored(listed(spark, sf), "listed")
    parts = [se.viewer_search(shown, text, exact).select(F.lit(how).alias("how"), "SOURCE_FILE", "id") for how, text, exact in (("in", " 1", False), ("is", "2", True))]
    return parts[0].unionAll(parts[1])


@query()
def shuffled_files(spark, sf):
    points = fx.gps_points(spark, sf).withColumn("SOURCE_FILE", F.concat("USER_ID", F.lit(".csv")))
    return se.shuffled_files(points, 10).select("USER_ID", "SEQ")


@query("SELECT user_id::VARCHAR AS USER_ID, strftime(min(ts), '%H:%M') AS HOUR FROM events GROUP BY 1")
def first_hour(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").cast("string").alias("USER_ID"), "ts")
    return se.first_time(events, "USER_ID", "ts")


VALUES = "SELECT x FROM (SELECT value::DOUBLE AS x FROM events) WHERE x IS NOT NULL AND isfinite(x) AND x > 0 AND x <= 60"


def values(spark, sf):
    return st.clean_series(spark.read.parquet(f"{sf}/events.parquet"), "value", True, 60)


@query(f"SELECT count(*) AS n, round(sum(x), 4) AS total FROM ({VALUES})")
def clean_series(spark, sf):
    return values(spark, sf).agg(F.count("x").alias("n"), F.round(F.sum("x"), 4).alias("total"))


SERIES = f"SELECT 'delta_t' AS section, delta_t::DOUBLE AS x FROM ({STEPS}) WHERE delta_t > 0 UNION ALL SELECT 'dist_m', dist_m FROM ({STEPS}) WHERE delta_t > 0 UNION ALL SELECT 'speed_mps', dist_m / delta_t FROM ({STEPS}) WHERE delta_t > 0 UNION ALL SELECT 'stop_min', duration_min FROM ({STOPS})"


def series(spark, sf):
    points = fx.gps_points(spark, sf)
    steps = sq.step_metrics(points, BY, AT, SEC).where("delta_t > 0")
    pairs = F.array(*[F.struct(F.lit(c).alias("section"), F.col(c).cast("double").alias("x")) for c in ("delta_t", "dist_m", "speed_mps")])
    stops = sq.stop_runs(points, BY, AT, SEC).select(F.lit("stop_min").alias("section"), F.col("duration_min").alias("x"))
    return stored(steps.select(F.explode(pairs).alias("p")).select("p.*").unionAll(stops), "series")


@query(f"SELECT section, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS least, round(max(x), 6) AS largest, " + ", ".join(f"round(quantile_cont(x, {p / 100}), 6) AS p{p}" for p in st.PERCENTILES) + f" FROM ({SERIES}) GROUP BY section")
def eda_describe(spark, sf):
    return rounded(st.describe(series(spark, sf), ["section"]), "mean", "std", "least", "largest", *[f"p{p}" for p in st.PERCENTILES], places=6)


#: Limits of each series.
LIMITS = {"delta_t": [300.0, 600.0, 900.0, 1800.0], "dist_m": [50.0, 100.0, 200.0, 500.0], "speed_mps": [1.0, 5.0, 15.0, 30.0], "stop_min": [5.0, 8.0, 10.0, 15.0, 20.0, 180.0]}


@query(f"SELECT section, t AS limit_value, round(avg(CASE WHEN x <= t THEN 1 ELSE 0 END), 9) AS share FROM ({SERIES}) JOIN (" + " UNION ALL ".join(f"SELECT '{s}' AS section, unnest({doubles(own)}) AS t" for s, own in LIMITS.items()) + ") USING (section) GROUP BY ALL")
def threshold_coverage(spark, sf):
    return rounded(st.coverage(series(spark, sf), LIMITS), "share")


@query("SELECT x, round((row_number() OVER (ORDER BY x)) / (count(*) OVER ()), 9) AS cdf FROM (SELECT value::DOUBLE AS x FROM events) WHERE isfinite(x)")
def ecdf(spark, sf):
    return rounded(st.ecdf(st.clean_series(spark.read.parquet(f"{sf}/events.parquet"), "value")), "cdf")


@query(f"WITH v AS ({VALUES}), m AS (SELECT min(x) AS lo, max(x) AS hi FROM v) SELECT least(floor((x - lo) / (hi - lo) * 80) + 1, 80)::BIGINT AS bin, count(*) AS n FROM v CROSS JOIN m GROUP BY 1")
def histogram80(spark, sf):
    return st.histogram(values(spark, sf))


@query(f"WITH c AS (SELECT event_type, count(*) AS n, avg(value) AS m FROM events GROUP BY 1) SELECT event_type, round((n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ()) * 100, 9) AS n_scaled, round((m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ()) * 100, 9) AS m_scaled FROM c")
def minmax_scale(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"))
    return rounded(st.minmax(rows, ["n", "m"]).select("event_type", "n_scaled", "m_scaled"), "n_scaled", "m_scaled")


@query(f"SELECT {MEAN_LAT} AS ref_lat, min(LATITUDE) AS south, max(LATITUDE) AS north, {MEAN_LON} AS mean_lon, min(LONGITUDE) AS west, max(LONGITUDE) AS east FROM {GPS}")
def map_bounds(spark, sf):
    lat, lon = F.col("LATITUDE"), F.col("LONGITUDE")
    return fx.gps_points(spark, sf).agg(geo.mean_degrees(lat).alias("ref_lat"), F.min(lat).alias("south"), F.max(lat).alias("north"), geo.mean_degrees(lon).alias("mean_lon"), F.min(lon).alias("west"), F.max(lon).alias("east"))


@query(f"""WITH RECURSIVE {CLUSTERS}, {SUMMARY}, z AS (SELECT USER_ID FROM (WITH {zone_sql(20, 60)}))
SELECT (SELECT count(*) FROM z) AS n_users, (SELECT count(*) FROM summary) AS n_clusters, (SELECT max(N_USERS) FROM summary) AS max_users_cluster, (SELECT max(N_TRAJECTORIES) FROM summary) AS max_traj_cluster,
  (SELECT count(*) FROM ({SEGMENTS})) AS n_segments, (SELECT max(N_USERS) FROM ({SEGMENTS})) AS max_segment_users, (SELECT coalesce(sum(N_TRAJECTORIES), 0)::BIGINT FROM ({SHOWN}) WHERE CRITERION = 'SEX') AS total_profile_traj""")
def report_totals(spark, sf):
    points, found = fx.trips(spark, sf), clustered(spark, sf)
    users = pr.zone_selection(pr.user_summary(points), 20, 60)
    return se.report_totals(users, si.cluster_summary(found), fe.weighted_segments(points, found), pr.profile_summary(points, profiles_of(spark, sf)))
