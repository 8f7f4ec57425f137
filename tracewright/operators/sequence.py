"""Ordered operators within a user or trip: runs, thinning, steps, cuts and trims.

Every operator takes the columns that identify a sequence (``by``) and the one
that orders it (``at``, unique within a sequence; rows that tie in it come in
any order). All are window expressions over one shuffle by ``by``; several on
the same keys share it. A null coordinate or time gives null distances, gaps and
speeds, which are neither near nor far: such rows are never merged, trimmed as
near or counted as slow. Null keys are a sequence of their own, repeated rows
count each, no rows give no rows, and further columns are carried along unless
they end in an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine, in_box


def ordered(by: list[str], at: str) -> Window:
    return Window.partitionBy(*by).orderBy(at)


def whole(by: list[str], at: str) -> Window:
    return ordered(by, at).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def so_far(by: list[str], at: str) -> Window:
    return ordered(by, at).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def runs(rows: DataFrame, by: list[str], at: str, starts: Column, name: str = "run") -> DataFrame:
    """``rows`` with a run number: how many rows of the sequence so far start a run."""
    return rows.withColumn("starts_", starts).withColumn(name, F.sum(F.when(F.col("starts_"), 1).otherwise(0)).over(so_far(by, at))).drop("starts_")


def step_metrics(points: DataFrame, by: list[str], at: str, time_s: str) -> DataFrame:
    """``points`` with ``delta_t`` (s), ``dist_m`` and ``speed_mps`` from the previous row; speed is null without time passing."""
    w = ordered(by, at)
    gap = F.col(time_s) - F.lag(time_s).over(w)
    dist = haversine(F.lag("LATITUDE").over(w), F.lag("LONGITUDE").over(w), F.col("LATITUDE"), F.col("LONGITUDE"))
    rows = points.withColumn("delta_t", gap).withColumn("dist_m", dist)
    return rows.withColumn("speed_mps", F.when(F.col("delta_t") > 0, F.col("dist_m") / F.col("delta_t")))


def presample(points: DataFrame, by: list[str], at: str, time_s: str, max_m: float = 2.0, max_s: float = 2.0) -> DataFrame:
    """Chains of raw points, each within reach of the one before, become one: mean position, the last row's other columns."""
    linked = (F.col("dist_m") <= max_m) & (F.col("delta_t") <= max_s)
    rows = step_metrics(points, by, at, time_s)
    rows = runs(rows, by, at, ~F.coalesce(linked, F.lit(False)))
    rest = [c for c in points.columns if c not in (*by, "LATITUDE", "LONGITUDE")]
    last = F.max_by(F.struct(*rest), at).alias("last_")
    merged = rows.groupBy(*by, "run").agg(F.avg("LATITUDE").alias("LATITUDE"), F.avg("LONGITUDE").alias("LONGITUDE"), last)
    return merged.select(*by, "LATITUDE", "LONGITUDE", *[F.col(f"last_.{c}").alias(c) for c in rest])


def trim_zones(points: DataFrame, by: list[str], at: str, radius_m: float = 100.0) -> DataFrame:
    """Rows farther than the radius from both the first and the last row; trips of one row stay. Mid-trip returns go too."""
    w = whole(by, at)
    lat, lon = F.col("LATITUDE"), F.col("LONGITUDE")
    rows = points.withColumn("distance_from_start", haversine(F.first("LATITUDE").over(w), F.first("LONGITUDE").over(w), lat, lon))
    rows = rows.withColumn("distance_from_end", haversine(F.last("LATITUDE").over(w), F.last("LONGITUDE").over(w), lat, lon))
    far = (F.col("distance_from_start") > radius_m) & (F.col("distance_from_end") > radius_m)
    return rows.withColumn("rows_", F.count(F.lit(1)).over(w)).where((F.col("rows_") < 2) | far).drop("rows_")


def every_kth(points: DataFrame, by: list[str], at: str, step: int | Column) -> DataFrame:
    """Rows 0, k, 2k ... of each sequence; ``step`` may depend on columns constant within it."""
    row = F.row_number().over(ordered(by, at)) - 1
    return points.withColumn("row_", row).where(F.col("row_") % step == 0).drop("row_")


def adaptive_sample(points: DataFrame, by: list[str], at: str, target: int = 80) -> DataFrame:
    """Every max(1, n // target)-th row of a sequence of n."""
    rows = points.withColumn("n_", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    return every_kth(rows, by, at, F.greatest(F.lit(1), F.floor(F.col("n_") / target))).drop("n_")


def thin_long(points: DataFrame, by: list[str], at: str, most: int = 10_000) -> DataFrame:
    """Every ceil(n / most)-th row of sequences of more than ``most`` rows; shorter ones stay whole."""
    rows = points.withColumn("n_", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    return every_kth(rows, by, at, F.ceil(F.col("n_") / most)).drop("n_")


def gap_split(points: DataFrame, by: list[str], at: str, time_s: str, max_s: float = 60.0, max_m: float = 200.0, least: int = 2) -> DataFrame:
    """``points`` with ``piece`` (1-based): a new one after a gap in time or space; pieces under ``least`` rows go."""
    rows = step_metrics(points, by, at, time_s)
    rows = runs(rows, by, at, F.coalesce((F.col("delta_t") > max_s) | (F.col("dist_m") > max_m), F.lit(True)), "piece")
    return rows.withColumn("n_", F.count(F.lit(1)).over(Window.partitionBy(*by, "piece"))).where(F.col("n_") >= least).drop("n_", "speed_mps")


def region_split(points: DataFrame, by: list[str], at: str, box: tuple[float, float, float, float], least: int = 2) -> DataFrame:
    """Maximal runs inside the box, ``piece`` numbered by the rows outside before them; short ones go."""
    rows = points.withColumn("inside_", F.coalesce(in_box(F.col("LATITUDE"), F.col("LONGITUDE"), box), F.lit(False)))
    rows = runs(rows, by, at, ~F.col("inside_"), "piece").where("inside_")
    return rows.withColumn("n_", F.count(F.lit(1)).over(Window.partitionBy(*by, "piece"))).where(F.col("n_") >= least).drop("n_", "inside_")


def stop_runs(points: DataFrame, by: list[str], at: str, time_s: str, max_speed: float = 1.0) -> DataFrame:
    """``by, run, duration_min`` of maximal runs slower than ``max_speed`` that last."""
    rows = step_metrics(points, by, at, time_s).where("delta_t > 0 and speed_mps is not null")
    slow = F.col("speed_mps") < max_speed
    rows = runs(rows, by, at, ~slow).where(slow)
    spans = rows.groupBy(*by, "run").agg(((F.max(time_s) - F.min(time_s)) / 60).alias("duration_min"))
    return spans.where("duration_min > 0")


def local_zone_trim(points: DataFrame, by: list[str], at: str, time_s: str, radius_m: Column | float, minutes: Column | int) -> DataFrame:
    """``points`` flagged ``in_start``, ``in_end`` and ``removed``: within the radius of an end or, if minutes > 0, that near it in time."""
    w = whole(by, at)
    lat, lon = F.col("LATITUDE"), F.col("LONGITUDE")
    radius, span = F.lit(radius_m), F.lit(minutes) * 60
    from_start = haversine(F.first("LATITUDE").over(w), F.first("LONGITUDE").over(w), lat, lon) <= radius
    from_end = haversine(F.last("LATITUDE").over(w), F.last("LONGITUDE").over(w), lat, lon) <= radius
    early = (span > 0) & (F.col(time_s) <= F.first(time_s).over(w) + span)
    late = (span > 0) & (F.col(time_s) >= F.last(time_s).over(w) - span)
    rows = points.withColumn("in_start", from_start | early).withColumn("in_end", from_end | late)
    return rows.withColumn("removed", F.col("in_start") | F.col("in_end"))


def edge_trim(points: DataFrame, by: list[str], at: str, time_s: str, speed: Column | float, factor: Column | float, least_m: float = 50.0, most_m: float = 300.0) -> DataFrame:
    """One row a sequence: what slow prefixes and suffixes near the ends take away.

    ``points`` has dist_m and speed_mps. The radius is the length's share, within
    bounds. A prefix ends at the first row that is far or fast; at least one row
    goes at each end.
    """
    w, back = whole(by, at), Window.partitionBy(*by).orderBy(F.col(at).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lat, lon = F.col("LATITUDE"), F.col("LONGITUDE")
    rows = points.withColumn("length_", F.sum("dist_m").over(w)).withColumn("radius_", F.least(F.lit(most_m), F.greatest(F.lit(least_m), F.col("length_") * F.lit(factor))))
    slow = F.coalesce(F.col("speed_mps") <= F.lit(speed), F.lit(False))
    near_start = haversine(F.first("LATITUDE").over(w), F.first("LONGITUDE").over(w), lat, lon) <= F.col("radius_")
    near_end = haversine(F.last("LATITUDE").over(w), F.last("LONGITUDE").over(w), lat, lon) <= F.col("radius_")
    rows = rows.withColumn("a_", (near_start & slow).cast("int")).withColumn("z_", (near_end & slow).cast("int"))
    rows = rows.withColumn("head_", F.min("a_").over(so_far(by, at))).withColumn("tail_", F.min("z_").over(back))
    rows = rows.withColumn("i_", F.row_number().over(ordered(by, at))).withColumn("n_", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    head, tail = F.greatest(F.lit(1), F.sum("head_").over(w)), F.greatest(F.lit(1), F.sum("tail_").over(w))
    rows = rows.withColumn("start_removed_points", head.cast("long")).withColumn("end_removed_points", tail.cast("long"))
    first = F.sum(F.when(F.col("i_") <= F.col("start_removed_points"), F.col("dist_m")))
    last = F.sum(F.when(F.col("i_") > F.col("n_") - F.col("end_removed_points"), F.col("dist_m")))
    found = rows.groupBy(*by).agg(F.max("radius_").alias("radius_m"), F.max("length_").alias("total_distance_m"), F.max("n_").alias("total_points"), F.max("start_removed_points").alias("start_removed_points"), F.max("end_removed_points").alias("end_removed_points"), (F.coalesce(first, F.lit(0.0)) + F.coalesce(last, F.lit(0.0))).alias("total_removed_distance_m"))
    total = F.col("start_removed_points") + F.col("end_removed_points")
    found = found.withColumn("total_removed_points", total).withColumn("kept_points", F.greatest(F.lit(0), F.col("total_points") - total))
    found = found.withColumn("removed_ratio", total / F.col("total_points"))
    return found.withColumn("removed_distance_ratio", F.when(F.col("total_distance_m") > 0, F.col("total_removed_distance_m") / F.col("total_distance_m")).otherwise(0.0))
