"""Rankings, samples and reports of bounded length.

Ties are broken by the id that each operator names last. Fewer rows than asked
for are all returned; no rows give no rows, and totals of zero.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.numbering import numbered
from .sequence import every_kth


def top_clusters(summary: DataFrame, min_size: int = 3, min_users: int = 2, rank_by: str = "users", most: int = 20) -> DataFrame:
    """The best clusters with enough trajectories and users; without any, with enough trajectories; else of all."""
    size, users = F.col("N_TRAJECTORIES") >= min_size, F.col("N_USERS") >= min_users
    tier = F.when(size & users, 0).when(size, 1).otherwise(2)
    rows = summary.withColumn("tier_", tier)
    rows = rows.crossJoin(F.broadcast(rows.agg(F.min("tier_").alias("best_"))))  # one row
    keys = ["N_USERS", "N_TRAJECTORIES"] if rank_by == "users" else ["N_TRAJECTORIES", "N_USERS"]
    # falling back to a tier takes in the tiers before it, which are empty then
    return rows.where("tier_ = best_ or best_ = 2").orderBy(*[F.desc(k) for k in keys], F.desc("AVG_CELLS"), "CLUSTER_ID").limit(most).drop("tier_", "best_")


def balanced_pick(clusters: DataFrame, per_user: int = 2, most: int = 30) -> DataFrame:
    """Trajectories of each cluster: the first ``per_user`` of every user, then the others, up to ``most``."""
    order = [F.col(c) for c in ("USER_ID", "N_CELLS", "N_POINTS", "TRAJECTORY_UID")]
    mine = F.row_number().over(Window.partitionBy("CLUSTER_ID", "USER_ID").orderBy(*order[1:]))
    rows = clusters.withColumn("mine_", mine)
    place = F.row_number().over(Window.partitionBy("CLUSTER_ID").orderBy((F.col("mine_") > per_user).cast("int"), *order))
    return rows.withColumn("PICK", place.cast("long")).where(F.col("PICK") <= most).drop("mine_")


def top_within(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group in an order."""
    return rows.withColumn("k_", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("k_") <= most).drop("k_")


def longest_trajectories(points: DataFrame, most: int = 100) -> DataFrame:
    """``TRAJECTORY_UID, N_POINTS`` of the trajectories with most points, two at least."""
    counts = points.groupBy("TRAJECTORY_UID").agg(F.count(F.lit(1)).alias("N_POINTS")).where("N_POINTS >= 2")
    return counts.orderBy(F.desc("N_POINTS"), "TRAJECTORY_UID").limit(most)


def _drawn(points: DataFrame, user: str, draw: Callable[[random.Random, list], list], seed: int) -> DataFrame:
    ids = sorted(r[0] for r in points.select(user).where(F.col(user).isNotNull()).distinct().collect())
    chosen = points.sparkSession.createDataFrame([(u,) for u in draw(random.Random(seed), ids)], f"{user} {points.schema[user].dataType.simpleString()}")
    return points.join(F.broadcast(chosen), user, "left_semi")


def random_users(points: DataFrame, size: int, seed: int = 42, user: str = "USER_ID") -> DataFrame:
    """Rows of a random sample of users, drawn from their sorted ids with the standard library's generator.

    The ids (a row a user) go to the driver, since that generator's draw must be
    reproduced.
    """
    return _drawn(points, user, lambda r, ids: r.sample(ids, min(size, len(ids))), seed)


def shuffled_files(points: DataFrame, most: int = 150, seed: int = 42, file: str = "SOURCE_FILE") -> DataFrame:
    """Rows of the first files of a random order; the names, as above, are sorted first."""
    def draw(r: random.Random, ids: list) -> list:
        r.shuffle(ids)
        return ids[:most]

    return _drawn(points, file, draw, seed)


def report_lines(points: DataFrame, clusters: DataFrame, top: DataFrame, most_points: int = 280, most_lines: int = 14) -> DataFrame:
    """Points of the first lines of each cluster in ``top``, trajectories in order of their ids: the first of each, two at least."""
    members = clusters.join(top.select("CLUSTER_ID"), "CLUSTER_ID", "left_semi").select("CLUSTER_ID", "TRAJECTORY_UID")
    rows = points.join(members, "TRAJECTORY_UID")
    counts = rows.groupBy("CLUSTER_ID", "TRAJECTORY_UID").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    lines = top_within(counts, ["CLUSTER_ID"], [F.col("TRAJECTORY_UID")], most_lines).select("TRAJECTORY_UID")
    return top_within(rows.join(lines, "TRAJECTORY_UID", "left_semi"), ["TRAJECTORY_UID"], [F.col("POINT_INDEX")], most_points)


def report_totals(users: DataFrame, summary: DataFrame, segments: DataFrame, profiles: DataFrame, criterion: str = "SEX") -> DataFrame:
    """One row of headline numbers of a focused run."""
    zero = F.lit(0).cast("long")
    rows = users.agg(F.count(F.lit(1)).alias("n_users"))
    rows = rows.crossJoin(summary.agg(F.count(F.lit(1)).alias("n_clusters"), F.coalesce(F.max("N_USERS"), zero).alias("max_users_cluster"), F.coalesce(F.max("N_TRAJECTORIES"), zero).alias("max_traj_cluster")))
    rows = rows.crossJoin(segments.agg(F.count(F.lit(1)).alias("n_segments"), F.coalesce(F.max("N_USERS"), zero).alias("max_segment_users")))
    return rows.crossJoin(profiles.agg(F.coalesce(F.sum(F.when(F.col("CRITERION") == criterion, F.col("N_TRAJECTORIES"))), zero).alias("total_profile_traj")))  # one row each


def sampled_trips(points: DataFrame, step: int = 5) -> DataFrame:
    """``TRAJECTORY_UID, N_POINTS, N_SAMPLED`` of trips that keep two points when thinned."""
    counts = points.groupBy("TRAJECTORY_UID").agg(F.count(F.lit(1)).alias("N_POINTS"))
    return counts.withColumn("N_SAMPLED", F.ceil(F.col("N_POINTS") / step).cast("long")).where("N_SAMPLED >= 2")


#: Colours of the viewer's lines, in turn.
COLORS = (
    "#ef4444", "#3b82f6", "#22c55e", "#a855f7", "#f97316",
    "#14b8a6", "#ec4899", "#84cc16", "#6366f1", "#facc15",
    "#f43f5e", "#0ea5e9", "#10b981", "#8b5cf6", "#fb923c",
)


def _viewed(points: DataFrame, by: str, least: int, step: int) -> DataFrame:
    """Points of files with enough of them to be shown, that is two when thinned."""
    rows = points.withColumn("n_", F.count(F.lit(1)).over(Window.partitionBy(by)))
    return rows.where(F.col("n_") >= F.greatest(F.lit(least), F.lit(step + 1))).drop("n_")


def viewer_trips(points: DataFrame, by: str = "SOURCE_FILE", at: str = "SEQ", least: int = 10, step: int = 15) -> DataFrame:
    """Every ``step``-th point of files with enough points that keep two."""
    return every_kth(_viewed(points, by, least, step), [by], at, step)


def viewer_heat(points: DataFrame, by: str = "SOURCE_FILE", at: str = "SEQ", least: int = 10, step: int = 15, heat_step: int = 100) -> DataFrame:
    """Every ``heat_step``-th point of the files that the viewer shows."""
    return every_kth(_viewed(points, by, least, step), [by], at, heat_step)


def viewer_list(points: DataFrame, by: str = "SOURCE_FILE", at: str = "SEQ", least: int = 10, step: int = 15) -> DataFrame:
    """``by, id, raw_count, shown_count, color``: the files shown, numbered by name from 1, with colours in turn."""
    files = _viewed(points, by, least, step).groupBy(by).agg(F.count(F.lit(1)).alias("raw_count"))
    rows = numbered(files, [F.col(by)], "place_")
    color = F.element_at(F.array(*map(F.lit, COLORS)), (F.col("place_") % len(COLORS) + 1).cast("int"))
    return rows.select(by, (F.col("place_") + 1).alias("id"), "raw_count", F.ceil(F.col("raw_count") / step).cast("long").alias("shown_count"), color.alias("color"))


def viewer_search(shown: DataFrame, text: str, exact: bool = False, by: str = "SOURCE_FILE") -> DataFrame:
    """Files shown whose id holds the text (or is it), or whose name holds it, upper or lower case."""
    asked, number = text.strip().lower(), F.col("id").cast("string")
    return shown.where((number == asked if exact else number.contains(asked)) | F.lower(by).contains(asked))


def render_points(points: DataFrame, by: list[str], at: str, step: int) -> DataFrame:
    """Every ``step``-th point of each line; all of a line that would keep one only; lines of one point go."""
    rows = points.withColumn("n_", F.count(F.lit(1)).over(Window.partitionBy(*by))).where("n_ >= 2")
    return every_kth(rows, by, at, F.when(F.col("n_") > step, F.lit(step)).otherwise(1)).drop("n_")


def first_time(points: DataFrame, by: str, ts: str) -> DataFrame:
    """``by, HOUR``: HH:mm of the first valid time, or ``?``."""
    return points.groupBy(by).agg(F.coalesce(F.date_format(F.min(ts), "HH:mm"), F.lit("?")).alias("HOUR"))
