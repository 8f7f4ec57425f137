"""Trajectories as cells, and the segments that they share.

POINT_INDEX orders a trajectory's points. Points with a null coordinate lie in no
cell and start no segment; trajectories without cells have no features; users
that are null are not counted. Repeated points count each; no points, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import cell_id, edge_key, haversine, snap_grid

UID, USER, AT = "TRAJECTORY_UID", "USER_ID", "POINT_INDEX"


def trajectory_features(points: DataFrame, size_m: float, least_cells: int) -> DataFrame:
    """One row a trajectory: its cell sequence without repeats in a row, its sorted cell set, both ends and counts."""
    w = Window.partitionBy(UID).orderBy(AT)
    rows = points.select(UID, USER, AT, cell_id(F.col("LATITUDE"), F.col("LONGITUDE"), size_m).alias("cell"))
    rows = rows.withColumn("new", F.coalesce(F.col("cell") != F.lag("cell").over(w), F.lit(True)))
    path = F.array_sort(F.collect_list(F.when(F.col("new"), F.struct(AT, "cell"))))
    found = rows.groupBy(UID, USER).agg(F.transform(path, lambda x: x["cell"]).alias("CELL_SEQUENCE"), F.array_sort(F.collect_set("cell")).alias("CELL_SET"), F.min_by("cell", AT).alias("START_CELL"), F.max_by("cell", AT).alias("END_CELL"), F.count(F.lit(1)).alias("N_POINTS"))
    return found.withColumn("N_CELLS", F.size("CELL_SET").cast("long")).where(F.col("N_CELLS") >= least_cells)


def cell_changes(points: DataFrame, size_m: float) -> DataFrame:
    """The first passage of each trajectory from a cell to another: last point in the old one, first in the new."""
    w = Window.partitionBy(UID).orderBy(AT)
    rows = points.select(UID, USER, AT, "LATITUDE", "LONGITUDE", cell_id(F.col("LATITUDE"), F.col("LONGITUDE"), size_m).alias("TO_CELL"))
    rows = rows.withColumn("FROM_CELL", F.lag("TO_CELL").over(w)).withColumn("FROM_LAT", F.lag("LATITUDE").over(w)).withColumn("FROM_LON", F.lag("LONGITUDE").over(w))
    rows = rows.where("FROM_CELL <> TO_CELL")
    first = F.min_by(F.struct("FROM_LAT", "FROM_LON", F.col("LATITUDE").alias("TO_LAT"), F.col("LONGITUDE").alias("TO_LON")), AT)
    return rows.groupBy(UID, USER, "FROM_CELL", "TO_CELL").agg(first.alias("x")).select(UID, USER, "FROM_CELL", "TO_CELL", "x.*")


def _segments(changes: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    means = [F.avg(c).alias(c) for c in ("FROM_LAT", "FROM_LON", "TO_LAT", "TO_LON")]
    return changes.groupBy(*keys).agg(*means, F.count_distinct(USER).alias("N_USERS"), F.count_distinct(UID).alias("N_TRAJECTORIES"), *more)


def shared_segments(points: DataFrame, size_m: float = 100.0) -> DataFrame:
    """Directed passages between cells with mean ends, users and trajectories."""
    users = F.array_join(F.array_sort(F.collect_set(USER)), " ").alias("USERS")
    found = _segments(cell_changes(points, size_m), ["FROM_CELL", "TO_CELL"], users)
    return found.withColumn("SEGMENT_ID", F.concat_ws("->", "FROM_CELL", "TO_CELL"))


def weighted_segments(points: DataFrame, clusters: DataFrame, size_m: float = 90.0) -> DataFrame:
    """The same by cluster of the trajectory; -1 for those without one."""
    changes = cell_changes(points, size_m).join(clusters.select(UID, "CLUSTER_ID"), UID, "left")
    changes = changes.withColumn("CLUSTER_ID", F.coalesce("CLUSTER_ID", F.lit(-1)).cast("long"))
    return _segments(changes, ["FROM_CELL", "TO_CELL", "CLUSTER_ID"])


def corridor_edges(points: DataFrame, size_m: float = 30.0, least_m: float = 10.0, most_m: float = 1000.0) -> DataFrame:
    """``edge, weight``: undirected steps between snapped cells, counted once a trajectory. The grid follows the mean latitude."""
    ref = points.agg(F.avg("LATITUDE").alias("ref_lat"))
    w = Window.partitionBy(UID).orderBy(AT)
    rows = points.select(UID, AT, "LATITUDE", "LONGITUDE", F.lead("LATITUDE").over(w).alias("lat2"), F.lead("LONGITUDE").over(w).alias("lon2"))
    rows = rows.where(haversine(F.col("LATITUDE"), F.col("LONGITUDE"), F.col("lat2"), F.col("lon2")).between(least_m, most_m)).crossJoin(F.broadcast(ref))  # one row
    a, b = snap_grid(F.col("LATITUDE"), F.col("LONGITUDE"), size_m, F.col("ref_lat")), snap_grid(F.col("lat2"), F.col("lon2"), size_m, F.col("ref_lat"))
    rows = rows.select(UID, a.alias("a"), b.alias("b")).where("a <> b").select(UID, edge_key(F.col("a"), F.col("b")).alias("edge")).distinct()
    return rows.groupBy("edge").agg(F.count(F.lit(1)).alias("weight"))


def segment_edges(segments: DataFrame) -> DataFrame:
    """``edge, weight`` of legacy segments (lat1, lon1, lat2, lon2, weight): ends to 8 places, no loops, largest weight."""
    def end(k: int) -> Column:
        return F.struct(F.round(f"lat{k}", 8).alias("lat"), F.round(f"lon{k}", 8).alias("lon"))

    rows = segments.select(end(1).alias("a"), end(2).alias("b"), "weight").where("a <> b")
    return rows.groupBy(edge_key(F.col("a"), F.col("b")).alias("edge")).agg(F.max("weight").alias("weight"))
