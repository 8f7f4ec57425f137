"""Staypoints and trips: the sequential kernel, and what follows from it.

Points have no null coordinate or time (cleaning drops these). Rows that tie in
their order come in any order; a user of one point has one trip and no stay; no
points, no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M
from ..plans.numbering import numbered
from .sequence import every_kth, presample, trim_zones

STAY_M, STAY_S, TRIP_ROWS, MERGE_M = 50.0, 600.0, 10, 100.0


def _metres(lat1, lon1, lat2, lon2):
    """The great-circle distance of ``functions.geo.haversine`` on numpy arrays."""
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


def stay_ends(lat: np.ndarray, lon: np.ndarray, time_s: np.ndarray, radius_m: float, least_s: float) -> np.ndarray:
    """For each row the end of the stay that it would begin, or -1.

    The rows after a row are followed until one is out of the radius (no stay)
    or late enough (a stay). All rows look one row further at once, and drop
    out when they are decided, so times may go back and gaps may be any.
    """
    ends = np.full(len(lat), -1, dtype=np.int64)
    open_ = np.arange(len(lat) - 1)
    step = 1
    while len(open_):
        then = open_ + step
        near = _metres(lat[open_], lon[open_], lat[then], lon[then]) <= radius_m
        late = near & (time_s[then] - time_s[open_] >= least_s)
        ends[open_[late]] = then[late]
        step += 1
        open_ = open_[near & ~late]
        open_ = open_[open_ + step < len(lat)]
    return ends


def stay_spans(lat: np.ndarray, lon: np.ndarray, time_s: np.ndarray, radius_m: float, least_s: float) -> list[tuple[int, int]]:
    """(anchor, end) of each staypoint, first come first served: the next anchor follows a stay's end."""
    ends = stay_ends(lat, lon, time_s, radius_m, least_s)
    spans, free = [], 0
    for i in np.flatnonzero(ends >= 0).tolist():  # only rows that begin a stay
        if i >= free:
            spans.append((i, int(ends[i])))
            free = int(ends[i]) + 1
    return spans


_TRIP = "TRIP_NO long, STAY_NO long"


def segment_trips(points: DataFrame, user: str, at: str, time_s: str, radius_m: float = STAY_M, least_s: float = STAY_S) -> DataFrame:
    """``points`` with ``TRIP_NO`` and ``STAY_NO`` (1-based, either may be null), one Arrow batch a user.

    A stay covers its anchor to its end. The anchor is also the last row of the
    trip before; the rows after it up to the end belong to no trip. Trips are
    numbered with all their rows, short ones included; ``keep_trips`` drops
    those. A row of equal times keeps the order of ``at``.
    """

    names, place = points.columns, [points.columns.index(c) for c in (at, "LATITUDE", "LONGITUDE", time_s)]

    def kernel(rows: pa.Table) -> pa.Table:  # the other columns pass by as they are
        order = pc.sort_indices(rows.column(place[0]))
        rows = rows.take(order)
        lat, lon, time = (rows.column(k).to_numpy().astype(np.float64) for k in place[1:])
        spans = stay_spans(lat, lon, time, radius_m, least_s)
        trip, stay = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        begin = 0
        for k, (i, j) in enumerate(spans, 1):
            trip[begin : i + 1] = k
            stay[i : j + 1] = k
            begin = j + 1
        trip[begin:] = len(spans) + 1
        return pa.table([*rows.columns, pa.array(trip, mask=trip == 0), pa.array(stay, mask=stay == 0)], names=[*names, "TRIP_NO", "STAY_NO"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.groupBy(user).applyInArrow(kernel, f"{fields}, {_TRIP}")


def staypoints(segmented: DataFrame, user: str, time_s: str) -> DataFrame:
    """``user, STAY_NO, latitude, longitude, start_s, end_s, duration_min`` of each stay."""
    stays = segmented.where("STAY_NO is not null").groupBy(user, "STAY_NO")
    return stays.agg(F.avg("LATITUDE").alias("latitude"), F.avg("LONGITUDE").alias("longitude"), F.min(time_s).alias("start_s"), F.max(time_s).alias("end_s"), ((F.max(time_s) - F.min(time_s)) / 60).alias("duration_min"))


def merge_staypoints(stays: DataFrame, user: str, order: str = "STAY_NO", within_m: float = MERGE_M) -> DataFrame:
    """``user, place, latitude, longitude, count``: each stay joins the first place whose running centre is near, or founds one."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        places: list[list[float]] = []
        for lat, lon in zip(frame["latitude"], frame["longitude"], strict=True):
            for place in places:
                if _metres(place[0], place[1], lat, lon) <= within_m:
                    n = place[2]
                    place[0], place[1], place[2] = (place[0] * n + lat) / (n + 1), (place[1] * n + lon) / (n + 1), n + 1
                    break
            else:
                places.append([lat, lon, 1])
        return pd.DataFrame([(frame[user].iloc[0], k, a, b, int(n)) for k, (a, b, n) in enumerate(places, 1)], columns=[user, "place", "latitude", "longitude", "count"])

    kind = stays.schema[user].dataType.simpleString()
    return stays.groupBy(user).applyInPandas(fold, f"`{user}` {kind}, place long, latitude double, longitude double, count long")


def refine(segmented: DataFrame, user: str, at: str, radius_m: float = 100.0, step: int = 1, least: int = TRIP_ROWS) -> DataFrame:
    """Refined points: trips of ``least`` rows, trimmed, of ``least`` rows still, thinned and renumbered from 1."""
    trip = Window.partitionBy(user, "TRIP_NO")
    rows = segmented.where("TRIP_NO is not null").withColumn("n_", F.count(F.lit(1)).over(trip)).where(F.col("n_") >= least)
    rows = trim_zones(rows, [user, "TRIP_NO"], at, radius_m).withColumn("n_", F.count(F.lit(1)).over(trip)).where(F.col("n_") >= least).drop("n_", "STAY_NO")
    if step > 1:
        rows = every_kth(rows, [user, "TRIP_NO"], at, step)
    rows = rows.withColumn("TRAJECTORY_ID", F.dense_rank().over(Window.partitionBy(user).orderBy("TRIP_NO")).cast("long"))
    rows = rows.withColumn("TRAJECTORY_UID", F.concat_ws("_", F.col(user), F.col("TRAJECTORY_ID")))
    return rows.withColumn("POINT_INDEX", (F.row_number().over(trip.orderBy(at)) - 1).cast("long")).drop("TRIP_NO")


def global_ids(refined: DataFrame, source: str, trip: str = "TRAJECTORY_ID") -> DataFrame:
    """``refined`` with ``GLOBAL_TRAJECTORY_ID``: trips numbered from 1 by source file, then trip."""
    trips = refined.groupBy(source, trip).agg(F.count(F.lit(1)).alias("rows_"))
    ids = numbered(trips, [F.col(source), F.col(trip)], "place_").withColumn("GLOBAL_TRAJECTORY_ID", F.col("place_") + 1)
    return refined.join(ids.drop("place_", "rows_"), [source, trip]).select(*refined.columns, "GLOBAL_TRAJECTORY_ID")


COUNTS = ["valid_points", "points_after_presampling", "presampling_removed_points", "trajectory_segments", "trajectories_kept", "staypoints", "merged_staypoints", "refined_points"]


def file_stats(points: DataFrame, thinned: DataFrame, segmented: DataFrame, refined: DataFrame, places: DataFrame, user: str, bad_files: DataFrame | None = None) -> DataFrame:
    """``user, source_file``, how many rows, stays and trips each step leaves (zeros where nothing is left), and ``error``, empty for files that could be read.

    ``bad_files`` (user, source_file, error) are added with zeros. A user's file
    is called as the user if the points do not name it.
    """
    def count(rows: DataFrame, name: str, what: str = "*") -> DataFrame:
        return rows.groupBy(user).agg((F.count(F.lit(1)) if what == "*" else F.count_distinct(what)).alias(name))

    trips = segmented.where("TRIP_NO is not null").groupBy(user, "TRIP_NO").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= TRIP_ROWS)
    file = F.min("SOURCE_FILE") if "SOURCE_FILE" in points.columns else F.concat(F.first(user), F.lit(".csv"))
    found = points.groupBy(user).agg(file.alias("source_file"), F.count(F.lit(1)).alias("valid_points"))
    for part in (count(thinned, "points_after_presampling"), count(trips, "trajectory_segments"), count(refined, "trajectories_kept", "TRAJECTORY_ID"), count(segmented, "staypoints", "STAY_NO"), count(places, "merged_staypoints"), count(refined, "refined_points")):
        found = found.join(part, user, "left")
    found = found.na.fill(0).withColumn("presampling_removed_points", F.col("valid_points") - F.col("points_after_presampling"))
    found = found.select(user, "source_file", *COUNTS, F.lit("").alias("error"))
    if bad_files is None:
        return found
    return found.unionAll(bad_files.select(user, "source_file", *[F.lit(0).cast("long").alias(c) for c in COUNTS], "error"))


def refine_users(points: DataFrame, user: str = "USER_ID", at: str = "SEQ", time_s: str = "EPOCH_S", step: int = 1) -> DataFrame:
    """Raw points to refined points: thin, segment, trim, sample and number."""
    return refine(segment_trips(presample(points, [user], at, time_s), user, at, time_s), user, at, step=step)
