"""Whole jobs from files to tables, with the settings that each mode uses by default.

``python -m tracewright.plans.jobs refine --input raw/ --output out/`` and so on;
every job writes Parquet, or CSV with ``--format csv``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import corridors as co
from ..operators import features as fe
from ..operators import profiles as pr
from ..operators import selection as se
from ..operators import sequence as sq
from ..operators import similarity as si
from ..operators import trips as tr
from ..sources import csv as src
from .storage import drop_stored, stored

#: Defaults of the general, focused, flow and corridor modes.
GENERAL = {"cell_m": 500, "threshold": 0.45, "min_shared": 3, "least_cells": 2, "same_ends": True}
FOCUSED = {"cell_m": 350, "threshold": 0.42, "min_shared": 5, "least_cells": 4, "same_ends": False}
SEGMENT_M, FOCUSED_SEGMENT_M, CORRIDOR_M = 100, 90, 30
STUDY = [0.25, 0.30, 0.35, 0.38, 0.40, 0.42, 0.45, 0.48, 0.50, 0.55, 0.60]


def refine_files(spark: SparkSession, path: str, step: int = 5, first_files: int | None = None) -> dict[str, DataFrame]:
    """Raw per-user files to refined points and per-file statistics; files that cannot be used are named there."""
    raw, bad = src.read_points_of_good_files(spark, src.input_paths(spark, path), first_files=first_files)
    raw = src.clean_points(raw)
    order = F.struct("DATETIME", "LATITUDE", "LONGITUDE")
    numbered = raw.withColumn("SEQ", F.row_number().over(sq.Window.partitionBy("USER_ID").orderBy(order)).cast("long"))
    points = numbered.withColumn("EPOCH_S", F.unix_micros(F.col("DATETIME").cast("timestamp")) / 1e6)
    points = stored(points, "points")
    thin = sq.presample(points, ["USER_ID"], "SEQ", "EPOCH_S")
    segmented = stored(tr.segment_trips(thin, "USER_ID", "SEQ", "EPOCH_S"), "segmented")
    places = tr.merge_staypoints(tr.staypoints(segmented, "USER_ID", "EPOCH_S"), "USER_ID")
    refined = stored(tr.refine(segmented, "USER_ID", "SEQ", step=step), "refined")
    stats = tr.file_stats(points, thin, segmented, refined, places, "USER_ID", bad)
    return {"refined": tr.global_ids(refined, "SOURCE_FILE").drop("SEQ", "EPOCH_S"), "file_stats": stats, "places": places}


def cluster_points(points: DataFrame, cell_m: float, threshold: float, min_shared: int, least_cells: int, same_ends: bool) -> dict[str, DataFrame]:
    features = stored(fe.trajectory_features(points, cell_m, least_cells), "features")
    clusters = stored(si.cluster_trajectories(features, threshold, min_shared, same_ends), "clusters")
    summary = si.cluster_summary(clusters)
    return {"features": features, "clusters": clusters, "cluster_summary": summary, "top_clusters": se.top_clusters(summary), "map_trajectories": se.balanced_pick(clusters)}


def general_clustering(spark: SparkSession, path: str, individuals: str | None = None) -> dict[str, DataFrame]:
    """Clusters by cells within common ends, overall and by profile."""
    out = cluster_points(src.read_refined(spark, src.input_paths(spark, path)), **GENERAL)
    if individuals:
        people = src.read_individuals(spark, individuals)
        criteria = [c for c in ("SEX", "AGE_GROUP", "NAVIGO_SUB", "DRIVING_LICENCE", "NB_CAR", "AREA_NAME") if c in people.columns]
        profile = stored(pr.profile_clusters(out["features"], people, criteria), "profile-clusters")
        out |= {"profile_clusters": profile, "profile_cluster_summary": pr.profile_cluster_summary(profile)}
    return out


def focused_clustering(spark: SparkSession, path: str, individuals: str | None = None, target_users: int = 200) -> dict[str, DataFrame]:
    """One zone's users: their clusters, weighted segments, medoids and profiles."""
    everything = src.read_refined(spark, src.input_paths(spark, path))
    users = stored(pr.zone_selection(pr.user_summary(everything), target_users), "zone-users")
    points = stored(everything.join(F.broadcast(users.select("USER_ID")), "USER_ID", "left_semi"), "zone-points")  # target_users rows
    out = {"selected_users": users} | cluster_points(points, **FOCUSED)
    out |= {"weighted_segments": fe.weighted_segments(points, out["clusters"], FOCUSED_SEGMENT_M), "medoids": si.medoids(out["clusters"])}
    shown = points.join(out["medoids"].select("TRAJECTORY_UID"), "TRAJECTORY_UID", "left_semi")
    out["medoid_lines"] = src.layer(se.render_points(shown, ["TRAJECTORY_UID"], "POINT_INDEX", 5), "TRAJECTORY_UID", "POINT_INDEX")
    if individuals:
        profiles = pr.user_profiles(users, src.read_individuals(spark, individuals).drop("AGE_GROUP"), None)
        out["profile_summary"] = pr.profile_summary(points, profiles)
    return out


def shared_flow(spark: SparkSession, path: str, min_users: int = 2, min_trajectories: int = 2) -> dict[str, DataFrame]:
    """Directed passages that enough users and trajectories share."""
    segments = fe.shared_segments(src.read_refined(spark, src.input_paths(spark, path)), SEGMENT_M)
    return {"shared_segments": segments.where((F.col("N_USERS") >= min_users) & (F.col("N_TRAJECTORIES") >= min_trajectories))}


def common_corridors(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Continuous corridors with their measures, and those that a map shows."""
    points = src.read_refined(spark, src.input_paths(spark, path))
    edges = stored(fe.corridor_edges(points, CORRIDOR_M), "edges")
    ref = points.agg(F.avg("LATITUDE").alias("ref_lat"))
    rows = co.corridors(edges).crossJoin(F.broadcast(ref))  # one row
    rows = rows.withColumn("coords", F.transform("cells", lambda c: geo.grid_node(c, CORRIDOR_M, F.col("ref_lat")))).drop("ref_lat", "cells")
    rows = stored(co.corridor_metrics(rows), "corridors")
    shown = co.without_overlap(rows.where(co.touches_region(F.col("coords"))).withColumn("shown", co.display_cells(F.col("coords"))), cells="shown")
    packed = [F.array_join(F.transform(f"coords.{axis}", lambda x: x.cast("string")), ";").alias(name) for axis, name in (("lat", "latitudes"), ("lon", "longitudes"))]
    return {"corridors": rows.select("*", *packed).drop("coords"), "map_corridors": shown.select("corridor_id")}


def corridor_report(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Corridors read back from a table, with the measures that it lacks and the intensities of the map."""
    return {"corridor_report": co.corridor_view(src.read_corridors(spark, path), 0.0, 0.0).drop("coords")}


def segment_corridors(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Edges of legacy segment files."""
    return {"segment_edges": src.read_segment_edges(spark, path).select("edge.a.lat", "edge.a.lon", F.col("edge.b.lat").alias("lat2"), F.col("edge.b.lon").alias("lon2"), "weight")}


def threshold_study(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """How clusters depend on the similarity threshold, from a table of trajectory features."""
    return {"threshold_study": si.threshold_sweep(stored(src.read_features(spark, path), "features"), STUDY, FOCUSED["min_shared"])}


JOBS = {"refine": refine_files, "general": general_clustering, "focused": focused_clustering, "flow": shared_flow, "corridors": common_corridors, "report": corridor_report, "segments": segment_corridors, "study": threshold_study}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("job", choices=sorted(JOBS))
    parser.add_argument("--input", required=True)
    parser.add_argument("--individuals")
    parser.add_argument("--output", required=True)
    parser.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    given = parser.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    more = {"individuals": given.individuals} if given.individuals else {}
    for name, table in JOBS[given.job](spark, given.input, **more).items():
        src.write_table(table, f"{given.output.rstrip('/')}/{name}", given.format)
    drop_stored(spark)


if __name__ == "__main__":
    main()
