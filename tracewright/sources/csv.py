"""CSV sources with declared columns, and the sinks that match them."""

from __future__ import annotations

import csv
import re
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import REGION, in_box
from ..functions.labels import age_group
from ..operators.corridors import corridor_metrics, parse_coordinates
from ..operators.features import segment_edges
from ..operators.sequence import adaptive_sample

POINT_COLUMNS = {"USER_ID": "string", "SOURCE_FILE": "string", "TRAJECTORY_ID": "bigint", "TRAJECTORY_UID": "string", "POINT_INDEX": "bigint", "LATITUDE": "double", "LONGITUDE": "double", "DATETIME": "timestamp_ntz"}
NEEDED = ("USER_ID", "TRAJECTORY_UID", "LATITUDE", "LONGITUDE")
INDIVIDUAL_COLUMNS = {"ID": "string", "SEX": "string", "AGE": "double", "NAVIGO_SUB": "string", "DRIVING_LICENCE": "string", "NB_CAR": "double", "AREA_NAME": "string", "BIKE": "string", "TWO_WHEELER": "string"}
SEGMENT_COLUMNS = {"lat1": "double", "lon1": "double", "lat2": "double", "lon2": "double", "weight": "double"}
CORRIDOR_COLUMNS = {"corridor_id": "bigint", "weight_mean": "double", "weight_max": "bigint", "weight_min": "bigint", "length_cells": "bigint", "display_score": "double", "length_km": "double", "direct_distance_km": "double", "sinuosity": "double", "latitudes": "string", "longitudes": "string"}
FEATURE_COLUMNS = {"TRAJECTORY_UID": "string", "USER_ID": "string", "N_POINTS": "bigint", "N_CELLS": "bigint", "START_CELL": "string", "END_CELL": "string", "CELL_SEQUENCE": "string", "CELL_SET": "string"}


def input_paths(spark: SparkSession, path: str) -> list[str]:
    """A file, a folder's ``*.csv`` files, or ``path + .csv``, in any store that Spark reads; sorted."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(hadoop):
        if fs.getFileStatus(hadoop).isDirectory():
            found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/*.csv"))
            return sorted(str(s.getPath().toString()) for s in found)
        return [path]
    if fs.exists(jvm.org.apache.hadoop.fs.Path(path + ".csv")):
        return [path + ".csv"]
    raise FileNotFoundError(path)


def read_columns(spark: SparkSession, paths: str | list[str], wanted: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """The wanted columns that a CSV has, with the declared types; text that does not parse is null. A byte order mark is dropped."""
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(paths)
    names = {c.lstrip("﻿"): c for c in raw.columns}
    if missing := [c for c in required if c not in names]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return raw.select(*[F.col(f"`{names[c]}`").try_cast(kind).alias(c) for c, kind in wanted.items() if c in names])


def _files(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """All files of paths, folders and patterns, sorted."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for path in [paths] if isinstance(paths, str) else paths:
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(conf)
        for status in fs.globStatus(hadoop) or []:
            inner = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
            found += [s.getPath().toString() for s in inner if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    if not found:
        raise FileNotFoundError(str(paths))
    return sorted(found)


def _header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The names in a CSV's first line; none if it is empty. A byte order mark is dropped."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    stream = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(hadoop)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
    try:
        line = reader.readLine()
    finally:
        reader.close()
    return tuple(next(csv.reader([line.lstrip("\ufeff")]), ())) if line else ()


def scan_files(spark: SparkSession, paths: str | list[str], needed: tuple[str, ...], first_files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Text rows of CSVs with ``USER_ID`` (the file's stem) and ``SOURCE_FILE``, and ``USER_ID, source_file, error`` of those that cannot be used.

    Only headers, one line a file, are read on the driver. Files of one header
    are read together, so each value lands in the column that its file names;
    columns that a file lacks are null. Files without the ``needed`` columns, or
    whose header cannot be read, are left out and named, not fatal. Optionally
    only the first files by name.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    bad: list[tuple[str, str, str]] = []
    files = _files(spark, paths)[:first_files]
    with ThreadPoolExecutor(16) as pool:
        for path, header in zip(files, pool.map(lambda p: _tried(spark, p), files), strict=True):
            name = path.rsplit("/", 1)[-1]
            lacks = [c for c in needed if c not in header] if isinstance(header, tuple) else []
            if isinstance(header, str) or lacks or len(set(header)) < len(header):
                bad.append((re.sub(r"\.csv$", "", name), name, header if isinstance(header, str) else f"missing columns: {', '.join(lacks)}" if lacks else "repeated columns"))
            else:
                groups.setdefault(header, []).append(path)
    rows = None
    for header, own in sorted(groups.items()):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        part = spark.read.schema(schema).option("header", True).csv(own).select("*", F.col("_metadata.file_name").alias("SOURCE_FILE"))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    if rows is None:
        rows = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in (*needed, "SOURCE_FILE")]))
    rows = rows.withColumn("SOURCE_FILE", F.replace(F.col("SOURCE_FILE"), F.lit("%20"), F.lit(" ")))
    rows = rows.withColumn("USER_ID", F.regexp_extract("SOURCE_FILE", r"^(.*)\.csv$", 1))
    return rows, spark.createDataFrame(bad, "USER_ID string, source_file string, error string")


def _tried(spark: SparkSession, path: str) -> tuple[str, ...] | str:
    try:
        return _header(spark, path)
    except (Py4JJavaError, csv.Error) as error:
        return str(error).splitlines()[0]


def _coordinates(raw: DataFrame) -> DataFrame:
    return raw.withColumns({c: F.col(c).try_cast("double") for c in ("LATITUDE", "LONGITUDE")})


def read_raw_points(spark: SparkSession, paths: str | list[str], first_files: int | None = None) -> DataFrame:
    """Raw points of per-user files with ``USER_ID`` (the file's stem) and ``SOURCE_FILE``; optionally of the first files by name.

    Every file has to name its coordinates: others raise an error that names them.
    """
    raw, bad = scan_files(spark, paths, ("LATITUDE", "LONGITUDE"), first_files)
    if wrong := bad.collect():
        raise ValueError("; ".join(f"{r['source_file']}: {r['error']}" for r in wrong))
    return _coordinates(raw)


def read_points_of_good_files(spark: SparkSession, paths: str | list[str], needed: tuple[str, ...] = ("LATITUDE", "LONGITUDE"), first_files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The same, and a table of the files that were skipped for want of ``needed`` columns."""
    raw, bad = scan_files(spark, paths, needed, first_files)
    return _coordinates(raw), bad


def clean_points(raw: DataFrame, box: tuple[float, float, float, float] = REGION) -> DataFrame:
    """Points with coordinates inside the box and a time that parses (UTC columns if there, else local), as ``DATETIME``."""
    kind = next((k for k in ("UTC", "LOCAL") if {f"{k}_DATE", f"{k}_TIME"} <= set(raw.columns)), None)
    if kind is None:
        raise ValueError("neither UTC_DATE and UTC_TIME nor LOCAL_DATE and LOCAL_TIME are there")
    lat, lon = F.col("LATITUDE"), F.col("LONGITUDE")
    good = lat.isNotNull() & lon.isNotNull() & in_box(lat, lon, (-90.0, 90.0, -180.0, 180.0)) & in_box(lat, lon, box)
    when = F.concat(f"{kind}_DATE", F.lit(" "), f"{kind}_TIME").try_cast("timestamp_ntz")  # local times have no gaps
    return raw.where(good).withColumn("DATETIME", when).where("DATETIME is not null")


def read_refined(spark: SparkSession, paths: str | list[str], first_trajectories: int | None = None) -> DataFrame:
    """Refined points with what is needed there; optionally of the first trajectories by id."""
    points = read_columns(spark, paths, POINT_COLUMNS, NEEDED).dropna(subset=list(NEEDED))
    if first_trajectories is None:
        return points
    chosen = points.select("TRAJECTORY_UID").distinct().orderBy("TRAJECTORY_UID").limit(first_trajectories)
    return points.join(F.broadcast(chosen), "TRAJECTORY_UID", "left_semi")


def read_individuals(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    people = read_columns(spark, paths, INDIVIDUAL_COLUMNS, ("ID",))
    return people.withColumn("AGE_GROUP", age_group(F.col("AGE"))) if "AGE" in people.columns else people


def read_segment_edges(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``edge, weight`` of legacy segment files; rows with an end or weight that is no number are left out."""
    rows = read_columns(spark, paths, SEGMENT_COLUMNS, tuple(SEGMENT_COLUMNS)).dropna()
    return segment_edges(rows.withColumn("weight", F.col("weight").cast("bigint")))


def read_corridors(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Corridors as the corridor job writes them, with ``coords``; measures that a file lacks are computed."""
    rows = read_columns(spark, paths, CORRIDOR_COLUMNS, ("corridor_id", "latitudes", "longitudes", "weight_mean"))
    rows = rows.withColumn("coords", parse_coordinates(F.col("latitudes"), F.col("longitudes"))).drop("latitudes", "longitudes")
    measures = {"length_km", "direct_distance_km", "sinuosity"}
    return rows if measures <= set(rows.columns) else corridor_metrics(rows.drop(*measures))


def read_numbers(spark: SparkSession, paths: str | list[str], kinds: dict[str, str], most: int | None = None) -> DataFrame:
    """Columns of a report table: ``kinds`` as numbers, 0 where the text is none, all others as text; optionally the first rows."""
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(paths)
    rows = raw.select(*[(number_or_zero(F.col(f"`{c}`"), kinds[n]) if (n := c.lstrip("\ufeff")) in kinds else F.col(f"`{c}`")).alias(n) for c in raw.columns])
    return rows if most is None else rows.withColumn("row_", F.monotonically_increasing_id()).orderBy("row_").limit(most).drop("row_")


def read_features(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Trajectory features with the packed cell columns as arrays."""
    rows = read_columns(spark, paths, FEATURE_COLUMNS, ("TRAJECTORY_UID", "CELL_SET"))
    for name in ("CELL_SEQUENCE", "CELL_SET"):
        if name in rows.columns:
            rows = rows.withColumn(name, unpack(F.col(name)))
    return rows


def unpack(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")


def number_or_zero(column: Column, kind: str = "double") -> Column:
    """Text as a number, 0 if it is none; whole numbers go over double."""
    value = column.try_cast("double")
    return F.coalesce(value.try_cast("bigint") if kind == "bigint" else value, F.lit(0).cast(kind))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", order: list[str] | None = None) -> None:
    """Parquet as it is; CSV with a header and arrays joined by spaces."""
    if order:
        df = df.orderBy(*order)
    if fmt == "csv":
        df = df.select(*[F.array_join(f.name, " ").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema.fields])
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)


def layer(points: DataFrame, key: str, at: str) -> DataFrame:
    """``key, geometry``: a GeoJSON line string for each key, for any map renderer."""
    order = F.array_sort(F.collect_list(F.struct(at, F.array("LONGITUDE", "LATITUDE").alias("p"))))
    line = F.struct(F.lit("LineString").alias("type"), F.transform(order, lambda x: x["p"]).alias("coordinates"))
    return points.groupBy(key).agg(F.to_json(line).alias("geometry"))


def demo_points(points: DataFrame, users: DataFrame, target: int = 80) -> DataFrame:
    """Points of selected users thinned to about ``target`` a trajectory."""
    return adaptive_sample(points.join(users.select("USER_ID"), "USER_ID", "left_semi"), ["TRAJECTORY_UID"], "POINT_INDEX", target)
