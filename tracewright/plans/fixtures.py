"""GPS-shaped views over the events table, as one SQL text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GPS = """
SELECT CAST(user_id AS STRING) AS USER_ID, rn AS SEQ, eff * 120 + (rn - eff) AS EPOCH_S, event_id AS EVENT_ID,
  CAST(48830000 + route * 6000 + (mv + shift * 2) * 1200 + ((event_id * 7919) % 11) - 5 AS DOUBLE) / CAST(1000000 AS DOUBLE) AS LATITUDE,
  CAST(2300000 + route * 9000 + CASE WHEN mv % 24 > 13 THEN branch * 6000 ELSE 0 END + ((event_id * 104729) % 11) - 5 AS DOUBLE) / CAST(1000000 AS DOUBLE) AS LONGITUDE
FROM (
  SELECT user_id, event_id, rn, eff, CAST(floor(eff / 30) AS BIGINT) * 24 + least(eff % 30, CAST(23 AS BIGINT)) AS mv,
    user_id % 6 AS route, CAST(floor(user_id / 6) AS BIGINT) % 5 AS shift, CAST(floor(user_id / 30) AS BIGINT) % 3 AS branch
  FROM (
    SELECT user_id, event_id, rn, CASE WHEN rn % 7 = 3 THEN rn - 1 ELSE rn END AS eff
    FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS rn FROM events) o) p) m"""

#: Trips of 30 ticks each, numbered by user: points as refinement leaves them.
TRIPS = f"""
SELECT USER_ID, concat(USER_ID, '.csv') AS SOURCE_FILE, CAST(floor(SEQ / 30) AS BIGINT) + 1 AS TRAJECTORY_ID,
  concat(USER_ID, '_', CAST(CAST(floor(SEQ / 30) AS BIGINT) + 1 AS STRING)) AS TRAJECTORY_UID, SEQ % 30 AS POINT_INDEX, EPOCH_S, LATITUDE, LONGITUDE
FROM ({GPS}) g"""

INDIVIDUALS = """
SELECT CAST(user_id AS STRING) AS ID, CASE WHEN user_id % 2 = 0 THEN 'Man' ELSE 'Woman' END AS SEX,
  CASE WHEN user_id % 11 = 0 THEN NULL ELSE 15 + (user_id * 7) % 60 END AS AGE, user_id % 4 AS NB_CAR,
  CASE user_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS NAVIGO_SUB,
  CASE user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'no' ELSE 'yes' END AS DRIVING_LICENCE
FROM (SELECT DISTINCT user_id FROM events) u"""

DISPLACEMENTS = """
SELECT CAST(user_id AS STRING) AS ID, event_type AS Main_Mode, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS POS
FROM events"""

#: Raw rows with the faults that cleaning has to meet, each marked by the event id.
DIRTY = f"""
SELECT USER_ID, SEQ,
  CASE WHEN EVENT_ID % 17 = 0 THEN NULL WHEN EVENT_ID % 17 = 1 THEN 91.0 ELSE LATITUDE END AS LATITUDE,
  CASE WHEN EVENT_ID % 17 = 2 THEN 10.0 ELSE LONGITUDE END AS LONGITUDE,
  CASE WHEN EVENT_ID % 17 = 3 THEN 'never' ELSE '2022-10-17' END AS UTC_DATE,
  concat(lpad(CAST(6 + CAST(floor((EPOCH_S % 36000) / 3600) AS BIGINT) AS STRING), 2, '0'), ':', lpad(CAST(CAST(floor((EPOCH_S % 3600) / 60) AS BIGINT) AS STRING), 2, '0'), ':00') AS UTC_TIME
FROM ({GPS}) g"""


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(text.replace("FROM events", "FROM {events}"), events=events)


def duck(text: str) -> str:
    """The same view for DuckDB, in parentheses."""
    return "(" + text.replace("AS STRING", "AS VARCHAR") + ")"


def gps_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, GPS).drop("EVENT_ID")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TRIPS)


def individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, INDIVIDUALS)


def displacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, DISPLACEMENTS)
