"""Users by profile: dimensions, dominant modes, zones and summaries.

A null dimension is the value Unknown where it is labelled, and the text ``nan``
in clusters by value, which summaries leave out. Null ids and modes are left out;
users that the individuals repeat have a profile for each. Ties are said with
each operator. No users give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import cell_id, mean_degrees
from ..functions.labels import UNKNOWN, age_group, bool_label, nb_car_group
from ..plans.storage import stored
from .selection import top_within
from .similarity import cluster_summary, medoids, number_clusters, similar_components

CRITERIA = ["SEX", "AGE_GROUP", "NAVIGO_SUB", "DRIVING_LICENCE", "NB_CAR_GROUP", "DOMINANT_MODE"]
BOOLEANS = ["NAVIGO_SUB", "DRIVING_LICENCE", "BIKE", "TWO_WHEELER"]
ZONE_SIZES = [4000, 5000, 6000, 8000, 10000, 12000, 16000]


def dominant_mode(displacements: DataFrame, order: str = "POS") -> DataFrame:
    """``ID, DOMINANT_MODE``: the most frequent mode; of equals the one that appears first."""
    counts = displacements.where("ID is not null and Main_Mode is not null").groupBy("ID", "Main_Mode").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counts.groupBy("ID").agg(F.max_by("Main_Mode", F.struct("n", -F.col("first"))).alias("DOMINANT_MODE"))


def user_profiles(users: DataFrame, individuals: DataFrame, displacements: DataFrame | None) -> DataFrame:
    """Selected users with their groups and labels; columns that individuals lack are unknown or absent."""
    rows = users.select("USER_ID").join(individuals, F.col("USER_ID") == F.col("ID"), "left")
    rows = rows.withColumn("AGE_GROUP", age_group(F.col("AGE")) if "AGE" in rows.columns else F.lit(UNKNOWN))
    rows = rows.withColumn("NB_CAR_GROUP", nb_car_group(F.col("NB_CAR")) if "NB_CAR" in rows.columns else F.lit(UNKNOWN))
    for name in BOOLEANS:
        if name in rows.columns:
            rows = rows.withColumn(name, bool_label(F.col(name)))
    if displacements is None:
        return rows.withColumn("DOMINANT_MODE", F.lit(UNKNOWN))
    modes = dominant_mode(displacements).withColumnRenamed("ID", "ID_MODE")
    return rows.join(modes, F.col("USER_ID") == F.col("ID_MODE"), "left").withColumn("DOMINANT_MODE", F.coalesce("DOMINANT_MODE", F.lit(UNKNOWN)))


def by_criterion(profiles: DataFrame, criteria: list[str] | None = None) -> DataFrame:
    """``CRITERION, VALUE, USER_ID``: one row a user and criterion; null values stay."""
    present = [c for c in criteria or CRITERIA if c in profiles.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("CRITERION"), F.col(c).cast("string").alias("VALUE")) for c in present])
    return profiles.select("USER_ID", F.explode(pairs).alias("x")).select("x.CRITERION", "x.VALUE", "USER_ID")


def profile_summary(points: DataFrame, profiles: DataFrame, min_users: int = 7, min_trajectories: int = 10) -> DataFrame:
    """Users, trajectories and points of each criterion's value. Points are counted by trajectory before they meet the profiles."""
    stacked = by_criterion(profiles)
    users = stacked.groupBy("CRITERION", "VALUE").agg(F.count_distinct("USER_ID").alias("N_USERS"))
    trips = points.groupBy("USER_ID", "TRAJECTORY_UID").agg(F.count(F.lit(1)).alias("n"))
    used = stacked.distinct().join(trips, "USER_ID").groupBy("CRITERION", "VALUE").agg(F.count_distinct("TRAJECTORY_UID").alias("N_TRAJECTORIES"), F.sum("n").alias("N_POINTS"))
    joined = users.alias("u").join(used.alias("t"), (F.col("u.CRITERION") == F.col("t.CRITERION")) & F.col("u.VALUE").eqNullSafe(F.col("t.VALUE")))
    return joined.where((F.col("N_USERS") >= min_users) & (F.col("N_TRAJECTORIES") >= min_trajectories)).select("u.CRITERION", "u.VALUE", "N_USERS", "N_TRAJECTORIES", "N_POINTS")


def profile_points(points: DataFrame, profiles: DataFrame, criterion: str, value: str | None) -> DataFrame:
    """Points of the users with a value; a null value is asked for by null or the text ``nan``."""
    wanted = F.coalesce(F.col(criterion).cast("string"), F.lit("nan")) == F.lit("nan" if value is None else value)
    return points.join(profiles.where(wanted).select("USER_ID"), "USER_ID", "left_semi")


def profile_clusters(features: DataFrame, individuals: DataFrame, criteria: list[str], threshold: float = 0.45, min_shared: int = 3, same_ends: bool = True, least: int = 10) -> DataFrame:
    """Clusters within each value of each criterion with enough trajectories: one pair join and one components run for all."""
    wide = features.join(individuals, F.col("USER_ID") == F.col("ID"), "left")
    pairs = F.array(*[F.struct(F.lit(c).alias("CRITERION"), F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("CRITERION_VALUE")) for c in criteria])
    rows = wide.select(*[F.col(c) for c in features.columns], F.explode(pairs).alias("x")).select("x.*", *features.columns)
    keys = ["CRITERION", "CRITERION_VALUE"]
    enough = rows.groupBy(*keys).agg(F.count_distinct("TRAJECTORY_UID").alias("n")).where(F.col("n") >= least).select(*keys)
    rows = rows.join(enough, keys, "left_semi")
    bucket = ["START_CELL", "END_CELL"] if same_ends else []
    found = number_clusters(stored(similar_components(rows, threshold, min_shared, keys, bucket), "profile-components"), keys)
    label = F.concat(F.col("CRITERION"), F.lit("="), F.col("CRITERION_VALUE"), F.lit("::"), F.col("CLUSTER_ID"))
    return found.withColumn("PROFILE_CLUSTER_ID", label)


def profile_cluster_summary(clusters: DataFrame) -> DataFrame:
    """Summaries of profile clusters; those of null values are left out."""
    return cluster_summary(clusters.where("CRITERION_VALUE <> 'nan'"), ["CRITERION", "CRITERION_VALUE"])


def profile_representatives(features: DataFrame, profiles: DataFrame, shown: DataFrame, threshold: float = 0.42, min_shared: int = 5, min_users: int = 2, min_trajectories: int = 4, most: int = 2) -> DataFrame:
    """``CRITERION, VALUE, CLUSTER_ID, N_USERS, N_TRAJECTORIES, REPRESENTATIVE``: the best clusters of each value shown, with their medoids.

    ``shown`` (CRITERION, VALUE) are the values of a profile summary; a null
    value is the text ``nan``. Clusters are those of the value's own
    trajectories: one pair join and one components run for all values.
    """
    keys = ["CRITERION", "VALUE"]
    wanted = shown.select("CRITERION", F.coalesce("VALUE", F.lit("nan")).alias("VALUE")).distinct()
    stacked = by_criterion(profiles).select("CRITERION", F.coalesce("VALUE", F.lit("nan")).alias("VALUE"), "USER_ID").distinct().join(wanted, keys)
    rows = features.join(stacked, "USER_ID").select(*keys, *features.columns)
    clusters = stored(number_clusters(stored(similar_components(rows, threshold, min_shared, keys), "profile-components"), keys), "profile-clusters")
    summary = cluster_summary(clusters, keys).where((F.col("N_USERS") >= min_users) & (F.col("N_TRAJECTORIES") >= min_trajectories))
    best = top_within(summary, keys, [F.desc("N_USERS"), F.desc("N_TRAJECTORIES"), F.desc("AVG_CELLS"), F.col("CLUSTER_ID")], most)
    best = stored(best.select(*keys, "CLUSTER_ID", "N_USERS", "N_TRAJECTORIES"), "profile-best")
    medoid = medoids(clusters.join(best.select(*keys, "CLUSTER_ID"), [*keys, "CLUSTER_ID"], "left_semi"), keys)
    return best.join(medoid.select(*keys, "CLUSTER_ID", F.col("TRAJECTORY_UID").alias("REPRESENTATIVE")), [*keys, "CLUSTER_ID"])


def profile_views(records: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked..., SHOWN, lines, trips, most_users``: what a map of profiles shows for each (CRITERION, VALUE) asked for.

    A value without records gives way to the criterion's first; zeros if it has none either.
    """
    values = records.groupBy("CRITERION", F.col("VALUE").alias("SHOWN")).agg(F.count(F.lit(1)).alias("lines"), F.sum("N_TRAJECTORIES").alias("trips"), F.max("N_USERS").alias("most_users"))
    met = asked.alias("a").join(values.alias("v"), "CRITERION", "left")
    found = met.groupBy("CRITERION", F.col("a.VALUE").alias("VALUE")).agg(F.min_by(F.struct("SHOWN", "lines", "trips", "most_users"), F.struct((F.col("SHOWN") != F.col("a.VALUE")).alias("other"), "SHOWN")).alias("x"))
    zero = F.lit(0).cast("long")
    return found.select("CRITERION", "VALUE", F.col("x.SHOWN").alias("SHOWN"), *[F.coalesce(f"x.{c}", zero).alias(c) for c in ("lines", "trips", "most_users")])


def user_summary(points: DataFrame) -> DataFrame:
    """One row a user: points, distinct trajectories, bounds and means; the means do not depend on the order of rows."""
    measures = [F.count(F.lit(1)).alias("N_POINTS"), F.count_distinct("TRAJECTORY_UID").alias("N_TRAJECTORIES")]
    for axis, name in (("LATITUDE", "LAT"), ("LONGITUDE", "LON")):
        measures += [F.min(axis).alias(f"MIN_{name}"), F.max(axis).alias(f"MAX_{name}"), mean_degrees(F.col(axis)).alias(f"MEAN_{name}")]
    return points.where("USER_ID is not null").groupBy("USER_ID").agg(*measures)


def zone_selection(users: DataFrame, target: int, min_points: int = 500, sizes: list[int] | None = None) -> DataFrame:
    """Up to ``target`` users of the best zone: the smallest cell size that holds enough of them, else the largest.

    Users with too few points are left out unless too few are left. All sizes are
    tried in one pass; ties of zones go to the smaller cell id, of users to the
    smaller id.
    """
    sizes = sizes or ZONE_SIZES
    enough = users.agg((F.count_if(F.col("N_POINTS") >= min_points) >= target).alias("enough_"))  # one row
    rows = users.crossJoin(F.broadcast(enough)).where((~F.col("enough_")) | (F.col("N_POINTS") >= min_points)).drop("enough_")
    tried = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("ZONE_CELL_SIZE_M"), cell_id(F.col("MEAN_LAT"), F.col("MEAN_LON"), s).alias("ZONE_CELL")) for k, s in enumerate(sizes)])
    rows = rows.withColumn("x", F.explode(tried)).select(*users.columns, "x.*")
    zones = rows.groupBy("k", "ZONE_CELL").agg(F.count_distinct("USER_ID").alias("u"), F.sum("N_TRAJECTORIES").alias("t"), F.sum("N_POINTS").alias("p"))
    full = F.col("u") >= target
    tier = F.when(full, F.col("k")).when(F.col("k") == len(sizes) - 1, F.lit(len(sizes)))
    best = zones.where(tier.isNotNull()).orderBy(tier, F.desc("u"), F.desc("t"), F.desc("p"), "ZONE_CELL").limit(1).select("k", "ZONE_CELL")
    chosen = rows.join(F.broadcast(best), ["k", "ZONE_CELL"])
    return chosen.orderBy(F.desc("N_TRAJECTORIES"), F.desc("N_POINTS"), "USER_ID").limit(target).select(*users.columns, "ZONE_CELL", "ZONE_CELL_SIZE_M")
