"""Thresholds on integer keys by nested histograms, without sorting rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stored

STEP_BITS = 12


def boundary_keys(rows: DataFrame, goals: DataFrame, bits: int) -> DataFrame:
    """``g, goal, h, under, v``: the least key of each group at which the running sum of sizes reaches the goal.

    ``rows`` has g, h (0 <= h < 2^bits) and size, ``goals`` has g and goal; groups
    compare null-safe. Sizes are summed by group and leading bits, the bucket in
    which the running sum passes the goal is the boundary, and only its rows are
    summed again by the next bits, until it holds a single key. ``under`` sums
    the sizes below that key and ``v`` those at it. Groups that never reach their
    goal, and goals of groups without rows, have no row. A histogram has at most
    2^12 buckets a group, partially summed before they move.
    """
    zero = F.lit(0).cast("long")
    state = stored(goals.select("g", "goal", zero.alias("prefix"), zero.alias("below")), "goals")
    done = None
    above = bits
    while above > 0:
        shift = max(0, above - STEP_BITS)
        inside = rows.alias("d").join(state.alias("s"), F.col("d.g").eqNullSafe(F.col("s.g")) & (F.shiftright("d.h", above) == F.col("s.prefix")))
        sums = inside.groupBy("s.g", "goal", "below", F.shiftright("d.h", shift).alias("b")).agg(F.sum("d.size").alias("v"), F.min("d.h").alias("h0"), F.max("d.h").alias("h1"))
        along = Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("under", F.col("below") + F.coalesce(F.sum("v").over(along), zero))
        passed = sums.where(F.col("under") + F.col("v") >= F.col("goal"))
        first = passed.groupBy("g", "goal").agg(F.min_by(F.struct("b", "under", "v", "h0", "h1"), "b").alias("x"))
        found = stored(first.select("g", "goal", "x.*"), "boundary")
        single = F.col("h0") == F.col("h1")
        ended = found.where(single).select("g", "goal", F.col("h0").alias("h"), "under", "v")
        done = ended if done is None else done.unionAll(ended)
        state = found.where(~single).select("g", "goal", F.col("b").alias("prefix"), F.col("under").alias("below"))
        above = shift
        if state.isEmpty():
            break
    return done
