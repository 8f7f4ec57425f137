"""Running sums and row numbers over a whole table, in ranges that tasks sort side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored


def running_sum(rows: DataFrame, order: list[Column], amount: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``amount`` over the rows before each in ``order``; nulls come first, as orders do.

    Rows are dealt to ranges of the order and summed within; only the ranges'
    own sums, a row a task, meet in one window. Rows that are equal in the order
    stay in one range, in any order.
    """
    ranged = rows.withColumn("amount_", amount).repartitionByRange(*order).withColumn("range_", F.spark_partition_id())
    ranged = stored(ranged, "ranges")
    earlier = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("range_").agg(F.sum("amount_").alias("n_")).withColumn("before_", F.coalesce(F.sum("n_").over(earlier), F.lit(0))).drop("n_")
    inside = Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("inside_", F.coalesce(F.sum("amount_").over(inside), F.lit(0)))
    return summed.join(before, "range_").withColumn(name, F.col("before_") + F.col("inside_")).drop("range_", "before_", "inside_", "amount_")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place in ``order``, from 0."""
    return running_sum(rows, order, F.lit(1).cast("long"), name)
