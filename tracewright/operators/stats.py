"""Distribution summaries for parameter studies.

Null values never count; ``clean_series`` also drops what is not finite. Equal
values count each. Without values there are no groups, steps or bins, and shares
are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.numbering import numbered, running_sum

PERCENTILES = (50, 75, 90, 95, 99)


def clean_series(rows: DataFrame, column: str, positive: bool = False, most: float | None = None) -> DataFrame:
    """``x``: finite values of a column, above zero and up to ``most`` if asked."""
    x = F.col(column).cast("double")
    kept = rows.select(x.alias("x")).where("x is not null and not isnan(x) and abs(x) <> double('infinity')")
    kept = kept.where("x > 0") if positive else kept
    return kept if most is None else kept.where(F.col("x") <= most)


def describe(rows: DataFrame, by: list[str] | None = None, column: str = "x") -> DataFrame:
    """count, mean, sample deviation, least, largest and exact percentiles (linear between ranks), by ``by``.

    Rows are counted by value before values are put in order, in ranges, so no
    task holds all values. Groups without values have no row.
    """
    by = by or []
    x = F.col(column)
    counts = rows.where(x.isNotNull()).groupBy(*by, x.alias("x_")).agg(F.count(F.lit(1)).alias("k_"))
    along = running_sum(counts, [F.col(c) for c in (*by, "x_")], F.col("k_"), "sum_")
    whole = rows.where(x.isNotNull()).groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("least"), F.max(column).alias("largest"))
    starts = along.groupBy(*by).agg(F.min("sum_").alias("start_"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    whole = whole.alias("a").join(starts.alias("b"), same).select("a.*", "start_")
    placed = along.alias("a").join(F.broadcast(whole).alias("b"), same).select("a.*", "b.n", "b.start_")  # a row a group, which are few
    before = F.col("sum_") - F.col("start_")

    def ranked(p: int, up: bool) -> Column:
        place = (F.ceil if up else F.floor)((F.col("n") - 1) * p / 100)
        return F.min(F.when((before <= place) & (place < before + F.col("k_")), F.col("x_"))).alias(f"{'hi' if up else 'lo'}{p}")

    found = placed.groupBy(*by).agg(*[ranked(p, up) for p in PERCENTILES for up in (False, True)])
    found = whole.alias("a").join(found.alias("b"), same).select("a.*", *[f"b.{e}{p}" for p in PERCENTILES for e in ("lo", "hi")])

    def between(p: int) -> Column:
        part = (F.col("n") - 1) * p / 100 - F.floor((F.col("n") - 1) * p / 100)
        return (F.col(f"lo{p}") + (F.col(f"hi{p}") - F.col(f"lo{p}")) * part).alias(f"p{p}")

    return found.select(*by, "n", "mean", "std", "least", "largest", *[between(p) for p in PERCENTILES])


def coverage(rows: DataFrame, limits: dict[str, list[float]], by: str = "section", column: str = "x") -> DataFrame:
    """``by, limit_value, share``: the part of each section's values up to each of its limits, all in one pass; null without values."""
    asked = [(s, float(t)) for s, own in limits.items() for t in own]
    shares = rows.agg(*[F.avg(F.when(F.col(by) == s, (F.col(column) <= t).cast("int"))).alias(f"s{k}") for k, (s, t) in enumerate(asked)])
    pairs = F.array(*[F.struct(F.lit(s).alias(by), F.lit(t).alias("limit_value"), F.col(f"s{k}").alias("share")) for k, (s, t) in enumerate(asked)])
    return shares.select(F.explode(pairs).alias("p")).select("p.*")


def ecdf(rows: DataFrame, column: str = "x") -> DataFrame:
    """``x, cdf``: the staircase of sorted values, a row each: its place, from 1, by the number of all. Equal values stand on one step each."""
    total = rows.agg(F.count(column).alias("n_"))
    placed = numbered(rows.where(F.col(column).isNotNull()).select(F.col(column).alias("x")), [F.col("x")], "place_")
    return placed.crossJoin(F.broadcast(total)).select("x", ((F.col("place_") + 1) / F.col("n_")).alias("cdf"))  # one row


def histogram(rows: DataFrame, bins: int = 80, column: str = "x") -> DataFrame:
    """``bin`` (1-based), ``n``: equal bins over the values' range; the largest value falls in the last."""
    span = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    binned = rows.crossJoin(F.broadcast(span))  # one row
    place = F.least(F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1, F.lit(bins))
    return binned.groupBy(F.when(F.col("hi") > F.col("lo"), place).otherwise(1).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def minmax(rows: DataFrame, columns: list[str], top: float = 100.0) -> DataFrame:
    """Columns scaled to 0..top over all rows; 0 where they are all alike, or null."""
    ends = rows.agg(*[f(c).alias(f"{c}_{name}") for c in columns for f, name in ((F.min, "lo"), (F.max, "hi"))])
    rows = rows.crossJoin(F.broadcast(ends))  # one row
    for c in columns:
        lo, hi = F.col(f"{c}_lo"), F.col(f"{c}_hi")
        rows = rows.withColumn(f"{c}_scaled", F.when(hi > lo, (F.col(c) - lo) / (hi - lo) * top).otherwise(0.0))
    return rows.drop(*ends.columns)


def axis_limits(rows: DataFrame, column: str, share: float = 0.08) -> DataFrame:
    """``low, high``: one row, the column's range and the share of it, of at least a millionth, at both ends; 0 and 1 without values."""
    ends = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    pad = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6)) * share
    return ends.select(F.coalesce(F.col("lo") - pad, F.lit(0.0)).alias("low"), F.coalesce(F.col("hi") + pad, F.lit(1.0)).alias("high"))
