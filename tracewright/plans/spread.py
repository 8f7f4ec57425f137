"""Joins with a table of one row a key, in which no task gets all rows of a hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more rows than ``HOT_ROWS``, and than a ``MOST_HOT``-th of all rows, is hot: its rows are dealt to ``SALTS`` groups.
HOT_ROWS, MOST_HOT, SALTS = 1 << 14, 1024, 64


def hot_from(rows: int) -> int | None:
    """Keys with more rows than this are hot, at most ``MOST_HOT`` of them; None if ``rows`` are too few for any."""
    return None if rows <= HOT_ROWS else max(HOT_ROWS, -(-rows // MOST_HOT))


def join_each(rows: DataFrame, each: DataFrame, keys: list[str], by: Column, most: int | None, n: str = "n", how: str = "inner") -> DataFrame:
    """``rows`` joined with the one row of ``each`` that has their keys, without its ``n``, the number of rows of the key.

    Keys with ``n`` above ``most`` (see ``hot_from``) are broadcast by name, at
    most ``MOST_HOT``; their rows are spread by ``by``, and their one row goes to
    every salt. Null keys match nothing; with ``how="left"`` their rows stay, and
    are spread as well.
    """
    if most is None:
        return rows.join(each.drop(n), keys, how)
    hot = each.where(F.col(n) > most).select(*keys, F.lit(True).alias("hot_"))
    apart = F.coalesce(F.col("hot_"), F.lit(False))
    for k in keys if how == "left" else ():
        apart = apart | F.col(k).isNull()
    salt = F.when(apart, F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0).cast("int")
    spread = rows.join(F.broadcast(hot), keys, "left").withColumn("salt_", salt).drop("hot_")
    salts = F.when(F.col(n) > most, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return spread.join(each.withColumn("salt_", F.explode(salts)).drop(n), [*keys, "salt_"], how).drop("salt_")
