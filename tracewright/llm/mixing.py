"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stored
from .histograms import boundary_keys

#: Of a document's hash.
HASH_BITS = 60
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def word_totals(docs: DataFrame, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``source, weight``: the words of each source."""
    words = word_count(F.col(text_col).cast("string"))
    return docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.sum(words).alias("weight"))


def turn_weights(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), source_col: str = "source") -> DataFrame:
    """``source, weight``: ``weights`` in turn for the sources by code point, null last."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    sources = docs.select(F.col(source_col).cast("string").alias("source")).distinct()
    return sources.select("source", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")).alias("weight"))


def id_hash(id_column: Column) -> Column:
    """60 bits of the MD5 of the id as text; null as the empty text."""
    digest = F.md5(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """``source, source_size, target`` by water level: each source gets its weight's part of share x all, at most cap x its size.

    Sources are ranked by code point, null last, and weigh ``weights`` in turn.
    Capped sources are those with the least room per weight, so a running sum
    over sources ordered by that room gives the level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    rows = totals.withColumn("w", weigh).withColumn("room", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("room") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    level = (budget - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    # the level at which this source and all with more room are not capped; it holds from the first where it fits
    rows = rows.withColumn("level", F.when(F.col("w") * level <= F.col("room"), level))
    level = F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.coalesce(F.col("w") * level, F.col("room")), F.col("room"))
    return rows.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """``source, repeats, threshold``: documents with a hash up to the threshold are taken once more than ``repeats``.

    The boundary hash, at which the running sum passes what is missing, is taken
    if this comes nearer to the target.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = goals.withColumn("repeats", whole).withColumn("goal", F.col("target") - F.col("repeats") * F.col("source_size"))
    edge = boundary_keys(sized.select(F.col("source").alias("g"), "h", "size"), state.select(F.col("source").alias("g"), "goal"), HASH_BITS)
    near = F.when(2 * (F.col("goal") - F.col("under")) >= F.col("v"), F.col("h")).otherwise(F.col("h") - 1)
    edge = edge.select(F.col("g").alias("source"), near.alias("threshold"))
    return state.alias("a").join(edge.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.source", "repeats", "threshold")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The rows of ``docs`` with ``size, source_size, target, taken, times``.

    size counts words (null text: 0). times is how often the mix takes the row,
    repeats counted and at most ``cap`` (up to 2), and taken is times x size.
    Which rows are taken depends only on their ids, so reruns agree; rows that
    repeat an id go together. A source's taken words miss its target by at most
    half of its boundary document. Null sources are one source, the last; a
    source without words takes nothing. Columns of these names are replaced, all
    others stay; no rows, no result. Only the plan, a row a source, is joined.
    """
    out = ("size", "source_size", "target", "taken", "times")
    docs = docs.drop(*[c for c in out if c not in (id_col, source_col, text_col)])
    source, size, h = F.col(source_col).cast("string"), word_count(F.col(text_col).cast("string")), id_hash(F.col(id_col))
    sized = stored(docs.select(source.alias("source"), size.alias("size"), h.alias("h")), "sizes")
    goals = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "targets")
    cut = thresholds(sized, goals)
    plan = goals.alias("g").join(cut.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source")), "left")
    plan = plan.select(F.col("g.source").alias("mix_source_"), "source_size", "target", F.coalesce("repeats", F.lit(0)).alias("mix_repeats_"), F.coalesce("threshold", F.lit(-1)).alias("mix_threshold_"))
    plan = stored(plan, "mix")
    rows = docs.withColumn("size", size).join(plan, source.eqNullSafe(F.col("mix_source_")))
    times = (F.col("mix_repeats_") + F.when(h <= F.col("mix_threshold_"), 1).otherwise(0)).cast("long")
    return rows.withColumn("times", times).withColumn("taken", F.col("size") * F.col("times")).select(*docs.columns, *out)


def mix_oracle(weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> str:
    """The query's result in DuckDB: the same rule with a sort in place of the histograms."""
    turns = " ".join(f"WHEN {k} THEN {float(w)!r}" for k, w in enumerate(weights))
    return f"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(COALESCE(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
t AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {turns} END::DOUBLE AS w
  FROM d GROUP BY source),
r AS (SELECT *, source_size * {float(cap)!r}::DOUBLE AS room, sum(source_size) OVER () * {float(share)!r}::DOUBLE AS budget FROM t),
l AS (
  SELECT *, (budget - COALESCE(sum(room) OVER (ORDER BY room / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / sum(w) OVER (ORDER BY room / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
f AS (SELECT min_by(level, room / w) AS level FROM l WHERE w * level <= room),
g AS (
  SELECT source, source_size, least(COALESCE(w * f.level, room), room) AS target
  FROM l CROSS JOIN f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS repeats FROM g),
c AS (
  SELECT doc_id, source, size, h, sum(size) OVER (PARTITION BY source, h) AS v,
         sum(size) OVER (PARTITION BY source ORDER BY h RANGE UNBOUNDED PRECEDING) - sum(size) OVER (PARTITION BY source, h) AS under
  FROM d)
SELECT c.doc_id, c.size, p.source_size, p.target,
       (c.size * (p.repeats + CASE WHEN 2 * (p.target - p.repeats * p.source_size - c.under) >= c.v THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source"""
