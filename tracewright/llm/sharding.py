"""K-d tree partitioning at distributed weighted medians."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stored
from .columns import named
from .histograms import boundary_keys

#: Cells of a dimension's range, and bits of the key that orders rows: cell, then text checksum.
CELL_BITS, SUM_BITS, TIE_BITS = 20, 32, 60
ROWS_A_SLOT_PART = 100_000


def kd_shards(docs: DataFrame, dimensions: dict[str, Column], shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", whole_share: float = 0.005) -> DataFrame:
    """``id_col, size, text_crc32, shard, slot`` for every row: a k-d tree over metadata, leaves of near equal bytes.

    size is the text's UTF-8 bytes plus 1 (null text: 1) and text_crc32 its
    unsigned checksum (null: 0). The number of leaves is ``shards``, or what
    ``target_bytes`` a leaf take. From the root on, a node is split along the
    dimension in which it is widest (against the whole table's range; null
    counts as the least value) at the weighted median, or for an odd number of
    leaves at the share of bytes its smaller side needs. Ties in the dimension
    are ordered by checksum, so copies stay together at a cut unless they hold
    over ``whole_share`` of a leaf; then their ids' hashes split them. All nodes of a level
    are split in one pass over a slim table, and medians come from nested
    histograms; only the tree (a row a node) is small. slot numbers a shard's
    rows from 0 without gaps. Rows that repeat are placed each, extra columns
    are ignored; no rows, no result.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give shards or target_bytes")
    names = sorted(dimensions)
    text = named(text_col).cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    crc = F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long")
    digest = F.md5(F.coalesce(named(id_col).cast("string"), F.lit("")).cast("binary"))
    tie = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    slim = docs.select(named(id_col).alias("id"), size.alias("size"), crc.alias("crc"), tie.alias("tie"), *[dimensions[n].cast("double").alias(f"d{k}") for k, n in enumerate(names)])
    slim = stored(slim, "slim")

    ranges = slim.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), *[f(f"d{k}").alias(f"{n}{k}") for k in range(len(names)) for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    total = ranges["bytes"] or 0
    leaves = shards if shards is not None else max(1, math.ceil(total / target_bytes))
    cells = []
    for k in range(len(names)):
        lo, hi = ranges[f"lo{k}"], ranges[f"hi{k}"]
        wide = 0.0 if lo is None else hi - lo
        cell = F.floor((F.col(f"d{k}") - F.lit(lo or 0.0)) / F.lit(wide) * F.lit(float((1 << CELL_BITS) - 2))) + 1 if wide > 0 else F.lit(1)
        cells.append(F.coalesce(cell, F.lit(0)).cast("long").alias(f"c{k}"))
    rows = slim.select("id", "size", "crc", "tie", *cells, F.lit(0).cast("long").alias("first"), F.lit(leaves).cast("long").alias("k"))
    width = F.array(*[F.struct((F.max(f"c{k}") - F.min(f"c{k}")).alias("w"), F.lit(-k).alias("i")) for k in range(len(names))])
    for _ in range(max(0, (leaves - 1).bit_length())):
        rows = _split(rows, width, len(names), whole_share * total / leaves)
    return _slots(rows.select("id", "size", "crc", F.col("first").cast("int").alias("shard")), leaves, ranges["rows"]).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def _split(rows: DataFrame, width: Column, dims: int, whole_bytes: float) -> DataFrame:
    """All nodes with more than one leaf are cut in two. A node is known by its first leaf."""
    rows = stored(rows, "nodes")
    half = F.floor(F.col("k") / 2)
    nodes = rows.where("k > 1").groupBy("first", "k").agg(F.sum("size").alias("bytes"), F.array_max(width).alias("wide"))
    nodes = stored(nodes.select("first", (-F.col("wide.i")).alias("axis"), (F.col("bytes") * half / F.col("k")).alias("goal")), "axes")
    cell = F.element_at(F.array(*[f"c{k}" for k in range(dims)]), (F.col("axis") + 1).cast("int"))
    keyed = rows.join(nodes.select("first", "axis"), "first").select(F.col("first").alias("g"), F.col("size"), "tie", (F.shiftleft(cell, SUM_BITS) + F.col("crc")).alias("h"))
    edge = stored(boundary_keys(keyed, nodes.select(F.col("first").alias("g"), "goal"), CELL_BITS + SUM_BITS), "medians")
    # copies that weigh too much to stay whole are cut by their ids
    heavy = edge.where(F.col("v") > F.lit(whole_bytes)).select("g", F.col("h").alias("at"), (F.col("goal") - F.col("under")).alias("goal"))
    copies = keyed.join(heavy, "g").where("h = at").select("g", F.col("tie").alias("h"), "size")
    within = boundary_keys(copies, heavy.select("g", "goal"), TIE_BITS)
    nearer = 2 * (F.col("goal") - F.col("under")) >= F.col("v")
    within = within.select("g", F.when(nearer, F.col("h")).otherwise(F.col("h") - 1).alias("tie_cut"))
    whole = F.when(nearer, F.lit((1 << TIE_BITS) - 1)).otherwise(F.lit(-1)).cast("long")
    cuts = edge.join(within, "g", "left").select(F.col("g").alias("first"), F.col("h").alias("cut"), F.coalesce("tie_cut", whole).alias("tie_cut"))
    cuts = stored(cuts.join(nodes.select("first", "axis"), "first"), "cuts")
    joined = rows.join(cuts, "first", "left")
    key = F.shiftleft(cell, SUM_BITS) + F.col("crc")
    right = (F.col("k") > 1) & F.coalesce((key > F.col("cut")) | ((key == F.col("cut")) & (F.col("tie") > F.col("tie_cut"))), F.lit(False))
    first = F.when(right, F.col("first") + half).otherwise(F.col("first"))
    k = F.when(F.col("k") <= 1, F.col("k")).when(right, F.col("k") - half).otherwise(half)
    return joined.select("id", "size", "crc", "tie", *[f"c{i}" for i in range(dims)], first.alias("first"), k.cast("long").alias("k"))


def _slots(rows: DataFrame, leaves: int, count: int) -> DataFrame:
    """Row numbers by shard: within parts of a shard of bounded size, plus the rows of earlier parts."""
    parts = math.ceil(count / leaves / ROWS_A_SLOT_PART) * 2 if count else 1
    rows = stored(rows.withColumn("part", F.pmod(F.xxhash64("id", "crc", F.monotonically_increasing_id()), F.lit(parts))), "shards")
    order = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "crc")).cast("long") - 1
    placed = rows.withColumn("slot", within).join(before.select("shard", "part", "before"), ["shard", "part"])
    return placed.withColumn("slot", F.col("slot") + F.col("before"))
