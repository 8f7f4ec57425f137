"""SimHash near-dedup by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..plans.spread import hot_from, join_each
from ..plans.storage import stored
from .columns import named
from .golay import codeword_indices

#: First bit and width of the segments of a fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: A bucket with more fingerprints than this is linked by shared neighbours, not by comparing its members.
PAIRWISE_UP_TO = 64
#: Hashes whose bits are counted at a time.
BLOCK = 1 << 16
SEED = 42


def majority(blocks: Iterable[np.ndarray]) -> int:
    """64 bits, as a signed long: a bit is 1 if it is set in over half of the hashes of all blocks; no hashes, no bits."""
    ones, total = np.zeros(64, dtype=np.int64), 0
    for hashes in blocks:
        ones += np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int.from_bytes(np.packbits(ones * 2 > total, bitorder="little").tobytes(), "little", signed=True)


def text_fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits; a bit is 1 if it is set in over half of the XXH64 of the word shingles. Null and wordless texts: 0."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles: Iterator[bytes] = iter([b" ".join(tokens)])
        total = 1
    else:
        shingles = map(b" ".join, zip(*(tokens[k:] for k in range(words)), strict=False))
        total = len(tokens) - words + 1
    digest = xxhash.xxh64_intdigest
    sizes = (min(BLOCK, total - start) for start in range(0, total, BLOCK))  # a long text goes through in blocks
    return majority(np.fromiter((digest(s, SEED) for s, _ in zip(shingles, range(size), strict=False)), dtype="<u8", count=size) for size in sizes)


def set_fingerprint(shingles: np.ndarray) -> int:
    """The same of the distinct shingles of a text, each counted once."""
    return majority(shingles[start : start + BLOCK] for start in range(0, len(shingles), BLOCK))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``id, fp`` (the fingerprint as a signed long) for every row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [text_fingerprint(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(named(id_col).alias("id"), named(text_col).cast("string").alias("t")).mapInArrow(compute, f"id {kind}, fp bigint")


def fuzzy_keys(fps: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """``fp, carried..., key``: one segment as it is with a codeword near the following segment, for each of the three.

    With at most two differing bits over three segments one segment has none
    (pigeonhole), and the segment after it, with at most two, shares a codeword.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = fp.view(np.uint64)
            part = [((bits >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
            for k in range(3):
                index, used = codeword_indices(part[(k + 1) % 3])
                row, col = np.nonzero(np.arange(index.shape[1])[None, :] < used[:, None])
                key = (np.int64(k) << 34) | (part[k][row] << 12) | index[row, col]
                others = [c.take(pa.array(row)) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(fp[row]), *others, pa.array(key)], names=["fp", *carried, "key"])

    kinds = dict(fps.dtypes)
    return fps.select("fp", *carried).mapInArrow(compute, ", ".join([f"{c} {kinds[c]}" for c in ("fp", *carried)] + ["key bigint"]))


def fingerprint_links(fps: DataFrame, max_distance: int = 2) -> DataFrame:
    """``src, dst`` links (a spanning set of them) between distinct fingerprints at most ``max_distance`` (0 to 2) bits apart.

    Small buckets of a shared key are compared member by member and verified.
    In larger ones, which near copies fill, comparing all members would cost the
    square, so each fingerprint is instead linked to the smallest one that shares
    a word at most one bit away from both. Two fingerprints share such a word
    exactly if they are at most two bits apart, so these links are verified by
    what they are; the others of a word are linked through its smallest, so the
    components are those of all pairs, and the links grow linearly.
    """
    if not 0 <= max_distance <= 2:
        raise ValueError("max_distance is 0, 1 or 2")
    keys = fuzzy_keys(fps)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = shared.withColumn("rows", F.col("n"))
    keys = stored(join_each(keys, shared, ["key"], F.col("fp"), hot_from(6 * 3 * fps.count()), "rows"), "buckets")  # up to six keys a segment
    small = keys.where(F.col("n") <= PAIRWISE_UP_TO)
    a, b = small.alias("a"), small.alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_distance
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & near)
    pairs = pairs.select(F.col("b.fp").alias("src"), F.col("a.fp").alias("dst"))
    crowd = keys.where(F.col("n") > PAIRWISE_UP_TO).select("fp").distinct()
    if max_distance == 0:
        return pairs.distinct()
    flips = [0] if max_distance == 1 else [0, *(1 << k for k in range(63)), -(1 << 63)]
    if max_distance == 1:  # a neighbour at distance 1 is one of the words themselves
        one = [1 << k for k in range(63)] + [-(1 << 63)]
        moved = crowd.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m)) for m in one])).alias("w"))
        met = moved.join(crowd.select(F.col("fp").alias("w")), "w").select(F.col("fp").alias("src"), F.col("w").alias("dst"))
    else:
        moved = crowd.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m)) for m in flips])).alias("w"))
        least = moved.groupBy("w").agg(F.min("fp").alias("dst"), F.count(F.lit(1)).alias("n")).where("n > 1")
        met = moved.join(least, "w").where("fp <> dst").select(F.col("fp").alias("src"), "dst")
    return pairs.unionAll(met).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_distance: int = 2) -> DataFrame:
    """``id_col, fp, component_id`` for every row; rows whose fingerprints link, directly or over others, share a component.

    component_id is the smallest id reachable. Equal fingerprints (copies, and
    all texts without words, null ones included) are one node, so a group of
    copies costs one row. Null ids never name a component unless there is no
    other; repeated rows stay; extra columns are ignored, whatever
    their names; no rows, no result.
    """
    rows = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    found = connected_components(fingerprint_links(nodes, max_distance))
    joined = nodes.join(found, nodes["fp"] == found["node"], "left")
    grouped = joined.select("fp", "n", "least_id", F.coalesce("component", "fp").alias("component"))
    ids = grouped.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    most = hot_from(rows.count())
    of = stored(join_each(grouped, ids, ["component"], F.col("fp"), most, "rows").select("fp", "n", "component_id"), "components")
    return join_each(rows, of, ["fp"], F.col("id"), most).select(F.col("id").alias(id_col), "fp", "component_id")
