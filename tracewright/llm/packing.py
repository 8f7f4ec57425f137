"""Mixture-controlled packing: deficit round-robin over source queues into fixed windows."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stored
from .columns import tidied

#: Documents whose windows are laid out at a time.
LAYOUT_ROWS = 256


@cache
def byte_bpe(path: str) -> Callable[[str], bytes]:
    """Ids of a text as little-endian unsigned 32-bit integers, as the tokenizers file at ``path`` gives them.

    A vocabulary of the same ranks beside it (``.tiktoken``) encodes ordinary
    text faster. Texts that hold a special string go through the file itself.
    """
    import base64
    import json
    import os

    from tokenizers import Tokenizer

    @cache
    def whole() -> Tokenizer:  # some 30 MB, which workers keep: only for those that need it
        return Tokenizer.from_file(path)

    def exact(text: str) -> bytes:
        return np.array(whole().encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks):
        return exact
    import public_tokenizers
    import tiktoken

    with open(path) as file:
        special = [t["content"] for t in json.load(file)["added_tokens"]]
    with open(ranks, "rb") as file:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def encode(text: str) -> bytes:
        if any(s in text for s in special):
            return exact(text)
        return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    return encode


def token_queues(docs: DataFrame, id_col: str, source_col: str, text_col: str, tokenizer: str, end_id: int) -> DataFrame:
    """``id, source, part, local, n, ids`` stored once: every text's ids and its place in its source's queue.

    A queue runs over the parts (the tasks that wrote them) in order; ``local``
    counts the source's ids before the text within its part. So no row moves.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, sums = byte_bpe(tokenizer), TaskContext.get().partitionId(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                local, n, ids = [], [], []
                for source, text in zip(piece.column(1).to_pylist(), piece.column(2), strict=True):
                    ids.append(ids_of(text.as_py() or "") + end)
                    n.append(len(ids[-1]) // 4)
                    local.append(sums.get(source, 0))
                    sums[source] = local[-1] + n[-1]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([part] * len(n), pa.int32()), pa.array(local, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["id", "source", "part", "local", "n", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("t"))
    return stored(rows.mapInArrow(tidied(encode), f"id {kind}, source string, part int, local long, n long, ids binary"), "tokens")


class RoundRobin:
    """Deficit round-robin over queues: how many ids each has given after any number of ids, in closed form.

    A round gives every queue a quantum, its target share of one id; an id costs
    a credit of 1, and what a queue has been given but not yet served is its
    deficit, carried into the next window, and the next partition. A queue's
    i-th id is due when its quanta reach i + 1/2, in round (i + 1/2) / weight;
    ids are served in the order in which they are due (ties: the earlier queue).
    Without ends, all queues' quanta up to any id are a multiple of their
    weights, so the counts and deficits at the start of any window follow from
    its number alone, and no partition waits for another. A queue that has ended
    drops out and the others share its quantum. Weights default to the queues'
    sizes, for which all of them end together.
    """

    def __init__(self, sizes: list[int], weights: list[float] | None = None) -> None:
        self.size = np.array(sizes, dtype=np.int64)
        self.weight = np.array(weights if weights is not None else sizes, dtype=np.float64)
        if (self.weight[self.size > 0] <= 0).any():
            raise ValueError("every source with text needs a positive weight")
        self.weight[self.size == 0] = 1.0
        self.total = int(self.size.sum())
        stops = np.unique(np.concatenate([[0.0], self.size / self.weight]))
        served = np.minimum(self.size, self.weight * stops[:, None]).sum(axis=1)
        self.stops, self.at_stops = stops, served

    def served(self, count: np.ndarray) -> np.ndarray:
        """For each total ``count`` of ids served, the ids of each queue among them: (len(count), queues)."""
        count = np.minimum(count, self.total)
        time = np.interp(count, self.at_stops, self.stops)[:, None]
        n = np.clip(np.floor(self.weight * time + 0.5).astype(np.int64), 0, self.size)
        n -= (n > 0) & ((n - 0.5) / self.weight > time)
        n += (n < self.size) & ((n + 0.5) / self.weight <= time)
        over = n.sum(axis=1) - count
        while (late := np.flatnonzero(over > 0)).size:
            due = np.where(n[late] > 0, (n[late] - 0.5) / self.weight, -np.inf)
            n[late, due.shape[1] - 1 - np.argmax(due[:, ::-1], axis=1)] -= 1
            over[late] -= 1
        while (early := np.flatnonzero(over < 0)).size:
            due = np.where(n[early] < self.size, (n[early] + 0.5) / self.weight, np.inf)
            n[early, np.argmin(due, axis=1)] += 1
            over[early] += 1
        return n

    def deficits(self, count: np.ndarray, served: np.ndarray) -> np.ndarray:
        """For each total ``count`` what the queues' quanta come to, less what they have ``served``: within an id or so of 0."""
        time = np.interp(np.minimum(count, self.total), self.at_stops, self.stops)[:, None]
        return np.minimum(self.size, self.weight * time) - served

    def around(self, queue: np.ndarray, place: np.ndarray) -> np.ndarray:
        """About how many ids are served when the one at ``place`` of ``queue`` is; off by at most the number of queues."""
        return np.interp((place + 0.5) / self.weight[queue], self.stops, self.at_stops)


def _pieces(robin: RoundRobin, window: int, queue: np.ndarray, start: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, int, int, int, float]]:
    """(row, begin within the text, length, window, offset in the window, its queue's deficit after it) for texts at ``start`` of their queues."""
    slack = len(robin.size) + 2
    low = np.maximum(0, np.floor((robin.around(queue, start) - slack) / window)).astype(np.int64)
    high = np.floor((robin.around(queue, start + n - 1) + slack) / window).astype(np.int64) + 2
    span = high - low
    step = max(1, (1 << 20) // len(robin.size))
    for a, b in _blocks(span, step):
        j = np.unique(np.concatenate([np.arange(low[k], high[k] + 1) for k in range(a, b)]))
        counts = np.concatenate([robin.served(j[c : c + step] * window) for c in range(0, len(j), step)])
        ahead = np.cumsum(counts, axis=1) - counts  # of earlier queues
        carried = np.concatenate([robin.deficits(j[c : c + step] * window, counts[c : c + step]) for c in range(0, len(j), step)])
        for k in range(a, b):
            s, rows = queue[k], np.searchsorted(j, np.arange(low[k], high[k] + 1))
            own, before = counts[rows, s], ahead[rows, s]
            begin, end = np.maximum(own[:-1], start[k]), np.minimum(own[1:], start[k] + n[k])
            for q in np.flatnonzero(end > begin):
                offset = before[q + 1] - before[q] + begin[q] - own[q]
                yield k, int(begin[q] - start[k]), int(end[q] - begin[q]), int(low[k] + q), int(offset), float(carried[rows[q + 1], s])


def _blocks(span: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    begin, held = 0, 0
    for k, m in enumerate(span.tolist()):
        if k > begin and (held + m > most or k - begin >= LAYOUT_ROWS):
            yield begin, k
            begin, held = k, 0
        held += m
    if begin < len(span):
        yield begin, len(span)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", window: int = 2048, end_id: int = 1, weights: DataFrame | None = None, most_queues: int = 1000) -> DataFrame:
    """Pieces of the token sequence of each row of ``docs``, laid into windows of ``window`` ids.

    One row a piece: ``id_col, source, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, deficit, ids`` (little-endian unsigned 32-bit). Every
    window is full but the last, and holds each source's target share to within
    an id until a source is used up; ``deficit`` is what of its share the source
    carries on after the window. ``weights`` (source, weight) gives the shares;
    by default they are the sources' own sizes, and a source without a positive
    weight gets its size's part of them. Sources beyond the ``most_queues``
    largest are served as one queue with the sum of their weights, so the driver
    and every task hold that many numbers at most; no row is left out. Null and
    empty texts are the end id alone; null sources are a source; rows that
    repeat are packed again; extra columns are ignored, whatever their names; no
    rows, no pieces.
    """
    rows = token_queues(docs, id_col, source_col, text_col, tokenizer, end_id)
    sums = stored(rows.groupBy("source", "part").agg(F.sum("n").alias("n")), "source-parts")
    totals = sums.groupBy("source").agg(F.sum("n").alias("n"))
    if weights is None:
        totals = totals.withColumn("weight", F.col("n").cast("double"))
    else:
        given = weights.groupBy(F.col("source").cast("string").alias("source0")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        totals = totals.join(given, F.col("source").eqNullSafe(F.col("source0")), "left").drop("source0")
        known = F.when(F.col("weight") > 0, F.col("weight"))
        each = totals.agg((F.sum(known) / F.sum(F.when(F.col("weight") > 0, F.col("n")))).alias("each"))
        totals = totals.crossJoin(F.broadcast(each)).withColumn("weight", F.coalesce(known, F.col("n") * F.coalesce("each", F.lit(1.0)))).drop("each")  # one row
    totals = stored(totals, "sources")
    everything = totals.agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("n"), F.sum("weight").alias("weight")).first()
    largest = totals.orderBy(F.desc("n"), F.col("source").asc_nulls_last()).limit(most_queues).collect()
    largest.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes, share = [r["n"] for r in largest], [r["weight"] for r in largest]
    if everything["count"] > most_queues:
        sizes.append(everything["n"] - sum(sizes))
        share.append(everything["weight"] - sum(share))

    # a queue runs over the parts in order, and within a part over its sources
    queues = docs.sparkSession.createDataFrame([(r["source"], k) for k, r in enumerate(largest)], "source0 string, queue0 int")
    sums = sums.join(F.broadcast(queues), F.col("source").eqNullSafe(F.col("source0")), "left")  # at most most_queues rows
    sums = stored(sums.select("source", "part", "n", F.coalesce("queue0", F.lit(len(largest))).alias("queue")), "queue-parts")
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.groupBy("queue", "part").agg(F.sum("n").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    inside = Window.partitionBy("queue", "part").orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, ["queue", "part"])
    sums = stored(sums.select("source", "part", "queue", (F.col("base") + F.col("before")).alias("base")), "queue-starts")
    rows = rows.alias("t").join(sums.alias("p"), F.col("t.source").eqNullSafe(F.col("p.source")) & (F.col("t.part") == F.col("p.part")))
    rows = rows.select("id", "t.source", "queue", (F.col("base") + F.col("local")).alias("start"), "t.n", "ids")
    kind = docs.schema[id_col].dataType.simpleString()

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        robin = RoundRobin(sizes, share)
        for whole in batches:
            for at in range(0, whole.num_rows, LAYOUT_ROWS):
                batch = whole.slice(at, LAYOUT_ROWS)
                queue, start, n = (batch.column(c).to_numpy().astype(np.int64) for c in (2, 3, 4))
                ids = [memoryview(x.as_buffer()) for x in batch.column(5)]
                found = list(_pieces(robin, window, queue, start, n))
                row, begin, length, place, offset = (np.array(x, dtype=np.int64) for x in list(zip(*found, strict=True))[:5])
                carried = pa.array([x[5] for x in found], pa.float64())
                body = [bytes(ids[k][4 * a : 4 * (a + m)]) for k, a, m, *_ in found]
                arrays = [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), begin, length, [zlib.crc32(x) for x in body], n[row], place, offset, carried, pa.array(body, pa.binary())]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in arrays], names=["id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "deficit", "ids"])

    laid = rows.mapInArrow(tidied(lay), f"id {kind}, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, deficit double, ids binary")
    return laid.withColumnRenamed("id", id_col)
