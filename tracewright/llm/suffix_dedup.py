"""Repeated passages by longest-previous-factor arrays over a partitioned suffix order.

Only factors of a fixed length L matter: byte s of a text starts a repeat if its
L bytes also start elsewhere. The suffix order, and with it the longest previous
factors, is therefore cut at L bytes. It is partitioned so that equal factors always meet: every L-byte window goes to
the partition of its minimizer, the least hash of its short grams, which depends
on nothing but the window. Neighbouring windows with the same minimizer travel
together as one *stretch* (about 77 windows), a few numbers and a hash; the text
of a stretch is fetched only where its minimizer occurs with differing stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.spread import hot_from, join_each
from ..plans.storage import discard, passing, release, stored
from .columns import by_place, free_names, named, tidied, tidy, without

GRAM = 48
#: Bytes that one pass of the minimizer kernel works on.
BLOCK = 1 << 18
#: A minimizer with more differing stretches than this is split by the windows' own hashes.
CROWD = 4000
#: Bytes of stretches whose suffixes one task sorts at a time; a worker takes some 70 times as many.
SORT_BYTES = 1 << 19
_INDEX_BITS = np.uint64(21)


class _Hasher:
    """Polynomial hashes of all grams of a block, modulo 2^64."""

    def __init__(self) -> None:
        random = np.random.default_rng(9)
        self.table = random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = np.full(BLOCK, 0x9E3779B97F4A7C15, dtype=np.uint64)
        base[0] = 1
        self.power = np.multiply.accumulate(base)
        base[1:] = pow(0x9E3779B97F4A7C15, -1, 1 << 64)
        self.inverse = np.multiply.accumulate(base)

    def grams(self, data: np.ndarray) -> np.ndarray:
        total = np.cumsum(self.table[data] * self.power[: len(data)], dtype=np.uint64)
        found = total[GRAM - 1 :].copy()
        found[1:] -= total[: -GRAM]
        found *= self.inverse[: len(found)]
        found ^= found >> np.uint64(32)
        found *= np.uint64(0xD6E8FEB86659FD93)
        found ^= found >> np.uint64(29)
        return found


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row: prefix and suffix minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def stretches(data: bytes, lengths: list[int], factor: int, hasher: _Hasher) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: for each stretch the text's number, its first and last window, its minimizer and both halves of its hash.

    Where a text repeats a stretch right after itself, as periodic text does, the
    copies are one row: the last window of all and their number come behind.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    grams = hasher.grams(raw)
    slot = np.arange(len(grams), dtype=np.uint64)
    key = (grams >> _INDEX_BITS << _INDEX_BITS) | slot
    where = (sliding_least(key, factor - GRAM + 1) & np.uint64((1 << 21) - 1)).astype(np.int64)
    ends = np.cumsum(lengths)
    begins = ends - np.asarray(lengths)
    inside = np.zeros(len(where) + 1, dtype=np.int32)
    long = np.asarray(lengths) >= factor
    np.add.at(inside, begins[long], 1)
    np.add.at(inside, ends[long] - factor + 1, -1)
    valid = np.cumsum(inside[:-1]) > 0
    new = np.ones(len(where), dtype=bool)
    new[1:] = where[1:] != where[:-1]
    after = np.ones(len(where), dtype=bool)
    after[:-1] = new[1:] | ~valid[1:]
    before = np.ones(len(where), dtype=bool)
    before[1:] = ~valid[:-1]
    first, last = np.flatnonzero(valid & (new | before)), np.flatnonzero(valid & after)
    text = np.searchsorted(ends, first, side="right")
    digest = xxhash.xxh3_128_digest
    code = np.frombuffer(b"".join(digest(data[a : b + factor]) for a, b in zip(first.tolist(), last.tolist(), strict=True)), dtype=np.int64).reshape(-1, 2)
    key = grams[where[first]]
    new = np.ones(len(first), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1]) | (code[1:] != code[:-1]).any(axis=1) | (first[1:] != last[:-1] + 1)
    head = np.flatnonzero(new)
    times = np.diff(np.concatenate([head, [len(first)]]))
    text, shift = text[head], begins[text[head]]
    return text, first[head] - shift, last[head] - shift, key[head].view(np.int64), *code[head].T, last[head + times - 1] - shift, times


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _cut(batches: Iterator[pa.RecordBatch], factor: int) -> Iterator[pa.RecordBatch]:
    hasher = _Hasher()

    def flush(batch: pa.RecordBatch, parts: list[bytes], owners: list[tuple[int, int]]) -> pa.RecordBatch:
        text, lo, hi, mh, code, more, end, times = stretches(b"".join(parts), [len(p) for p in parts], factor, hasher)
        row, shift = (np.array(x, dtype=np.int64) for x in zip(*owners, strict=True))
        ids = [batch.column(c).take(pa.array(row[text])) for c in range(2)]
        numbers = (lo + shift[text], hi + shift[text], mh, code, more, end + shift[text], times)
        return pa.RecordBatch.from_arrays(ids + [pa.array(x) for x in numbers], names=["rid", "at", "lo", "hi", "mh", "code", "more", "end", "times"])

    for batch in batches:
        parts: list[bytes] = []
        owners: list[tuple[int, int]] = []
        held = 0
        for row, text in enumerate(batch.column(2)):
            data = _utf8(text.as_py())
            if len(data) < factor:
                continue
            for at in range(0, len(data) - factor + 1, BLOCK // 2):  # blocks of a long text overlap by a factor less a byte
                part = data[at : at + BLOCK // 2 + factor - 1]
                if held + len(part) > BLOCK:
                    yield flush(batch, parts, owners)
                    parts, owners, held = [], [], 0
                parts.append(part)
                owners.append((row, at))
                held += len(part)
        if parts:
            yield flush(batch, parts, owners)


def _ranks(key: np.ndarray) -> np.ndarray:
    """Of each key its place among the distinct ones."""
    order = np.argsort(key)
    new = np.zeros(len(key), dtype=bool)
    along = key[order]
    np.not_equal(along[1:], along[:-1], out=new[1:])
    del along
    rank = np.empty(len(key), dtype=np.int32)
    rank[order] = np.cumsum(new, dtype=np.int32)
    return rank


def _pairs(first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
    """One key for each two ranks below ``size``."""
    key = first.astype(np.int64)
    key *= size + 1
    key += second
    return key


class SuffixOrder:
    """The suffix order of the ``length``-byte factors at ``starts`` of ``data``, cut at that length, by prefix doubling.

    ``rank`` is each factor's place among the distinct ones. The ranks of the
    8, 16, 32 ... byte strings at every byte stay, for common prefixes.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, length: int) -> None:
        self.data, self.starts, self.length = data, starts, length
        padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
        word = np.zeros(len(data), dtype=np.uint64)
        for k in range(8):
            word = (word << np.uint64(8)) | padded[k : k + len(data)].astype(np.uint64)
        rank = _ranks(word)
        del word
        self.levels = [(8, rank)]
        done = 8
        while done * 2 <= length:
            ahead = np.zeros_like(rank)
            ahead[:-done] = rank[done:]
            rank = _ranks(_pairs(rank, ahead, len(rank)))
            done *= 2
            self.levels.append((done, rank))
        self.rank = _ranks(_pairs(rank[starts], rank[starts + length - done], len(rank)))

    def common(self, i: np.ndarray, j: np.ndarray, to_the_byte: bool) -> np.ndarray:
        """Lengths of the longest common prefixes of the factors i and j, to the byte or in steps of eight."""
        a, b = self.starts[i], self.starts[j]
        size = np.zeros(len(a), dtype=np.int64)
        for step, rank in reversed(self.levels):
            fits = np.flatnonzero(size + step <= self.length)
            same = fits[rank[a[fits] + size[fits]] == rank[b[fits] + size[fits]]]
            size[same] += step
        open_ = np.flatnonzero(size < self.length) if to_the_byte else size[:0]
        while len(open_):  # fewer than eight bytes are left to compare
            open_ = open_[self.data[a[open_] + size[open_]] == self.data[b[open_] + size[open_]]]
            size[open_] += 1
            open_ = open_[size[open_] < self.length]
        return size


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place of an array the nearest place before it with a smaller value, or -1.

    All places look back at once. A place that is passed has larger values only
    between itself and the one it looked back to, so that one is next.
    """
    before = np.arange(-1, len(values) - 1)
    todo = np.arange(len(values))
    while True:
        todo = todo[before[todo] >= 0]
        todo = todo[values[before[todo]] >= values[todo]]
        if not len(todo):
            return before
        before[todo] = before[before[todo]]


def previous_factors(order: SuffixOrder, position: np.ndarray, to_the_byte: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The longest-previous-factor array, up to the order's length: how long a prefix of each factor starts at a smaller position; and the same at a larger one.

    In suffix order the smaller positions with the longest common prefix are the
    nearest ones before and after (previous and next smaller positions), and so
    are the larger ones. Factors of one place in the order are taken by position.
    """
    place = np.lexsort((position, order.rank))
    out = []
    for way in (place, place[::-1]):  # backwards, larger positions come first
        along = position[way] if way is place else -position[way]
        best = np.zeros(len(along), dtype=np.int64)
        back = len(along) - 1 - nearest_smaller(along[::-1])[::-1]  # the next smaller one; len(along) if none is
        for near in (nearest_smaller(along), back):
            there = np.flatnonzero((near >= 0) & (near < len(along)))
            best[there] = np.maximum(best[there], order.common(way[there], way[near[there]], to_the_byte))
        found = np.empty(len(along), dtype=np.int64)
        found[way] = best
        out.append(found)
    return out[0], out[1]


def _runs(flags: np.ndarray, owner: np.ndarray, offset: np.ndarray, owners: int) -> pa.ListArray:
    """For each owner of flagged windows, in order, its runs of flagged ones as (first, last)."""
    change = np.ones(len(flags), dtype=bool)
    change[1:] = (flags[1:] != flags[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(change)
    end = np.append(begin[1:], len(flags)) - 1
    begin, end = begin[flags[begin]], end[flags[begin]]
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner[begin], minlength=owners))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(offset[begin], pa.int64()), pa.array(offset[end], pa.int64())], names=["a", "b"]))


_KEY = ["mh", "code", "more"]
_FOUND = "mh long, code long, more long, n long, repeated array<struct<a:long,b:long>>, earlier array<struct<a:long,b:long>>"


def _sorted_repeats(stretch: pa.Table, factor: int) -> pa.Table:
    """Of each stretch of whole minimizer groups: the windows that repeat, and those that repeat an earlier stretch."""
    tidy()
    stretch = stretch.sort_by([("at", "ascending"), ("rid", "ascending"), ("lo", "ascending")]).combine_chunks()  # null ids last
    body = stretch["body"].to_pylist()
    size = np.fromiter(map(len, body), dtype=np.int64, count=len(body))
    begin = np.cumsum(size) - size
    windows = size - factor + 1
    owner = np.repeat(np.arange(len(body)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    order = SuffixOrder(np.frombuffer(b"".join(body), dtype=np.uint8), begin[owner] + offset, factor)
    before, after = previous_factors(order, np.arange(len(owner)), to_the_byte=False)
    earlier = before >= factor
    repeated = earlier | (after >= factor) | (stretch["n"].to_numpy()[owner] > 1)
    found = [_runs(f, owner, offset, len(body)) for f in (repeated, earlier)]
    return pa.table([*(stretch[c] for c in (*_KEY, "n")), *found], names=[*_KEY, "n", "repeated", "earlier"])


def _hashed_repeats(stretch: DataFrame, factor: int) -> DataFrame:
    """The same for minimizers with very many stretches: windows are counted by 128 bits of their own hash, partially summed."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                body = batch.column(7)[row].as_py()
                m = len(body) - factor + 1
                digest = b"".join(xxhash.xxh3_128_digest(body[k : k + factor]) for k in range(m))
                same = [batch.column(c).take(pa.array([row] * m)) for c in range(7)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(range(m), pa.int64()), *(pa.array(h) for h in np.frombuffer(digest, dtype=np.int64).reshape(-1, 2).T)], names=[*_KEY, "n", "at", "rid", "lo", "k", "w", "x"])

    at = stretch.schema["at"].dataType.simpleString()
    rows = stored(stretch.select(*_KEY, "n", "at", "rid", "lo", "body").mapInArrow(tidied(explode), f"mh long, code long, more long, n long, at {at}, rid long, lo long, k long, w long, x long"), "windows")
    place = F.struct(F.col("at").isNull().alias("z"), "at", "rid", "lo", "k")
    seen = rows.groupBy("mh", "w", "x").agg(F.sum("n").alias("total"), F.min(place).alias("least")).where("total > 1")
    marked = rows.join(seen, ["mh", "w", "x"]).withColumn("is_first", place == F.col("least"))
    one = F.struct(F.col("k").alias("a"), F.col("k").alias("b"))
    return marked.groupBy(*_KEY, "n").agg(F.collect_list(one).alias("repeated"), F.collect_list(F.when(~F.col("is_first"), one)).alias("earlier"))


def repeated_windows(texts: DataFrame, factor: int, keep_first: bool) -> DataFrame:
    """``rid, at, a, b``: runs of window starts to remove. ``texts`` has rid, at (the id) and t."""
    kind = texts.schema["at"].dataType.simpleString()
    schema = f"rid long, at {kind}, lo long, hi long, mh long, code long, more long, end long, times long"
    with passing(texts.sparkSession) as keep:
        rows = stored(texts.select("rid", "at", "t").where(F.octet_length("t") >= factor).mapInArrow(tidied(lambda it: _cut(it, factor)), schema), "stretches")
        most = hot_from(rows.agg(F.sum("times")).first()[0] or 0)
        where = F.struct("rid", "lo")
        ends = [f(c).alias(f"{c}{k}") for c in ("code", "more") for k, f in enumerate((F.min, F.max))]
        by_key = rows.groupBy("mh").agg(F.sum("times").alias("n"), *ends)
        again = by_key.where("n > 1").select("mh", ((F.col("code0") == F.col("code1")) & (F.col("more0") == F.col("more1"))).alias("alike"), "n")
        every, rows = rows, stored(join_each(rows, again, ["mh"], where, most), "repeated-stretches")
        discard(every)

        place = F.struct(F.col("at").isNull().alias("z"), "at", "rid", "lo", "hi")
        classes = rows.groupBy(*_KEY, "alike").agg(F.sum("times").alias("n"), F.min(place).alias("one"))
        classes = stored(classes.select(*_KEY, "alike", "n", "one.at", "one.rid", "one.lo", "one.hi"), "classes")
        release(texts.sparkSession)  # the shuffles of all stretches are read; those of the last table written stay held till another is
        mixed = classes.where("not alike")
        needed = mixed.groupBy(F.col("rid").alias("rid0"), F.col("at").alias("at0")).agg(F.collect_list(F.struct(*_KEY, "n", "lo", "hi")).alias("cuts"))

        def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    data, cuts = _utf8(batch.column(2)[k].as_py()), batch.column(3)[k].as_py()
                    fields = {x: [c[x] for c in cuts] for x in (*_KEY, "n")}
                    fields["at"] = batch.column(1).take(pa.array([k] * len(cuts)))
                    fields["rid"] = [batch.column(0)[k].as_py()] * len(cuts)
                    fields["lo"] = [c["lo"] for c in cuts]
                    fields["body"] = [data[c["lo"] : c["hi"] + factor] for c in cuts]
                    yield pa.RecordBatch.from_pydict(fields)

        bodies = texts.join(needed, (F.col("rid") == F.col("rid0")) & F.col("at").eqNullSafe(F.col("at0"))).select("rid", "at", "t", "cuts")
        bodies = bodies.mapInArrow(tidied(slices), f"mh long, code long, more long, n long, at {kind}, rid long, lo long, body binary").dropDuplicates(_KEY)
        crowds = mixed.groupBy("mh").agg(F.count(F.lit(1)).alias("m"))
        bodies = stored(bodies.join(crowds, "mh"), "bodies")
        release(texts.sparkSession)  # and that of all texts
        few, many = bodies.where(F.col("m") <= CROWD), bodies.where(F.col("m") > CROWD)
        parts = int((few.agg(F.sum(F.octet_length("body"))).first()[0] or 0) // SORT_BYTES) + 1
        found = few.withColumn("part", F.pmod("mh", F.lit(parts))).groupBy("part").applyInArrow(lambda f: _sorted_repeats(f, factor), _FOUND)
        found = stored(found.unionAll(_hashed_repeats(many, factor).select(*_KEY, "n", "repeated", "earlier")), "repeats")
        discard(bodies)

        # stretches that are alike repeat as wholes; of the others the found windows do; copies right behind a stretch always do
        begin = F.lit(False)  # whether a row is the first place of its stretch, which stays
        if keep_first:
            head = classes.select(*_KEY, "n", F.col("at").alias("at0"), F.col("rid").alias("rid0"), F.col("lo").alias("lo0"))
            rows = join_each(rows, head, _KEY, where, most)
            begin = (F.col("rid") == F.col("rid0")) & F.col("at").eqNullSafe(F.col("at0")) & (F.col("lo") == F.col("lo0"))
        whole = rows.where("alike").where(~begin).select("rid", "at", F.col("lo").alias("a"), F.col("hi").alias("b"))
        behind = rows.where("times > 1").select("rid", "at", (F.col("hi") + 1).alias("a"), F.col("end").alias("b"))
        part = join_each(rows.where("not alike"), found, _KEY, where, most)
        part = part.select("rid", "at", "lo", F.explode(F.when(begin, F.col("earlier")).otherwise(F.col("repeated"))).alias("x"))
        part = part.select("rid", "at", (F.col("lo") + F.col("x.a")).alias("a"), (F.col("lo") + F.col("x.b")).alias("b"))
        return keep(stored(whole.unionAll(behind).unionAll(part), "runs"))


def cut_spans(size: int, starts: list[tuple[int, int]], factor: int) -> list[tuple[int, int]]:
    """Maximal byte spans [begin, end) covered by the factors at runs of window starts."""
    spans: list[tuple[int, int]] = []
    for a, b in sorted(starts):
        end = min(size, b + factor)
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
        else:
            spans.append((a, end))
    return spans


def _kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def _on_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


_RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", factor: int = 200, keep_first: bool = True, keep_text: bool = True, whole_chars: bool = False) -> DataFrame:
    """Each row of ``docs`` with ``n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, ``kept`` (the bytes left).

    Removed is every byte covered by a ``factor``-byte string (at least 48) of
    the text's UTF-8 that also starts at an earlier place in (id, offset) order,
    the same text included; with ``keep_first=False``, at any other place.
    Strings are judged on the input and never span two texts. ``whole_chars``
    shrinks removed spans to whole characters, so that the bytes left are UTF-8. Null texts count
    as empty, and their ``kept`` is null; null ids come last in the order; rows
    that repeat both id and text count as one place for ``keep_first``, and as
    two otherwise. Shorter texts come out whole. The text column gives way to
    ``kept``; all others stay, whatever their names, but for those named like a
    column of the result. No rows, no result.
    """
    if factor < GRAM:
        raise ValueError(f"factor is at least {GRAM}")
    out = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    kept_columns, fields = without(docs.drop(text_col) if text_col != id_col else docs, out, keep=(id_col,))
    others = [f.name for f in fields]
    rid, at, t, rid0, at0, spans_ = free_names([*others, *out], "rid", "at", "t", "rid0", "at0", "spans")
    text = named(text_col).cast("string")
    # rows with the same id and text share the id and this hash; without an id only the hash tells texts apart
    docs = docs.select(*kept_columns, F.xxhash64(F.lit(1), text).alias(rid), named(id_col).alias(at), text.alias(t))
    runs = repeated_windows(docs.select(F.col(rid).alias("rid"), F.col(at).alias("at"), F.col(t).alias("t")), factor, keep_first)
    spans = runs.groupBy(F.col("rid").alias(rid0), F.col("at").alias(at0)).agg(F.collect_list(F.struct("a", "b")).alias(spans_))
    joined = docs.join(spans, (F.col(rid) == F.col(rid0)) & F.col(at).eqNullSafe(F.col(at0)), "left")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {c: [] for c in out}
            for text, starts in zip(batch.column(len(others)), batch.column(len(others) + 1), strict=True):
                data = _utf8(text.as_py())
                cut = cut_spans(len(data), [(x["a"], x["b"]) for x in starts.as_py() or ()], factor)
                if whole_chars:
                    cut = _on_characters(data, cut)
                kept = _kept(data, cut)
                found["n_bytes"].append(len(data))
                found["n_removed"].append(len(data) - len(kept))
                found["n_spans"].append(len(cut))
                found["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                found["kept"].append(kept if keep_text and text.is_valid else None)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *(pa.array(found[c], k) for c, k in zip(out, kinds, strict=True))], names=[*others, *out])

    kinds = (T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BinaryType())
    result = by_place(joined.select(*map(named, others), F.col(t), F.col(spans_))).mapInArrow(tidied(digest), T.StructType([*fields, *map(T.StructField, out, kinds)]))
    return result if keep_text else result.drop("kept")
