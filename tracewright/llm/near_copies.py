"""Near copies: documents whose sets of word shingles have a Jaccard similarity of at least a given one.

SimHash fingerprints meet under their Golay keys and are verified on the sets;
an exact search finds the links between what these leave apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.graph import connected_components
from ..plans.spread import hot_from, join_each
from ..plans.storage import discard, passing, release, stored
from .columns import free_names, named, tidied, tidy
from .simhash import fuzzy_keys, set_fingerprint

SEED = 42
#: Bytes of text whose shingles one task counts at a time, and that are cut into shingles at a time.
COUNT_BYTES, CUT_BYTES = 1 << 22, 1 << 21
#: Sets of a list that all others of it are compared with in a turn, and turns before the rest is compared in full, in blocks.
CENTRES, TURNS, BLOCK_SETS = 2, 2, 4096
SKETCH = 16
#: Links that connect as all do, up to which one task unites them.
FEW_LINKS = 1 << 17
_LIST = ["la", "lb"]


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """The sorted distinct XXH64 of the word shingles; a shorter text is one shingle, a wordless or null one has none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # as text_fingerprint
    if not tokens:
        return np.empty(0, np.uint64)
    total = max(1, len(tokens) - words + 1)
    shingles = map(b" ".join, zip(*(tokens[k:] for k in range(words)), strict=False)) if len(tokens) >= words else iter([b" ".join(tokens)])
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in islice(shingles, total)), dtype=np.uint64, count=total))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """``SKETCH`` longs, in which every shingle sets one bit: two sets differ in as many shingles at least as their sketches in bits."""
    bits = np.zeros(64 * SKETCH, dtype=np.uint8)
    bits[(shingles >> np.uint64(20)).astype(np.int64) % len(bits)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def least_shared(n: Column, percent: int) -> Column:
    """The least overlap that a set of ``n`` needs for the similarity, whatever the other set is: ``ceil(percent / 100 n)``."""
    return ((n * percent + 99) / 100).cast("long")


def text_key(text: Column) -> list[Column]:
    """128 bits that tell texts apart, null ones too, as two longs ``h1`` and ``h2``."""
    return [F.xxhash64(F.lit(k), text).alias(f"h{k}") for k in (1, 2)]


def _candidates(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """``id, h1, h2`` of the rows (with t) that may have a near copy: enough of their shingles stand in another row too.

    Shingles are counted in packed blocks, one a batch and part of the hash
    space, by 24 further bits of the hash: a collision can only keep a row. Back
    come, by block, the numbers of shared shingles of its rows.
    """
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = int(size // COUNT_BYTES) + 1
    kind = rows.schema["id"].dataType.simpleString()
    row = f"struct<id:{kind},h1:long,h2:long>"

    def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        begin, held = 0, 0
        for k, n in enumerate(pc.fill_null(pc.binary_length(batch.column(3)), 0).to_pylist()):
            if held and held + n > CUT_BYTES or k - begin == 1 << 16:  # a row's place in its batch has 16 bits
                yield batch.slice(begin, k - begin)
                begin, held = k, 0
            held += n
        if begin < batch.num_rows:
            yield batch.slice(begin)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in slices(whole)):
            sets = [shingle_set(t.as_py(), words) for t in batch.column(3)]
            size = np.array([len(s) for s in sets], dtype=np.int64)
            every = np.concatenate(sets)
            name = xxhash.xxh3_64_intdigest(every.tobytes() + size.tobytes() + b"".join(batch.column(c).to_numpy().tobytes() for c in (1, 2)) + repr(batch.column(0).to_pylist()).encode()) >> 1
            part = (every % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, place = part[order], np.repeat(np.arange(len(size), dtype=np.uint16), size)[order]
            low = np.ascontiguousarray((every >> np.uint64(32)).astype("<u4")[order].view(np.uint8).reshape(-1, 4)[:, :3])
            del sets, every, order
            found, begin = np.unique(part, return_index=True)
            ends = [*begin[1:].tolist(), len(part)]
            for k, a, b in zip(found.tolist(), begin.tolist(), ends, strict=True):
                steps = np.diff(place[a:b], prepend=np.uint16(0)).astype("<u2").view(np.uint8).reshape(-1, 2)  # rows rise, so most upper bytes are zero
                yield block(name, k, low[a:b].tobytes(), steps.T.tobytes(), None, None)
            own = pa.StructArray.from_arrays([batch.column(c) for c in range(3)], names=["id", "h1", "h2"])
            yield block(name, name % parts, None, None, pa.array(size), own)

    def block(name: int, part: int, low: bytes | None, place: bytes | None, sizes: pa.Array | None, own: pa.Array | None) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.struct([("id", id_kind), ("h1", pa.int64()), ("h2", pa.int64())]))
        lists = [pa.nulls(1, pa.list_(t)) if x is None else pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x, t in zip((sizes, own), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int64()), *(pa.array([x], pa.binary()) for x in (low, place)), *lists], names=["batch", "part", "low", "place", "sizes", "own"])

    id_kind = to_arrow_type(rows.schema["id"].dataType)

    def count(blocks: pa.Table) -> pa.Table:
        tidy()
        named_, full = blocks.filter(pc.is_null(blocks["low"])), blocks.filter(pc.is_valid(blocks["low"]))
        names = ["batch", "part", "place", "sizes", "own"]
        if not full.num_rows:
            return named_.select(names)
        packed = [np.frombuffer(x.as_py(), np.uint8).reshape(-1, 3) for x in full["low"]]
        ends = np.cumsum([0, *map(len, packed)])
        every = np.zeros((ends[-1], 4), dtype=np.uint8)
        for x, a in zip(packed, ends.tolist(), strict=False):
            every[a : a + len(x), :3] = x
        every = every.view("<u4").ravel()
        order = np.argsort(every, kind="stable")
        same = every[order][1:] == every[order][:-1]
        shared = np.zeros(len(every), dtype=bool)
        shared[order[1:]] |= same
        shared[order[:-1]] |= same
        counts = []
        for x, a, b in zip(full["place"], ends.tolist(), ends[1:].tolist(), strict=False):
            place = np.cumsum(np.ascontiguousarray(np.frombuffer(x.as_py(), np.uint8).reshape(2, -1).T).view("<u2").ravel(), dtype=np.int64)
            which, times = np.unique(place[shared[a:b]], return_counts=True)
            # how many rows there are comes before them
            counts.append(np.int64(len(which)).tobytes() + which.astype("<u2").tobytes() + times.astype("<u4").tobytes())
        full = full.set_column(full.schema.get_field_index("place"), "place", pa.array(counts, pa.binary()))
        return pa.concat_tables([full.select(names), named_.select(names)])

    def choose(blocks: pa.Table) -> pa.Table:
        own = blocks.filter(pc.is_valid(blocks["own"]))
        copies, own = own.num_rows, own.slice(0, 1)  # batches of one name are alike
        size = np.array(own["sizes"][0].as_py(), dtype=np.int64)
        counts = blocks.filter(pc.is_null(blocks["own"]))
        seen, shared = set(), np.zeros(len(size), dtype=np.int64)
        for part, x in zip(counts["part"].to_pylist(), counts["place"].to_pylist(), strict=True):
            if part not in seen:
                seen.add(part)
                n = int(np.frombuffer(x[:8], np.int64)[0])
                shared[np.frombuffer(x[8 : 8 + 2 * n], "<u2")] += np.frombuffer(x[8 + 2 * n :], "<u4")
        kept = (shared >= (size * percent + 99) // 100) | (copies > 1)
        return pa.table({"own": own["own"].combine_chunks().flatten().filter(pa.array(kept))})

    blocks = rows.select("id", "h1", "h2", "t").mapInArrow(tidied(cut), f"batch long, part long, low binary, place binary, sizes array<long>, own array<{row}>")
    marked = blocks.groupBy("part").applyInArrow(count, f"batch long, part long, place binary, sizes array<long>, own array<{row}>")
    return marked.groupBy("batch").applyInArrow(choose, f"own {row}").select("own.*").distinct()


def _linked(members: DataFrame, percent: int, other: DataFrame, keys: list[str]) -> DataFrame:
    """``a, b`` (a < b) of the rows of a list that may be similar and lie in two components.

    The shingle that two sets share first has ``rem`` shingles of its set from
    it on, and the overlap that they need is at most the lesser number.
    """
    fits = F.least(F.col("rem"), F.col("rem0")) * (100 + percent) >= percent * (F.col("n") + F.col("n0"))
    met = members.join(other, keys).where(fits & (F.col("c") != F.col("c0")) & (F.col("key") != F.col("key0")))
    return met.select(F.least("key", "key0").alias("a"), F.greatest("key", "key0").alias("b"))


def _other(members: DataFrame) -> DataFrame:
    return members.select(*_LIST, *[F.col(c).alias(f"{c}0") for c in ("key", "n", "rem", "c")])


def _with_centres(members: DataFrame, turn: int, percent: int) -> DataFrame:
    """``a, b``: the sets of long lists with a few sets of each, others every turn; of two components."""
    order = Window.partitionBy(*_LIST).orderBy(F.xxhash64("key", F.lit(turn)), "key")
    first = members.withColumn("r", F.row_number().over(order)).where(F.col("r") <= CENTRES)
    centres = _other(first).join(members.groupBy(*_LIST).agg(F.count(F.lit(1)).alias("rows")), _LIST)
    total = members.count()
    met = join_each(members, centres, _LIST, F.col("key"), hot_from(total), "rows")
    fits = F.least(F.col("rem"), F.col("rem0")) * (100 + percent) >= percent * (F.col("n") + F.col("n0"))
    return met.where(fits & (F.col("c") != F.col("c0")) & (F.col("key") != F.col("key0"))).select(F.least("key", "key0").alias("a"), F.greatest("key", "key0").alias("b"))


def _in_blocks(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``a, b``: all pairs of lists whose sets lie in two components, but for those inside a list's most frequent component.

    Both sides are dealt to blocks, so that no task holds a whole list. Pairs
    whose sketches differ in more bits than similar sets can are left out.
    """
    counts = members.groupBy(*_LIST, "c").agg(F.count(F.lit(1)).alias("k"))
    stats = counts.groupBy(*_LIST).agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.sum("k").alias("k"), (F.sum("k") - F.max("k")).alias("minor"))
    blocks = [F.ceil(F.col(c) / BLOCK_SETS).cast("long").alias(f"b{c}") for c in ("minor", "k")]
    stats = stored(stats.where("minor > 0").select(*_LIST, "main", *blocks), "list-blocks")
    def numbers(c: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    rows = members.join(stats, _LIST).join(nodes.select("key", "bits"), "key")
    left = rows.where("c <> main").withColumn("i", F.pmod(F.xxhash64("key"), F.col("bminor"))).withColumn("j", numbers("bk"))
    right = rows.withColumn("j", F.pmod(F.xxhash64("key"), F.col("bk"))).withColumn("i", numbers("bminor"))
    right = right.select(*_LIST, "i", "j", *[F.col(c).alias(f"{c}0") for c in ("key", "n", "rem", "c", "bits")])
    differ = sum((F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("bits0")[k])) for k in range(SKETCH)), F.lit(0))
    both = F.col("n") + F.col("n0")
    fits = (F.least(F.col("rem"), F.col("rem0")) * (100 + percent) >= percent * both) & ((both - differ) * (100 + percent) >= 2 * percent * both)
    met = left.join(right, [*_LIST, "i", "j"]).where(fits & (F.col("c") != F.col("c0")))
    return met.select(F.least("key", "key0").alias("a"), F.greatest("key", "key0").alias("b"))


def _lists(nodes: DataFrame, percent: int) -> DataFrame:
    """``la, lb, m, key, n, rem``: for each shingle of a prefix the sets that have it there, lists that are alike once.

    A node's shingles are ordered from the rarest on; two similar sets share one
    of the first ``n - least_shared + 1`` (prefix filter). A list is known by 128
    bits over its sets, ``m`` is its length, ``rem`` how many shingles a set has
    from the list's first shingle on. Sets that cannot reach the overlap with
    the shortest set of the list, nor with the shortest similar one, are left out.
    """
    each = nodes.select("key", "n", F.explode("shingles").alias("x"))
    often = each.groupBy("x").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    common = join_each(each, often.withColumn("rows", F.col("df")), ["x"], F.col("key"), hot_from(each.count()), "rows")
    common = common.groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("c"))
    first = F.size("c") - least_shared(F.col("n"), percent) + 1  # of the prefix, without the shingles of this set alone
    common = common.where(first > 0).select("key", "n", F.size("c").alias("size"), F.posexplode(F.slice("c", F.lit(1), first.cast("int"))).alias("at", "c"))
    prefix = stored(common.select("key", "n", "c.x", (F.col("size") - F.col("at")).cast("long").alias("rem")), "prefixes")
    own = [F.bit_xor(F.xxhash64(F.lit(k), "key")).alias(name) for k, name in enumerate(_LIST)]
    lists = prefix.groupBy("x").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("shortest"), *own).where("m > 1")
    rows = join_each(prefix, lists.withColumn("rows", F.col("m")), ["x"], F.col("key"), hot_from(prefix.count()), "rows")
    rows = rows.groupBy("key", "n", "m", "shortest", *_LIST).agg(F.max("rem").alias("rem"))
    least = F.greatest(F.col("shortest"), least_shared(F.col("n"), percent))
    found = stored(rows.where(F.col("rem") * (100 + percent) >= percent * (F.col("n") + least)).drop("shortest"), "prefix-lists")
    discard(prefix)
    return found


def _buckets(nodes: DataFrame) -> DataFrame:
    """``la, lb, m, key, n, rem, c``: the sets whose fingerprints share a Golay key, as lists; each set is a component of its own."""
    keys = fuzzy_keys(nodes.select("fp", F.col("key").alias("node"), "n"), ("node", "n"))
    keys = stored(keys.select(F.col("key").alias("la"), F.lit(0).cast("long").alias("lb"), F.col("node").alias("key"), "n"), "fingerprint-keys")
    lists = keys.groupBy(*_LIST).agg(F.count(F.lit(1)).alias("m")).where("m > 1").withColumn("rows", F.col("m"))
    met = join_each(keys, lists, _LIST, F.col("key"), hot_from(keys.count()), "rows")
    return stored(met.select(*_LIST, "m", "key", "n", F.col("n").alias("rem"), F.col("key").alias("c")), "fingerprint-lists")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``id_col, h1, h2, rows, component_id, kept`` of the rows with a near copy: those that links of similarity >= ``percent`` / 100 connect.

    h1 and h2 are 128 bits of the row's text (``text_key``), so that rows which
    repeat an id are told apart; rows that repeat both come back once, with
    their number.
    component_id is the smallest id reachable, ``kept`` marks the one (id, text)
    with it; of texts without id the one with the least bits. The links are
    exact, up to collisions of 64-bit hashes of shingles. Rows with enough
    shingles that others hold too are candidates; equal sets are one node. Nodes
    whose SimHash fingerprints share a Golay key are compared first. Copies just
    over the similarity differ in more bits than such keys bear, so an exact
    search follows among what is not connected yet: sets meet in the lists of
    their rarest shingles. Long lists are first compared with a few of their
    sets, and at last in all pairs that no links connect: a group of near copies
    that a few connect costs rows in proportion to it, sets that share shingles
    without being similar by pairs.
    Texts without words, null ones included, are near copies of each other.
    Extra columns are ignored, whatever their names. No rows, no result.
    """
    text = named(text_col).cast("string")
    rows = docs.select(named(id_col).alias("id"), *text_key(text), text.alias("t"))
    with passing(docs.sparkSession) as keep:
        chosen = stored(_candidates(rows, words, percent), "candidates")
        release(docs.sparkSession)  # the shuffles of all shingles are read
        held = chosen.select(*[F.col(c).alias(f"{c}_") for c in chosen.columns])
        same = F.col("id").eqNullSafe(F.col("id_")) & (F.col("h1") == F.col("h1_")) & (F.col("h2") == F.col("h2_"))
        kind = rows.schema["id"].dataType.simpleString()

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = [shingle_set(t.as_py(), words) for t in batch.column(3)]
                key = [xxhash.xxh3_128_digest(s.tobytes()) for s in own]
                ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
                flat = np.concatenate([np.empty(0, np.uint64), *own]).view(np.int64)
                bits = pa.array([sketch(s) for s in own], pa.list_(pa.int64()))
                fp = pa.array([set_fingerprint(s) for s in own], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(key, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), bits, fp], names=["id", "h1", "h2", "key", "shingles", "bits", "fp"])

        rows = rows.join(held, same, "left_semi").mapInArrow(tidied(sets), f"id {kind}, h1 long, h2 long, key binary, shingles array<long>, bits array<long>, fp long")
        rows = stored(rows, "shingle-sets")
        discard(chosen)
        release(docs.sparkSession)  # and that of all texts
        place = F.struct(F.col("id").isNull().alias("z"), "id", "h1", "h2")
        nodes = rows.groupBy(F.col("key").alias("own")).agg(F.min(place).alias("least"), F.first("shingles").alias("shingles"), F.first("bits").alias("bits"), F.first("fp").alias("fp"))
        # a node's number is fixed by being written; numbers are smaller than keys, and no two nodes share one
        nodes = stored(nodes.withColumn("n", F.size("shingles").cast("long")).withColumn("key", F.monotonically_increasing_id()), "nodes")
        def verified(pairs: DataFrame) -> DataFrame:
            met = pairs = stored(pairs.distinct(), "pairs")
            most = hot_from(pairs.count())
            for k in "ab":  # a centre has a pair with each set of its lists
                own = nodes.select(F.col("key").alias(k), F.col("shingles").alias(f"s{k}"))
                if most is not None:
                    own = own.join(stored(met.groupBy(k).agg(F.count(F.lit(1)).alias("rows")), "pair-counts"), k)
                pairs = join_each(pairs, own, [k], F.col("b" if k == "a" else "a"), most, "rows")
            both = F.size(F.array_intersect("sa", "sb"))
            found = stored(pairs.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b"), "links")
            discard(met)
            return found

        def compared(members: DataFrame, turn: int) -> DataFrame:
            short, long = members.where(F.col("m") <= 2 * CENTRES), members.where(F.col("m") > 2 * CENTRES)
            if turn == 0:
                return verified(_linked(short, percent, _other(short), _LIST).unionAll(_with_centres(long, 0, percent)))
            return verified(_with_centres(long, turn, percent) if turn < TURNS else _in_blocks(long, nodes, percent))

        links = compared(keep(_buckets(nodes)), 0)  # these lists, small beside the texts, stay to be looked at
        found = stored(connected_components(links, "a", "b", few=FEW_LINKS), "parts")
        lists = _lists(nodes, percent)
        release(docs.sparkSession)
        for turn in range(TURNS + 1):
            members = lists.join(found, F.col("key") == F.col("node"), "left").select(*_LIST, "m", "key", "n", "rem", F.coalesce("component", "key").alias("c"))
            mixed = members.groupBy(*_LIST).agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select(*_LIST)
            members = stored(members.join(mixed, _LIST, "left_semi").where(F.col("m") > (2 * CENTRES if turn else 0)), "mixed-lists")
            if members.isEmpty():
                break
            more = compared(members, turn)
            discard(members)
            if more.isEmpty():
                continue
            links = links.unionAll(more)
            found = stored(connected_components(links, "a", "b", few=FEW_LINKS), "parts")
        grouped = nodes.join(found, nodes["key"] == found["node"], "left").select("own", "least", F.coalesce("component", "key").alias("component"))
        first = grouped.groupBy("component").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("rows"))
        most = hot_from(nodes.count())
        repeats = keep(stored(rows.groupBy("id", "h1", "h2", F.col("key").alias("own")).agg(F.count(F.lit(1)).alias("rows")), "repeats"))
        of_key = join_each(grouped, stored(first, "firsts"), ["component"], F.col("own"), most, "rows").select("own", "first")
        of_key = keep(stored(of_key.join(repeats.groupBy("own").agg(F.count(F.lit(1)).alias("n")), "own"), "named-nodes"))
    result = join_each(repeats, of_key, ["own"], F.col("h1"), hot_from(repeats.count()))
    return result.select(F.col("id").alias(id_col), "h1", "h2", "rows", F.col("first.id").alias("component_id"), (place == F.col("first")).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near copies, that of the smallest id; rows without a near copy stay.

    Rows are taken out, not ids: a text that shares its id with a copy stays. Of
    rows that repeat id and text one stays, the one whose columns have the least
    hash. Null ids come last. Columns keep their names, whatever these are.
    """
    names = docs.columns
    h1, h2, *others = free_names(names, "h1", "h2", "id0", "h10", "h20", "rows", "kept")
    id0, h10, h20, rows, kept = others
    text = named(text_col).cast("string")
    found = near_copies(docs, id_col, text_col, words, percent)
    found = found.select(named(id_col).alias(id0), F.col("h1").alias(h10), F.col("h2").alias(h20), F.col("rows").alias(rows), F.col("kept").alias(kept))
    keyed = docs.select(*map(named, names), *(c.alias(n) for c, n in zip(text_key(text), (h1, h2), strict=True)))
    same = named(id_col).eqNullSafe(F.col(id0)) & (F.col(h1) == F.col(h10)) & (F.col(h2) == F.col(h20))
    joined = keyed.join(found, same, "left").where(F.coalesce(F.col(kept), F.lit(True)))
    single = joined.where(F.coalesce(F.col(rows), F.lit(1)) == 1).select(*map(named, names))
    whole = F.struct(*map(named, names))
    several = joined.where(F.col(rows) > 1).groupBy(named(id_col).alias(id0), h1, h2).agg(F.min_by(whole, F.xxhash64(*map(named, names))).alias(kept))
    return single.unionAll(several.select(*[F.col(kept).getField(n).alias(n) for n in names]))
