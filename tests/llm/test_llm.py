"""The corpus operators against brute force, and their defined results for odd input."""

import hashlib
import os
import random
import tracemalloc
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm import golay, histograms, suffix_dedup, toxicity
from tracewright.llm.forest_search import forest_search
from tracewright.llm.graph_dedup import near_vectors
from tracewright.llm.mixing import mix_sources
from tracewright.llm import near_copies as near
from tracewright.llm.near_copies import near_copies
from tracewright.llm.packing import RoundRobin, byte_bpe, pack
from tracewright.llm.sharding import kd_shards
from tracewright.llm.simhash import set_fingerprint, simhash_components, text_fingerprint
from tracewright.llm.suffix_dedup import remove_repeats
from tracewright.llm.token_counts import WordBpe, count_tokens
from tracewright.llm.toxicity import OrdinalModel, fit, score, severity, text_features
from tracewright.llm.url_filter import judge_oracle, judge_urls
from tracewright.plans import storage

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, rid string, times string, shard string"


def docs(spark, rows):
    """(doc_id, text, source) with columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", "z", "w") for i, t, s in rows], DOCS)


def prose(seed, words):
    pick = random.Random(seed)
    return " ".join("".join(pick.choice("abcdefghilmnorstu") for _ in range(pick.randint(2, 9))) for _ in range(words))


ODD = [(0, None, "b"), (1, "", "b"), (2, "   \n\t", None), (3, "one", "a"), (4, "One two", "a"), (5, "ÀÉÎ ß 漢字 😀", "a"), (None, "no id here at all", "a"), (6, "long " * 30000, "a"), (7, "same text", "c"), (7, "same text", "c"), (8, "same text", "c")]


# ---- simhash ----

def test_golay_words_two_apart_share_a_codeword():
    lead = golay.error_patterns()[0][:, 0]  # every word up to a codeword
    def keys(words):
        index, used = golay.codeword_indices(words)
        return [set(a[:n].tolist()) for a, n in zip(index, used, strict=True)]
    near = keys(lead)
    for d in (0, 1, 2):
        for bits in combinations(range(23), d):
            assert all(a & b for a, b in zip(near, keys(lead ^ sum(1 << b for b in bits)), strict=True))


def test_fingerprint_counts_bits():
    text = "The cat SAT on\x0bthe mat  the cat sat"
    words = "the cat sat on the mat the cat sat".split()
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]), seed=42) for k in range(7)]
    want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > 7)
    assert text_fingerprint(text) % 2**64 == want
    assert text_fingerprint(None) == text_fingerprint(" \n") == 0
    assert text_fingerprint("two Words") % 2**64 == xxhash.xxh64_intdigest("two words", seed=42)


@pytest.mark.parametrize("crowd", [64, 2])
def test_simhash_links_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr("tracewright.llm.simhash.PAIRWISE_UP_TO", crowd)  # the small one sends buckets the other way
    base = prose(1, 400).split()
    rows = []
    for k in range(60):
        words = list(base)
        for j in range(k % 6):
            words[(37 * k + 11 * j) % 400] = f"w{k}x{j}"
        rows.append((100 + k, " ".join(words), "a"))
    rows += [(300 + k, prose(k, 50), "a") for k in range(20)] + ODD
    found = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash_components(docs(spark, rows)).collect()}
    fps = [(i, text_fingerprint(t)) for i, t, _ in rows]
    label = {i: i for i, _ in fps if i is not None}
    for _ in range(30):
        for (a, x), (b, y) in combinations([p for p in fps if p[0] is not None], 2):
            if bin((x ^ y) % 2**64).count("1") <= 2:
                label[a] = label[b] = min(label[a], label[b])
    assert {k: v for k, v in found.items() if k[0] is not None} == {(i, fp): label[i] for i, fp in fps if i is not None}
    assert simhash_components(docs(spark, [])).count() == 0


# ---- near copies ----

def edited_rows():
    rows = list(ODD)
    for k in range(40):
        words = prose(50 + k % 20, 300).split()
        for j in range(k % 20):  # 0 to 19 words edited: a similarity from 1 down to 0.5
            words[7 + 15 * j] = f"e{k}x{j}"
        rows.append((100 + k, " ".join(words), "a"))
    return rows + [(500 + k, prose(900, 200 + 30 * k), "a") for k in range(6)]


@pytest.mark.parametrize("centres", [8, 1])
def test_near_copies_equal_brute_force(spark, monkeypatch, centres):
    monkeypatch.setattr("tracewright.llm.near_copies.CENTRES", centres)  # with one, lists of three go through all turns
    monkeypatch.setattr("tracewright.llm.near_copies.COUNT_BYTES", 1 << 16)
    rows = [r for r in edited_rows() if r[0] is not None]
    sets = []
    for _, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = {r[0]: r[0] for r in rows}
    for _ in range(30):
        for (a, x), (b, y) in combinations(zip([r[0] for r in rows], sets, strict=True), 2):
            if 10 * len(x & y) >= 8 * len(x | y):
                label[a] = label[b] = min(label[a], label[b])
    found = {r["doc_id"]: r["component_id"] for r in near_copies(docs(spark, edited_rows())).collect()}
    assert {k: found.get(k, k) for k in label} == label and len(set(label.values())) < len(label) - 10
    assert near_copies(docs(spark, [])).count() == 0


def test_near_copies_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr("tracewright.plans.spread.HOT_ROWS", 20)
    monkeypatch.setattr("tracewright.llm.near_copies.BLOCK_SETS", 3)
    test_near_copies_equal_brute_force(spark, monkeypatch, 1)


def test_sketches_never_lose_a_similar_pair():
    pick = random.Random(3)
    for _ in range(300):
        both = [pick.getrandbits(64) for _ in range(pick.randint(0, 400))]
        a, b = ([*both, *(pick.getrandbits(64) for _ in range(pick.randint(0, 60)))] for _ in range(2))
        x, y = (near.sketch(np.unique(np.array(s, dtype=np.uint64))) for s in (a, b))
        assert sum((int(u) ^ int(v)).bit_count() if u >= 0 and v >= 0 else ((int(u) ^ int(v)) % 2**64).bit_count() for u, v in zip(x, y, strict=True)) <= len(set(a) ^ set(b))


def test_near_copies_meet_by_fingerprints_first(spark, monkeypatch):
    """Lightly edited copies share Golay keys of their fingerprints, and need no exact search; the others get one."""
    rows = [(k, t, s) for k, t, s in edited_rows() if k is not None and (k < 100 or k % 20 < 2)]
    shown = []
    monkeypatch.setattr(near, "_buckets", lambda nodes, own=near._buckets: shown.append(own(nodes)) or shown[0])
    found = {r["doc_id"]: r["component_id"] for r in near_copies(docs(spark, rows)).collect()}
    assert found[120] == 100 and found[121] == 101
    by_list = {}
    for r in shown[0].collect():
        by_list.setdefault(r["la"], set()).add(r["key"])
    assert any(len(keys) > 1 for keys in by_list.values())
    # with no list of rare shingles the fingerprints alone link them
    monkeypatch.setattr(near, "_lists", lambda nodes, percent, own=near._lists: own(nodes, percent).limit(0))
    alone = {r["doc_id"]: r["component_id"] for r in near_copies(docs(spark, rows)).collect()}
    assert alone[121] == 101 and alone[8] == alone[7]


def test_fingerprints_of_sets():
    picked = np.unique(np.random.default_rng(4).integers(0, 2**63, 301).astype(np.uint64))
    want = sum(1 << b for b in range(64) if sum(int(x) >> b & 1 for x in picked) * 2 > len(picked))
    assert set_fingerprint(picked) % 2**64 == want and set_fingerprint(picked[:0]) == 0


def test_pipeline_drops_edited_copies(spark):
    import corpus_pipeline

    text = prose(77, 400).split()
    edited = [" ".join(f"new{k}" if j in (50, 150, 250, 350)[:k] else w for j, w in enumerate(text)) for k in range(5)]
    table = docs(spark, [(k, t, "a") for k, t in enumerate(edited)] + [(9, prose(78, 400), "a")])
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, table, "").collect()} == {0, 9}


def test_stages_leave_only_what_their_results_need(spark):
    """A later stage's tables lie beside what an earlier one left: before, eight and more tables of all shingle sets and stretches."""
    import corpus_pipeline

    own = storage._own_dir(spark).removeprefix("file:")
    table = docs(spark, [(k, prose(k % 8, 60), "a") for k in range(12)] + [(20 + k, f"{prose(90 + k, 40)} {prose(50, 60)}", "a") for k in range(4)])
    for stage, left, want in ((corpus_pipeline.drop_near_copies, {"repeats", "named-nodes", "fingerprint-lists"}, 12), (corpus_pipeline.drop_repeated_passages, {"runs"}, 16)):
        before = set(os.listdir(own)) if os.path.isdir(own) else set()
        found = stage(spark, table, "")
        assert {x.rpartition("-")[0] for x in set(os.listdir(own)) - before} == left
        if stage is corpus_pipeline.drop_near_copies:
            assert found.count() == want
        else:
            assert {r["doc_id"]: prose(50, 60) in r["text"] for r in found.where("doc_id >= 20").collect()} == {20: True, 21: False, 22: False, 23: False}


def test_tables_of_an_inner_block_go_with_the_outer_one(spark):
    def there(table):
        return os.path.isdir(table.stored_path_.removeprefix("file:"))

    with storage.passing(spark) as keep:
        first = storage.stored(spark.range(3), "first")
        with storage.passing(spark) as keep_inner:
            second, third = storage.stored(spark.range(2), "second"), keep_inner(storage.stored(spark.range(1), "third"))
        assert there(first) and not there(second) and there(third)
        fourth = keep(storage.stored(spark.range(4), "fourth"))
    assert not there(first) and not there(third) and fourth.count() == 4


# ---- suffix array ----

def brute_repeats(rows, factor, keep_first):
    seen = Counter()
    starts = [[(t or "").encode()[k : k + factor] for k in range(len((t or "").encode()) - factor + 1)] for _, t in rows]
    for own in starts:
        seen.update(own)
    out, before = [], set()
    for (i, t), own in zip(rows, starts, strict=True):
        data = (t or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for k, s in enumerate(own):
            if (s in before) if keep_first else seen[s] > 1:
                gone[k : k + factor] = True
            before.add(s)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowd", [4000, 1])
@pytest.mark.parametrize("keep_first", [False, True])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, keep_first, crowd):
    monkeypatch.setattr("tracewright.llm.suffix_dedup.CROWD", crowd)
    shared, other = prose(5, 60), prose(6, 300)
    rows = [(k, f"{prose(10 + k, 20 + k)} {shared} {prose(50 + k, 30)}") for k in range(12)]
    rows += [(20, other), (21, other), (22, other[:700] + "X" + other[700:]), (23, "Is " * 200), (24, "a" * 500), (25, None), (26, ""), (27, "x" * 199), (28, "é" * 150 + shared)]
    found = remove_repeats(docs(spark, [(i, t, "a") for i, t in rows]), factor=200, keep_first=keep_first)
    mine = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found.collect()), key=str)
    assert mine == brute_repeats(rows, 200, keep_first)


@pytest.mark.parametrize("length", [48, 200])
def test_longest_previous_factors_equal_brute_force(length):
    pick = random.Random(length)
    text = "".join(pick.choice("ab") * pick.choice((1, 1, 3, 60)) for _ in range(120)).encode()
    text += text[100:400] + b"c" + text[:250]
    starts = np.arange(len(text) - length + 1)
    order = suffix_dedup.SuffixOrder(np.frombuffer(text, np.uint8), starts, length)
    position = np.array(pick.sample(range(5000), len(starts)))  # places in any order

    def common(a, b):
        n = 0
        while n < length and text[a + n] == text[b + n]:
            n += 1
        return n

    want = [[max((common(s, o) for o, q in zip(starts, position, strict=True) if sign * q < sign * p), default=0) for s, p in zip(starts, position, strict=True)] for sign in (1, -1)]
    assert [f.tolist() for f in suffix_dedup.previous_factors(order, position)] == want
    assert [f.tolist() for f in suffix_dedup.previous_factors(order, position, to_the_byte=False)] == [[w // 8 * 8 for w in own] for own in want]


def test_sorting_stretches_takes_little_memory():
    """A task sorts SORT_BYTES at a time, two of them share the 1200 MB that an executor has beside its heap."""
    draw = random.Random(5)
    bodies = [draw.randbytes(277) for _ in range(suffix_dedup.SORT_BYTES // 277)]
    bodies[7] = bodies[3][:210] + bodies[7][:67]
    k = pa.array(range(len(bodies)), pa.int64())
    stretch = pa.table([k, k, k, pa.array([1] * len(bodies), pa.int64()), k, k, k, pa.array(bodies, pa.binary())], names=["mh", "code", "more", "n", "at", "rid", "lo", "body"])
    tracemalloc.start()
    try:
        found = suffix_dedup._sorted_repeats(stretch, 200)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 80e6
    rows = found.to_pylist()
    assert {x["mh"]: (x["repeated"], x["earlier"]) for x in rows if x["repeated"]} == {3: ([{"a": 0, "b": 10}], []), 7: ([{"a": 0, "b": 10}], [{"a": 0, "b": 10}])}


def test_suffix_dedup_odd_input(spark):
    found = remove_repeats(docs(spark, ODD), keep_first=False)
    assert found.count() == len(ODD) and remove_repeats(docs(spark, [])).count() == 0
    text = "ü" + prose(3, 80)
    cut = remove_repeats(docs(spark, [(1, "x" + text, "a"), (2, "é"[0] + text, "a")]), whole_chars=True)
    assert all(bytes(r["kept"]).decode() is not None for r in cut.collect())
    with pytest.raises(ValueError):
        remove_repeats(docs(spark, ODD), factor=10)


# ---- mixing, thresholds ----

def test_boundary_keys_equal_a_sort(spark):
    pick = random.Random(2)
    rows = [(g, pick.randrange(1 << 20) if g else pick.randrange(4), pick.randrange(50)) for g in (0, 1, None) for _ in range(300)]
    goals = [(0, 3000.0), (1, 2500.5), (None, 1.0), (9, 5.0)]
    found = {r["g"]: (r["h"], r["under"], r["v"]) for r in histograms.boundary_keys(spark.createDataFrame(rows, "g int, h long, size long"), spark.createDataFrame(goals, "g int, goal double"), 20).collect()}
    want = {}
    for g, goal in goals[:3]:
        under = 0
        for h in sorted({x[1] for x in rows if x[0] == g}):
            v = sum(x[2] for x in rows if x[0] == g and x[1] == h)
            if under + v >= goal:
                want[g] = h, under, v
                break
            under += v
    assert found == want


def test_mix_hits_targets(spark):
    rows = [(k, prose(k, 5 + k % 40), f"s{k % 5}") for k in range(400)] + ODD
    found = mix_sources(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    for source in {r["source"] for r in found}:
        own = [r for r in found if r["source"] == source]
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    assert sum({r["source"]: r["target"] for r in found}.values()) == pytest.approx(1.5 * sum(r["size"] for r in found))
    assert sorted(map(str, mix_sources(docs(spark, rows).repartition(7)).collect())) == sorted(map(str, found))
    assert mix_sources(docs(spark, [])).count() == 0


# ---- packing ----

def test_round_robin_serves_every_id_once():
    for sizes in ([5], [1000, 3, 0, 777], [1, 1, 1], [10**6, 10, 999]):
        robin = RoundRobin(sizes)
        counts = np.arange(0, robin.total + 1, max(1, robin.total // 500))
        n = robin.served(counts)
        assert (n.sum(axis=1) == counts).all() and (np.diff(n, axis=0) >= 0).all()
        assert np.abs(n - counts[:, None] * np.array(sizes) / robin.total).max() <= 1.01
    weighted = RoundRobin([100, 1000], [1.0, 1.0])
    assert weighted.served(np.array([100, 400])).tolist() == [[50, 50], [100, 300]]


def served_one_by_one(sizes, weights, window):
    """Deficit round-robin id by id: quanta grow until the next id of some queue is due; counts at the end of every window."""
    given, counts = [0] * len(sizes), []
    for k in range(1, sum(sizes) + 1):
        left = [s for s, n in enumerate(sizes) if given[s] < n]
        given[min(left, key=lambda s: ((given[s] + 0.5) / weights[s], s))] += 1
        if k % window == 0 or k == sum(sizes):
            counts.append(list(given))
    return counts


def test_round_robin_equals_serving_one_by_one():
    for sizes, weights in (([300, 40, 0, 7], [3.0, 1.0, 2.0, 1.0]), ([50, 50, 50], [1.0, 1.0, 1.0]), ([1, 500], [5.0, 1.0]), ([97, 31, 64, 12, 205], [0.3, 0.1, 0.2, 0.15, 0.25])):
        robin = RoundRobin(sizes, weights)
        counts = np.array(served_one_by_one(sizes, weights, 16))
        at = np.minimum(np.arange(1, len(counts) + 1) * 16, sum(sizes))
        assert robin.served(at).tolist() == counts.tolist()
        assert np.abs(robin.deficits(at, counts)).max() <= len(sizes)


def test_pack_follows_the_weights(spark):
    rows = [(k, prose(k, 60), f"s{k % 3}") for k in range(90)] + [(900 + k, prose(k, 3), f"t{k:02d}") for k in range(30)]
    weights = spark.createDataFrame([("s0", 3.0), ("s1", 1.0), ("s2", 2.0), ("nobody", 9.0)], "source string, weight double")
    pieces = pack(docs(spark, rows), BYTE_BPE, window=128, weights=weights, most_queues=4).collect()
    encode, total, share = byte_bpe(BYTE_BPE), Counter(), {}
    for i, t, s in rows:
        total[s] += len(encode(t)) // 4 + 1
    by_window = {}
    for p in pieces:
        by_window.setdefault(p["sequence_id"], Counter())[p["source"]] += p["length"]
        assert abs(p["deficit"]) <= 5
    whole = Counter()
    for own in by_window.values():
        whole.update(own)
    assert whole == total and all(sum(c.values()) == 128 for w, c in by_window.items() if w != max(by_window))
    first = sum((by_window[w] for w in range(5)), Counter())
    assert abs(first["s0"] - 3 * first["s1"]) <= 6 and abs(first["s2"] - 2 * first["s1"]) <= 6


def test_byte_bpe_is_the_library_on_odd_and_real_texts():
    from tokenizers import Tokenizer

    whole, encode, pick = Tokenizer.from_file(BYTE_BPE), byte_bpe(BYTE_BPE), random.Random(12)
    texts = ["".join(chr(pick.choice((pick.randrange(32, 127), pick.randrange(0xA0, 0x2FFF), pick.randrange(0x3000, 0xD7FF), pick.randrange(0xE000, 0x10FFFF), 10, 32, 0x0301, 0x200D))) for _ in range(pick.randint(1, 300))) for _ in range(400)]
    if os.path.exists("/root/testdata/sf0.001/documents.parquet"):
        import pyarrow.parquet as pq

        texts += [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()]
    for text, e in zip(texts, whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(encode(text), "<u4").tolist() == e.ids


def test_byte_bpe_is_the_library():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BYTE_BPE)
    for text in ("", " a  b\n\n c\t", "it's <|endoftext|> here", "漢字 ñandú 😀", "x" * 3000, prose(1, 200)):
        assert np.frombuffer(byte_bpe(BYTE_BPE)(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_pack_round_trip(spark):
    rows = [(100 + k, prose(k, 10 + 7 * k), f"s{k % 3}") for k in range(60)] + ODD
    pieces = pack(docs(spark, rows), BYTE_BPE, window=256).collect()
    encode = byte_bpe(BYTE_BPE)
    whole = {i: encode(t or "") + b"\x01\0\0\0" for i, t, _ in rows}
    by_doc, by_window = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_window.setdefault(p["sequence_id"], []).append(p)
        assert zlib.crc32(bytes(p["ids"])) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"]
    for i, own in by_doc.items():
        times = sum(1 for r in rows if r[0] == i)
        assert sum(p["length"] for p in own) == times * len(whole[i]) // 4
        if times == 1:
            assert b"".join(bytes(p["ids"]) for p in sorted(own, key=lambda p: p["start"])) == whole[i]
    assert set(by_doc) == set(whole)
    last = max(by_window)
    for w, own in by_window.items():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 256 or w == last
    assert sorted(by_window) == list(range(last + 1))
    assert pack(docs(spark, []), BYTE_BPE).count() == 0


# ---- token counts ----

def test_counts_do_not_depend_on_what_is_remembered(monkeypatch):
    texts = [prose(k % 7, 60) for k in range(40)]
    want = WordBpe(WORD_BPE).counts(iter(texts))
    monkeypatch.setattr("tracewright.llm.token_counts.REMEMBERED", 50)
    monkeypatch.setattr("tracewright.llm.token_counts.BATCH_SYMBOLS", 300)
    assert WordBpe(WORD_BPE).counts(iter(texts)) == want


def test_counts_are_the_library_s(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORD_BPE)
    pick = random.Random(4)
    texts = ["", " ", "ΟΔΟΣ ΣΑΣ", "İstanbul", "aaaaaaaaaaaaaaaaaa", "it's <|endoftext|>x<|startoftext|>", "12 345", "é é", "x" * 4000, "\x85\x1c z", prose(1, 300)]
    texts += ["".join(pick.choice("abcdeéÉß'.,! \n\t12ΣσÅ漢😀-") for _ in range(pick.randint(1, 200))) for _ in range(100)]
    assert WordBpe(WORD_BPE).counts(iter(texts)) == [len(e.ids) for e in whole.encode_batch(texts, add_special_tokens=False)]
    found = count_tokens(docs(spark, ODD), WORD_BPE)
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in found.collect()) == sorted((str(i), len(whole.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in ODD)
    assert found.where("doc_id = 6").first()["over_limit"] and count_tokens(docs(spark, []), WORD_BPE).count() == 0


# ---- toxicity ----

def test_ordinal_model_separates_and_orders(spark):
    bad = ["vile", "scum", "filth"]
    rows, marks = [], []
    for k in range(400):
        text = prose(k % 350, 40)
        grade = (0, 0, 0, 1, 2)[k % 5]
        rows.append((k, text + "".join(f" {b}" for b in bad[: (0, 1, 3)[grade]]) + (" worst" if grade == 2 else ""), "a"))
        marks.append((k, 0 if grade == 2 else 1, int(grade > 0)))
    labels = spark.createDataFrame([m for m in marks if m[0] % 2] + [(999, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    table = docs(spark, rows + [(1000, None, "a"), (1001, "", None)])
    model = fit(table, labels, severity(F.col("toxic"), F.col("quality")))
    assert model.cuts == sorted(model.cuts)
    found = {r["doc_id"]: r for r in score(table, model).collect()}
    held = [k for k in range(0, 400, 2)]
    assert np.mean([found[k]["toxic"] == (k % 5 >= 3) for k in held]) >= 0.97
    assert np.mean([found[k]["expected_severity"] for k in held if k % 5 == 4]) > np.mean([found[k]["expected_severity"] for k in held if k % 5 == 3]) + 0.3
    assert found[1000]["toxic"] is False and found[1001]["toxic"] is False
    nobody = fit(table, labels.where("toxic = 0"), severity(F.col("toxic"), F.col("quality")))
    assert not any(r["toxic"] for r in score(table, nobody).collect())
    assert score(docs(spark, []), model).count() == 0
    assert text_features("Lowei lowei x") == {"lowei", "x", "^lowe"} and OrdinalModel({}, [0.0]).exceeding(None)[0] == 0.5


def test_ordinal_fit_is_at_the_least_loss_of_plain_loops(spark):
    """The fitted weights and cuts against the likelihood written as a loop: no small step makes it better."""
    pick = random.Random(6)
    names = ["w0", "w1", "w2", "w3"]
    rows, grades = [], []
    for _ in range(300):
        own = [k for k in range(4) if pick.random() < 0.4]
        score_ = 2.0 * (0 in own) + 1.0 * (1 in own) - 1.0 * (2 in own) + pick.gauss(0, 1)
        rows.append(own)
        grades.append(0 if score_ < 0.5 else 1 if score_ < 2.0 else 2)
    row, col = np.array([(r, c) for r, own in enumerate(rows) for c in own]).T
    model = toxicity._descend(names, np.array(grades), row, col, 3000, 0.02, 5e-4)

    def loss(weights, cuts):
        total = 0.0
        for own, grade in zip(rows, grades, strict=True):
            s = sum(weights[c] for c in own)
            above = [1.0] + [1 / (1 + np.exp(c - s)) for c in cuts] + [0.0]
            total -= np.log(above[grade] - above[grade + 1])
        return total / len(rows) + 5e-4 / 2 * sum(w * w for w in weights)

    weights = [model.weights.get(n, 0.0) for n in names]
    best = loss(weights, model.cuts)
    for k in range(4):
        for step in (-0.1, 0.1):
            assert loss([w + step * (j == k) for j, w in enumerate(weights)], model.cuts) > best
    for k in range(2):
        for step in (-0.1, 0.1):
            assert loss(weights, [c + step * (j == k) for j, c in enumerate(model.cuts)]) > best
    assert weights[0] > weights[1] > 0 > weights[2] and model.cuts[0] < model.cuts[1]


def test_toxicity_of_long_and_repeated_texts(spark):
    model = OrdinalModel({"vile": 3.0, "^vile": 1.0}, [1.0, 2.0])
    rows = [(1, "vile " * 300_000, "a"), (1, "vile", "a"), (1, "vile", "a"), (None, "fine", None), (2, "vilest", "a")]
    found = sorted((str(r["doc_id"]), r["expected_severity"], r["grade"], r["toxic"]) for r in score(docs(spark, rows), model).collect())
    p = [1 / (1 + np.exp(c - 3.0)) for c in (1.0, 2.0)]
    assert len(found) == 5 and [f[1] for f in found if f[0] == "1"] == [pytest.approx(sum(p))] * 3 and {f[2] for f in found if f[0] == "1"} == {2}
    assert [f[2:] for f in found if f[0] == "None"] == [(0, False)]


@pytest.mark.parametrize("name", ["n_bytes_", "counted_text", "N_TOKENS", "scored_text", "scored_text_", "t_", "spans_", "rid", "a.b", "x`y", "Toxic"])
def test_columns_of_any_name_stay(spark, name):
    table = spark.createDataFrame([(1, "some text", 7), (None, None, None)], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField(name, T.LongType())]))
    counted = count_tokens(table, WORD_BPE)
    graded = score(table, OrdinalModel({"some": 1.0}, [0.5]))
    cut = remove_repeats(table)
    for found, own in ((counted, "n_tokens"), (graded, "toxic"), (cut, "n_removed")):
        rows = [r.asDict() for r in found.collect()]
        assert len(rows) == 2 and own in rows[0]
        if name.lower() not in ("n_tokens", "toxic"):
            assert sorted((r[name] for r in rows), key=str) == [7, None]


# ---- urls ----

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "bad.org", "")]


def test_aliases_share_blocks_and_allows_win(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://a.com/en/1", None), (2, "https://x.example.com/en/77", ""), (3, "http://free.net/p", link.format("http://b.com/en/2")),
        (4, "http://free.net/q", "<META http-equiv='refresh' content='0; url=http://free.net/p'>"), (5, "http://both.net/", link.format("http://example.com/en/7") + "<meta http-equiv=refresh content='0;url=http://bad.org/'>"),
        (6, None, None), (7, "nothing", link.format("http://bad.org/")), (8, "HTTP://www.Free.net/q/?utm_source=x#top", None), (9, "ftp://bad.org", None), (10, "http://notbad.org/", None), (1, "http://a.com/en/1", None), (11, "http://sub.net/d/e", link.format("../../x")),
    ]
    pages = spark.createDataFrame([(*r, "k", "v") for r in rows], "page_id long, url string, html string, component string, rule string")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, RULES).collect()}
    assert found[1] == ("a.com", "/en/1", "com/en/", "block") and found[2][2:] == ("example.com/en/7", "allow")
    assert [found[k][3] for k in (3, 4, 8)] == ["block"] * 3 and found[5][3] == "allow"
    assert found[6] == found[7] == ("", "", None, "allow")
    assert found[9] == ("bad.org", "", "bad.org", "block") and found[10][3] == "allow"
    assert judge_urls(pages, RULES).count() == len(rows) and judge_urls(pages.limit(0), RULES).count() == 0
    more = spark.createDataFrame([("http://notbad.org/", "http://bad.org/x"), (None, "http://bad.org/")], "src_url string, dst_url string")
    assert judge_urls(pages, RULES, links=more).where("page_id = 10").first()["verdict"] == "block"


def test_all_links_of_a_page_count(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://x.org/a/b/p.html", link.format("../q.html") + link.format("http://bad.org/?a=1&amp;b=2") + '<meta http-equiv="refresh" content="5; url=./r.html">'),
        (2, "http://x.org/a/q.html", None), (3, "http://x.org/a/b/r.html", None), (4, "http://x.org/a/./b/../q.html", None),
        (5, "http://y.org/s", "<base href='http://z.org/dir/index.html'>" + link.format("t.html")), (6, "http://z.org/dir/t.html", "<META HTTP-EQUIV=refresh CONTENT='0;URL=http://bad.org/'>"),
        (7, "http://w.org/" + "long/" * 20000, "<link rel=canonical href=" + "x" * 100_000), (8, "http://v.org/<", "<<<link <link rel='canonical'><base><meta http-equiv=refresh>" * 2000),
        (9, "http://only.org/../../up", link.format("http://x.org/up")), (None, "http://x.org/a/q.html", None), (10, "http://x.org/../up", None),
    ]
    pages = spark.createDataFrame([(*r, "n") for r in rows], "page_id long, url string, html string, n string")
    found = {r["page_id"]: r["verdict"] for r in judge_urls(pages, [("block", "bad.org", "")]).collect()}
    assert found == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "block", 7: "allow", 8: "allow", 9: "allow", None: "block", 10: "allow"}
    frame = pages.drop("n").toPandas()
    connection = duckdb.connect()
    connection.register("frame", frame)
    connection.execute("create view pages as select page_id::bigint as page_id, url, html from frame where page_id is not null")
    rules = [("block", "bad.org", "")]
    theirs = connection.sql(judge_oracle(rules)).fetchall()
    mine = [tuple(r) for r in judge_urls(pages.where("page_id is not null"), rules).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert sorted(mine, key=str) == sorted(theirs, key=str)


def test_pages_of_one_url_and_component_are_spread(spark, monkeypatch):
    monkeypatch.setattr("tracewright.plans.spread.HOT_ROWS", 10)
    rows = [(k, "http://hub.org/") for k in range(100)] + [(200 + k, f"http://a{k}.org/") for k in range(50)] + [(300 + k, None) for k in range(50)]
    pages = spark.createDataFrame([(i, u, "<link rel=canonical href='http://hub.org/'>") for i, u in rows], "page_id long, url string, html string")
    links = spark.createDataFrame([("http://hub.org/", "http://bad.org/")], "src_url string, dst_url string")
    found = judge_urls(pages, [("block", "bad.org", "")], links=links).collect()
    assert len(found) == 200 and {r["verdict"] for r in found if r["page_id"] < 300} == {"block"} and {r["verdict"] for r in found if r["page_id"] >= 300} == {"allow"}


# ---- sharding ----

def test_leaves_are_even_and_copies_stay_together(spark):
    rows = [(k, prose(k, 1 + (k * k) % 90), "a") for k in range(20, 620)] + [(1000 + k, prose(k, 30), "a") for k in range(50) for _ in (0, 1)] + ODD[:7] + ODD[8:]
    table = docs(spark, rows)
    dims = {"length": F.octet_length("text"), "n": F.col("n_chars")}
    found = kd_shards(table, dims, shards=5).collect()
    assert len(found) == len(rows)
    size = Counter()
    for r in found:
        size[r["shard"]] += r["size"]
    assert len(size) == 5 and max(size.values()) - min(size.values()) <= 2 * max(r["size"] for r in found)
    for s in size:
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sum(1 for r in found if r["shard"] == s)))
    assert {(r["size"], r["text_crc32"]) for r in found if r["doc_id"] in (0, 1)} == {(1, 0)}
    by_bytes = kd_shards(table, dims, target_bytes=10_000)
    assert by_bytes.select("shard").distinct().count() == -(-sum(size.values()) // 10_000)
    assert kd_shards(docs(spark, []), dims, shards=8).count() == 0
    hot = kd_shards(docs(spark, [(k, "copy", "a") for k in range(800)]), dims, shards=4).groupBy("shard").count().collect()
    assert len(hot) == 4 and all(150 < r["count"] < 250 for r in hot)


def brute_kd(rows, dims, shards, whole_share=0.005):
    """The same tree by sorting: rows of (id, text), dims of functions of a text; {(id, text): shard}."""
    def hashed(i):
        return int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)

    values = [[float(d(t)) if d(t) is not None else None for d in dims] for _, t in rows]
    spans = [(min(x), max(x)) if (x := [v[k] for v in values if v[k] is not None]) else (0.0, 0.0) for k in range(len(dims))]
    def cell(v, k):
        lo, hi = spans[k]
        return 0 if v is None else 1 if hi <= lo else int((v - lo) / (hi - lo) * ((1 << 20) - 2)) + 1
    points = [dict(row=r, size=len((r[1] or "").encode()) + 1, crc=zlib.crc32(r[1].encode()) if r[1] is not None else 0, tie=hashed(r[0]), cells=[cell(v, k) for k, v in enumerate(vs)]) for r, vs in zip(rows, values, strict=True)]
    whole = whole_share * sum(p["size"] for p in points) / shards
    out = {}

    def cut(some, key, goal, heavy):
        """(last key on the left, whether the boundary key goes left) of rows ordered by key."""
        under = 0
        for k in sorted({p[key] for p in some}):
            v = sum(p["size"] for p in some if p[key] == k)
            if under + v >= goal:
                if heavy and v > whole:
                    at, _ = cut([p for p in some if p[key] == k], "tie", goal - under, False)
                    return k, at
                left = 2 * (goal - under) >= v
                return (k, (1 << 60) - 1 if left else -1) if heavy else (k if left else k - 1, None)
            under += v

    def split(some, first, k):
        if k <= 1 or not some:
            out.update({p["row"]: first for p in some})
            return
        half = k // 2
        wide = [max(p["cells"][d] for p in some) - min(p["cells"][d] for p in some) for d in range(len(dims))]
        axis = wide.index(max(wide))
        for p in some:
            p["key"] = (p["cells"][axis] << 32) + p["crc"]
        at, tie = cut(some, "key", sum(p["size"] for p in some) * half / k, True)
        right = [p for p in some if p["key"] > at or p["key"] == at and p["tie"] > tie]
        split([p for p in some if p not in right], first, half)
        split(right, first + half, k - half)

    split(points, 0, shards)
    return out


def test_shards_equal_a_tree_by_sorting(spark):
    rows = [(k, prose(k % 150, 1 + (k * k) % 60)) for k in range(220)] + [(1000 + k, "a hot copy") for k in range(80)] + [(None, "no id"), (2000, None), (2001, "")]
    frame = docs(spark, [(i, t, "a") for i, t in rows])
    dims = {"length": F.octet_length("text"), "vowels": F.length(F.regexp_replace("text", "[^aeiou]", ""))}
    found = {(r["doc_id"], r["text"]): r["shard"] for r in kd_shards(frame.withColumn("text_crc32", F.lit("x")), dims, shards=6).join(frame.select(F.col("doc_id").alias("i"), "text"), F.col("doc_id").eqNullSafe(F.col("i"))).collect()}
    want = brute_kd(rows, [lambda t: None if t is None else len(t.encode()), lambda t: None if t is None else sum(c in "aeiou" for c in t)], 6)
    assert found == want and len(set(want.values())) == 6


def test_shards_with_equal_values_everywhere(spark):
    same = docs(spark, [(k, "x" * 20, "a") for k in range(64)])
    flat = {"a": F.lit(1), "b": F.lit(None).cast("double")}
    sizes = Counter(r["shard"] for r in kd_shards(same, flat, shards=4).collect())
    assert set(sizes) == {0, 1, 2, 3} and max(sizes.values()) - min(sizes.values()) <= 4
    whole = Counter(r["shard"] for r in kd_shards(same, flat, shards=4, whole_share=10.0).collect())
    assert len(whole) == 1  # a group of copies that may stay whole does


# ---- vectors ----

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("score", T.StringType())])
BAD = [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1.0, 2.0]]


def vectors(spark, data, more=()):
    rows = [(k, [float(x) for x in v], 0, "s") for k, v in enumerate(data)] + [(10_000 + 20 * k, v, 0, "s") for k, v in enumerate(BAD)] + list(more)
    return spark.createDataFrame(rows, VECTORS)


def test_near_vectors_equal_brute_force(spark):
    r = np.random.default_rng(3)
    centre = r.standard_normal((6, 8))
    data = np.concatenate([r.standard_normal((300, 8)), np.repeat(centre, 25, axis=0) + 0.12 * r.standard_normal((150, 8)), np.repeat(centre[:1], 40, axis=0)]).astype(np.float32)
    found = {x["vec_id"]: x for x in near_vectors(vectors(spark, data, [(None, [1.0] * 8, 0, "s")]), shard_rows=200).collect()}
    unit = data.astype(float) / np.linalg.norm(data.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    got = np.array([found[k]["n_links"] for k in range(len(data))])
    assert (got <= near.sum(1)).all() and got.sum() >= 0.95 * near.sum()
    label = np.arange(len(data))
    for _ in range(60):
        label = np.array([min(label[k], label[near[k]].min(initial=label[k])) for k in range(len(data))])
    assert np.mean([found[k]["component_id"] == label[k] for k in range(len(data))]) > 0.97
    for k in range(len(BAD)):
        x = found[10_000 + 20 * k]
        assert (x["n_links"], x["component_id"], x["kept"]) == (0, 10_000 + 20 * k, True)
    assert found[None]["n_links"] == 0
    assert near_vectors(vectors(spark, []).limit(0)).count() == 0


def families(seed):
    """Two tight families, cosine 0.99 inside and 0.92 across, and rows far from both; with the links among them."""
    r = np.random.default_rng(seed)
    axis = np.eye(96)
    rows = []
    for centre in (axis[0], 0.929 * axis[0] + np.sqrt(1 - 0.929**2) * axis[1]):
        for _ in range(70):
            noise = np.concatenate([[0, 0], r.standard_normal(94)])
            rows.append(np.sqrt(0.99) * centre + np.sqrt(0.01) * noise / np.linalg.norm(noise))
    data = np.concatenate([rows, r.standard_normal((400, 96))]).astype(np.float32)
    unit = data.astype(float) / np.linalg.norm(data.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    return data, near


def test_tight_families_stay_linked(spark, monkeypatch):
    monkeypatch.setattr("tracewright.llm.graph_dedup._found_share", lambda *_: 1.0)  # without the audit's help
    data, near = families(8)
    assert near[:70, 70:140].all()
    found = {x["vec_id"]: x for x in near_vectors(vectors(spark, data), shard_rows=2000).collect()}
    assert [found[k]["n_links"] for k in range(len(data))] == near.sum(1).tolist()
    assert {found[k]["component_id"] for k in range(140)} == {0}


def test_links_across_shards_and_levels(spark, monkeypatch):
    """One long chain, cut into shards of a few rows: near nodes of other shards are met, and each link counts once."""
    r = np.random.default_rng(11)
    turn = np.linspace(0, 6, 160)
    base = np.stack([np.cos(turn), np.sin(turn), np.zeros(160), np.zeros(160)], axis=1) + 0.02 * r.standard_normal((160, 4))
    data = np.concatenate([base, base[::16]]).astype(np.float32)  # and some copies
    unit = data.astype(float) / np.linalg.norm(data.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    for level in (4096, 3):
        monkeypatch.setattr("tracewright.llm.graph_dedup.LEVEL", level)
        found = {x["vec_id"]: x for x in near_vectors(vectors(spark, data), least=0.95, shard_rows=24, overlap=2, recall=0.0).collect()}
        got = np.array([found[k]["n_links"] for k in range(len(data))])
        assert (got <= near.sum(1)).all() and got.sum() >= 0.9 * near.sum()
        assert {found[k]["component_id"] for k in range(len(data))} == {0} and 0.9 <= found[0]["audit_recall"] <= 1
        twice = {x["vec_id"]: x["n_links"] for x in near_vectors(vectors(spark, data), least=0.95, shard_rows=40, overlap=3).collect()}
        assert [twice[k] for k in range(len(data))] == near.sum(1).tolist()


def test_recall_is_audited_when_shards_end(spark, monkeypatch):
    empty = lambda *_: (np.empty(0, np.int64), np.empty(0, np.int64))
    monkeypatch.setattr("tracewright.llm.graph_dedup.range_search", empty)
    monkeypatch.setattr("tracewright.llm.graph_dedup.crowded_pairs", empty, raising=False)
    monkeypatch.setattr("tracewright.llm.graph_dedup.BLOCK_ROWS", 100, raising=False)
    data, near = families(9)
    found = {x["vec_id"]: x["n_links"] for x in near_vectors(vectors(spark, data), audit_queries=540).collect()}
    assert [found[k] for k in range(len(data))] == near.sum(1).tolist()


def test_forest_search_recall_and_ties(spark):
    r = np.random.default_rng(4)
    data = np.concatenate([r.standard_normal((1500, 8)), np.repeat(r.standard_normal((1, 8)), 60, axis=0)]).astype(np.float32).astype(float)
    table = vectors(spark, data)
    found = forest_search(table, F.col("vec_id") % 20 == 0, leaf_rows=64).collect()
    by = {}
    for x in found:
        by.setdefault(x["query_id"], []).append(x)
    assert set(by) == set(range(0, len(data), 20))
    hit = 0
    for q, own in by.items():
        own.sort(key=lambda x: x["rank"])
        exact = (data * data[q]).sum(axis=1)
        assert [x["rank"] for x in own] == list(range(1, 21)) and all(x["score"] == pytest.approx(exact[x["vec_id"]], abs=1e-9) for x in own)
        order = [k for k in np.lexsort((np.arange(len(data)), -np.round(exact, 9))) if k != q][:20]
        hit += len({x["vec_id"] for x in own} & set(order))
        assert [(-x["score"], x["vec_id"]) for x in own] == sorted((-x["score"], x["vec_id"]) for x in own)
    assert hit >= 0.9 * 20 * len(by)
    few = forest_search(vectors(spark, data[:5]), F.col("vec_id") == 0).collect()
    assert len(few) == 4
    assert forest_search(vectors(spark, []).limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_forest_search_keeps_all_ties(spark):
    r = np.random.default_rng(6)
    data = np.concatenate([[[1.0, 0, 0]], np.c_[np.full(300, 0.5), r.permutation(300) - 150.0, np.ones(300)]])
    found = forest_search(vectors(spark, data), F.col("vec_id") == 0, leaf_rows=4096).collect()
    assert sorted(x["vec_id"] for x in found) == list(range(1, 21))


def test_vectors_repeated_rows_null_ids_and_clashes(spark):
    """Rows that repeat id and vector, ids with two vectors, null ids, columns named like results."""
    r = np.random.default_rng(12)
    base = r.standard_normal((40, 8)).astype(np.float32)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(base)]
    rows += [rows[0], rows[0], (0, rows[5][1]), (None, rows[1][1]), (60, rows[1][1])]
    names = T.StructType([*VECTORS.fields[:2], *(T.StructField(n, T.StringType()) for n in ("shard", "rank", "query_id", "n_links", "node", "v", "id"))])
    table = spark.createDataFrame([(*row, *"abcdefg") for row in rows], names)
    found = [(x["vec_id"], x["n_links"], x["component_id"], x["kept"]) for x in near_vectors(table).collect()]
    unit = base.astype(float) / np.linalg.norm(base.astype(float), axis=1)[:, None]
    near = {k: {j for j in range(40) if j != k and unit[k] @ unit[j] >= 0.9} for k in range(40)}
    assert len(found) == len(rows) and sorted(f[1] for f in found if f[0] == 0) == sorted([2 + len(near[0])] * 3 + [1 + len(near[5])])
    assert [f[2:] for f in found if f[0] == 60] == [(1, False)] and [f[1] for f in found if f[0] == 60] == [1 + len(near[1])] and (None, 0, None, True) in found
    best = forest_search(table, F.col("vec_id") % 20 == 0, k=3).collect()
    assert {x["query_id"] for x in best} == {0, 20, 60} and all(x["vec_id"] is not None and x["vec_id"] != x["query_id"] for x in best)
    own = sorted((x["rank"], x["vec_id"], x["score"]) for x in best if x["query_id"] == 60)
    score = {i: max(float(np.dot(np.array(v), np.array(rows[1][1]))) for j, v in rows if j == i) for i in {i for i, _ in rows if i is not None and i != 60}}
    assert [i for _, i, _ in own] == [i for _, i in sorted((-s, i) for i, s in score.items())[:3]]


def test_ties_across_classes_and_leaves(spark):
    """300 vectors score alike, a third of them in equal groups: of those found the least ids are returned."""
    r = np.random.default_rng(13)
    ids = r.permutation(np.arange(1, 301))
    data = [(0, [1.0, 0.0, 0.0])] + [(int(i), [0.5, float(n // 3 if n < 100 else n), 1.0]) for n, i in enumerate(ids)]
    table = spark.createDataFrame([(i, v, 0, "s") for i, v in data], VECTORS)
    whole = forest_search(table, F.col("vec_id") == 0, k=20, leaf_rows=4096).collect()
    assert sorted((x["rank"], x["vec_id"], x["score"]) for x in whole) == [(k, k, 0.5) for k in range(1, 21)]
    found = sorted((x["rank"], x["vec_id"], x["score"]) for x in forest_search(table, F.col("vec_id") == 0, k=20, leaf_rows=64).collect())
    assert [f[0] for f in found] == list(range(1, 21)) and {f[2] for f in found} == {0.5} and [f[1] for f in found] == sorted(f[1] for f in found)


# ---- pipeline ----

def test_pipeline_drops_what_it_should(spark, tmp_path):
    import corpus_pipeline

    fine = [(k, prose(k, 80 + k % 50), f"s{k % 2}") for k in range(120)]
    toxic = [(200 + k, prose(500 + k, 40) + " vilescum" * 3, "s0") for k in range(40)]
    copies = [(300 + k, fine[k][1], "s1") for k in range(10)]
    passage = prose(9999, 70)
    holders = [(400 + k, f"{prose(700 + k, 60)} {passage} {prose(800 + k, 60)}", "s0") for k in range(5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, "en", s, len(t)) for i, t, s in fine + toxic + copies + holders] + [(900, None, None, None, None), (901, "", "en", "s0", 0)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i >= 200)) for i, _, _ in fine[::2] + toxic[::2]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = stage["toxicity"](spark, table, str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {t[0] for t in toxic}
    single = stage["simhash"](spark, kept, str(tmp_path))
    assert not {r["doc_id"] for r in single.collect()} & {c[0] for c in copies} and {r["doc_id"] for r in single.collect()} >= {f[0] for f in fine}
    cut = {r["doc_id"]: r for r in stage["suffix_array"](spark, single, str(tmp_path)).collect()}
    assert passage in cut[400]["text"] and all(passage not in cut[k]["text"] for k in range(401, 405))
    assert all(cut[i]["text"] == t for i, t, _ in fine)
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert final.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(final.columns)


CLASHES = "doc_id long, text string, lang string, source string, n_chars int, toxic string, grade string, size string, target string, times string, rid string, spans string, kept string, h1 string, component_id string, copy string, c0 string"


def test_pipeline_rows_ids_and_columns(spark, tmp_path):
    """Repeated ids, repeated rows, null ids, texts and sources, clashing columns: rows are judged, not ids."""
    import corpus_pipeline

    copied, alone = prose(1, 90), prose(2, 90)
    rows = [(5, copied, "a"), (7, copied, "a"), (7, alone, "b"), (8, alone + " more", None), (None, copied, "a"), (None, prose(3, 90), None), (9, prose(4, 90), "b"), (9, prose(4, 90), "b"), (10, None, "a"), (11, "", "b"), (12, "é" * 60 + prose(5, 30), None)]
    table = spark.createDataFrame([(i, t, "en", s, len(t or ""), *"tgstmrskhccz") for i, t, s in rows], CLASHES)
    spark.createDataFrame([(5, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stage = dict(corpus_pipeline.STAGES)

    def texts(df):
        assert df.columns == table.columns and df.dtypes == table.dtypes
        return sorted(((r["doc_id"], r["text"], r["source"]) for r in df.collect()), key=str)

    kept = stage["toxicity"](spark, table, str(tmp_path))
    assert texts(kept) == sorted(rows, key=str)  # no labels of two grades
    single = stage["simhash"](spark, kept, str(tmp_path))
    assert texts(single) == sorted([rows[0], rows[2], rows[5], rows[6], rows[8], rows[10]], key=str)
    clean = stage["suffix_array"](spark, single, str(tmp_path))
    assert texts(clean) == texts(single)
    mixed = stage["mixing"](spark, clean, str(tmp_path))
    assert set(texts(mixed)) <= set(texts(clean)) and all(r["toxic"] == "t" and r["copy"] == "c" for r in mixed.collect())
    packed = stage["packing"](spark, clean, str(tmp_path))
    assert packed.select("doc_id", "source").distinct().count() == 6
    for name, function in corpus_pipeline.STAGES:
        assert function(spark, table.limit(0), str(tmp_path)).count() == 0, name


def test_pipeline_cuts_later_copies_of_repeated_ids(spark):
    import corpus_pipeline

    passage = prose(21, 60)
    rows = [(3, prose(22, 40) + " " + passage, "a"), (3, prose(23, 40) + " " + passage, "a"), (None, passage + " " + prose(24, 40), "a"), (4, None, "a")]
    table = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.drop_repeated_passages(spark, table, "").collect()
    held = [r for r in found if r["text"] and passage in r["text"]]
    assert len(found) == 4 and len(held) == 1 and held[0]["doc_id"] == 3
    assert all(r["n_chars"] == len(r["text"]) for r in found if r["text"] is not None) and [r["doc_id"] for r in found if r["text"] is None] == [4]


def test_near_copies_tell_rows_apart(spark):
    text = prose(31, 80)
    rows = [(7, text, "a"), (6, text, "a"), (7, prose(32, 80), "a"), (None, text, "a"), (6, text, "a")]
    found = near_copies(docs(spark, rows)).collect()
    assert {(r["doc_id"], r["rows"], r["component_id"], r["kept"]) for r in found} == {(6, 2, 6, True), (7, 1, 6, False), (None, 1, 6, False)}
