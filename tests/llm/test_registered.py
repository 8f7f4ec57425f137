"""The registered queries on the driver's smallest tables, against SQL, the libraries or brute force."""

import os
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from test_llm import BYTE_BPE, WORD_BPE, brute_kd, brute_repeats, served_one_by_one

from tracewright.llm import queries
from tracewright.llm.packing import byte_bpe
from tracewright.llm.simhash import text_fingerprint

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def texts():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_oracle(spark, name):
    connection = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    names = sorted(df.columns)
    relation = connection.sql(queries.oracle_sql()[name])
    assert {c: KINDS[k] for c, k in df.dtypes} == {c: str(t) for c, t in zip(relation.columns, relation.types, strict=True)}
    theirs = sorted(tuple(str(r[relation.columns.index(c)]) for c in names) for r in relation.fetchall())
    assert sorted(tuple(str(r[c]) for c in names) for r in df.collect()) == theirs


def test_op2_is_the_tree_by_sorting(spark, texts):
    import zlib

    found = {r["doc_id"]: r for r in queries.op2_sharding(spark, SF).collect()}
    dims = [lambda t: len(t.encode()) / len(t) if t else None, lambda t: langs[t], lambda t: np.log2(len(t.encode()) + 1)]
    langs = {r["text"]: zlib.crc32(r["lang"].encode()) if r["lang"] is not None else None for r in texts}
    if len({(r["text"], r["lang"]) for r in texts}) > len(langs):
        pytest.skip("a text has two languages")
    want = brute_kd([(r["doc_id"], r["text"]) for r in texts], dims, 8)
    size = Counter()
    for r in texts:
        size[found[r["doc_id"]]["shard"]] += found[r["doc_id"]]["size"]
    assert {i: r["shard"] for i, r in found.items()} == {i: s for (i, _), s in want.items()}
    assert set(size) == set(range(8)) and {r["law"] for r in found.values()} == {"bytes"}


def test_op4_is_serving_one_by_one(spark, texts):
    encode, window = byte_bpe(BYTE_BPE), 2048
    rows = queries.op4_packing(spark, SF).collect()
    whole = {r["doc_id"]: len(encode(r["text"] or "")) // 4 + 1 for r in texts}
    got = Counter()
    by_window = {}
    for p in rows:
        got[p["doc_id"]] += p["length"]
        assert p["doc_tokens"] == whole[p["doc_id"]]
        by_window.setdefault(p["sequence_id"], Counter())[p["source"]] += p["length"]
    assert got == whole
    total = Counter()
    for r in texts:
        total[r["source"]] += whole[r["doc_id"]]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    counts = np.diff([[0] * len(names), *served_one_by_one([total[s] for s in names], [float((3, 1, 2)[k % 3]) for k in range(len(names))], window)], axis=0)
    assert [[by_window[w][s] for s in names] for w in sorted(by_window)] == counts.tolist()


def test_op6_is_the_library(spark, texts):
    from tokenizers import Tokenizer

    encoded = Tokenizer.from_file(WORD_BPE).encode_batch([r["text"] or "" for r in texts], add_special_tokens=False)
    want = sorted((r["doc_id"], len((r["text"] or "").encode()), len(e.ids), len(e.ids) > 2048) for r, e in zip(texts, encoded, strict=True))
    assert sorted(tuple(r) for r in queries.op6_token_counts(spark, SF).collect()) == want


def test_op7_reaches_its_recall(spark):
    table = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    data, ids = np.array([r["embedding"] for r in table], dtype=np.float64), np.array([r["vec_id"] for r in table])
    rows, hit, asked = queries.op7_forest_search(spark, SF).collect(), 0, 0
    for q in ids[ids % 20 == 0]:
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == q)
        score = data @ data[ids == q][0]
        best = [i for _, i in sorted((-s, i) for s, i in zip(score, ids, strict=True) if i != q)[:20]]
        assert [r[0] for r in own] == list(range(1, 21)) and all(s == pytest.approx(score[ids == i][0], abs=1e-12) for _, i, s in own)
        hit, asked = hit + len({r[1] for r in own} & set(best)), asked + 20
    assert hit / asked >= 0.9 and rows[0]["audit_recall"] >= 0.93


def test_op8_finds_what_is_labelled(spark):
    found = {r["doc_id"]: r for r in queries.op8_toxicity(spark, SF).collect()}
    labels = [r for r in pq.read_table(f"{SF}/labels.parquet").to_pylist() if r["doc_id"] in found]
    assert len(found) == 200 and np.mean([found[r["doc_id"]]["toxic"] == bool(r["toxic"]) for r in labels]) >= 0.97
    assert all(0 <= r["expected_severity"] <= 2 and r["grade"] in (0, 1, 2) for r in found.values())


def test_op9_is_brute_force(spark, texts):
    found = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op9_suffix_array(spark, SF).collect()), key=str)
    assert found == brute_repeats([(r["doc_id"], r["text"]) for r in texts], 200, False)


def test_op10_is_brute_force(spark, texts):
    fps = {r["doc_id"]: text_fingerprint(r["text"]) % 2**64 for r in texts}
    label = {i: i for i in fps}
    for _ in range(20):
        for (a, x), (b, y) in combinations(fps.items(), 2):
            if (x ^ y).bit_count() <= 2:
                label[a] = label[b] = min(label[a], label[b])
    assert sorted(tuple(r) for r in queries.op10_simhash(spark, SF).collect()) == sorted((i, f"{fp:016x}", label[i]) for i, fp in fps.items())
