"""Toxicity grades by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.storage import stored
from .columns import by_place, named, tidied, without

_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that are features beside whole words.
STEMS = (4, 5)
BLOCK = 1 << 20
#: Words whose features a worker remembers, and texts scored at a time.
KNOWN_WORDS, SCORED_ROWS = 200_000, 1000


def word_features(word: str) -> list[str]:
    """The word, and its beginnings (marked ``^``) if it is longer than they are."""
    return [word, *("^" + word[:n] for n in STEMS if len(word) > n)]


def text_features(text: str | None) -> set[str]:
    """The distinct features of the lower-case words of a whole text."""
    words: set[str] = set()
    for block in _blocks(text or ""):
        words.update(_WORD.findall(block.lower()))
    return {f for w in words for f in word_features(w)}


def _blocks(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = min(len(text), at + BLOCK)
        while end < len(text) and text[end].isalpha():  # not within a word
            end += 1
        yield text[at:end]
        at = end


@dataclass
class OrdinalModel:
    """P(grade > k) = sigmoid(sum of weights of the text's features - cut[k]); one weight a feature for all cuts."""

    weights: dict[str, float]
    cuts: list[float]

    def encoder(self) -> Callable[[str | None], list[int]]:
        """Gives the sorted numbers of a text's features among the weights; a word is looked up once a worker."""
        number = {f: k for k, f in enumerate(self.weights)}
        known: dict[str, tuple[int, ...]] = {}

        def encode(text: str | None) -> list[int]:
            found: set[int] = set()
            for block in _blocks(text or ""):
                for word in set(_WORD.findall(block.lower())):
                    hit = known.get(word)
                    if hit is None:
                        if len(known) >= KNOWN_WORDS:
                            known.clear()
                        hit = known[word] = tuple(number[f] for f in word_features(word) if f in number)
                    found.update(hit)
            return sorted(found)

        return encode

    def exceeding(self, text: str | None) -> np.ndarray:
        """For each cut the probability of a grade above it."""
        return self.all_exceeding([self.encoder()(text)])[0]

    def all_exceeding(self, rows: list[list[int]]) -> np.ndarray:
        """The same for many texts, each given as its features' numbers: (texts, cuts)."""
        weight = np.array(list(self.weights.values()), dtype=np.float64)
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        col = np.fromiter((k for r in rows for k in r), dtype=np.int64, count=len(row))
        score = np.bincount(row, weights=weight[col] if len(col) else None, minlength=len(rows)).astype(np.float64)
        return 1.0 / (1.0 + np.exp(-np.clip(score[:, None] - np.array(self.cuts), -40, 40)))


def severity(toxic: Column, quality: Column) -> Column:
    """Grades from two labels: 0 not toxic; 1 toxic; 2 toxic and judged of low quality as well. Null if toxic is."""
    return F.when(toxic == 0, 0).when(toxic == 1, F.when(quality == 0, 2).otherwise(1)).cast("int")


def training_rows(docs: DataFrame, labels: DataFrame, grade: Column, most: int, id_col: str, text_col: str) -> DataFrame:
    """At most ``most`` labelled texts, those with the least hashes of their ids, without copies."""
    rated = labels.select(F.col(id_col).alias("id"), grade.alias("grade")).where("grade is not null and id is not null")
    rated = rated.groupBy("id").agg(F.max("grade").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).where(F.col("t").isNotNull())
    return texts.join(F.broadcast(chosen), "id").groupBy("t").agg(F.max("grade").alias("grade"))


def fit(docs: DataFrame, labels: DataFrame, grade: Column, most: int = 8000, max_features: int = 20000, min_texts: int = 3, id_col: str = "doc_id", text_col: str = "text", rounds: int = 300, rate: float = 0.05, ridge: float = 5e-4) -> OrdinalModel:
    """Fit on a bounded sample: at most ``most`` labelled texts and ``max_features`` features reach the driver.

    Kept are the features in at least ``min_texts`` sampled texts whose share
    differs most between grade 0 and the others (ties by name). Labels without id
    or grade, and ids without a text, are left out; of repeated labels, and of
    equal texts, the highest grade counts, once. Without rows of two grades the
    model grades everything 0.
    """
    sample = stored(training_rows(docs, labels, grade, most, id_col, text_col), "labelled")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, g in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                names = sorted(text_features(text.as_py()))
                yield pa.RecordBatch.from_pydict({"f": names, "bad": pa.array([int(g > 0)] * len(names), pa.int64())})

    counts = {bool(r["bad"]): r["n"] for r in sample.groupBy((F.col("grade") > 0).alias("bad")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return OrdinalModel({}, [40.0])
    seen = sample.mapInArrow(explode, "f string, bad long").groupBy("f").agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n"))
    gap = F.abs(F.col("bad") / counts[True] - (F.col("n") - F.col("bad")) / counts[False])
    names = [r["f"] for r in seen.where(F.col("n") >= min_texts).orderBy(gap.desc(), "f").limit(max_features).select("f").collect()]
    number = {f: k for k, f in enumerate(names)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sorted(number[f] for f in text_features(t.as_py()) & number.keys()) for t in batch.column(0)]
            yield pa.RecordBatch.from_pydict({"grade": batch.column(1), "x": pa.array(rows, pa.list_(pa.int32()))})

    rows = sample.mapInArrow(encode, "grade int, x array<int>").toArrow()
    x = pa.concat_arrays(rows["x"].chunks) if rows.num_rows else pa.array([], pa.list_(pa.int32()))
    grades, ends, flat = rows["grade"].to_numpy(), x.offsets.to_numpy(), x.values.to_numpy()
    order = sorted(range(len(grades)), key=lambda k: (grades[k], flat[ends[k] : ends[k + 1]].tobytes()))  # the same sums in the same order in every run
    length = np.diff(ends)[order]
    col = np.concatenate([flat[ends[k] : ends[k + 1]] for k in order])
    return _descend(names, grades[order], np.repeat(np.arange(len(order)), length), col, rounds, rate, ridge)


def _descend(names: list[str], grades: np.ndarray, row: np.ndarray, col: np.ndarray, rounds: int, rate: float, ridge: float) -> OrdinalModel:
    """Adam on the mean negative log-likelihood of the grades; cuts stay in order as a first cut and positive gaps."""
    top = int(grades.max())
    w, first, gap = np.zeros(len(names)), 1.0, np.zeros(top - 1)
    state = [np.zeros(len(names) + top), np.zeros(len(names) + top)]
    n = len(grades)
    for t in range(1, rounds + 1):
        cuts = first + np.concatenate([[0.0], np.cumsum(np.exp(gap))])
        score = np.bincount(row, weights=w[col], minlength=n)
        above = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -40, 40)))  # P(grade > k)
        full = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        slope = np.concatenate([np.zeros((n, 1)), above * (1 - above), np.zeros((n, 1))], axis=1)
        here = np.arange(n)
        p = np.maximum(full[here, grades] - full[here, grades + 1], 1e-12)
        low, high = slope[here, grades] / p, slope[here, grades + 1] / p
        by_score = -(low - high) / n
        by_cut = np.zeros(top + 1)
        np.add.at(by_cut, grades[grades > 0] - 1, low[grades > 0] / n)
        np.add.at(by_cut, grades[grades < top], -high[grades < top] / n)
        by_cut = by_cut[:top]
        grad = np.concatenate([np.bincount(col, weights=by_score[row], minlength=len(names)) + ridge * w, [by_cut.sum()], [np.exp(gap[k]) * by_cut[k + 1 :].sum() for k in range(top - 1)]])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.999 * state[1] + 0.001 * grad * grad
        step = rate * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.999**t)) + 1e-8)
        w, first, gap = w - step[: len(names)], first - step[len(names)], gap - step[len(names) + 1 :]
    cuts = first + np.concatenate([[0.0], np.cumsum(np.exp(gap))])
    return OrdinalModel({f: float(v) for f, v in zip(names, w, strict=True) if abs(v) > 1e-3}, cuts.tolist())


def score(docs: DataFrame, model: OrdinalModel, text_col: str = "text", evidence: float = 0.4) -> DataFrame:
    """``docs`` with ``expected_severity`` (sum over cuts of P(grade > k)), ``grade`` (the likeliest) and ``toxic``.

    toxic: the text's features lead at least ``evidence`` of the way, in log-odds of
    a grade above 0, from a text without features to even odds. On held-out labels
    0.4 found 98 % of the toxic texts and rejected no other. Whole texts count; null and
    empty texts have no features and get the base rate. Equal texts get equal
    results; equal shares go to the lower grade. Columns of these names (in any
    case) are replaced, all others stay, whatever their names. No rows, no result.
    """
    out = ("expected_severity", "grade", "toxic")
    kept, fields = without(docs, out)
    names = [f.name for f in fields]
    reject_from = 1 / (1 + np.exp((1 - evidence) * max(0.0, model.cuts[0])))

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = model.encoder()
        for batch in batches:
            for at in range(0, batch.num_rows, SCORED_ROWS):
                piece = batch.slice(at, SCORED_ROWS)
                p = model.all_exceeding([encode(t.as_py()) for t in piece.column(piece.num_columns - 1)])
                ends = np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], axis=1)
                found = [pa.array(p.sum(axis=1)), pa.array(np.argmax(-np.diff(ends, axis=1), axis=1).astype(np.int32)), pa.array(p[:, 0] >= reject_from)]
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], *found], names=[*names, *out])

    rows = by_place(docs.select(*kept, named(text_col).cast("string")))
    kinds = (T.DoubleType(), T.IntegerType(), T.BooleanType())
    return rows.mapInArrow(tidied(grade), T.StructType([*fields, *map(T.StructField, out, kinds)]))
