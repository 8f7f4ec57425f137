"""A corpus cleaned, deduplicated, mixed and packed, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and
returns documents with the same columns; the last returns packed pieces. What a
stage decides on is in ``doc_id``, ``source`` and ``text``; all other columns
are carried along, whatever their names. Rows, not ids, are dropped and kept, so
rows that repeat an id are judged each. Null ids and sources are values like any
other. No rows give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.columns import named
from tracewright.llm.mixing import mix_sources, word_totals
from tracewright.llm.near_copies import one_of_each
from tracewright.llm.packing import pack
from tracewright.llm.suffix_dedup import remove_repeats
from tracewright.llm.toxicity import fit, score, severity
from tracewright.plans.storage import discard, passing, stored


#: What stages read of a document; its other columns are called c0, c1 ... on the way, which no operator's result clashes with.
READ = ("doc_id", "source", "text")


def _carried(docs: DataFrame) -> DataFrame:
    return docs.select(*READ, *[named(c).alias(f"c{k}") for k, c in enumerate(docs.columns) if c not in READ])


def _restored(docs: DataFrame, rows: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` from carried ``rows``; the text from the column ``text``, and if that is another one, its length too."""
    columns = []
    for k, (name, kind) in enumerate(docs.dtypes):
        column = F.col(text if name == "text" else name if name in READ else f"c{k}")
        if name == "n_chars" and text != "text":
            column = F.char_length(text).cast(kind)
        columns.append(column.alias(name))
    return rows.select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the ordinal model, fitted on the labelled ones, counts as toxic.

    Null and empty texts have no features and stay. Equal texts have equal
    verdicts; without labels of two grades all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, severity(F.col("toxic"), F.col("quality")))
    return _restored(docs, score(_carried(docs), model).where("not toxic"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group that five-word shingle similarities of 0.8 or more connect.

    Of rows that repeat id and text one stays. Texts without words, null ones
    included, are one group.
    """
    return one_of_each(docs, words=5, percent=80)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that stand in an earlier place are cut; a document left empty goes.

    Null texts stay null, and empty ones empty. Rows that repeat id and text
    count as one place, so all of them stay.
    """
    cut = remove_repeats(_carried(docs), factor=200, keep_first=True, whole_chars=True)
    cut = cut.where("n_removed = 0 or n_removed < n_bytes").withColumn("kept", F.col("kept").cast("string"))
    return _restored(docs, cut, text="kept")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    Null texts have no words; whether such rows are taken depends on their ids
    alone, as for all. Rows that repeat an id go together.
    """
    mixed = mix_sources(_carried(docs)).where("times > 0")
    return _restored(docs, mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full windows of 2048 ids, each with the share of every source that its words have of the mix.

    Null and empty texts are an end id alone; repeated rows are packed each.
    """
    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=2048, end_id=1, weights=word_totals(docs))
    return pieces.select("doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("suffix_array", drop_repeated_passages),
    ("mixing", mix),
    ("packing", pack_windows),
]

#: Neither the fitted model nor shingle sets can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; what each returns is written to the shared folder and read again, and stays until the next has ended."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        if k + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        before = docs
        with passing(spark) as keep:
            docs = keep(stored(stage(spark, before, sf_dir), name))
        if k:
            discard(before)
    return docs
