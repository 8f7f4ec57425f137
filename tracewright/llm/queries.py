"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .forest_search import forest_search
from .graph_dedup import links_oracle, near_vectors
from .mixing import mix_oracle, mix_sources, turn_weights
from .packing import pack
from .sharding import kd_shards
from .simhash import simhash_components
from .suffix_dedup import remove_repeats
from .token_counts import count_tokens
from .toxicity import fit, score, severity
from .url_filter import Rule, judge_oracle, judge_urls

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of those at most two bits apart."""
    found = simhash_components(table(spark, sf_dir, "documents"), words=3, max_distance=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


RULES: list[Rule] = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages with the rule that fits their url and the verdict on it."""
    judged = judge_urls(table(spark, sf_dir, "pages"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight leaves of near equal bytes of a k-d tree over length, language and density."""
    docs = table(spark, sf_dir, "documents")
    text_bytes = F.octet_length("text")
    dimensions = {"length": F.log2(text_bytes + 1), "language": F.crc32(F.col("lang").cast("binary")), "density": text_bytes / F.char_length("text")}
    shards = kd_shards(docs, dimensions, shards=8)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_graph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings with their links of cosine 0.9 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.9)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of full windows of 2048 ids, sources in the proportions of the mix (3, 1, 2 in turn) while they last."""
    docs = table(spark, sf_dir, "documents")
    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=2048, end_id=1, weights=turn_weights(docs))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "deficit")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of them."""
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), limit=2048)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op7_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every twentieth embedding with all others."""
    found = forest_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
    return found.select("query_id", "rank", "vec_id", "score", "audit_recall")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their expected severity, likeliest grade and whether they count as toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), severity(F.col("toxic"), F.col("quality")))
    return score(docs, model).select("doc_id", "expected_severity", "grade", "toxic")


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without any byte of a 200-byte string that starts twice or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, factor=200, keep_first=False, keep_text=False)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_url_filter, op2_sharding, op3_graph_dedup, op4_packing, op5_mixing, op6_token_counts, op7_forest_search, op8_toxicity, op9_suffix_array, op10_simhash)}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": judge_oracle(RULES), "op3_graph_dedup": links_oracle(0.9), "op5_mixing": mix_oracle()}
