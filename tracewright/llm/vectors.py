"""What the vector operators share: valid vectors, classes of equal ones, Arrow to numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64


def is_valid(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v`` of the rows that take part: valid, with an id, and as long as most vectors are (ties: the longer)."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & is_valid(F.col("v")))
    length = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("v") == (length["d"] if length else 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def sample(rows: DataFrame, most: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of at most ``most`` rows, those with the least hashes: a bounded sample on the driver."""
    found = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most).select("id", "v").toArrow()
    return found["id"].to_numpy(), matrix(found["v"])


def best_of_all(rows: DataFrame, own: np.ndarray, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact search of a bounded number of queries, in blocks over all rows but their own: (query number, id, score), ``most`` a query."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ids = matrix(batch.column(1)), batch.column(0).to_numpy()
            if not len(ids):
                continue
            score = queries @ data.T
            score[own[:, None] == ids[None, :]] = -np.inf
            k = min(most, score.shape[1])
            top = np.argpartition(-score, k - 1, axis=1)[:, :k]
            q, found = np.repeat(np.arange(len(queries)), k), score[np.arange(len(queries))[:, None], top].ravel()
            real = np.isfinite(found)
            yield pa.RecordBatch.from_arrays([pa.array(q[real]), pa.array(ids[top.ravel()[real]]), pa.array(found[real])], names=["q", "id", "score"])

    from pyspark.sql import Window

    found = rows.select("id", "v").mapInArrow(search, "q long, id long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    kept = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("q", "id", "score").toArrow()
    return kept["q"].to_numpy(), kept["id"].to_numpy(), kept["score"].to_numpy()
