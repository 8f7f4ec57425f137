"""Tables that cut lineage, in the folder that driver and executors share.

Iterative plans write their state as Parquet there and read it back, so a lost
executor costs a re-read and never a re-run of the earlier rounds.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: The setting that bounds an Arrow batch, and the most that plans with long texts should send a Python worker at once.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 22
#: For each ``passing`` block that is entered, the paths of the tables stored in it.
_passing: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a folder of its own only where that is unset (local tests)."""
    folder = spark.conf.get(SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {SETTING} to a folder that driver and executors share")
        folder = f"{tempfile.gettempdir()}/tracewright-checkpoints"
        spark.conf.set(SETTING, folder)
    return folder.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tracewright/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_BYTES``: the JVM and each worker hold some of them, and ten thousand long texts are many."""
    given = re.fullmatch(r"(-?\d+)b?", spark.conf.get(BATCH_SETTING, f"{BATCH_BYTES}b"))
    if given and not 0 < int(given[1]) <= BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, and read from there."""
    spark = df.sparkSession
    _bound_batches(spark)
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _passing:
        _passing[-1].append(path)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_path_ = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table made by ``stored`` that nothing will read again."""
    _delete(table.sparkSession, table.stored_path_)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored within go when the block is left, but for those given to the function that comes with it.

    What a function returns is read after it has ended, and often beside what
    later steps store: only what that result is made of should still be there.
    """
    kept: list[str] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table.stored_path_)
        return table

    _passing.append([])
    try:
        yield keep
    finally:
        for path in _passing.pop():
            if path not in kept:
                _delete(spark, path)
        if _passing:
            _passing[-1].extend(kept)
    release(spark)


def release(spark: SparkSession) -> None:
    """Let the driver's JVM collect plans that nothing holds, so that executors delete their shuffle files now."""
    spark.sparkContext._jvm.System.gc()


def drop_stored(spark: SparkSession) -> None:
    """Delete all tables that this application stored, once its results have been written."""
    _delete(spark, _own_dir(spark))
