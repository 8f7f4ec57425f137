"""Columns of any name, beside which the operators keep theirs, and functions over Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_names(taken: Iterable[str], *stems: str) -> list[str]:
    """For each stem a name that none of ``taken`` has, in any case."""
    used = {t.lower() for t in taken}
    out = []
    for stem in stems:
        while stem.lower() in used:
            stem += "_"
        used.add(stem.lower())
        out.append(stem)
    return out


def without(docs: DataFrame, out: Iterable[str], keep: Iterable[str] = ()) -> tuple[list[Column], list[T.StructField]]:
    """Columns and fields of ``docs`` but for those named like a result column; ``keep`` stay anyway."""
    gone = {c.lower() for c in out} - {c.lower() for c in keep}
    fields = [f for f in docs.schema.fields if f.name.lower() not in gone]
    return [named(f.name) for f in fields], fields


def by_place(rows: DataFrame) -> DataFrame:
    """``rows`` with its columns called c0, c1 ..., as functions over Arrow batches take no name with a dot."""
    return rows.toDF(*[f"c{k}" for k in range(len(rows.columns))])


def tidy() -> None:
    """Give freed memory back to the system: Python workers are used again by later stages, with what they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def tidied(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``kernel`` followed by ``tidy``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)
        tidy()

    return run
