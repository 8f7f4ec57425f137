"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.spread import hot_from, join_each
from ..plans.storage import discard, stored

#: Edges that a task thins at a time.
THIN_ROWS = 1 << 18


def _codes(column: pa.Array) -> np.ndarray:
    """Whole numbers, equal for equal values; structs are coded field by field."""
    if pa.types.is_struct(column.type):
        code = np.zeros(len(column), dtype=np.int64)
        for field in column.flatten():
            own = _codes(field)
            code = np.unique(code * (own.max(initial=0) + 1) + own, return_inverse=True)[1]
        return code
    return column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1


def _forest(a: list[int], b: list[int]) -> list[int]:
    """Places of the edges that connect two parts when they come, by union-find."""
    parent = list(range(max(max(a, default=0), max(b, default=0)) + 1))
    kept = []
    for place, (x, y) in enumerate(zip(a, b, strict=True)):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[x] = y
            kept.append(place)
    return kept


def spanning_edges(edges: DataFrame, src: str, dst: str, weight: str | None = None) -> DataFrame:
    """Some of ``edges`` (src, dst and weight) that connect what all do; with a weight, at every least weight too.

    Each task keeps a spanning forest of its rows, the heaviest first. Nothing
    moves; a dense cluster leaves about a row a node and task.
    """
    names = [src, dst] + ([weight] if weight else [])

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def kept() -> pa.Table:
            table = pa.Table.from_batches(held).combine_chunks()
            if weight:
                table = table.sort_by([(weight, "descending")])
            ends = [table[c].chunk(0) if table[c].num_chunks else table[c].combine_chunks() for c in (src, dst)]
            code = _codes(pa.concat_arrays(ends)).tolist()
            return table.take(pa.array(_forest(code[: len(table)], code[len(table) :]), pa.int64()))

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= THIN_ROWS:
                some = kept()
                held = some.combine_chunks().to_batches()
                if some.num_rows > THIN_ROWS // 2:
                    yield from held
                    held = []
        if held:
            yield from kept().to_batches()

    fields = {f.name: f for f in edges.schema.fields}
    return edges.select(*names).mapInArrow(thin, T.StructType([fields[n] for n in names]))


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, component`` of all edges (u and v, whole numbers) at once."""
    held = list(batches)
    if not held:
        return
    rows = pa.Table.from_batches(held)
    ends = [rows[c].to_numpy() for c in ("u", "v")]
    node, place = np.unique(np.concatenate(ends), return_inverse=True)  # the least place of a component is its smallest node
    parent = list(range(len(node)))
    place = place.tolist()
    for x, y in zip(place[: rows.num_rows], place[rows.num_rows :], strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        parent[max(x, y)] = min(x, y)
    for k, above in enumerate(parent):  # parents are smaller, so they are done
        parent[k] = parent[above]
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[parent])], names=["node", "component"])


def _large_star(edges: DataFrame, most: int | None) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or to the node)."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return join_each(both.where("v > u"), least, ["u"], F.col("v"), most).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, most: int | None) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = join_each(edges, least, ["u"], F.col("v"), most).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, few: int = 0) -> DataFrame:
    """``node, component`` for every node that has an edge to another one; component is the smallest node reachable.

    Nodes may be of any orderable type. Edges with a null end and self loops are
    ignored; repeated edges are harmless; no edges give an empty table. Tasks
    first thin their own edges to a forest. Each round then joins edges with
    per-node minima (partially aggregated; a hub's edges are salted) and is
    written to the shared folder; rounds grow with the logarithm of the
    component size. Up to ``few`` edges that are left when thinned are united
    by one task, without rounds; nodes are longs then.
    """
    start = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    thinned = spanning_edges(start, "a", "b")
    current = stored(thinned.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if few and current.count() <= few:
        return current.coalesce(1).mapInArrow(_united, "node long, component long")
    before = None
    for _ in range(max_rounds):
        seen = _signature(current)
        if seen == before or not seen[0]:
            break
        before = seen
        most = hot_from(2 * seen[0])  # of edge ends; a large star has no more edges
        current, last = stored(_small_star(_large_star(current, most), most), "stars"), current
        discard(last)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(nodes.select(F.col("component").alias("node"), "component").distinct())


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
