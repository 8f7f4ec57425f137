"""Embedding near-duplicates on a robust-pruned flat graph."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..plans.spread import hot_from, join_each
from ..plans.storage import stored
from .vectors import matrix, sample, valid_vectors

#: Nearest vectors considered for a node's edges, edges kept, and the pruning factor.
CANDIDATES, DEGREE, ALPHA = 48, 24, 1.2
#: Width of the beam that leads from the medoid to a query, and queries that walk together.
BEAM, TOGETHER = 24, 256
#: Nodes in a block of the exact comparison of all, and in a piece of a coarse cell.
BLOCK_ROWS, CELL_ROWS = 4096, 65536
#: Centres of one level of k-means.
LEVEL = 4096
NO_SHARD = np.iinfo(np.int64).max
#: How far below the wanted cosine the range still expands.
SLACK = 0.1


def cluster_centres(rows: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on unit rows; starts from evenly spaced rows."""
    if not len(rows):
        return rows
    centres = rows[np.linspace(0, len(rows) - 1, min(count, len(rows))).astype(int)].copy()
    for _ in range(rounds):
        owner = np.concatenate([np.argmax(rows[a : a + 4096] @ centres.T, axis=1) for a in range(0, len(rows), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, rows)
        size = np.linalg.norm(sums, axis=1)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def robust_prune(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directed edges (from, to) of a flat graph over unit rows.

    Each node takes its nearest candidate and drops the candidates that are
    nearer to that one, by the factor, than to the node, until ``DEGREE`` are
    taken.
    """
    m = len(data)
    c = min(CANDIDATES, m - 1)
    if c < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sources, sinks = [], []
    for at in range(0, m, TOGETHER):
        block = data[at : at + TOGETHER]
        rows = np.arange(len(block))
        near = block @ data.T
        near[rows, at + rows] = -np.inf
        cand = np.argpartition(-near, c - 1, axis=1)[:, :c]
        sim = near[rows[:, None], cand]
        order = np.argsort(-sim, axis=1, kind="stable")
        cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        points = data[cand]
        between = 2 - 2 * (points @ points.transpose(0, 2, 1))  # squared distances
        own = 2 - 2 * sim
        open_ = np.ones((len(block), c), dtype=bool)
        taken = np.zeros(len(block), dtype=np.int64)
        for k in range(c):
            pick = open_[:, k] & (taken < DEGREE)
            sources.append(at + rows[pick])
            sinks.append(cand[pick, k])
            taken += pick
            open_ &= ~(pick[:, None] & (ALPHA * ALPHA * between[:, k, :] <= own))
    return np.concatenate(sources), np.concatenate(sinks)


class Neighbours:
    """Adjacency lists of local nodes, both ways round."""

    def __init__(self, count: int, a: np.ndarray, b: np.ndarray) -> None:
        pair = np.unique(np.concatenate([a * count + b, b * count + a]))
        self.sink = pair % count if count else pair
        self.begin = np.searchsorted(pair, np.arange(count + 1) * count)

    def of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``nodes``, neighbour) of all their edges."""
        size = self.begin[nodes + 1] - self.begin[nodes]
        row = np.repeat(np.arange(len(nodes)), size)
        return row, self.sink[np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.begin[nodes], size)]


def range_search(data: np.ndarray, graph: Neighbours, least: float, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a row of ``q`` and another row with a cosine of at least ``least`` that the graph leads to.

    Each row of q is a query, which walks greedily with a beam from the medoid
    towards itself; whatever lies within the range, a little widened, and the
    query's own node then expand until nothing new does.
    """
    m = len(data)
    medoid = int(np.argmax(data @ data.mean(axis=0)))
    left, right = [], []
    seen = np.zeros((len(q), m), dtype=bool)
    seen[:, medoid] = True
    best = np.full((len(q), BEAM), -1)
    score = np.full((len(q), BEAM), -np.inf)
    done = np.ones((len(q), BEAM), dtype=bool)
    best[:, 0], score[:, 0], done[:, 0] = medoid, data[q] @ data[medoid], False
    for _ in range(2 * BEAM):
        nxt = np.argmax(np.where(done, -np.inf, score), axis=1)
        active = np.flatnonzero(~done[np.arange(len(q)), nxt])
        if not len(active):
            break
        done[active, nxt[active]] = True
        row, node = graph.of(best[active, nxt[active]])
        row = active[row]
        new = ~seen[row, node]
        row, node = row[new], node[new]
        seen[row, node] = True
        sim = np.einsum("ij,ij->i", data[q[row]], data[node])
        size = np.bincount(row, minlength=len(q))
        wide = int(size.max(initial=0))
        if not wide:
            continue
        slot = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        more_n, more_s = np.full((len(q), wide), -1), np.full((len(q), wide), -np.inf)
        more_n[row, slot], more_s[row, slot] = node, sim
        all_n, all_s = np.concatenate([best, more_n], axis=1), np.concatenate([score, more_s], axis=1)
        all_d = np.concatenate([done, np.zeros((len(q), wide), dtype=bool)], axis=1)
        order = np.argsort(-all_s, axis=1, kind="stable")[:, :BEAM]
        best, score, done = (np.take_along_axis(x, order, 1) for x in (all_n, all_s, all_d))
        done |= best < 0
    # the range expands
    seen[:] = False
    seen[np.arange(len(q)), q] = True
    row, k = np.nonzero((score >= least - SLACK) & (best >= 0))
    node = best[row, k]
    fresh = ~seen[row, node]
    row, node = np.concatenate([np.arange(len(q)), row[fresh]]), np.concatenate([q, node[fresh]])
    seen[row, node] = True
    while len(row):
        sim = np.einsum("ij,ij->i", data[q[row]], data[node])
        hit = (sim >= least) & (q[row] != node)
        left.append(q[row[hit]])
        right.append(node[hit])
        on = sim >= least - SLACK
        row, node = row[on], node[on]
        pair, sink = graph.of(node)
        row, node = row[pair], sink
        new = ~seen[row, node]
        code = np.unique(row[new] * m + node[new])
        row, node = code // m, code % m
        seen[row, node] = True
    return np.concatenate(left), np.concatenate(right)


def crowded_pairs(data: np.ndarray, least: float, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same pairs for the rows of ``q`` that have more near rows than a graph node candidates, by comparing them with all rows.

    Where even the farthest candidate lies within the widened range, edges and
    beam may stay in one tight family; so no cap is left.
    """
    if len(data) <= CANDIDATES:
        return q[:0], q[:0]
    near = data[q] @ data.T
    near[np.arange(len(q)), q] = -np.inf
    crowded = np.flatnonzero((near >= least - SLACK).sum(axis=1) >= CANDIDATES)
    row, other = np.nonzero(near[crowded] >= least)
    return q[crowded[row]], other


def _least_common(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """The least shard that is in both lists of each pair (-1 fills lists up); a very large number if none is."""
    out = np.full(len(mine), NO_SHARD, dtype=np.int64)
    for k in range(mine.shape[1]):
        there = (theirs == mine[:, k : k + 1]).any(axis=1) & (mine[:, k] >= 0)
        out = np.where(there, np.minimum(out, mine[:, k]), out)
    return out


def _labels(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``count`` rows the least row that the links reach."""
    label = np.arange(count)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_vectors(table: DataFrame, least: float = 0.9, shard_rows: int = 2000, overlap: int = 4, sample_rows: int = 20000, recall: float = 0.95, audit_queries: int = 200, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col, n_links, component_id, kept, audit_recall`` for every vector: links of cosine >= ``least`` and what they connect.

    Equal vectors are one node. Nodes lie in the shards of their ``overlap``
    nearest centres (k-means in two levels, each fitted on at most
    ``sample_rows`` vectors); each shard builds a robust-pruned graph and the
    adjacency lists of a node are united over its shards. A range search from
    each shard's medoid follows the united lists over the shard's nodes and the
    near nodes of other shards that the lists lead to; nodes with more near rows
    than candidates are compared with all of these. A link is counted by the
    least shard that sees it, so no row a link is made, however large a group.
    All links found are computed in double precision. ``audit_recall`` is the
    share of the links of ``audit_queries`` nodes, those with a near candidate
    first, that was found, against an exact search of all nodes (null if these
    have no link); below ``recall`` the overlap doubles and the work is done
    again, and where all shards do not do, all nodes are compared. component_id
    is the smallest id reachable. Vectors that are null, zero, of another length
    than most, or hold null or non-finite components link with nothing, not even
    with their like; rows that repeat an id and vector are copies of each other
    and are counted. Null ids come back without links. Extra columns are
    ignored, whatever their names. No rows, no result.
    """
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    good = stored(valid_vectors(table, id_col, vector_col), "valid-vectors")
    nodes = good.groupBy("v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = stored(nodes.withColumn("id", F.monotonically_increasing_id()), "distinct-vectors")  # numbers of their own, fixed by being written: a row's id may have two vectors
    count = nodes.count()
    _, some = sample(nodes.select(F.col("least").alias("id"), "v"), sample_rows)
    unit = some / np.linalg.norm(some, axis=1, keepdims=True) if len(some) else some
    shards = Shards(nodes, unit, max(1, math.ceil(count * overlap / shard_rows)), sample_rows)
    while True:
        overlap = min(overlap, max(1, shards.count))
        counts, spans = _links(shards.members(nodes, overlap), least)
        share = _found_share(nodes, counts, least, audit_queries)
        if share is None or share >= recall:
            break
        if overlap >= shards.count:
            counts, spans = _all_links(nodes, count, least)
            share = 1.0
            break
        overlap *= 2
    found = connected_components(spans, "a", "b")
    linked = counts.groupBy("id").agg(F.sum("linked").alias("linked"))
    placed = nodes.select("id", "least", "copies").join(linked, "id", "left").join(found, F.col("id") == F.col("node"), "left")
    placed = stored(placed.select(F.col("id").alias("node"), "least", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"), F.col("copies").alias("n")), "linked-nodes")
    first = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    placed = join_each(placed.drop("least"), first, ["component"], F.col("node"), hot_from(count), "rows").drop("component")
    named = nodes.select("v", F.col("id").alias("node"), F.col("copies").alias("n"))
    most = hot_from(good.count())
    inside = join_each(good.select("id", "v"), named, ["v"], F.col("id"), most)
    inside = join_each(inside.select("id", "node"), placed, ["node"], F.col("id"), most).select("id", "n_links", "component_id")
    outside = rows.select("id", F.xxhash64("v").alias("h")).join(good.select("id", F.xxhash64("v").alias("h")).distinct(), ["id", "h"], "left_anti")
    outside = outside.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    result = inside.unionAll(outside)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    return result.select(F.col("id").alias(id_col), "n_links", "component_id", kept, F.lit(share).cast("double").alias("audit_recall"))


class Shards:
    """Overlapping shards around centres: one level of k-means for up to ``LEVEL`` shards, else a second one in each coarse cell.

    So shards keep their size however many there are. The coarse centres, at
    most ``LEVEL``, are the only ones that the driver and every task hold; a
    cell's own are fitted by a task, on at most ``sample_rows`` of its vectors.
    """

    def __init__(self, nodes: DataFrame, unit: np.ndarray, wanted: int, sample_rows: int) -> None:
        several = wanted > LEVEL
        self.coarse = cluster_centres(unit, min(math.isqrt(wanted) + 1 if several else wanted, max(1, len(unit) // 4)))
        self.fine: DataFrame | None = None
        self.count = len(self.coarse)
        if several:
            each = math.ceil(wanted / max(1, len(self.coarse)))

            def fit(cell: pa.Table) -> pa.Table:
                data = matrix(cell.sort_by("r")["v"])
                found = cluster_centres(data / np.linalg.norm(data, axis=1, keepdims=True), min(each, max(1, len(data) // 4)))
                return pa.table({"cell": pa.array([cell["cell"][0].as_py()] * len(found), pa.int64()), "number": pa.array(range(len(found)), pa.int64()), "c": pa.array(list(found), pa.list_(pa.float64()))})

            order = Window.partitionBy("cell").orderBy(F.xxhash64("id"), "id")
            placed = self._cells(nodes, 1).withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample_rows)
            self.fine = stored(placed.groupBy("cell").applyInArrow(fit, "cell long, number long, c array<double>"), "fine-centres")
            self.count = self.fine.count()

    def _cells(self, nodes: DataFrame, most: int) -> DataFrame:
        """``cell, id, v, copies, cells``: each node in each of its nearest coarse cells."""
        centres, most = self.coarse, min(most, max(1, len(self.coarse)))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                data = matrix(batch.column(1))
                near = (data / np.linalg.norm(data, axis=1, keepdims=True)) @ centres.T
                top = np.argpartition(-near, most - 1, axis=1)[:, :most].astype(np.int64)
                cells = pa.array(list(top), pa.list_(pa.int64()))
                for k in range(most):
                    yield pa.RecordBatch.from_arrays([pa.array(top[:, k]), *batch.columns, cells], names=["cell", "id", "v", "copies", "cells"])

        vector = nodes.schema["v"].dataType.simpleString()
        return nodes.select("id", "v", "copies").mapInArrow(place, f"cell long, id long, v {vector}, copies long, cells array<long>")

    def members(self, nodes: DataFrame, overlap: int) -> DataFrame:
        """Stored ``shard, id, v, copies, shards``: each node in each of its nearest shards, and the list of these."""
        if self.fine is None:
            return stored(self._cells(nodes, overlap).withColumnsRenamed({"cell": "shard", "cells": "shards"}), "shards")
        cells = stored(self._cells(nodes, overlap).select("cell", "id", "v"), "cells")
        loads = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("long").alias("pieces"))
        rows = cells.join(loads, "cell").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces"))).drop("pieces")
        fine = self.fine.join(loads, "cell").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).drop("pieces")

        def choose(rows: pa.Table, centres: pa.Table) -> pa.Table:
            if not rows.num_rows or not centres.num_rows:
                return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["id", "shard", "score"])
            data, some = matrix(rows["v"]), matrix(centres["c"])
            near = (data / np.linalg.norm(data, axis=1, keepdims=True)) @ some.T
            most = min(overlap, len(some))
            top = np.argpartition(-near, most - 1, axis=1)[:, :most]
            shard = (centres["cell"].to_numpy() * (1 << 32) + centres["number"].to_numpy())[top.ravel()]
            return pa.table([pa.array(np.repeat(rows["id"].to_numpy(), most)), pa.array(shard), pa.array(np.take_along_axis(near, top, 1).ravel())], names=["id", "shard", "score"])

        found = rows.groupBy("cell", "piece").cogroup(fine.groupBy("cell", "piece")).applyInArrow(choose, "id long, shard long, score double")
        order = Window.partitionBy("id").orderBy(F.desc("score"), "shard")
        lists = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= overlap).groupBy("id").agg(F.sort_array(F.collect_list("shard")).alias("shards"))
        return stored(nodes.select("id", "v", "copies").join(lists, "id").select(F.explode("shards").alias("shard"), "id", "v", "copies", "shards"), "shards")


def _links(members: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """``id, linked`` (copies linked by the links that a shard counts), and ``a, b`` that span what each shard connects."""

    def build(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("id")
        data, ids = matrix(shard["v"]), shard["id"].to_numpy()
        data = data / np.linalg.norm(data, axis=1, keepdims=True)
        a, b = robust_prune(data)
        near = np.einsum("ij,ij->i", data[a], data[b]) >= least - SLACK
        return pa.table({"id": pa.array(ids[a], pa.int64()), "sink": pa.array(ids[b], pa.int64()), "near": pa.array(near, pa.bool_())})

    edges = members.select("shard", "id", "v").groupBy("shard").applyInArrow(build, "id long, sink long, near boolean")
    united = stored(edges.groupBy("id").agg(F.collect_set("sink").alias("sinks"), F.collect_set(F.when(F.col("near"), F.col("sink"))).alias("near")), "adjacency")  # at most overlap x DEGREE
    # near nodes that the lists of a shard's nodes lead to, without being of the shard
    spots = members.select("shard", "id")
    reached = spots.join(united.where(F.size("near") > 0), "id").select("shard", F.explode("near").alias("id")).distinct().join(spots, ["shard", "id"], "left_anti")
    halos = stored(reached, "halos")
    seen_by = halos.groupBy("id").agg(F.array_sort(F.collect_list("shard")).alias("guest"))
    hosts = members.join(seen_by, "id", "left").select("shard", "id", "v", "copies", "shards", "guest", F.lit(True).alias("host"))
    guests = halos.join(members.where(F.col("shard") == F.element_at("shards", 1)).drop("shard"), "id").join(seen_by, "id")
    everyone = hosts.unionAll(guests.select("shard", "id", "v", "copies", "shards", "guest", F.lit(False).alias("host")))
    placed = everyone.select("shard", "id").join(united.select("id", "sinks"), "id").select(F.col("shard").alias("place"), F.col("id").alias("node"), "sinks")

    def search(key: tuple, shard: pa.Table, lists: pa.Table) -> pa.Table:
        number = key[0].as_py()
        shard = shard.sort_by([("host", "descending"), ("id", "ascending")])
        data, ids, copies = matrix(shard["v"]), shard["id"].to_numpy(), shard["copies"].to_numpy()
        data = data / np.linalg.norm(data, axis=1, keepdims=True)
        own = int(np.count_nonzero(shard["host"].to_numpy()))
        order = np.argsort(ids, kind="stable")
        sinks = lists["sinks"].combine_chunks()
        to = sinks.flatten().to_numpy()
        a = np.repeat(order[np.searchsorted(ids, lists["node"].to_numpy(), sorter=order)], np.diff(sinks.offsets.to_numpy()))
        b = order[np.minimum(np.searchsorted(ids, to, sorter=order), len(ids) - 1)]
        here = ids[b] == to  # lists also name nodes that are neither of the shard nor near
        home, guest = _padded(shard["shards"]), _padded(shard["guest"])
        linked, near = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=bool)
        spans: list[tuple[np.ndarray, np.ndarray]] = []
        graph = Neighbours(len(ids), a[here], b[here])
        for at in range(0, own, TOGETHER):
            asked = np.arange(at, min(own, at + TOGETHER))
            found = range_search(data, graph, least, asked), crowded_pairs(data, least, asked)
            code = np.unique(np.concatenate([x * len(ids) + y for x, y in found]))
            q, n = code // len(ids), code % len(ids)
            # hosts of one shard meet in the least shard that both are of; a host and a guest in the least that sees them
            met = _least_common(home[q], home[n])
            apart = met == NO_SHARD
            met[apart] = np.minimum(_least_common(home[q[apart]], guest[n[apart]]), _least_common(home[n[apart]], guest[q[apart]]))
            mine = met == number
            np.add.at(linked, q[mine], copies[n[mine]])
            outside = mine & (n >= own)  # a guest is no query here
            np.add.at(linked, n[outside], copies[q[outside]])
            near[q], near[n] = True, True
            label = _labels(len(ids), q, n)
            moved = np.flatnonzero(label != np.arange(len(ids)))
            spans.append((label[moved], moved))
        left, right = (np.concatenate([s[k] for s in spans]) if spans else np.empty(0, np.int64) for k in (0, 1))
        label = _labels(len(ids), left, right)
        moved = np.flatnonzero(label != np.arange(len(ids)))
        said = np.flatnonzero(near)
        return pa.table({
            "id": pa.array(np.concatenate([ids[said], ids[moved]]), pa.int64()),
            "linked": pa.array(np.concatenate([linked[said], np.zeros(len(moved), np.int64)]), pa.int64()),
            "other": pa.array(np.concatenate([np.zeros(len(said), np.int64), ids[label[moved]]]), pa.int64()),
            "span": pa.array(np.concatenate([np.zeros(len(said), bool), np.ones(len(moved), bool)]), pa.bool_()),
        })

    found = everyone.groupBy("shard").cogroup(placed.groupBy("place")).applyInArrow(search, "id long, linked long, other long, span boolean")
    found = stored(found, "links")
    return found.where("not span").select("id", "linked"), found.where("span").select(F.col("other").alias("a"), F.col("id").alias("b"))


def _padded(column: pa.ChunkedArray) -> np.ndarray:
    """Lists as rows of a matrix, -1 behind them; null lists are empty."""
    column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.int64()))
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    out = np.full((len(column), max(1, int(size.max(initial=0)))), -1, dtype=np.int64)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = column.flatten().to_numpy()
    return out


def _found_share(nodes: DataFrame, counts: DataFrame, least: float, audit: int) -> float | None:
    """Of the links of ``audit`` nodes, those that have a link first, the share that ``counts`` has, against all nodes; None without links.

    Half of the nodes are drawn from all, so that links which the search left out count too.
    """
    linked = counts.groupBy("id").agg(F.sum("linked").alias("linked"))
    drawn = F.xxhash64("id", F.lit(7))
    every = nodes.select("id").orderBy(drawn, "id").limit(audit - audit // 2)
    near = linked.where("linked > 0").select("id").orderBy(drawn, "id").limit(audit // 2)
    asked = [r["id"] for r in every.unionAll(near).distinct().collect()]
    some = nodes.where(F.col("id").isin(asked)).select("id", "v").toArrow()
    queries, own = matrix(some["v"]), some["id"].to_numpy()
    queries = queries / np.linalg.norm(queries, axis=1, keepdims=True) if len(own) else queries

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(own):
                continue
            data, ids, copies = matrix(batch.column(1)), batch.column(0).to_numpy(), batch.column(2).to_numpy()
            q, k = np.nonzero(queries @ (data / np.linalg.norm(data, axis=1, keepdims=True)).T >= least)
            other = own[q] != ids[k]
            total = np.bincount(q[other], weights=copies[k[other]], minlength=len(own)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total)], names=["id", "truth"])

    truth = nodes.select("id", "v", "copies").mapInArrow(search, "id long, truth long").groupBy("id").agg(F.sum("truth").alias("truth"))
    both = truth.join(linked, "id", "left").agg(F.sum("truth").alias("truth"), F.sum("linked").alias("linked")).first()
    return (both["linked"] or 0) / both["truth"] if both["truth"] else None


def _all_links(nodes: DataFrame, count: int, least: float) -> tuple[DataFrame, DataFrame]:
    """The same as ``_links`` from comparing every two blocks of nodes: exact, and its work grows with the square."""
    blocks = max(1, math.ceil(count / BLOCK_ROWS))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks))
    met = nodes.select("id", "v", "copies", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("other"))
    met = met.select("id", "v", "copies", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(both: pa.Table) -> pa.Table:
        data, ids, own, copies = matrix(both["v"]), both["id"].to_numpy(), both["own"].to_numpy(), both["copies"].to_numpy()
        data = data / np.linalg.norm(data, axis=1, keepdims=True)
        first, second = (np.flatnonzero(own == both[c][0].as_py()) for c in "ij")
        linked, spans = np.zeros(len(ids), dtype=np.int64), [(np.empty(0, np.int64), np.empty(0, np.int64))]
        same = both["i"][0].as_py() == both["j"][0].as_py()
        for at in range(0, len(first), TOGETHER):
            a, b = np.nonzero(data[first[at : at + TOGETHER]] @ data[second].T >= least)
            a, b = first[at + a], second[b]
            a, b = a[a != b], b[a != b]
            np.add.at(linked, a, copies[b])
            if not same:
                np.add.at(linked, b, copies[a])
            label = _labels(len(ids), a, b)
            moved = np.flatnonzero(label != np.arange(len(ids)))
            spans.append((label[moved], moved))
        left, right = (np.concatenate([s[k] for s in spans]) for k in (0, 1))
        said = np.flatnonzero(linked)
        return pa.table({
            "id": pa.array(np.concatenate([ids[said], ids[right]]), pa.int64()),
            "linked": pa.array(np.concatenate([linked[said], np.zeros(len(right), np.int64)]), pa.int64()),
            "other": pa.array(np.concatenate([np.zeros(len(said), np.int64), ids[left]]), pa.int64()),
            "span": pa.array(np.concatenate([np.zeros(len(said), bool), np.ones(len(right), bool)]), pa.bool_()),
        })

    found = stored(met.groupBy("i", "j").applyInArrow(compare, "id long, linked long, other long, span boolean"), "all-links")
    return found.where("not span").select("id", "linked"), found.where("span").select(F.col("other").alias("a"), F.col("id").alias("b"))


def links_oracle(least: float, table: str = "embeddings", id_col: str = "vec_id", vector_col: str = "embedding") -> str:
    """All links by a self join in DuckDB, and the closure by recursion; the search has to find every one."""
    return f"""
WITH RECURSIVE t AS (SELECT {id_col}::BIGINT AS id, {vector_col}::DOUBLE[] AS e, row_number() OVER () AS r FROM {table}),
ok AS (SELECT *, len(e) AS d FROM t WHERE id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
v AS MATERIALIZED (SELECT *, sqrt(list_inner_product(e, e)) AS n FROM ok WHERE d = (SELECT d FROM ok GROUP BY d ORDER BY count(*) DESC, d DESC LIMIT 1)),
l AS MATERIALIZED (SELECT a.r, a.id, b.id AS other, a.e = b.e AS same FROM v a JOIN v b ON a.r <> b.r AND (a.e = b.e OR list_inner_product(a.e, b.e) / (a.n * b.n) >= {least})),
reach AS (SELECT id AS x, id AS y FROM v UNION SELECT reach.x, l.other FROM reach JOIN l ON reach.y = l.id),
c AS (SELECT x, min(y) AS component FROM reach GROUP BY x),
k AS (SELECT r, count(*) AS links FROM l GROUP BY r)
SELECT t.id AS {id_col}, coalesce(k.links, 0) AS n_links, coalesce(c.component, t.id) AS component_id, coalesce(t.id = coalesce(c.component, t.id), true) AS kept,
  CASE WHEN EXISTS (SELECT 1 FROM l WHERE NOT same) THEN 1.0::DOUBLE END AS audit_recall
FROM t LEFT JOIN v USING (r) LEFT JOIN k USING (r) LEFT JOIN c ON c.x = v.id"""
