"""Nearest neighbours by a forest of random-projection trees."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stored
from .vectors import SALTS, best_of_all, matrix, sample, valid_vectors

#: Vectors in a part and queries that ask it, which one task holds at a time, and scores it computes at a time.
PART_ROWS, ASKED_ROWS, SCORE_BLOCK = 8192, 8192, 1 << 21


class Forest:
    """Trees of equal depth; a level has one random direction, a node the median of its sample along it.

    Directions live in the space with one more axis that makes all norms equal,
    so that the largest inner products become the smallest angles. Nodes without
    samples split at their parent's point. ``depth`` levels give 2^depth leaves.
    """

    def __init__(self, rows: np.ndarray, longest: float, trees: int, depth: int, seed: int = 5) -> None:
        random = np.random.default_rng(seed)
        self.longest, self.depth = longest, depth
        dim = rows.shape[1] + 1
        self.axes = [np.linalg.qr(random.standard_normal((dim, max(depth, 1))))[0].T[:depth] if depth <= dim else random.standard_normal((depth, dim)) for _ in range(trees)]
        rows = self.lifted(rows)
        self.splits = []
        for axes in self.axes:
            along, node, splits = rows @ axes.T, np.zeros(len(rows), dtype=np.int64), []
            for level in range(depth):
                cut = np.zeros(1 << level)
                order = np.argsort(node, kind="stable")
                begin = np.searchsorted(node[order], np.arange((1 << level) + 1))
                for k in range(1 << level):
                    mine = order[begin[k] : begin[k + 1]]
                    if len(mine):
                        cut[k] = np.median(along[mine, level])
                splits.append(cut)
                node = node * 2 + (along[:, level] > cut[node])
            self.splits.append(splits)

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        gap = np.sqrt(np.maximum(0.0, self.longest - np.einsum("ij,ij->i", rows, rows)))
        return np.concatenate([rows, gap[:, None]], axis=1)

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree: (rows, trees)."""
        rows = self.lifted(rows)
        out = []
        for axes, splits in zip(self.axes, self.splits, strict=True):
            along, node = rows @ axes.T, np.zeros(len(rows), dtype=np.int64)
            for level in range(self.depth):
                node = node * 2 + (along[:, level] > splits[level][node])
            out.append(node)
        return np.stack(out, axis=1)

    def visits(self, query: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
        """(tree, leaf), up to ``most``, from one queue for all trees: least squared distance to the leaf's cell first."""
        point = np.concatenate([query * (math.sqrt(self.longest) / np.linalg.norm(query)), [0.0]])
        along = [(axes @ point).tolist() for axes in self.axes]
        queue = [(0.0, tree, 0, 0) for tree in range(len(self.axes))]
        heapq.heapify(queue)
        while queue and most > 0:
            far, tree, level, node = heapq.heappop(queue)
            while level < self.depth:
                gap = along[tree][level] - self.splits[tree][level][node]
                heapq.heappush(queue, (far + gap * gap, tree, level + 1, 2 * node + (gap <= 0)))
                node = 2 * node + (gap > 0)
                level += 1
            most -= 1
            yield tree, node


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """``id, v, ids``: distinct vectors with their k + 1 smallest ids; no answer of k can hold more of a class."""
    rows = rows.distinct()
    for key in (["v", "salt"], ["v"]):  # a class of copies is thinned in salted groups first
        if key == ["v", "salt"]:
            rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
        order = Window.partitionBy(*key).orderBy("id")
        rows = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
    found = rows.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return found.select(F.element_at("ids", 1).alias("id"), "v", "ids")


def _ranked(data: np.ndarray, leaf: np.ndarray, ids: pa.ListArray, points: np.ndarray, own: np.ndarray, row: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score): the k best of the leaves that each query wants, and all that tie with the last class needed.

    ``leaf`` and ``wanted`` are sorted; point ``row[n]`` wants leaf ``wanted[n]``.
    Only a leaf's rows and the queries that want it are multiplied.
    """
    slack = 1e-9 * np.linalg.norm(data, axis=1).max() * np.linalg.norm(points, axis=1)  # equal scores may differ by rounding
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for one in np.unique(leaf):
        a, b = np.searchsorted(leaf, [one, one + 1])
        i, j = np.searchsorted(wanted, [one, one + 1])
        step = max(1, SCORE_BLOCK // (b - a))
        for at in range(i, j, step):
            q = row[at : min(j, at + step)]
            score = points[q] @ data[a:b].T
            m = min(b - a, k + 1)  # one may be the query itself
            cut = -np.partition(-score, m - 1, axis=1)[:, m - 1] - slack[q]
            x, c = np.nonzero(score >= cut[:, None])
            q, c = q[x], a + c
            found.append((q, c, (data[c] * points[q]).sum(axis=1)))  # one order of summation for all
    if not found:
        return own[:0], own[:0], np.empty(0)
    q, c, score = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((c, -score, q))
    q, c, score = q[order], c[order], score[order]
    begin = np.searchsorted(q, q)
    last = np.minimum(begin + k, np.searchsorted(q, q, side="right") - 1)
    kept = score >= score[last]
    q, c, score = q[kept], c[kept], score[kept]
    size = np.diff(ids.offsets.to_numpy())[c]
    at = np.repeat(ids.offsets.to_numpy()[c] - np.cumsum(size) + size, size) + np.arange(size.sum())
    q, score, name = np.repeat(q, size), np.repeat(score, size), ids.values.to_numpy()[at]
    other = name != own[q]
    q, score, name = q[other], score[other], name[other]
    order = np.lexsort((name, -score, q))
    q, score, name = q[order], score[order], name[order]
    best = np.arange(len(q)) - np.searchsorted(q, q) < k
    return own[q[best]], name[best], score[best]


def forest_search(table: DataFrame, is_query: Column, k: int = 20, trees: int = 3, leaf_rows: int = 256, recall: float = 0.93, sample_rows: int = 20000, audit_queries: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score, audit_recall``: for each query row the ``k`` largest inner products found among the others.

    The forest is fitted on at most ``sample_rows`` vectors, every vector is
    indexed. A queue over all trees orders leaves; how many of them a query
    visits is read from ``audit_queries`` queries searched exactly over all
    rows, as the number that reaches ``recall`` of their neighbours, themselves
    and their copies aside; ``audit_recall`` is the share it reaches. Leaf
    candidates, and only these, are scored on the original vectors in double
    precision. Equal scores are ordered by id. Vectors that are null, zero, of
    another length than most, or hold null or non-finite components take no
    part, nor do rows without id; rows that repeat id and vector count once;
    copies of a vector are indexed once, with the k + 1 smallest of their ids.
    Extra columns are ignored, whatever their names. No rows, no result.
    """
    rows = valid_vectors(table, id_col, vector_col)
    classes = stored(_classes(rows, k), "distinct-vectors")
    queries = valid_vectors(table.where(is_query), id_col, vector_col).distinct()
    count = classes.count()
    _, fitted = sample(classes, sample_rows)
    longest = float(classes.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).first()[0] or 1.0)
    depth = max(0, round(math.log2(max(1, count) / leaf_rows)))
    forest = Forest(fitted if len(fitted) else np.zeros((0, 1)), longest, trees, depth)
    visits, reached = _audited_visits(forest, classes, queries, k, recall, audit_queries)
    across = max(1, min(1 << depth, round(count / PART_ROWS)))  # parts of a tree, runs of neighbouring leaves

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf = forest.leaves(matrix(batch.column(1)))
            for tree in range(trees):
                part = tree * across + ((leaf[:, tree] * across) >> depth)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(leaf[:, tree]), batch.column(1), batch.column(2)], names=["part", "leaf", "v", "ids"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ids = matrix(batch.column(1)), batch.column(0).to_pylist()
            out: list[tuple[int, int, list[int], int]] = []
            for row, q in enumerate(ids):
                by_part: dict[int, list[int]] = {}
                for tree, leaf in forest.visits(data[row], visits):
                    by_part.setdefault(tree * across + ((leaf * across) >> depth), []).append(leaf)
                out += [(part, q, leaves, row) for part, leaves in by_part.items()]
            if out:
                part, q, leaves, row = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(q, pa.int64()), batch.column(1).take(pa.array(row)), pa.array(leaves, pa.list_(pa.int64()))], names=["part", "query_id", "q", "leaves"])

    vector = classes.schema["v"].dataType.simpleString()
    indexed = classes.mapInArrow(index, f"part long, leaf long, v {vector}, ids array<long>")
    tasks = max(64, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    routed = stored(queries.repartition(tasks, "id").mapInArrow(route, f"part long, query_id long, q {vector}, leaves array<long>"), "routes")
    loads = routed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / ASKED_ROWS).cast("long").alias("pieces"))  # a part that many queries ask works in pieces
    indexed = indexed.join(loads, "part").select("part", "leaf", "v", "ids", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))
    routed = routed.join(loads, "part").select("part", "query_id", "q", "leaves", F.pmod(F.xxhash64("query_id"), F.col("pieces")).alias("piece"))

    def rank(members: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not members.num_rows or not asked.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        members = members.sort_by("leaf")
        leaves = asked["leaves"].combine_chunks()
        row, wanted = np.repeat(np.arange(len(leaves)), np.diff(leaves.offsets.to_numpy())), leaves.flatten().to_numpy()
        order = np.argsort(wanted, kind="stable")
        ids = pa.concat_arrays(members["ids"].chunks)  # offsets from 0
        found = _ranked(matrix(members["v"]), members["leaf"].to_numpy(), ids, matrix(asked["q"]), asked["query_id"].to_numpy(), row[order], wanted[order], k)
        return pa.table([pa.array(x) for x in found], names=names)

    ranked = indexed.groupBy("part", "piece").cogroup(routed.groupBy("part", "piece")).applyInArrow(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = ranked.repartition("query_id").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id"), "score", F.lit(reached).alias("audit_recall"))


def _audited_visits(forest: Forest, classes: DataFrame, queries: DataFrame, k: int, recall: float, audit: int) -> tuple[int, float]:
    """The least number of visits with which the audit queries' exact neighbours are found to ``recall``, and some more; and the share found."""
    leaves = len(forest.axes) << forest.depth
    own, points = sample(classes.join(queries.select("v").distinct(), "v", "left_semi"), audit)
    if not len(points) or forest.depth == 0:
        return leaves, 1.0
    q, ids, _ = best_of_all(classes, own, points, k)
    wanted = classes.where(F.col("id").isin([int(i) for i in set(ids.tolist())])).select("id", "v").toArrow()
    leaf_of = dict(zip(wanted["id"].to_pylist(), forest.leaves(matrix(wanted["v"])).tolist(), strict=True))
    turns = []
    for number, point in enumerate(points):
        at = {visit: turn for turn, visit in enumerate(forest.visits(point, leaves), 1)}
        turns += [min(at[(tree, leaf)] for tree, leaf in enumerate(leaf_of[i])) for i in ids[q == number].tolist()]
    if not turns:
        return leaves, 1.0
    turns.sort()
    visits = min(leaves, math.ceil(turns[min(len(turns) - 1, math.ceil(recall * len(turns)))] * 1.02))
    return visits, sum(t <= visits for t in turns) / len(turns)
