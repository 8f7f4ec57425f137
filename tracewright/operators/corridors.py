"""Continuous corridors over weighted grid edges, their measures and what of them a map shows.

An edge comes once, its smaller end first. Ties of seeds and steps go to the
smaller edge and cell, so results are the same in every run. A corridor of one
point has no length; no edges, no corridors.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import MAP_REGION, haversine, in_box
from ..functions.labels import corridor_intensity
from ..plans.numbering import numbered
from ..plans.storage import stored
from .graph import connected_components

LEAST_WEIGHT, WEIGHT_BONUS, LEAST_COSINE, MOST_STEPS, LEAST_CELLS = 2, 0.35, -0.2, 5000, 8
MOST_OVERLAP, MOST_SHOWN = 0.35, 500

Cell = tuple[int, int]


class _Tracer:
    """Walks along unused edges of one component, straight on and along heavy ones."""

    def __init__(self, edges: list[tuple[Cell, Cell, int]], heaviest: float) -> None:
        self.heaviest, self.used = heaviest, set()
        self.around: dict[Cell, list[tuple[Cell, int]]] = defaultdict(list)
        for a, b, weight in edges:
            self.around[a].append((b, weight))
            self.around[b].append((a, weight))
        for near in self.around.values():
            near.sort()

    def step(self, before: Cell, here: Cell) -> tuple[Cell, int] | None:
        best: tuple[float, float, Cell, int] | None = None
        x, y = here[0] - before[0], here[1] - before[1]
        for there, weight in self.around[here]:
            if there == before or (min(here, there), max(here, there)) in self.used:
                continue
            u, v = there[0] - here[0], there[1] - here[1]
            lengths = math.hypot(x, y) * math.hypot(u, v)
            cosine = (x * u + y * v) / lengths if lengths else -1.0
            score = cosine + WEIGHT_BONUS * weight / self.heaviest
            if best is None or score > best[0]:
                best = score, cosine, there, weight
        return None if best is None or best[1] < LEAST_COSINE else best[2:]

    def trace(self, a: Cell, b: Cell, weight: int) -> tuple[list[Cell], list[int]]:
        self.used.add((a, b))
        path, weights = [a, b], [weight]
        for _ in range(2):  # on from one end, then from the other
            while len(path) < MOST_STEPS and (found := self.step(path[-2], path[-1])):
                there, w = found
                self.used.add((min(path[-1], there), max(path[-1], there)))
                path.append(there)
                weights.append(w)
            path.reverse()
        return path, weights


def corridors(edges: DataFrame, least_weight: int = LEAST_WEIGHT, least_cells: int = LEAST_CELLS) -> DataFrame:
    """``corridor_id, cells, weight_mean, weight_max, weight_min, length_cells, display_score`` from ``edge, weight``.

    A corridor never leaves a connected component, so each component is traced by
    one task, seeds by weight, then edge; ties of a step go to the smaller cell.
    """
    heavy = edges.where(F.col("weight") >= least_weight)
    parts = connected_components(heavy.select(F.col("edge.a").alias("src"), F.col("edge.b").alias("dst")))
    heaviest = heavy.agg(F.max("weight").alias("heaviest"))
    rows = heavy.join(parts, F.col("edge.a") == F.col("node")).crossJoin(F.broadcast(heaviest))  # one row
    rows = rows.select("component", F.col("edge.a.gx").alias("ax"), F.col("edge.a.gy").alias("ay"), F.col("edge.b.gx").alias("bx"), F.col("edge.b.gy").alias("by"), "weight", "heaviest")

    def trace(frame: pd.DataFrame) -> pd.DataFrame:
        seeds = [((r.ax, r.ay), (r.bx, r.by), r.weight) for r in frame.itertuples()]
        seeds.sort(key=lambda e: (-e[2], e[0], e[1]))
        tracer, found = _Tracer(seeds, float(frame["heaviest"].iloc[0])), []
        for a, b, weight in seeds:
            if (a, b) in tracer.used:
                continue
            path, weights = tracer.trace(a, b, weight)
            if len(path) >= least_cells:
                mean = sum(weights) / len(weights)
                found.append(([{"gx": int(x), "gy": int(y)} for x, y in path], mean, max(weights), min(weights), len(path), mean * math.log1p(len(path))))
        return pd.DataFrame(found, columns=["cells", "weight_mean", "weight_max", "weight_min", "length_cells", "display_score"])

    traced = rows.groupBy("component").applyInPandas(trace, "cells array<struct<gx:long,gy:long>>, weight_mean double, weight_max long, weight_min long, length_cells long, display_score double")
    order = [F.desc("display_score"), F.desc("weight_mean"), F.desc("length_cells"), F.col("cells")]
    return numbered(traced, order, "place_").withColumn("corridor_id", F.col("place_") + 1).drop("place_")


def parse_coordinates(latitudes: Column, longitudes: Column) -> Column:
    """``array<struct<lat, lon>>`` of two ``;``-joined texts; empty parts are skipped."""
    def numbers(text: Column) -> Column:
        return F.transform(F.filter(F.split(text, ";"), lambda x: F.trim(x) != ""), lambda x: x.cast("double"))

    return F.zip_with(numbers(latitudes), numbers(longitudes), lambda a, b: F.struct(a.alias("lat"), b.alias("lon")))


def corridor_metrics(corridor: DataFrame, coords: str = "coords") -> DataFrame:
    """``corridor`` with length_km, direct_distance_km, sinuosity (1 for no distance) and display_score if it lacks one."""
    c = F.col(coords)
    legs = F.zip_with(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: haversine(a["lat"], a["lon"], b["lat"], b["lon"]))
    length = F.aggregate(legs, F.lit(0.0), lambda a, x: a + x) / 1000
    ends = (F.element_at(c, 1), F.element_at(c, -1))
    direct = F.when(F.size(c) >= 2, haversine(ends[0]["lat"], ends[0]["lon"], ends[1]["lat"], ends[1]["lon"]) / 1000).otherwise(0.0)
    rows = corridor.withColumn("length_", length).withColumn("direct_", direct)
    rows = rows.withColumn("length_km", F.round("length_", 3)).withColumn("direct_distance_km", F.round("direct_", 3))
    rows = rows.withColumn("sinuosity", F.round(F.when(F.col("direct_") > 0, F.col("length_") / F.col("direct_")).otherwise(1.0), 3)).drop("length_", "direct_")
    if "display_score" not in corridor.columns:
        rows = rows.withColumn("display_score", F.round(F.col("weight_mean") * F.log1p(F.size(c)), 2))
    return rows


def corridor_view(corridor: DataFrame, least_weight: float, least_km: float, intensity: str | None = None) -> DataFrame:
    """``corridor`` with ``intensity``, against the largest mean weight of all, those heavy and long enough; of one intensity if asked."""
    largest = corridor.agg(F.max("weight_mean").alias("m_"))  # one row
    rows = corridor.crossJoin(F.broadcast(largest)).withColumn("intensity", corridor_intensity(F.col("weight_mean"), F.col("m_"))).drop("m_")
    rows = rows.where((F.col("weight_mean") >= least_weight) & (F.col("length_km") >= least_km))
    return rows if intensity is None else rows.where(F.col("intensity") == intensity)


def touches_region(coords: Column, box: tuple[float, float, float, float] = MAP_REGION) -> Column:
    return F.exists(coords, lambda p: in_box(p["lat"], p["lon"], box))


def display_cells(coords: Column) -> Column:
    return F.array_distinct(F.transform(coords, lambda p: F.struct(F.bround(p["lat"], 3).alias("lat"), F.bround(p["lon"], 3).alias("lon"))))


def without_overlap(shown: DataFrame, order: str = "corridor_id", cells: str = "cells", most_overlap: float = MOST_OVERLAP, most: int = MOST_SHOWN, block: int = 20 * MOST_SHOWN) -> DataFrame:
    """Corridors in order, leaving out those that mostly lie on accepted ones; at most ``most``, and the first ones if none is.

    Only ids and cells go to the one task that decides, ``block`` corridors at a
    time, until ``most`` are accepted or the corridors end. What is carried on
    are the accepted ids and their cells, which ``most`` bounds.
    """
    spark = shown.sparkSession
    rows = stored(shown.where(F.size(cells) > 0).select(F.col(order).alias("key"), F.col(cells).alias("own")), "corridor-cells")
    kept: list[int] = []
    taken: set[tuple] = set()
    last = None
    while len(kept) < most:
        rest = rows if last is None else rows.where(F.col("key") > last)
        some = rest.orderBy("key").limit(block).select("key", "own", F.lit(0).alias("all_"))
        room = most - len(kept)

        def accept(frame: pd.DataFrame) -> pd.DataFrame:  # runs before the next block changes what it holds
            occupied, found = set(taken), []
            frame = frame.sort_values("key")
            for key, own in zip(frame["key"], frame["own"], strict=True):
                mine = {tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in own}
                if len(mine & occupied) / len(mine) <= most_overlap:
                    found.append((key, pickle.dumps(mine)))
                    occupied |= mine
                    if len(found) == room:
                        break
            return pd.DataFrame([*found, (frame["key"].iloc[-1], None)], columns=["key", "mine"])  # the last one: how far the block goes

        ends = some.groupBy("all_").applyInPandas(accept, "key long, mine binary").collect()
        if not ends:
            break
        for r in ends:
            if r["mine"] is None:
                last = r["key"]
            else:
                kept.append(r["key"])
                taken |= pickle.loads(r["mine"])
    return shown.join(F.broadcast(spark.createDataFrame([(k,) for k in kept], f"{order} long")), order, "left_semi")
