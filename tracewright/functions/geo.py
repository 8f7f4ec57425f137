"""Distances, grids and boxes as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
M_PER_DEGREE = 111_320.0
#: Latitude whose parallel sets the east-west size of grid cells.
GRID_LATITUDE = 48.8566
M_PER_DEGREE_EAST = M_PER_DEGREE * math.cos(math.radians(GRID_LATITUDE))
#: (min lat, max lat, min lon, max lon) of the region that raw points must lie in, and of corridor maps.
REGION = (48.10, 49.25, 1.40, 3.60)
MAP_REGION = (48.10, 49.25, 1.45, 3.60)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres; null if any coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def cell_id(lat: Column, lon: Column, size_m: float) -> Column:
    """``north:east`` numbers of the floor grid cell."""
    north = F.floor(lat * F.lit(M_PER_DEGREE) / F.lit(float(size_m)))
    east = F.floor(lon * F.lit(M_PER_DEGREE_EAST) / F.lit(float(size_m)))
    return F.concat_ws(":", north, east)


def cell_center(cell: Column, size_m: float) -> Column:
    """``struct<lat, lon>`` of the middle of a floor grid cell."""
    part = F.split(cell, ":")
    lat = (part[0].cast("double") + 0.5) * F.lit(float(size_m)) / F.lit(M_PER_DEGREE)
    lon = (part[1].cast("double") + 0.5) * F.lit(float(size_m)) / F.lit(M_PER_DEGREE_EAST)
    return F.struct(lat.alias("lat"), lon.alias("lon"))


def snap_grid(lat: Column, lon: Column, size_m: float, ref_lat: Column) -> Column:
    """``struct<gx, gy>`` of the nearest grid node; halves go to the even one."""
    gx = F.rint(lon * (F.lit(M_PER_DEGREE) * F.cos(F.radians(ref_lat))) / F.lit(float(size_m)))
    gy = F.rint(lat * F.lit(M_PER_DEGREE) / F.lit(float(size_m)))
    return F.struct(gx.cast("long").alias("gx"), gy.cast("long").alias("gy"))


def grid_node(node: Column, size_m: float, ref_lat: Column) -> Column:
    """``struct<lat, lon>`` of a grid node."""
    lat = node["gy"] * F.lit(float(size_m)) / F.lit(M_PER_DEGREE)
    lon = node["gx"] * F.lit(float(size_m)) / (F.lit(M_PER_DEGREE) * F.cos(F.radians(ref_lat)))
    return F.struct(lat.alias("lat"), lon.alias("lon"))


def edge_key(a: Column, b: Column) -> Column:
    """``struct<a, b>`` of an undirected edge: the smaller end first."""
    return F.when(a <= b, F.struct(a.alias("a"), b.alias("b"))).otherwise(F.struct(b.alias("a"), a.alias("b")))


def mean_degrees(column: Column) -> Column:
    """Mean of coordinates to the billionth of a degree (a tenth of a millimetre), summed exactly: the same in any order of rows."""
    return F.sum(column.cast("decimal(18,9)")).cast("double") / F.count(column)


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])
