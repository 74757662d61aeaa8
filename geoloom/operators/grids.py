"""Grids over a box: rows of cells from sequences, generated in parallel.

Cell counts and offsets are plain numbers, so a grid is range() and arithmetic.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import lines as L
from geoloom.functions.geodesy import EARTH_RADIUS, METRES_PER_DEGREE


def haversine(x1: float, y1: float, x2: float, y2: float) -> float:
    a = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * EARTH_RADIUS * math.asin(min(1.0, math.sqrt(a)))


def _spans(box: tuple, cell_width: float, cell_height: float) -> tuple[float, float]:
    """Degrees that a cell takes, from the box's extent along its centre lines."""
    x1, y1, x2, y2 = box
    cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
    return cell_width / haversine(x1, cy, x2, cy) * (x2 - x1), cell_height / haversine(cx, y1, cx, y2) * (y2 - y1)


def _cells(spark: SparkSession, columns: int, rows: int) -> DataFrame:
    n = max(0, columns * rows)
    return spark.range(n).select((F.col("id") % max(columns, 1)).cast("int").alias("col"), F.floor(F.col("id") / max(columns, 1)).cast("int").alias("row"))


def point_grid(spark: SparkSession, box: tuple, side: float) -> DataFrame:
    """col, row, lon, lat: points a side apart, centred in the box."""
    w, h = _spans(box, side, side)
    columns, rows = math.floor((box[2] - box[0]) / w), math.floor((box[3] - box[1]) / h)
    dx, dy = ((box[2] - box[0]) - columns * w) / 2, ((box[3] - box[1]) - rows * h) / 2
    return _cells(spark, columns + 1, rows + 1).select("col", "row", (F.lit(box[0] + dx) + F.col("col") * w).alias("lon"), (F.lit(box[1] + dy) + F.col("row") * h).alias("lat"))


def rectangle_grid(spark: SparkSession, box: tuple, width: float, height: float) -> DataFrame:
    """col, row, ring of cells with fixed metres per degree on both axes, centred."""
    w, h = width / METRES_PER_DEGREE, height / METRES_PER_DEGREE
    columns, rows = math.floor((box[2] - box[0]) / w), math.floor((box[3] - box[1]) / h)
    dx, dy = ((box[2] - box[0]) - columns * w) / 2, ((box[3] - box[1]) - rows * h) / 2
    x, y = F.lit(box[0] + dx) + F.col("col") * w, F.lit(box[1] + dy) + F.col("row") * h
    return _cells(spark, columns, rows).select("col", "row", L.box_ring(x, y, x + w, y + h).alias("ring"))


def square_grid(spark: SparkSession, box: tuple, side: float) -> DataFrame:
    return rectangle_grid(spark, box, side, side)


def triangle_grid(spark: SparkSession, box: tuple, side: float) -> DataFrame:
    """col, row, part, ring: two triangles a cell, the diagonal turning from cell to cell."""
    w, h = _spans(box, side, side)
    columns, rows = math.floor((box[2] - box[0]) / w), math.floor((box[3] - box[1]) / h)
    x, y = F.lit(box[0]) + F.col("col") * w, F.lit(box[1]) + F.col("row") * h
    a, b, c, d = L.xy(x, y), L.xy(x + w, y), L.xy(x + w, y + h), L.xy(x, y + h)
    rising = (F.col("col") + F.col("row")) % 2 == 0
    rings = F.when(rising, F.array(F.array(a, b, c, a), F.array(a, c, d, a))).otherwise(F.array(F.array(a, b, d, a), F.array(b, c, d, b)))
    return _cells(spark, columns, rows).select("col", "row", F.posexplode(rings).alias("part", "ring"))


def hex_grid(spark: SparkSession, box: tuple, side: float, triangles: bool = False) -> DataFrame:
    """col, row, ring of flat-topped hexagons, odd columns half a cell lower; or six triangles for each."""
    rx, ry = _spans(box, side, side)
    step_x, step_y = rx * 1.5, ry * math.sqrt(3)
    columns = max(0, math.floor((box[2] - box[0] - 2 * rx) / step_x) + 1)
    rows = max(0, math.floor((box[3] - box[1] - step_y) / step_y))
    cx = F.lit(box[0] + rx) + F.col("col") * step_x
    cy = F.lit(box[1] + step_y / 2) + F.col("row") * step_y + F.when(F.col("col") % 2 == 1, step_y / 2).otherwise(0.0)
    corner = [L.xy(cx + rx * math.cos(math.radians(60 * k)), cy + ry * math.sin(math.radians(60 * k))) for k in range(6)]
    cells = _cells(spark, columns, rows)
    if triangles:
        rings = F.array(*[F.array(L.xy(cx, cy), corner[k], corner[(k + 1) % 6], L.xy(cx, cy)) for k in range(6)])
        return cells.select("col", "row", F.posexplode(rings).alias("part", "ring"))
    return cells.select("col", "row", F.array(*corner, corner[0]).alias("ring"))


def masked(grid: DataFrame, mask_ring, centre: bool = True) -> DataFrame:
    """Cells whose centroid (or point) is inside a ring expression."""
    if "ring" in grid.columns:
        c = L.centroid(F.col("ring"))
        return grid.where(L.ring_contains(mask_ring, c["x"], c["y"]))
    return grid.where(L.ring_contains(mask_ring, F.col("lon"), F.col("lat")))


def random_points(spark: SparkSession, box: tuple, n: int, seed: int) -> DataFrame:
    """id, lon, lat: uniform in the box, the same for the same seed whatever the partitioning."""
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("id")), F.lit(1 << 40)) / float(1 << 40)
    return spark.range(n).select("id", (F.lit(box[0]) + u(0) * (box[2] - box[0])).alias("lon"), (F.lit(box[1]) + u(1) * (box[3] - box[1])).alias("lat"))


def random_lines(spark: SparkSession, box: tuple, n: int, vertices: int, seed: int) -> DataFrame:
    u = lambda k, j: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), j, F.col("id")), F.lit(1 << 40)) / float(1 << 40)
    line = F.transform(F.sequence(F.lit(1), F.lit(vertices)), lambda j: L.xy(F.lit(box[0]) + u(0, j) * (box[2] - box[0]), F.lit(box[1]) + u(1, j) * (box[3] - box[1])))
    return spark.range(n).select("id", line.alias("line"))


def random_polygons(spark: SparkSession, box: tuple, n: int, vertices: int, seed: int, radius: float = 1.0) -> DataFrame:
    """Star-shaped rings around random centres."""
    u = lambda k, j: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), j, F.col("id")), F.lit(1 << 40)) / float(1 << 40)
    spots = random_points(spark, box, n, seed + 1)
    at = lambda j: (0.4 + 0.6 * u(2, j % vertices)) * radius
    ring = F.transform(F.sequence(F.lit(0), F.lit(vertices)), lambda j: L.xy(F.col("lon") + at(j) * F.cos((j % vertices) * (2 * math.pi / vertices)), F.col("lat") + at(j) * F.sin((j % vertices) * (2 * math.pi / vertices))))
    return spots.select("id", ring.alias("ring"))
