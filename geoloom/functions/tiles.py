"""Web-mercator map tiles and bounding boxes as column expressions.

A box is four columns (xmin, ymin, xmax, ymax); one whose xmin exceeds xmax
crosses the antimeridian.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.geodesy import MAX_MERCATOR_LATITUDE, clamp, metres_per_pixel, midpoint

Box = tuple[Column, Column, Column, Column]


def tile_x(x: Column, zoom: int | Column) -> Column:
    n = F.pow(F.lit(2.0), F.lit(zoom) if isinstance(zoom, int) else zoom)
    return F.greatest(F.lit(0), F.least(F.floor((x / 360.0 + 0.5) * n), n - 1)).cast("int")


def tile_y(y: Column, zoom: int | Column) -> Column:
    n = F.pow(F.lit(2.0), F.lit(zoom) if isinstance(zoom, int) else zoom)
    lat = F.radians(clamp(y, -MAX_MERCATOR_LATITUDE, MAX_MERCATOR_LATITUDE))
    return F.greatest(F.lit(0), F.least(F.floor((0.5 - F.log(F.tan(math.pi / 4 + lat / 2)) / math.pi / 2) * n), n - 1)).cast("int")


def quadkey(x: Column, y: Column, zoom: int) -> Column:
    digits = [((F.shiftright(x, k).bitwiseAND(1)) + 2 * (F.shiftright(y, k).bitwiseAND(1))).cast("string") for k in range(zoom - 1, -1, -1)]
    return F.concat(*digits) if digits else F.lit("")


def from_quadkey(key: Column) -> Column:
    """struct(x, y, z)."""
    digit = F.split(key, "")
    bit = lambda k: F.aggregate(F.filter(digit, lambda d: d != ""), F.lit(0), lambda t, d: t * 2 + F.shiftright(d.cast("int"), k).bitwiseAND(1))
    return F.struct(bit(0).alias("x"), bit(1).alias("y"), F.length(key).alias("z"))


def from_string(text: Column) -> Column:
    """struct(x, y, z) of "z/x/y"; null where the text isn't that."""
    part = F.split(text, "/")
    return F.when(text.rlike(r"^\d+/\d+/\d+$"), F.struct(part[1].cast("int").alias("x"), part[2].cast("int").alias("y"), part[0].cast("int").alias("z")))


def tms_row(y: Column, zoom: Column) -> Column:
    return (F.pow(F.lit(2.0), zoom) - 1 - y).cast("int")


def tile_lon(x: Column, zoom: Column) -> Column:
    return x / F.pow(F.lit(2.0), zoom) * 360.0 - 180.0


def tile_lat(y: Column, zoom: Column) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / F.pow(F.lit(2.0), zoom)))))


def tile_box(x: Column, y: Column, zoom: Column) -> Box:
    return tile_lon(x, zoom), tile_lat(y + 1, zoom), tile_lon(x + 1, zoom), tile_lat(y, zoom)


def tile_centre(x: Column, y: Column, zoom: Column) -> Column:
    """struct(x, y) of the middle pixel."""
    return F.struct(tile_lon(x + 0.5, zoom).alias("x"), tile_lat(y + 0.5, zoom).alias("y"))


def parent(x: Column, y: Column, zoom: Column) -> Column:
    """struct(x, y, z); null for the world tile."""
    return F.when(zoom > 0, F.struct(F.shiftright(x, 1).alias("x"), F.shiftright(y, 1).alias("y"), (zoom - 1).alias("z")))


def _tile(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), z.cast("int").alias("z"))


def children(x: Column, y: Column, zoom: Column) -> Column:
    return F.array(*[_tile(2 * x + i, 2 * y + j, zoom + 1) for j in (0, 1) for i in (0, 1)])


def siblings(x: Column, y: Column, zoom: Column) -> Column:
    return F.when(zoom > 0, F.filter(children(F.shiftright(x, 1), F.shiftright(y, 1), zoom - 1), lambda t: (t["x"] != x) | (t["y"] != y))).otherwise(F.array(_tile(x, y, zoom)).cast("array<struct<x:int,y:int,z:int>>"))


def neighbours(x: Column, y: Column, zoom: Column) -> Column:
    """The tile itself and those around it; columns wrap around the world, rows end at the poles."""
    n = F.pow(F.lit(2.0), zoom).cast("int")
    around = F.array(*[_tile(F.pmod(x + i, n), y + j, zoom) for j in (-1, 0, 1) for i in (-1, 0, 1)])
    return F.array_distinct(F.filter(around, lambda t: (t["y"] >= 0) & (t["y"] < n)))


def ancestors(x: Column, y: Column, zoom: Column) -> Column:
    return F.transform(
        F.when(zoom > 0, F.sequence(F.lit(1), zoom)).otherwise(F.array().cast("array<int>")),
        lambda k: _tile(F.floor(x / F.pow(F.lit(2.0), k)), F.floor(y / F.pow(F.lit(2.0), k)), zoom - k),
    )


def descendants(x: Column, y: Column, zoom: Column, at: Column) -> Column:
    side = F.pow(F.lit(2.0), at - zoom).cast("int")
    cells = F.sequence(F.lit(0), side - 1)
    return F.flatten(F.transform(cells, lambda j: F.transform(cells, lambda i: _tile(x * side + i, y * side + j, at))))


def is_ancestor(x: Column, y: Column, z: Column, x2: Column, y2: Column, z2: Column) -> Column:
    k = F.pow(F.lit(2.0), z2 - z)
    return (z < z2) & (F.floor(x2 / k) == x) & (F.floor(y2 / k) == y)


def common_tile(box: Box, deepest: int = 22) -> Column:
    """struct(x, y, z) of the smallest tile that holds a box."""
    x1, x2 = tile_x(box[0], deepest), tile_x(box[2], deepest)
    y1, y2 = tile_y(box[3], deepest), tile_y(box[1], deepest)
    differ = F.greatest(x1.bitwiseXOR(x2), y1.bitwiseXOR(y2))
    up = F.when(differ == 0, F.lit(0)).otherwise(F.length(F.bin(differ)))
    shift = lambda v: F.floor(v / F.pow(F.lit(2.0), up))
    return _tile(shift(x1), shift(y1), F.lit(deepest) - up)


def tile_metres_per_pixel(y: Column, zoom: Column) -> Column:
    return metres_per_pixel(zoom, tile_lat(y + 0.5, zoom))


def crosses_antimeridian(box: Box) -> Column:
    return box[0] > box[2]


def box_contains(box: Box, x: Column, y: Column) -> Column:
    inside = F.when(crosses_antimeridian(box), (x >= box[0]) | (x <= box[2])).otherwise((x >= box[0]) & (x <= box[2]))
    return inside & (y >= box[1]) & (y <= box[3])


def _spans_meet(a: Box, b: Box) -> Column:
    ca, cb = crosses_antimeridian(a), crosses_antimeridian(b)
    plain = (a[0] <= b[2]) & (b[0] <= a[2])
    return F.when(ca & cb, F.lit(True)).when(ca | cb, (a[0] <= b[2]) | (b[0] <= a[2])).otherwise(plain)


def boxes_intersect(a: Box, b: Box) -> Column:
    return _spans_meet(a, b) & (a[1] <= b[3]) & (b[1] <= a[3])


def box_within(inner: Box, outer: Box) -> Column:
    return (inner[0] >= outer[0]) & (inner[1] >= outer[1]) & (inner[2] <= outer[2]) & (inner[3] <= outer[3])


def box_intersection(a: Box, b: Box) -> Column:
    """struct(xmin, ymin, xmax, ymax); null where boxes that don't cross the antimeridian are apart."""
    own = F.struct(F.greatest(a[0], b[0]).alias("xmin"), F.greatest(a[1], b[1]).alias("ymin"), F.least(a[2], b[2]).alias("xmax"), F.least(a[3], b[3]).alias("ymax"))
    return F.when(boxes_intersect(a, b), own)


def box_union(a: Box, b: Box) -> Column:
    return F.struct(F.least(a[0], b[0]).alias("xmin"), F.least(a[1], b[1]).alias("ymin"), F.greatest(a[2], b[2]).alias("xmax"), F.greatest(a[3], b[3]).alias("ymax"))


def box_padded(box: Box, degrees: Column) -> Column:
    return F.struct((box[0] - degrees).alias("xmin"), (box[1] - degrees).alias("ymin"), (box[2] + degrees).alias("xmax"), (box[3] + degrees).alias("ymax"))


def box_squared(box: Box) -> Column:
    """The shorter side grown about the centre to the longer one's degrees."""
    w, h = box[2] - box[0], box[3] - box[1]
    dx, dy = F.greatest(h - w, F.lit(0.0)) / 2, F.greatest(w - h, F.lit(0.0)) / 2
    return F.struct((box[0] - dx).alias("xmin"), (box[1] - dy).alias("ymin"), (box[2] + dx).alias("xmax"), (box[3] + dy).alias("ymax"))


def box_centre(box: Box) -> Column:
    return midpoint(*box)


#: Bits of box_position.
CENTRE, TOP, RIGHT, BOTTOM, LEFT, OUTSIDE = (1 << k for k in range(6))


def box_position(box: Box, x: Column, y: Column) -> Column:
    """Bit set: the upper, right, lower, left 35 % that a point is in, the centre if none, and whether it's outside."""
    w, h = box[2] - box[0], box[3] - box[1]
    flag = lambda on, bit: F.when(on, bit).otherwise(0)
    bits = (
        flag(~box_contains(box, x, y), OUTSIDE) + flag(y > box[1] + h * 0.65, TOP) + flag(x > box[0] + w * 0.65, RIGHT)
        + flag(y < box[1] + h * 0.35, BOTTOM) + flag(x < box[0] + w * 0.35, LEFT)
    )
    return F.when(bits == 0, CENTRE).otherwise(bits).cast("int")
