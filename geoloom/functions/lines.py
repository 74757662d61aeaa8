"""Lines and rings as arrays of struct<x, y>, measured and reshaped with higher-order functions.

Arrays are expected to be columns, so that a lambda's reference to one is a
field access. No rows are exploded and no Python runs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions import geodesy as G


def xy(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def segments(line: Column) -> Column:
    """array<struct<a, b>> of consecutive pairs."""
    n = F.size(line)
    return F.when(n > 1, F.zip_with(F.slice(line, F.lit(1), n - 1), F.slice(line, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def total(values: Column) -> Column:
    return F.aggregate(F.coalesce(values, F.array().cast("array<double>")), F.lit(0.0), lambda t, v: t + v)


def length(line: Column) -> Column:
    return total(F.transform(segments(line), lambda s: G.distance(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])))


def rhumb_length(line: Column) -> Column:
    return total(F.transform(segments(line), lambda s: G.rhumb_distance(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])))


def signed_ring_area(ring: Column) -> Column:
    """Spherical area in square metres of a closed ring, by the sum of lon differences times sines; positive if counter-clockwise."""
    dx = lambda s: G.wrap180(s["b"]["x"] - s["a"]["x"])
    part = lambda s: F.radians(dx(s)) * (F.sin(F.radians(s["a"]["y"])) + F.sin(F.radians(s["b"]["y"])))
    return -total(F.transform(segments(ring), part)) * (G.EQUATORIAL_RADIUS**2 / 2)


def ring_area(ring: Column) -> Column:
    return F.abs(signed_ring_area(ring))


def polygon_area(rings: Column) -> Column:
    """Outer ring less the holes, which are taken to be disjoint."""
    holes = F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))
    return ring_area(rings[0]) - total(F.transform(holes, ring_area))


def planar_area(ring: Column) -> Column:
    """Signed shoelace area in square degrees."""
    return total(F.transform(segments(ring), lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])) / 2


def is_clockwise(ring: Column) -> Column:
    return planar_area(ring) < 0


def centroid(line: Column) -> Column:
    """Mean of the vertices, a closing one counted once."""
    n = F.size(line)
    closed = (n > 1) & (line[0]["x"] == line[n - 1]["x"]) & (line[0]["y"] == line[n - 1]["y"])
    own = F.slice(line, F.lit(1), n - F.when(closed, 1).otherwise(0))
    mean = lambda f: total(F.transform(own, lambda c: c[f])) / F.size(own)
    return xy(mean("x"), mean("y"))


def centre_of_mass(ring: Column) -> Column:
    """Shoelace centroid of a closed ring."""
    cross = lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
    sum_of = lambda f: total(F.transform(segments(ring), lambda s: (s["a"][f] + s["b"][f]) * cross(s)))
    area = planar_area(ring)
    return xy(sum_of("x") / (6 * area), sum_of("y") / (6 * area))


def bounds(line: Column) -> Column:
    pick = lambda fn, f: fn(F.transform(line, lambda c: c[f]))
    return F.struct(pick(F.array_min, "x").alias("xmin"), pick(F.array_min, "y").alias("ymin"), pick(F.array_max, "x").alias("xmax"), pick(F.array_max, "y").alias("ymax"))


def on_segment(s: Column, x: Column, y: Column) -> Column:
    """Whether a point is within 1e-10 degrees of a segment, by its distance across and the segment's box widened by as much."""
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
    across = dx * (y - s["a"]["y"]) - dy * (x - s["a"]["x"])
    in_range = lambda v, f: (v >= F.least(s["a"][f], s["b"][f]) - 1e-10) & (v <= F.greatest(s["a"][f], s["b"][f]) + 1e-10)
    return in_range(x, "x") & in_range(y, "y") & (across * across <= 1e-20 * (dx * dx + dy * dy))


def on_line(line: Column, x: Column, y: Column) -> Column:
    return F.exists(segments(line), lambda s: on_segment(s, x, y))


def _crossings(ring: Column, x: Column, y: Column) -> Column:
    """Number of edges to the right of a point that its parallel crosses."""

    def hit(s: Column) -> Column:
        spans = (s["a"]["y"] > y) != (s["b"]["y"] > y)
        at = s["a"]["x"] + (y - s["a"]["y"]) / F.when(s["b"]["y"] == s["a"]["y"], F.lit(1.0)).otherwise(s["b"]["y"] - s["a"]["y"]) * (s["b"]["x"] - s["a"]["x"])
        return spans & (x < at)

    return F.size(F.filter(segments(ring), hit))


def ring_contains(ring: Column, x: Column, y: Column, ignoring_boundary: bool = False) -> Column:
    """Even-odd test; the boundary is inside unless it's ignored. A ring may cross the antimeridian."""

    def holds(own: Column, at: Column) -> Column:
        return F.when(on_line(own, at, y), F.lit(not ignoring_boundary)).otherwise(_crossings(own, at, y) % 2 == 1)

    across = unwrapped(ring)
    return F.when(crosses_antimeridian(ring), holds(across, x) | holds(across, x + 360.0) | holds(across, x - 360.0)).otherwise(holds(ring, x))


def polygon_contains(rings: Column, x: Column, y: Column, ignoring_boundary: bool = False) -> Column:
    """In the outer ring and in no hole; a hole's edge belongs to the hole unless boundaries are ignored."""
    holes = F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))
    return ring_contains(rings[0], x, y, ignoring_boundary) & ~F.exists(holes, lambda h: ring_contains(h, x, y, ignoring_boundary))


def foot(s: Column, x: Column, y: Column, clamp: bool = True) -> Column:
    """struct(x, y) of the perpendicular foot on a segment, in degree space."""
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
    square = dx * dx + dy * dy
    t = ((x - s["a"]["x"]) * dx + (y - s["a"]["y"]) * dy) / square
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) if clamp else t
    t = F.when(square == 0, F.lit(0.0)).otherwise(t)
    return xy(s["a"]["x"] + t * dx, s["a"]["y"] + t * dy)


def nearest_on_line(line: Column, x: Column, y: Column) -> Column:
    """struct(distance, index, x, y) of the nearest point on the line; of equally near ones (a vertex of two segments) the first, in the arithmetic of the SQL."""

    def near(s: Column, k: Column) -> Column:
        p = foot(s, x, y)
        return F.struct(G.distance_by_sine(x, y, p["x"], p["y"]).alias("distance"), k.alias("index"), p["x"].alias("x"), p["y"].alias("y"))

    return F.array_min(F.transform(segments(line), near))


def point_to_line_distance(line: Column, x: Column, y: Column) -> Column:
    return nearest_on_line(line, x, y)["distance"]


def nearest_vertex(line: Column, x: Column, y: Column) -> Column:
    """struct(distance, index, x, y) of the nearest vertex."""
    return F.array_min(F.transform(line, lambda c, k: F.struct(G.distance(x, y, c["x"], c["y"]).alias("distance"), k.alias("index"), c["x"].alias("x"), c["y"].alias("y"))))


def along(line: Column, metres: Column) -> Column:
    """struct(x, y) at a distance along the line, clamped to its end."""
    start = F.struct(metres.cast("double").alias("left"), line[0].alias("at"), F.lit(False).alias("done"))

    def step(t: Column, s: Column) -> Column:
        d = G.distance(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])
        hit = ~t["done"] & (t["left"] <= d)
        target = F.when(t["left"] == 0, s["a"]).otherwise(G.in_direction_of(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"], t["left"]))
        at = F.when(t["done"], t["at"]).when(hit, target).otherwise(s["b"])
        return F.struct((t["left"] - F.when(t["done"], 0.0).otherwise(d)).alias("left"), at.alias("at"), (t["done"] | hit).alias("done"))

    return F.aggregate(segments(line), start, step)["at"]


def hausdorff(a: Column, b: Column, distance=G.distance) -> Column:
    """Symmetric greatest nearest-vertex distance."""
    one = lambda p, q: F.array_max(F.transform(p, lambda c: F.array_min(F.transform(q, lambda d: distance(c["x"], c["y"], d["x"], d["y"])))))
    return F.greatest(one(a, b), one(b, a))


def segment_intersection(s: Column, t: Column) -> Column:
    """struct(x, y) where two segments meet in one point; null if they're apart or parallel."""
    rx, ry, qx, qy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"], t["b"]["x"] - t["a"]["x"], t["b"]["y"] - t["a"]["y"]
    det = rx * qy - ry * qx
    safe = F.when(F.abs(det) < 1e-15, F.lit(None)).otherwise(det)
    u = ((t["a"]["x"] - s["a"]["x"]) * qy - (t["a"]["y"] - s["a"]["y"]) * qx) / safe
    v = ((t["a"]["x"] - s["a"]["x"]) * ry - (t["a"]["y"] - s["a"]["y"]) * rx) / safe
    inside = (u >= -1e-12) & (u <= 1 + 1e-12) & (v >= -1e-12) & (v <= 1 + 1e-12)
    return F.when(inside, xy(s["a"]["x"] + u * rx, s["a"]["y"] + u * ry))


def intersections(a: Column, b: Column, distinct: bool = True) -> Column:
    """Points where two lines cross; not distinct: one for each two segments that do, so a place crossed again counts again."""
    hits = F.flatten(F.transform(segments(a), lambda s: F.transform(segments(b), lambda t: segment_intersection(s, t))))
    found = F.filter(hits, lambda p: p.isNotNull())
    return F.array_distinct(found) if distinct else found


def is_concave(ring: Column) -> Column:
    """Whether successive turns of a closed ring change sign."""
    n = F.size(ring) - 1
    turn = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda k: (ring[(k + 1) % n]["x"] - ring[k]["x"]) * (ring[(k + 2) % n]["y"] - ring[(k + 1) % n]["y"])
        - (ring[(k + 1) % n]["y"] - ring[k]["y"]) * (ring[(k + 2) % n]["x"] - ring[(k + 1) % n]["x"]),
    )
    return F.exists(turn, lambda v: v > 0) & F.exists(turn, lambda v: v < 0)


def is_parallel(a: Column, b: Column, tolerance: float = 0.0, undirected: bool = False) -> Column:
    """Whether the rhumb azimuths of the segments agree pairwise."""
    way = lambda s: G.azimuth(G.rhumb_bearing(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]))

    def agree(s: Column, t: Column) -> Column:
        d = F.abs(G.angle_between(way(s), way(t)))
        return (F.least(d, 180.0 - d) if undirected else d) <= tolerance + 1e-9

    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(segments(a), segments(b), agree), lambda ok: F.coalesce(ok, F.lit(False)))


def flipped(line: Column) -> Column:
    return F.transform(line, lambda c: xy(c["y"], c["x"]))


def truncated(line: Column, precision: int = 6) -> Column:
    return F.transform(line, lambda c: xy(F.round(c["x"], precision), F.round(c["y"], precision)))


def without_repeats(line: Column) -> Column:
    """Consecutive equal vertices once."""
    return F.filter(line, lambda c, k: (k == 0) | (c["x"] != line[F.greatest(k - 1, F.lit(0))]["x"]) | (c["y"] != line[F.greatest(k - 1, F.lit(0))]["y"]))


def snapped(line: Column, cell: float) -> Column:
    """Vertices on a grid, half away from zero."""
    return F.transform(line, lambda c: xy(F.round(c["x"] / cell) * cell, F.round(c["y"] / cell) * cell))


def rewound(ring: Column, clockwise: bool = False) -> Column:
    return F.when(is_clockwise(ring) == clockwise, ring).otherwise(F.reverse(ring))


def translated(line: Column, metres: float, direction: float) -> Column:
    """Rhumb shift; the sign of the distance is ignored."""
    return F.transform(line, lambda c: G.rhumb_destination(c["x"], c["y"], F.lit(abs(metres)), F.lit(float(direction))))


def _sent(line: Column, px: Column, py: Column, factor: float, angle: float) -> Column:
    """Vertices at a factor of their rhumb distance from a pivot, turned clockwise by an angle.

    As rhumb_distance, rhumb_bearing and rhumb_destination one after the other, but
    with a step for each value that is used several times: inside a lambda an
    expression is worked out wherever it stands.
    """
    p = F.radians(py)
    whole = lambda c: F.when(c["x"] - px > 180, c["x"] - 360).when(px - c["x"] > 180, c["x"] + 360).otherwise(c["x"])
    east = lambda v: F.when(v > math.pi, v - 2 * math.pi).when(v < -math.pi, v + 2 * math.pi).otherwise(v)
    fold = lambda v: F.when(v > math.pi / 2, math.pi - v).when(v < -math.pi / 2, -math.pi - v).otherwise(v)
    steps = [
        lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), F.radians(F.abs(whole(c) - px)).alias("dx"), F.radians(c["x"] - px).alias("e"), F.radians(c["y"] - py).alias("dy"), G._stretched(py, c["y"]).alias("psi")),
        lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), s["dx"].alias("dx"), s["dy"].alias("dy"), F.when(F.abs(s["psi"]) > 1e-12, s["dy"] / s["psi"]).otherwise(F.cos(p)).alias("q"), F.pmod(F.degrees(F.atan2(east(s["e"]), s["psi"])) + 360.0, F.lit(360.0)).alias("b")),
        lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), (F.sqrt(s["dy"] * s["dy"] + s["q"] * s["q"] * s["dx"] * s["dx"]) * G.EARTH_RADIUS).alias("m"), F.radians(F.when(s["b"] > 180, s["b"] - 360.0).otherwise(s["b"]) + angle).alias("t")),
        lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), s["m"].alias("m"), s["t"].alias("t"), (s["m"] * factor / G.EARTH_RADIUS).alias("d"), (s["m"] * factor / G.EARTH_RADIUS * F.cos(s["t"])).alias("dp")),
        lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), s["m"].alias("m"), s["t"].alias("t"), s["d"].alias("d"), s["dp"].alias("dp"), fold(p + s["dp"]).alias("p2")),
        lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), s["m"].alias("m"), s["t"].alias("t"), s["d"].alias("d"), s["dp"].alias("dp"), s["p2"].alias("p2"), F.log(F.tan(s["p2"] / 2 + math.pi / 4) / F.tan(p / 2 + math.pi / 4)).alias("psi")),
        lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), s["m"].alias("m"), s["p2"].alias("p2"), G.wrap180(F.degrees(F.radians(px) + s["d"] * F.sin(s["t"]) / F.when(F.abs(s["psi"]) > 1e-11, s["dp"] / s["psi"]).otherwise(F.cos(p)))).alias("x2")),
        lambda s: F.when(s["m"] == 0, xy(s["x"], s["y"])).otherwise(F.struct(F.when(s["x2"] - px > 180, s["x2"] - 360.0).when(px - s["x2"] > 180, s["x2"] + 360.0).otherwise(s["x2"]).alias("x"), F.degrees(s["p2"]).alias("y"))),
    ]
    for step in steps:
        line = F.transform(line, step)
    return line


def _around(line: Column, px: Column, py: Column, factor: float, angle: float) -> Column:
    """_sent with the pivot worked out once a line."""
    own = F.array(F.struct(line.alias("line"), px.cast("double").alias("x"), py.cast("double").alias("y")))
    return F.transform(own, lambda o: _sent(o["line"], o["x"], o["y"], factor, angle))[0]


def rotated(line: Column, angle: float, px: Column, py: Column) -> Column:
    """Clockwise rotation about a pivot along rhumb lines."""
    return _around(line, px, py, 1.0, angle)


def scaled(line: Column, factor: float, ax: Column, ay: Column) -> Column:
    """Rhumb distances from an anchor times a factor."""
    return _around(line, ax, ay, factor, 0.0)


def densified(line: Column, metres: float) -> Column:
    """Vertices added so that no segment spans more than metres / 111325 degrees."""
    limit = metres / G.METRES_PER_DEGREE

    def cut(s: Column) -> Column:
        n = F.greatest(F.ceil(G.planar_distance(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]) / limit).cast("int"), F.lit(1))
        at = lambda k, f: s["a"][f] + (s["b"][f] - s["a"][f]) * k / n
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: xy(at(k, "x"), at(k, "y")))

    return F.concat(F.flatten(F.transform(segments(line), cut)), F.array(line[F.size(line) - 1]))


def smooth(ring: Column) -> Column:
    """One round of corner cutting at 3/4 and 1/4 of each edge of a closed ring, closed again."""
    blend = lambda s, w: xy(s["a"]["x"] * w + s["b"]["x"] * (1 - w), s["a"]["y"] * w + s["b"]["y"] * (1 - w))
    cut = F.flatten(F.transform(segments(ring), lambda s: F.array(blend(s, 0.75), blend(s, 0.25))))
    return F.concat(cut, F.array(cut[0]))


def circle(x: Column, y: Column, radius: Column, steps: int = 64) -> Column:
    """Closed ring of destinations around a point."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: G.destination(x, y, radius, F.when(k == steps, F.lit(0.0)).otherwise(k * (-360.0 / steps))))


def ellipse(x: Column, y: Column, x_axis: Column, y_axis: Column, steps: int = 64, angle: float = 0.0) -> Column:
    """Closed ring with semi-axes in metres, turned clockwise by an angle."""
    t = math.radians(angle)

    def at(k: Column) -> Column:
        s = F.when(k == steps, F.lit(0.0)).otherwise(k * (-2 * math.pi / steps))
        ex, ny = x_axis * F.cos(s), y_axis * F.sin(s)
        e, n = ex * math.cos(t) + ny * math.sin(t), -ex * math.sin(t) + ny * math.cos(t)
        return G.rhumb_destination(x, y, F.sqrt(e * e + n * n), F.degrees(F.atan2(e, n)))

    return F.transform(F.sequence(F.lit(0), F.lit(steps)), at)


def arc(x: Column, y: Column, radius: Column, from_bearing: float, to_bearing: float, steps: int = 64) -> Column:
    """Line along a circle between two bearings, clockwise; the whole circle if they're equal."""
    span = (to_bearing - from_bearing) % 360.0
    if span == 0:
        return circle(x, y, radius, steps)
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: G.destination(x, y, radius, from_bearing + k * (span / steps)))


def sector(x: Column, y: Column, radius: Column, from_bearing: float, to_bearing: float, steps: int = 64) -> Column:
    """Closed ring: centre, arc, centre."""
    if (to_bearing - from_bearing) % 360.0 == 0:
        return circle(x, y, radius, steps)
    c = F.array(xy(x, y))
    return F.concat(c, arc(x, y, radius, from_bearing, to_bearing, steps), c)


def great_circle(x1: Column, y1: Column, x2: Column, y2: Column, points: int = 100) -> Column:
    """Points by spherical interpolation between two."""
    d = G.distance(x1, y1, x2, y2) / G.EARTH_RADIUS

    def at(k: Column) -> Column:
        f = k / (points - 1.0)
        a, b = F.sin((1 - f) * d) / F.sin(d), F.sin(f * d) / F.sin(d)
        part = lambda fx, fy: a * F.cos(F.radians(y1)) * fx(F.radians(x1)) + b * F.cos(F.radians(y2)) * fy(F.radians(x2))
        px, py, pz = part(F.cos, F.cos), part(F.sin, F.sin), a * F.sin(F.radians(y1)) + b * F.sin(F.radians(y2))
        return xy(F.degrees(F.atan2(py, px)), F.degrees(F.atan2(pz, F.sqrt(px * px + py * py))))

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)


def crosses_antimeridian(line: Column) -> Column:
    """Whether a step spans over half the globe, but not all of it."""
    step = lambda s: F.abs(s["b"]["x"] - s["a"]["x"])
    return F.exists(segments(line), lambda s: (step(s) > 180) & (step(s) < 360))


def unwrapped(line: Column) -> Column:
    """The line on longitudes without jumps, which may pass 180; as it is where it doesn't cross the antimeridian."""
    start = F.struct(F.lit(0.0).alias("shift"), line[0]["x"].cast("double").alias("last"), F.slice(line, 1, 0).alias("done"))

    def step(t: Column, c: Column) -> Column:
        d = c["x"] - t["last"]
        shift = t["shift"] + F.when((d > 180) & (d < 360), -360.0).when((d < -180) & (d > -360), 360.0).otherwise(0.0)
        moved = F.transform(F.array(c), lambda p: p.withField("x", p["x"] + shift))
        return F.struct(shift.alias("shift"), c["x"].cast("double").alias("last"), F.concat(t["done"], moved).alias("done"))

    return F.when(crosses_antimeridian(line), F.aggregate(line, start, step)["done"]).otherwise(line)


def box_ring(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return F.array(xy(xmin, ymin), xy(xmax, ymin), xy(xmax, ymax), xy(xmin, ymax), xy(xmin, ymin))


def is_valid_ring(ring: Column) -> Column:
    n = F.size(ring)
    return (n >= 4) & (ring[0]["x"] == ring[n - 1]["x"]) & (ring[0]["y"] == ring[n - 1]["y"])


def wkt_line(line: Column) -> Column:
    return F.concat(F.lit("LINESTRING("), F.array_join(F.transform(line, lambda c: F.concat_ws(" ", c["x"].cast("string"), c["y"].cast("string"))), ","), F.lit(")"))
