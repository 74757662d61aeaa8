"""Irregular geometry operators as Arrow-batched column functions over GeoJSON text.

Each takes one or two geometry columns (and plain Python options) and returns
GeoJSON text, a number or a boolean. Null or malformed input gives null, and so
does a geometry of a kind that an operator has no value for; every part of a
multi-part geometry counts. They are row-wise: no shuffle, and memory is bounded
by a batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.kernels import planar as P
from geoloom.kernels import predicates as Q


class NotApplicable(ValueError):
    """An operator has no value for a geometry of that kind."""


def _positions(c, least: int) -> bool:
    return isinstance(c, list) and len(c) >= least and all(isinstance(p, list) and len(p) >= 2 and all(isinstance(v, (int, float)) for v in p[:2]) for p in c)


def well_formed(g) -> bool:
    """Whether a parsed value is a geometry, feature or collection whose coordinates have the shape of its kind."""
    kind = g.get("type") if isinstance(g, dict) else None
    if kind in ("GeometryCollection", "FeatureCollection"):
        members = g.get("geometries") or g.get("features") or []
        return isinstance(members, list) and all(map(well_formed, members))
    if kind == "Feature":
        return well_formed(g.get("geometry"))
    c = g.get("coordinates") if kind else None
    every = lambda f: isinstance(c, list) and all(map(f, c))
    rings = lambda q: isinstance(q, list) and bool(q) and all(_positions(r, 4) for r in q)
    shapes = {
        "Point": lambda: _positions([c], 1), "MultiPoint": lambda: _positions(c, 0), "LineString": lambda: _positions(c, 2),
        "MultiLineString": lambda: every(lambda x: _positions(x, 2)), "Polygon": lambda: rings(c), "MultiPolygon": lambda: every(rings),
    }
    return kind in shapes and shapes[kind]()


def _load(text):
    """A parsed geometry; None where the text isn't one."""
    if not isinstance(text, str):
        return None
    try:
        g = json.loads(text)
    except ValueError:
        return None
    return g if well_formed(g) else None


def row_function(kind: str, f: Callable) -> Callable[..., Column]:
    """A column function from f(geometry, ...) on parsed GeoJSON; an error inside f fails the query."""

    def run(*columns: pd.Series) -> pd.Series:
        out = []
        for values in zip(*columns):
            own = [_load(v) for v in values]
            try:
                out.append(None if any(v is None for v in own) else f(*own))
            except NotApplicable:
                out.append(None)
        return pd.Series(out, dtype=object)

    def one(a: pd.Series) -> pd.Series:
        return run(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    made = {"string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType()}[kind]
    udfs = {1: F.pandas_udf(one, made), 2: F.pandas_udf(two, made)}
    return lambda *columns: udfs[len(columns)](*columns)


def snapped(g: dict, cell: float | None) -> dict:
    """Every coordinate on a grid first, for operators with a grid_size."""
    from geoloom.kernels.codecs import transformed

    if not cell:
        return g
    near = lambda v: P.math.floor(abs(v) / cell + 0.5) * cell * (1 if v >= 0 else -1)
    return transformed(g, lambda p: [near(p[0]), near(p[1]), *p[2:]])


def polygons_of(g: dict) -> list:
    own = Q.parts(g)[2]
    if not own:
        raise NotApplicable("no polygon")
    return own


def lines_of(g: dict) -> list:
    own = Q.parts(g)[1]
    if not own:
        raise NotApplicable("no line")
    return own


def line_of(g: dict) -> list:
    own = lines_of(g)
    if len(own) > 1:
        raise NotApplicable("several lines")
    return own[0]


def point_of(g: dict) -> tuple:
    own = Q.parts(g)[0]
    if len(own) != 1:
        raise NotApplicable("not one point")
    return own[0]


def vertices_of(g: dict) -> list:
    own = Q.vertices(g)
    if not own:
        raise NotApplicable("no vertex")
    return own


def inner_pole(g: dict) -> tuple:
    """The pole of the polygon whose own is farthest from its boundary."""
    return max((P.pole_of_inaccessibility(q) for q in polygons_of(g)), key=lambda p: p[2])


def text(kind: str, coordinates) -> str | None:
    return json.dumps({"type": kind, "coordinates": coordinates}) if coordinates else None


def multi(polygons) -> str | None:
    """Polygon or MultiPolygon text; null if there is nothing."""
    if not polygons:
        return None
    return text("Polygon", polygons[0]) if len(polygons) == 1 else text("MultiPolygon", polygons)


def lines(parts) -> str | None:
    return None if not parts else text("LineString", parts[0]) if len(parts) == 1 else text("MultiLineString", parts)


# Relations


def relation(f: Callable, grid_size: float | None = None) -> Callable[..., Column]:
    return row_function("boolean", lambda a, b: f(snapped(a, grid_size), snapped(b, grid_size)))


intersects, is_disjoint, contains, is_within = relation(Q.intersects), relation(Q.disjoint), relation(Q.contains), relation(Q.within)
covers, covered_by, crosses, touches, is_overlapping = relation(Q.contains), relation(Q.within), relation(Q.crosses), relation(Q.touches), relation(Q.overlaps)

# Overlay


def overlay(op: str, grid_size: float | None = None) -> Callable[..., Column]:
    return row_function("string", lambda a, b: multi(P.overlay(Q.parts(snapped(a, grid_size))[2], Q.parts(snapped(b, grid_size))[2], op)))


union, intersection, difference, symmetric_difference = (overlay(op) for op in ("union", "intersection", "difference", "xor"))
unary_union = row_function("string", lambda g: multi(P.union_all(Q.parts(g)[2])))
coverage_union = unary_union
area = row_function("double", lambda g: P.multi_area(Q.parts(g)[2]))


def coverage_is_valid_of(g: dict) -> bool:
    own = Q.parts(g)[2]
    joined, apart = P.multi_area(P.union_all(own)), sum(P.multi_area([q]) for q in own)
    return abs(joined - apart) <= 1e-6 * max(apart, 1e-12)


coverage_is_valid = row_function("boolean", coverage_is_valid_of)
kinks = row_function("string", lambda g: text("MultiPoint", [k for q in Q.parts(g)[2] for r in q for k in P.kinks(r)]))
unkinked = row_function("string", lambda g: multi([s for q in Q.parts(g)[2] for s in P.unkinked(q)]))
made_valid = row_function("string", lambda g: multi([v for q in Q.parts(g)[2] if (v := P.made_valid(q))]))


def clipped(box: tuple) -> Callable[..., Column]:
    def run(g):
        pts, own, polygons = Q.parts(g)
        if polygons:
            kept = [[r for r in (P.clip_ring(r, box) for r in q) if r] for q in polygons if P.clip_ring(q[0], box)]
            return multi(kept)
        if own:
            return lines([p for line in own for p in P.clip_line(line, box)])
        return text("MultiPoint", [p for p in pts if box[0] <= p[0] <= box[2] and box[1] <= p[1] <= box[3]])

    return row_function("string", run)


def cut_of(g):
    _, own, polygons = Q.parts(g)
    return multi([p for q in polygons for p in P.cut_polygon_at_antimeridian(q)]) if polygons else lines([p for line in own for p in P.cut_line_at_antimeridian(line)])


cut_at_antimeridian = row_function("string", cut_of)


def mask(outer: list | None = None) -> Callable[..., Column]:
    return row_function("string", lambda g: multi([P.mask(Q.parts(g)[2], outer)]))


polygonized = row_function("string", lambda g: multi(P.polygonize([*Q.parts(g)[1], *(r for q in Q.parts(g)[2] for r in q)])))

# Construction


def buffered(metres: float, steps: int = 32, end: str = "round", join: str = "round", limit: float = 2.0, merge: str = "individual") -> Callable[..., Column]:
    """Geometries of one kind: points, lines or polygons; see planar.buffer for the options."""

    def run(g):
        own = Q.parts(g)
        if sum(map(bool, own)) != 1:
            raise NotApplicable("several kinds, or nothing")
        kind = ("MultiPoint", "MultiLineString", "MultiPolygon")[next(k for k, x in enumerate(own) if x)]
        return multi(P.buffer(kind, next(filter(None, own)), metres, steps, end, join, limit, merge))

    return row_function("string", run)


convex_hull = row_function("string", lambda g: text("Polygon", [h] if (h := P.convex_hull(vertices_of(g))) else None))
oriented_envelope = row_function("string", lambda g: text("Polygon", [h] if (h := P.oriented_envelope(vertices_of(g))) else None))
bounding_radius = row_function("double", lambda g: P.bounding_circle(vertices_of(g))[2])
inscribed_radius = row_function("double", lambda g: inner_pole(g)[2])
pole_of_inaccessibility = row_function("string", lambda g: text("Point", inner_pole(g)[:2]))
point_on_feature = row_function("string", lambda g: text("Point", P.point_on_feature(max(polygons_of(g), key=lambda q: P.multi_area([q])))))


def bounding_circle(steps: int = 64) -> Callable[..., Column]:
    return row_function("string", lambda g: text("Polygon", [P.disc((c := P.bounding_circle(vertices_of(g)))[:2], c[2], c[2], steps)]))


def inscribed_circle(steps: int = 64) -> Callable[..., Column]:
    return row_function("string", lambda g: text("Polygon", [P.disc((c := inner_pole(g))[:2], c[2], c[2], steps)]))


def concave_hull(metres: float) -> Callable[..., Column]:
    return row_function("string", lambda g: multi(P.concave_hull(Q.vertices(g), metres)))


tin = row_function("string", lambda g: text("MultiPolygon", [[t] for t in P.tin([tuple(p) for p in g["coordinates"]])]))
tin_to_point_cloud = row_function("string", lambda g: text("MultiPoint", [tuple(sum(p[d] for p in t[:3]) / 3 for d in range(len(t[0]))) for t in P.tin([tuple(p) for p in g["coordinates"]])]))
tessellated = row_function("string", lambda g: text("MultiPolygon", [[t] for q in Q.parts(g)[2] for t in P.tessellate(q)]))


def voronoi(box: tuple) -> Callable[..., Column]:
    return row_function("string", lambda g: text("MultiPolygon", [[c] for c in P.voronoi(Q.vertices(g), box) if c]))


tangent_points = row_function("string", lambda g, p: text("MultiPoint", P.tangents([[p for q in polygons_of(g) for p in q[0]]], point_of(p))))


def summed(f: Callable) -> Callable:
    """f of every pair of polygons, united."""
    return lambda a, b: multi(P.union_all([x for p in polygons_of(a) for q in polygons_of(b) for x in f(p, q)]))


minkowski_sum, minkowski_difference = (row_function("string", summed(f)) for f in (P.minkowski_sum, P.minkowski_difference))
boundary = row_function("string", lambda g: lines(Q.boundary(g)) if Q.parts(g)[2] else text("MultiPoint", Q.boundary(g)))
polygon_to_lines = row_function("string", lambda g: lines([r for q in Q.parts(g)[2] for r in q]))


def bezier_spline(steps: int = 25) -> Callable[..., Column]:
    return row_function("string", lambda g: lines([P.bezier(line, steps) for line in lines_of(g)]))


def isolines(breaks: list[float]) -> Callable[..., Column]:
    """From a MultiPoint of a full regular grid with heights: a GeoJSON collection, one MultiLineString a break."""

    def run(g):
        pts = sorted(map(tuple, g["coordinates"]), key=lambda p: (p[1], p[0]))
        width = len({p[0] for p in pts})
        found = P.isolines([pts[k : k + width] for k in range(0, len(pts), width)], breaks)
        return json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"break": b}, "geometry": {"type": "MultiLineString", "coordinates": c}} for b, c in found.items()]})

    return row_function("string", run)


# Lines


def simplified(metres: float, high_quality: bool = False) -> Callable[..., Column]:
    def run(g):
        _, own, polygons = Q.parts(g)
        return multi([[P.simplify(r, metres, high_quality) for r in q] for q in polygons]) if polygons else lines([P.simplify(line, metres, high_quality, False) for line in own])

    return row_function("string", run)


def topology_preserved_simplified(metres: float) -> Callable[..., Column]:
    return row_function("string", lambda g: multi([v for q in Q.parts(g)[2] if (v := P.made_valid([P.simplify(r, metres, True) for r in q]))]))


def polygon_hull_simplified(least_area: float) -> Callable[..., Column]:
    return row_function("string", lambda g: multi([[P.visvalingam(r, least_area) for r in q] for q in Q.parts(g)[2]]))


def coverage_simplified(metres: float) -> Callable[..., Column]:
    """Polygons of a MultiPolygon with their shared stretches simplified alike: nodes of the coverage stay."""

    def run(g):
        polygons = Q.parts(g)[2]
        near: dict = {}
        for q in polygons:
            for r in q:
                for a, b in P.edges_of(r):
                    near.setdefault(a, set()).add(b)
                    near.setdefault(b, set()).add(a)
        out = []
        for q in polygons:
            own = []
            for r in q:
                pts = r[:-1]
                fixed = [k for k, p in enumerate(pts) if len(near[p]) > 2] or [pts.index(min(pts))]
                turned = pts[fixed[0] :] + pts[: fixed[0] + 1]
                cuts = sorted({(k - fixed[0]) % len(pts) for k in fixed}) + [len(pts)]
                ring = turned[:1]
                for low, high in zip(cuts, cuts[1:]):
                    part = turned[low : high + 1]
                    forward = part[0] <= part[-1]
                    got = P.douglas_peucker(part if forward else part[::-1], metres / P.METRES_PER_DEGREE) if part[0] != part[-1] else P.simplify(part, metres, True)
                    ring += (got if forward else got[::-1])[1:]
                own.append(ring if len(ring) > 3 else r)
            out.append(own)
        return multi(out)

    return row_function("string", run)


def chunked(metres: float) -> Callable[..., Column]:
    return row_function("string", lambda g: text("MultiLineString", [c for line in Q.parts(g)[1] for c in Q.chunked(line, metres)]))


#: Of one line; null for several, which have no common measure along them.
slice_between = row_function("string", lambda g, ends: text("LineString", Q.slice_between(line_of(g), *Q.vertices(ends)[:2])))


def slice_along(start: float, stop: float) -> Callable[..., Column]:
    return row_function("string", lambda g: text("LineString", Q.slice_along(line_of(g), start, stop)))


def line_split(tolerance: float = 1.0) -> Callable[..., Column]:
    def run(g, other):
        pts = [*Q.parts(other)[0], *Q.touch_points(g, other)]
        return text("MultiLineString", [part for line in lines_of(g) for part in Q.split_at(line, pts, tolerance)])

    return row_function("string", run)


line_merged = row_function("string", lambda g: lines(P.merge_lines(Q.parts(g)[1])))


def offset(metres: float) -> Callable[..., Column]:
    return row_function("string", lambda g: lines([Q.offset(line, metres) for line in Q.parts(g)[1]]))


overlapping_segments = row_function("string", lambda a, b: text("MultiLineString", Q.overlapping_parts(a, b)))
shared_paths = row_function("string", lambda a, b: text("MultiLineString", Q.shared_paths(a, b)))
intersections = row_function("string", lambda a, b: text("MultiPoint", Q.touch_points(a, b)))
frechet = row_function("double", lambda a, b: Q.frechet(vertices_of(a), vertices_of(b)))
distance_along = row_function("double", lambda g, p: Q.distance_along(line_of(g), point_of(p)))
#: The place on a feature that is nearest to a point; the point itself inside a polygon.
nearest_on_feature = row_function("string", lambda g, p: text("Point", Q.nearest_on_feature(g, point_of(p))[1]))
#: Which of many points is nearest to a line (or another feature); of equally near ones the least.
nearest_point_to_line = row_function("string", lambda pts, g: text("Point", min((Q.nearest_on_feature(g, p)[0], p) for p in Q.parts(pts)[0])[1]) if Q.parts(pts)[0] else None)
nearest_distance = row_function("double", lambda g, p: Q.nearest_on_feature(g, point_of(p))[0])


def tile_cover(zoom: int) -> Callable[[Column], Column]:
    """Map tiles that a geometry touches: array of struct(x, y), in order."""
    wide = 1 << zoom

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def ids(geometry: pd.Series) -> pd.Series:
        return pd.Series([None if (g := _load(t)) is None else [x * wide + y for x, y in Q.tile_cover(g, zoom)] for t in geometry], dtype=object)

    return lambda g: F.transform(ids(g), lambda k: F.struct(F.shiftright(k, zoom).cast("int").alias("x"), k.bitwiseAND(F.lit(wide - 1)).cast("int").alias("y")))


def self_overlap_of(g, metres: float) -> float:
    """Length of the segments of a line that lie on an earlier one."""
    segs = [s for line in Q.parts(g)[1] for s in P.edges_of(line)]
    own = [{"type": "LineString", "coordinates": list(s)} for s in segs]
    return sum(Q.haversine(*s) for i, a in enumerate(own) for s in [x for b in own[:i] for x in Q.overlapping_parts(a, b, metres / P.METRES_PER_DEGREE)][:1])


def estimated_overlap(metres: float = 1.0) -> Callable[..., Column]:
    return row_function("double", lambda g: self_overlap_of(g, metres))
