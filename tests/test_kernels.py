"""Geometry, codec and graph kernels against closed forms, sampling and exhaustive search."""

import itertools
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.kernels import codecs as C
from geoloom.kernels import planar as P
from geoloom.kernels import predicates as Q
from geoloom.kernels import routing as R


def box(x, y, w, h):
    return [[(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]]


small = st.integers(0, 8)
side = st.integers(1, 6)


@settings(max_examples=60, deadline=None)
@given(small, small, side, side, small, small, side, side)
def test_overlay_of_boxes(ax, ay, aw, ah, bx, by, bw, bh):
    a, b = box(ax, ay, aw, ah), box(bx, by, bw, bh)
    both = max(0, min(ax + aw, bx + bw) - max(ax, bx)) * max(0, min(ay + ah, by + bh) - max(ay, by))
    want = {"union": aw * ah + bw * bh - both, "intersection": both, "difference": aw * ah - both, "xor": aw * ah + bw * bh - 2 * both}
    for op, area in want.items():
        assert math.isclose(P.multi_area(P.overlay([a], [b], op)), area, abs_tol=1e-6)


def star(r, n, x, y, size=1.0):
    return P.closed([(x + size * (0.3 + r.random()) * math.cos(2 * math.pi * k / n), y + size * (0.3 + r.random()) * math.sin(2 * math.pi * k / n)) for k in range(n)])


def test_overlay_of_stars():
    """A thousand pairs of concave polygons, some with holes, some with shared edges: areas add up, and the union is found."""
    for seed in range(1000):
        r = random.Random(seed)
        a, b = ([P.oriented(star(r, r.choice((5, 9, 17)), r.uniform(-0.5, 0.5), r.uniform(-0.5, 0.5)))] for _ in range(2))
        if seed % 3 == 0:
            a.append(P.oriented(star(r, 5, *P.centroid(a[0]), 0.05), False))
        if seed % 5 == 0:
            b = [[*a[0][:3], *b[0][:3], a[0][0]]]
        own, other = P.multi_area(P.unkinked(a)), P.multi_area(P.unkinked(b))
        union, both, less, xor = (P.multi_area(P.overlay([a], [b], op)) for op in ("union", "intersection", "difference", "xor"))
        assert abs(union + both - own - other) < 1e-7 and abs(less + both - own) < 1e-7 and abs(xor + both - union) < 1e-7, seed


def test_corner_joins_and_the_antimeridian():
    k = P.METRES_PER_DEGREE
    line = [(0.0, -0.1), (0.0, 0.0), (0.1, 0.0)]
    strips = 2 * 0.1 * k * 1000 * 2 - 1000**2
    for join, more in (("miter", 1.0), ("bevel", 0.5)):
        got = P.multi_area(P.buffer("LineString", line, 1000, 64, "butt", join)) * k * k
        assert math.isclose(got, strips + more * 1000**2, rel_tol=1e-4)
    far = P.buffer("LineString", [(179.9, 0.0), (-179.9, 0.0)], 10_000)
    assert len(far) == 2 and all(abs(x) <= 180 for g in far for ring in g for x, _ in ring)
    assert len(P.buffer("MultiPoint", [(0, 0), (0.1, 0)], 10_000)) == 2 and len(P.buffer("MultiPoint", [(0, 0), (0.1, 0)], 10_000, merge="overlapping")) == 1


@pytest.mark.parametrize("seed", range(30))
def test_tile_cover(seed):
    """Every sampled inner point's tile is there, and every other tile is passed by an edge; also across the antimeridian."""
    r = random.Random(seed)
    zoom, n = r.choice((3, 5, 6)), 9
    ring = star(r, n, r.uniform(-150, 175), r.uniform(-50, 50), 20)
    got = set(Q.tile_cover({"type": "Polygon", "coordinates": [[((x + 180) % 360 - 180, y) for x, y in ring]]}, zoom))
    tile = lambda p: (math.floor(Q.tile_point(p, zoom)[0]) % 2**zoom, math.floor(Q.tile_point(p, zoom)[1]))
    inner = {tile(p) for p in ((r.uniform(min(a[0] for a in ring), max(a[0] for a in ring)), r.uniform(min(a[1] for a in ring), max(a[1] for a in ring))) for _ in range(4000)) if P.in_ring(p, ring)}
    passed = {(x % 2**zoom, y) for a, b in P.edges_of(ring) for x, y in Q.tiles_along(Q.tile_point(a, zoom), Q.tile_point(b, zoom))}
    assert inner <= got and passed <= got
    if zoom < 6:
        assert got <= inner | passed


def test_union_with_holes():
    ring = P.overlay([box(0, 0, 10, 10)], [box(3, 3, 2, 2)], "difference")
    assert len(ring) == 1 and len(ring[0]) == 2 and math.isclose(P.multi_area(ring), 96)


def test_triangulations():
    r = random.Random(1)
    pts = [(r.random(), r.random()) for _ in range(150)]
    hull = P.convex_hull(pts)
    triangles = P.delaunay(pts)
    assert math.isclose(sum(abs(P.cross(*(pts[k] for k in t))) / 2 for t in triangles), P.area(hull), rel_tol=1e-9)
    assert math.isclose(sum(P.area(c) for c in P.voronoi(pts, (0, 0, 1, 1))), 1, rel_tol=1e-9)
    assert math.isclose(sum(abs(P.area(t)) for t in P.tessellate([box(0, 0, 10, 10)[0], box(3, 3, 2, 2)[0], box(6, 6, 1, 1)[0]])), 95)


def test_buffers_and_sums():
    k = P.METRES_PER_DEGREE / 1000
    assert math.isclose(P.multi_area(P.buffer("Point", (0, 0), 1000, 64)) * k * k, math.pi, rel_tol=2e-3)
    assert math.isclose(P.multi_area(P.buffer("Polygon", box(0, 0, 0.1, 0.1), -1000)) * k * k, (0.1 * k - 2) ** 2, rel_tol=1e-3)
    assert math.isclose(P.multi_area(P.minkowski_sum(box(0, 0, 2, 2), box(0, 0, 1, 1))), 9)
    assert P.bounding_circle([(0, 0), (2, 0), (1, 1)]) == pytest.approx((1, 0, 1))


def test_lines():
    bow = [(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]
    assert P.kinks(bow) == [(1, 1)] and len(P.unkinked([bow])) == 2
    assert len(P.polygonize([box(0, 0, 2, 2)[0], [(1, -1), (1, 3)], [(5, 5), (6, 6)]])) == 2
    assert P.cut_line_at_antimeridian([(170, 0), (-170, 10)]) == [[(170, 0), (180, 5)], [(-180, 5), (-170, 10)]]
    line = [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)]
    assert math.isclose(sum(Q.length(c) for c in Q.chunked(line, 50_000)), Q.length(line), rel_tol=1e-9)
    assert len(Q.split_at(line, [(0.5, 0.0), (1.5, 0.0)])) == 3
    assert math.isclose(Q.frechet([(0, 0), (1, 0)], [(0, 1), (1, 1)], math.dist), 1)


def test_relations():
    g = lambda c: {"type": "Polygon", "coordinates": c}
    a, b, inner = g(box(0, 0, 4, 4)), g(box(4, 0, 2, 2)), g(box(1, 1, 1, 1))
    assert Q.touches(a, b) and Q.intersects(a, b) and not Q.overlaps(a, b) and not Q.touches(a, inner)
    assert Q.contains(a, inner) and not Q.contains(inner, a) and Q.overlaps(a, g(box(2, 2, 4, 4)))
    holed = g([box(0, 0, 10, 10)[0], box(4, 4, 2, 2)[0]])
    assert not Q.contains(holed, g(box(3, 3, 4, 4))) and Q.disjoint(holed, g(box(4.5, 4.5, 1, 1)))
    line = {"type": "LineString", "coordinates": [(-1, 1), (5, 1)]}
    assert Q.crosses(line, a) and not Q.crosses({"type": "LineString", "coordinates": [(1, 1), (2, 2)]}, a)


coordinate = st.floats(-179, 179, allow_nan=False).map(lambda v: round(v, 6))
position = st.tuples(coordinate, coordinate).map(list)


@settings(max_examples=60, deadline=None)
@given(st.one_of(
    position.map(lambda c: {"type": "Point", "coordinates": c}),
    st.lists(position, min_size=2, max_size=6).map(lambda c: {"type": "LineString", "coordinates": c}),
    st.lists(position, min_size=1, max_size=4).map(lambda c: {"type": "MultiPoint", "coordinates": c}),
    st.lists(st.lists(position, min_size=4, max_size=5), min_size=1, max_size=2).map(lambda c: {"type": "Polygon", "coordinates": c}),
))
def test_codecs_round_trip(g):
    assert C.parse_wkt(C.write_wkt(g)) == g
    for little, srid in itertools.product((True, False), (None, 4326)):
        assert C.parse_wkb(C.write_wkb(g, little, srid)) == g
    assert C.sniff(C.write_wkb(g).hex()) == g and C.sniff(C.write_wkt(g)) == g


def test_codec_details():
    assert C.decode_polyline("_p~iF~ps|U_ulLnnqC_mqNvxq`@") == [[-120.2, 38.5], [-120.95, 40.7], [-126.453, 43.252]]
    assert C.parse_twkb(bytes.fromhex("02000202020808")) == {"type": "LineString", "coordinates": [[1.0, 1.0], [5.0, 5.0]]}
    assert C.parse_wkt("SRID=3857;POINT(111319.49079327358 0)")["coordinates"] == pytest.approx([1, 0])
    assert C.parse_wkt("POINT ZM (1 2 3 4)")["coordinates"] == [1, 2, 3, 4] and C.parse_wkt("POINT M (1 2 3)")["coordinates"] == [1, 2, None, 3]
    for bad in ("POINT(1)", "BLOB(1 2)", "POINT(1 2"):
        with pytest.raises((ValueError, IndexError)):
            C.parse_wkt(bad)


@pytest.mark.parametrize("seed", range(12))
def test_routes_and_structure(seed):
    r = random.Random(seed)
    edges = [(a, b, float(r.randint(1, 9))) for a in range(8) for b in range(a) if r.random() < 0.4]
    g = R.adjacency(edges)
    for s, t in itertools.product(g, g):
        found = [R.shortest_path(g, s, t), R.bidirectional_path(g, s, t), R.path_via_contraction(g, s, t)]
        assert len({bool(p) for p in found}) == 1
        if found[0]:
            assert len({R.length(g, p) for p in found}) == 1
    parts = lambda h: len(R.strongly_connected(h))
    bridges, joints = R.low_links(g)
    for a, b, _ in edges:
        h = R.adjacency([e for e in edges if e[:2] != (a, b)])
        for v in g:
            h.setdefault(v, {})
        assert ((min(a, b), max(a, b)) in bridges) == (parts(h) > parts(g))
    if parts(g) == 1 and g:
        tour = R.postman_tour(g)
        assert tour[0] == tour[-1] and {frozenset(e) for e in zip(tour, tour[1:])} == {frozenset(e[:2]) for e in edges}


def test_betweenness_of_a_chain():
    g = R.adjacency([(k, k + 1, 1.0) for k in range(4)])
    total: dict = {}
    for v in g:
        for u, x in R.betweenness_from(g, v).items():
            total[u] = total.get(u, 0) + x / 2
    assert [total[v] for v in range(5)] == [0, 3, 4, 3, 0]
