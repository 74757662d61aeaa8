"""Queries on concave shapes, checked point by point.

Two star-shaped rings lie across each other around every inner customer point
(star_pair). A result of an overlay, hull or buffer is checked by how many points
of a lattice it holds, against an even-odd test in SQL; hulls, circles and
envelopes by their closed forms over all pairs and triples of vertices.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import lines as L
from geoloom.functions import shapes as K
from geoloom.functions import tiles as T
from geoloom.kernels import predicates as Q
from geoloom.operators import spatial
from geoloom.operators.dissolve import dissolved
from geoloom.plans import sqlgeo as S
from geoloom.plans.layers import ALL_SQL, NEEDS, customer_inner, points, with_layers
from geoloom.sources import geojson as J

QUERIES: dict = {}
ORACLES: dict = {}

#: Lattice around each point: steps to either side, and their width.
STEPS, WIDTH = 7, 0.293


def _vertex(k: str, n: int, seed: int, x: str, y: str) -> tuple[str, str]:
    radius = f"(0.5 + ((id * {seed} + ({k} % {n}) * 37) % 41) / 20.0)"
    angle = f"radians(({k} % {n}) * {360 / n!r} + 11.3)"
    return f"({x} + {radius} * cos({angle}))", f"({y} + {radius} * sin({angle}))"


def _ring_sql(n: int, seed: int, dx: float, dy: float) -> str:
    x, y = _vertex("k", n, seed, f"(lon + {dx})", f"(lat + {dy})")
    return f"list_transform(range(0, {n + 1}), lambda k: {{'x': {x}, 'y': {y}}})"


def _ring(n: int, seed: int, dx: float, dy: float) -> Column:
    x, y = _vertex("k", n, seed, f"(lon + {dx}D)", f"(lat + {dy}D)")
    return F.expr(f"transform(sequence(0, {n}), k -> named_struct('x', {x}, 'y', {y}))")


A, B = (9, 31, 0.0, 0.0), (7, 53, 0.71, -0.37)
#: A ring that crosses itself: the vertices of the first, taken in another order.
ORDER = (0, 4, 1, 6, 3, 8, 2, 7, 5, 0)
ALL_SQL["star_pair"] = (
    f"SELECT *, list_transform([{', '.join(map(str, ORDER))}], lambda k: a[k + 1]) AS knot FROM (SELECT id, lon, lat, nation, {_ring_sql(*A)} AS a, {_ring_sql(*B)} AS b FROM customer_inner)"
)
NEEDS["star_pair"] = ["customer_pt", "customer_inner"]


def star_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lon, lat, nation, a, b (rings of nine and seven vertices), knot (crosses itself), their GeoJSON ga, gb, gk, and the lattice."""
    own = customer_inner(spark, sf_dir).select("id", "lon", "lat", "nation").withColumn("a", _ring(*A)).withColumn("b", _ring(*B))
    own = own.withColumn("knot", F.transform(F.array(*map(F.lit, ORDER)), lambda k: F.element_at("a", k + 1)))
    own = own.select("*", lattice().alias("lattice"), J.polygon_json(F.col("a")).alias("ga"), J.polygon_json(F.col("b")).alias("gb"), J.polygon_json(F.col("knot")).alias("gk"))
    # The work is in the kernels, not in bytes, so the tasks are as many as there are cores for and not as few as the bytes fill.
    return own.repartition(4 * spark.sparkContext.defaultParallelism, "id")


def lattice() -> Column:
    """A MultiPoint around lon, lat."""
    at = F.expr(f"flatten(transform(sequence(-{STEPS}, {STEPS}), i -> transform(sequence(-{STEPS}, {STEPS}), j -> array(lon + i * {WIDTH}D, lat + j * {WIDTH}D))))")
    return F.to_json(F.struct(F.lit("MultiPoint").alias("type"), at.alias("coordinates")))


LATTICE = f"flatten(list_transform(range(-{STEPS}, {STEPS + 1}), lambda i: list_transform(range(-{STEPS}, {STEPS + 1}), lambda j: {{'x': lon + i * {WIDTH}, 'y': lat + j * {WIDTH}}})))"
#: How many points of a MultiPoint a geometry holds.
held = K.row_function("double", lambda pts, g: float(Q.held_points(g, Q.parts(pts)[0]).sum()))


def holds(g: Column) -> Column:
    return F.coalesce(held(F.col("lattice"), g), F.lit(0.0)).cast("int")


def counted(condition: str) -> str:
    """Lattice points p that a condition holds for."""
    return f"CAST(len(list_filter({LATTICE}, lambda p: {condition})) AS INTEGER)"


IN = {ring: S.inside(ring, "p.x", "p.y") for ring in ("a", "b", "knot")}


def shape(name: str, columns, sql: dict[str, str], more: str = "", source: str = "star_pair", layers: tuple = ("star_pair",)) -> None:
    QUERIES[name] = lambda spark, sf_dir: star_pair(spark, sf_dir).select("id", *[c.alias(n) for n, c in columns().items()])
    ORACLES[name] = with_layers("SELECT id, " + ", ".join(f"{e} AS {n}" for n, e in sql.items()) + f" FROM {source}", *layers, more=more)


GA, GB, GK = (lambda: F.col("ga")), (lambda: F.col("gb")), (lambda: F.col("gk"))
OPS = {"union": "{a} OR {b}", "intersection": "{a} AND {b}", "difference": "{a} AND NOT {b}", "symmetric_difference": "({a}) <> ({b})"}
shape("star_overlay", lambda: {op: holds(getattr(K, op)(GA(), GB())) for op in OPS}, {op: counted(t.format(**IN)) for op, t in OPS.items()})
_both = lambda: F.format_string('{"type":"MultiPolygon","coordinates":[%s,%s]}', F.get_json_object(GA(), "$.coordinates"), F.get_json_object(GB(), "$.coordinates"))
shape("star_unary_union", lambda: {"n": holds(K.unary_union(_both())), "a": F.round(K.area(K.union(GA(), GB())) + K.area(K.intersection(GA(), GB())), 5)}, {"n": counted(OPS["union"].format(**IN)), "a": f"round({S.shoelace('a')} + {S.shoelace('b')}, 5)"})
shape("knot_unkinked", lambda: {"n": holds(K.unkinked(GK())), "some": holds(K.made_valid(GK())) <= holds(K.unkinked(GK()))}, {"n": counted(IN["knot"]), "some": "true"})
shape("star_clipped", lambda: {"n": holds(K.clipped((-60.25, -40.5, 55.75, 45.25))(GA()))}, {"n": counted(IN["a"] + " AND p.x BETWEEN -60.25 AND 55.75 AND p.y BETWEEN -40.5 AND 45.25")})

_PROPER = "(({r}[i + 1].x - {r}[i].x) * ({s}[j].y - {r}[i].y) - ({r}[i + 1].y - {r}[i].y) * ({s}[j].x - {r}[i].x) > 0) <> (({r}[i + 1].x - {r}[i].x) * ({s}[j + 1].y - {r}[i].y) - ({r}[i + 1].y - {r}[i].y) * ({s}[j + 1].x - {r}[i].x) > 0)"
_CROSSING = _PROPER.format(r="a", s="b") + " AND " + _PROPER.replace("[i", "[@").replace("[j", "[i").replace("[@", "[j").format(r="b", s="a")
CROSSINGS = f"list_sum(list_transform(range(1, 10), lambda i: len(list_filter(range(1, 8), lambda j: {_CROSSING}))))"
ALL_IN = f"len(list_filter(b, lambda v: {S.inside('a', 'v.x', 'v.y')}))"
NONE_IN = f"len(list_filter(a, lambda v: {S.inside('b', 'v.x', 'v.y')}))"
_REL = f"rel AS (SELECT *, {CROSSINGS} AS cuts, {ALL_IN} AS b_in_a, {NONE_IN} AS a_in_b FROM star_pair)"
_small = lambda: J.polygon_json(F.transform("b", lambda v: L.xy(F.col("lon") + (v["x"] - F.col("lon") - B[2]) * 0.2, F.col("lat") + (v["y"] - F.col("lat") - B[3]) * 0.2)))
shape(
    "star_relations",
    lambda: {"meet": K.intersects(GA(), GB()), "apart": K.is_disjoint(GA(), GB()), "holds": K.contains(GA(), GB()), "within": K.is_within(GA(), GB()), "overlap": K.is_overlapping(GA(), GB()), "points": F.coalesce(F.size(F.try_variant_get(F.try_parse_json(K.intersections(GA(), GB())), "$.coordinates", "array<variant>")), F.lit(0)), "small": K.contains(GA(), _small())},
    {"meet": "cuts > 0 OR b_in_a > 0 OR a_in_b > 0", "apart": "NOT (cuts > 0 OR b_in_a > 0 OR a_in_b > 0)", "holds": "cuts = 0 AND b_in_a = 8", "within": "cuts = 0 AND a_in_b = 10", "overlap": "cuts > 0", "points": "CAST(cuts AS INTEGER)",
     "small": f"len(list_filter(range(1, 8), lambda j: NOT {S.inside('a', 'lon + (b[j].x - lon - 0.71) * 0.2', 'lat + (b[j].y - lat + 0.37) * 0.2')})) = 0 AND list_sum(list_transform(range(1, 10), lambda i: len(list_filter(range(1, 8), lambda j: {_CROSSING.replace('b[j].x', '(lon + (b[j].x - lon - 0.71) * 0.2)').replace('b[j + 1].x', '(lon + (b[j + 1].x - lon - 0.71) * 0.2)').replace('b[j].y', '(lat + (b[j].y - lat + 0.37) * 0.2)').replace('b[j + 1].y', '(lat + (b[j + 1].y - lat + 0.37) * 0.2)')})))) = 0"},
    _REL, "rel",
)

# Hulls, envelopes and circles of all sixteen vertices, from pairs (u, v) with every other vertex on the left, and from triples.
_PTS = "pts AS (SELECT id, lon, lat, unnest(list_concat(a[1:9], b[1:7])) AS p, unnest(range(0, 16)) AS k FROM star_pair)"
_HULL = (
    _PTS + ", side AS (SELECT u.id, u.p AS u, v.p AS v FROM pts u JOIN pts v ON u.id = v.id AND u.k <> v.k JOIN pts w ON w.id = u.id GROUP BY u.id, u.p, v.p"
    " HAVING min((v.p.x - u.p.x) * (w.p.y - u.p.y) - (v.p.y - u.p.y) * (w.p.x - u.p.x)) >= -1e-9)"
)
QUERIES["star_hull"] = lambda spark, sf_dir: star_pair(spark, sf_dir).select("id", F.round(K.area(K.convex_hull(_both())), 5).alias("area"), (F.size(F.try_variant_get(F.try_parse_json(K.convex_hull(_both())), "$.coordinates[0]", "array<variant>")) - 1).alias("corners"))
ORACLES["star_hull"] = with_layers("SELECT id, round(sum(u.x * v.y - v.x * u.y) / 2, 5) AS area, CAST(count(*) AS INTEGER) AS corners FROM side GROUP BY id", "star_pair", more=_HULL)
_ALONG = "(w.p.x * (v.x - u.x) + w.p.y * (v.y - u.y))"
_ACROSS = "(w.p.y * (v.x - u.x) - w.p.x * (v.y - u.y))"
_ENVELOPE = _HULL + f", boxes AS (SELECT side.id, (max({_ALONG}) - min({_ALONG})) * (max({_ACROSS}) - min({_ACROSS})) / (pow(v.x - u.x, 2) + pow(v.y - u.y, 2)) AS area FROM side JOIN pts w ON w.id = side.id GROUP BY side.id, u, v)"
QUERIES["star_envelope"] = lambda spark, sf_dir: star_pair(spark, sf_dir).select("id", F.round(K.area(K.oriented_envelope(_both())), 5).alias("area"))
ORACLES["star_envelope"] = with_layers("SELECT id, round(min(area), 5) AS area FROM boxes GROUP BY id", "star_pair", more=_ENVELOPE)
_D2 = lambda p, q: f"(pow({p}.p.x - {q}.p.x, 2) + pow({p}.p.y - {q}.p.y, 2))"
_CIRCLE = (
    _PTS + f", sides AS (SELECT s.id, {_D2('s', 't')} AS c2, {_D2('s', 'r')} AS b2, {_D2('t', 'r')} AS a2, abs((t.p.x - s.p.x) * (r.p.y - s.p.y) - (t.p.y - s.p.y) * (r.p.x - s.p.x)) AS twice FROM pts s JOIN pts t ON s.id = t.id AND s.k < t.k JOIN pts r ON r.id = s.id AND t.k < r.k)"
    ", least_circle AS (SELECT id, CASE WHEN 2 * greatest(a2, b2, c2) >= a2 + b2 + c2 OR twice < 1e-12 THEN sqrt(greatest(a2, b2, c2)) / 2 ELSE sqrt(a2 * b2 * c2) / (2 * twice) END AS radius FROM sides)"
)
QUERIES["star_circle"] = lambda spark, sf_dir: star_pair(spark, sf_dir).select("id", F.round(K.bounding_radius(_both()), 5).alias("radius"))
ORACLES["star_circle"] = with_layers("SELECT id, round(max(radius), 5) AS radius FROM least_circle GROUP BY id", "star_pair", more=_CIRCLE)

# Buffers: of the lattice points that are clearly nearer or farther than the distance, those inside. The frame is the buffer's own.
_REACH = 60_000.0
_KX = "(111325.0 * cos(radians(list_avg(list_transform(a, lambda v: v.y)))))"
_T = "greatest(0.0, least(1.0, ((p.x - a[i].x) * (a[i + 1].x - a[i].x) * kx * kx + (p.y - a[i].y) * (a[i + 1].y - a[i].y) * 111325.0 * 111325.0) / (pow((a[i + 1].x - a[i].x) * kx, 2) + pow((a[i + 1].y - a[i].y) * 111325.0, 2))))"
_OFF = f"sqrt(pow((a[i].x + {_T} * (a[i + 1].x - a[i].x) - p.x) * kx, 2) + pow((a[i].y + {_T} * (a[i + 1].y - a[i].y) - p.y) * 111325.0, 2))"
_NEAR = f"list_min(list_transform(range(1, 10), lambda i: {_OFF}))"


def _clear(lattice: dict, polygon: dict) -> str:
    """The lattice points that are clearly nearer to a ring or farther from it than _REACH."""
    ring = np.array(polygon["coordinates"][0])
    scale = np.array([111_325.0 * np.cos(np.radians(ring[:, 1].mean())), 111_325.0])
    a, d = ring[None, :-1] * scale, np.diff(ring, axis=0)[None] * scale
    p = np.array(lattice["coordinates"])[:, None] * scale - a
    t = np.clip((p * d).sum(axis=2) / (d * d).sum(axis=2), 0.0, 1.0)
    away = np.sqrt(np.square(p - t[:, :, None] * d).sum(axis=2).min(axis=1))
    clear = np.abs(away - _REACH) > 0.02 * _REACH
    return json.dumps({"type": "MultiPoint", "coordinates": [q for q, yes in zip(lattice["coordinates"], clear.tolist()) if yes]})


clear_points = K.row_function("string", _clear)


def buffered_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clear points in the buffer of each ring's line, of the polygon, and in the polygon's inset."""
    own = star_pair(spark, sf_dir).withColumn("clear", clear_points(F.col("lattice"), GA()))
    n = lambda g: F.coalesce(held(F.col("clear"), g), F.lit(0.0)).cast("int")
    line = J.line_json(F.col("a"))
    return own.select("id", n(K.buffered(_REACH)(line)).alias("line"), n(K.buffered(_REACH)(GA())).alias("polygon"), n(K.buffered(-_REACH)(GA())).alias("inset"))


_CLEAR = f"abs({_NEAR} - {_REACH}) > {0.02 * _REACH}"
QUERIES["buffered_star"] = buffered_star
ORACLES["buffered_star"] = with_layers(
    f"SELECT id, {counted(f'{_CLEAR} AND {_NEAR} < {_REACH}')} AS line, {counted(f'{_CLEAR} AND ({_NEAR} < {_REACH} OR {IN['a']})')} AS polygon, {counted(f'{_CLEAR} AND {_NEAR} > {_REACH} AND {IN['a']}')} AS inset FROM framed",
    "star_pair", more=f"framed AS (SELECT *, {_KX} AS kx FROM star_pair)",
)


def corner_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of a right-angled line's buffer by join, near the equator where the frame is square."""
    line = J.line_json(F.array(L.xy(F.lit(0.0), F.lit(-0.2)), L.xy(F.lit(0.0), F.lit(0.0)), L.xy(F.col("s"), F.lit(0.0))))
    own = spark.range(1).select(F.lit(0.2).alias("s"))
    size = lambda join: F.round(K.area(K.buffered(1000, 256, end="butt", join=join)(line)) * 111.325**2 * F.cos(F.radians(F.lit(0.2 / 3))), 2)
    return own.select(size("miter").alias("miter"), size("bevel").alias("bevel"), size("round").alias("round"))


QUERIES["corner_joins"] = corner_joins
_STRIPS = "0.2 * 111.325 * (1 + cos(radians(0.2 / 3))) * 2 - 1"
ORACLES["corner_joins"] = f"SELECT round({_STRIPS} + 1, 2) AS miter, round({_STRIPS} + 0.5, 2) AS bevel, round({_STRIPS} + pi() / 4, 2) AS round"


#: Groups that the customers of a nation are dealt to.
SHARES = 16


def dissolve_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping stars of each nation united: lattice points of its own customers that the union holds."""
    own = star_pair(spark, sf_dir)
    united = dissolved(own.where("nation is not null").select("nation", F.col("ga").alias("geometry")), "nation")
    # A nation's union goes to SHARES groups of its customers once each, not to every row, and lattices in strips to the edges beside them.
    keyed = own.where("nation is not null").select("nation", F.pmod("id", F.lit(SHARES)).alias("share"), "lattice")
    parts = united.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
    kind = own.schema["nation"].dataType.simpleString()

    def count(lattices: pd.DataFrame, unions: pd.DataFrame) -> pd.DataFrame:
        if lattices.empty or unions.empty:
            return pd.DataFrame({"nation": [], "n": []})
        polygons = [q for t in unions["geometry"] if t is not None for q in Q.parts(json.loads(t))[2]]
        n, texts = 0, lattices["lattice"].tolist()
        for k in range(0, len(texts), 2000):
            pts = np.array([p for t in texts[k : k + 2000] for p in json.loads(t)["coordinates"]])
            n += int(Q.held_by_disjoint(polygons, pts).sum())
        return pd.DataFrame({"nation": [lattices["nation"].iloc[0]], "n": [n]})

    counted = keyed.groupBy("nation", "share").cogroup(parts.groupBy("nation", "share")).applyInPandas(count, f"nation {kind}, n long")
    return counted.groupBy("nation").agg(F.sum("n").cast("long").alias("n"))


QUERIES["dissolve_stars"] = dissolve_stars
ORACLES["dissolve_stars"] = with_layers(
    f"SELECT nation, CAST(count(*) AS BIGINT) AS n FROM (SELECT id, nation, unnest({LATTICE}) AS p FROM star_pair WHERE nation IS NOT NULL) q"
    f" WHERE EXISTS (SELECT 1 FROM star_pair s WHERE s.nation = q.nation AND abs(s.lon - q.p.x) < 2.6 AND abs(s.lat - q.p.y) < 2.6 AND {S.inside('s.a', 'q.p.x', 'q.p.y')}) GROUP BY nation",
    "star_pair",
)


def shapes_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars and nation boxes that meet."""
    left = star_pair(spark, sf_dir).select(F.col("id").alias("lid"), F.col("ga").alias("left_shape"), L.bounds(F.col("a")).alias("left_box"))
    boxes = points(spark, sf_dir, "nation_box").withColumn("ring", L.box_ring(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]))
    right = boxes.select(F.col("id").alias("rid"), J.polygon_json(F.col("ring")).alias("right_shape"), L.bounds(F.col("ring")).alias("right_box"))
    return spatial.shapes_join(left, right).select(F.col("lid").alias("id"), F.col("rid").alias("box"))


_BOX_CUT = " OR ".join(
    f"((a[i].{u} - b.{e}) * (a[i + 1].{u} - b.{e}) < 0 AND a[i].{v} + (b.{e} - a[i].{u}) / (a[i + 1].{u} - a[i].{u}) * (a[i + 1].{v} - a[i].{v}) BETWEEN b.{v}min AND b.{v}max)"
    for u, v, e in (("x", "y", "xmin"), ("x", "y", "xmax"), ("y", "x", "ymin"), ("y", "x", "ymax"))
)
QUERIES["shapes_join"] = shapes_join
ORACLES["shapes_join"] = with_layers(
    f"SELECT s.id, b.id AS box FROM star_pair s JOIN nation_box b ON abs(s.lon - (b.xmin + b.xmax) / 2) < 28 AND abs(s.lat - (b.ymin + b.ymax) / 2) < 14 WHERE (s.lon BETWEEN b.xmin AND b.xmax AND s.lat BETWEEN b.ymin AND b.ymax)"
    f" OR len(list_filter(range(1, 10), lambda i: {_BOX_CUT})) > 0",
    "star_pair", "nation_box",
)

# Across the antimeridian: rings as wide as before around points near 180 degrees.


def antimeridian_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers inside rings that straddle the antimeridian, by cells of five degrees."""
    own = points(spark, sf_dir, "nation_box").select("id", F.col("ymin"), F.col("ymax"))
    x = lambda v: F.when(v > 180, v - 360).otherwise(v)
    west, east = 172.0 + F.col("id") % 7, 183.5 + F.col("id") % 11
    ring = F.array(L.xy(x(west), F.col("ymin")), L.xy(x(east), F.col("ymin")), L.xy(x(east + 2.3), F.col("ymax")), L.xy(x(west - 1.7), F.col("ymax")), L.xy(x(west), F.col("ymin")))
    rings = own.select(F.col("id").alias("box"), ring.alias("ring"))
    return spatial.points_in_polygons(points(spark, sf_dir, "customer_pt"), rings).select("id", "box")


_X = "(CASE WHEN p.lon < 0 THEN p.lon + 360 ELSE p.lon END)"
_UP = "((p.lat - b.ymin) / (b.ymax - b.ymin))"
QUERIES["antimeridian_join"] = antimeridian_join
ORACLES["antimeridian_join"] = with_layers(f"SELECT p.id, b.id AS box FROM customer_pt p JOIN nation_box b ON p.lat BETWEEN b.ymin AND b.ymax AND {_X} BETWEEN 172.0 + b.id % 7 - 1.7 * {_UP} AND 183.5 + b.id % 11 + 2.3 * {_UP}", "customer_pt", "nation_box")


def tile_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of zoom 5 that each nation's box touches."""
    own = points(spark, sf_dir, "nation_box").withColumn("g", J.polygon_json(L.box_ring(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")])))
    return own.select("id", F.explode(K.tile_cover(5)(F.col("g"))).alias("t")).select("id", "t.x", "t.y")


QUERIES["tile_cover"] = tile_cover
ORACLES["tile_cover"] = with_layers(f"SELECT id, x, unnest(range({S.tile_y('ymax', 5)}, {S.tile_y('ymin', 5)} + 1))::INTEGER AS y FROM (SELECT *, unnest(range({S.tile_x('xmin', 5)}, {S.tile_x('xmax', 5)} + 1))::INTEGER AS x FROM nation_box)", "nation_box")


def nearest_point_to_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which vertex of the second ring is nearest to the meridian line west of it."""
    line = J.line_json(F.array(L.xy(F.col("lon") - 4, F.lit(-89.0)), L.xy(F.col("lon") - 4, F.lit(89.0))))
    pts = F.to_json(F.struct(F.lit("MultiPoint").alias("type"), F.transform("b", lambda v: F.array(v["x"], v["y"])).alias("coordinates")))
    near = K.nearest_point_to_line(pts, line)
    return star_pair(spark, sf_dir).select("id", F.round(F.get_json_object(near, "$.coordinates[0]").cast("double"), 6).alias("x"))


QUERIES["nearest_point_to_line"] = nearest_point_to_line
ORACLES["nearest_point_to_line"] = with_layers(f"SELECT id, round(list_aggregate(list_transform(b, lambda v: {{'d': {S.distance('v.x', 'v.y', 'lon - 4', 'v.y')}, 'x': v.x}}), 'min').x, 6) AS x FROM star_pair", "star_pair")
