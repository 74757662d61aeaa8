"""Queries on irregular kernels; where shapes are rectangles the SQL is their closed form."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import lines as L
from geoloom.functions import shapes as K
from geoloom.kernels import routing
from geoloom.operators.components_kernels import betweenness, per_component
from geoloom.operators.dissolve import dissolved
from geoloom.plans import sqlgeo as S
from geoloom.plans.graph_queries import EDGE_SQL, nation_edges
from geoloom.plans.layers import customer_inner, customer_rings, order_lines, points, with_layers
from geoloom.sources import geojson as J

QUERIES: dict = {}
ORACLES: dict = {}


def box_json(x1, y1, x2, y2) -> Column:
    c = [v if isinstance(v, Column) else F.lit(float(v)) for v in (x1, y1, x2, y2)]
    return J.polygon_json(L.box_ring(*c))


def fixed(g: dict) -> Column:
    return F.lit(json.dumps(g))


def point(x: Column, y: Column) -> Column:
    return J.point_json(x, y)


BOX = lambda: box_json(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")])
OTHER = (-60.25, -40.5, 55.75, 45.25)
LAYERS = {
    "nation_box": lambda s, d: points(s, d, "nation_box").withColumn("g", BOX()),
    "customer_inner": lambda s, d: customer_inner(s, d).withColumn("g", point(F.col("lon"), F.col("lat"))),
    "customer_ring": lambda s, d: customer_rings(s, d).withColumn("g", J.polygon_json(F.col("ring"))),
    "order_line": lambda s, d: order_lines(s, d).withColumn("g", J.line_json(F.col("line"))),
}


def kernel(name: str, layer: str, columns: Callable[[], dict[str, Column]], sql: dict[str, str] | None, digits: int = 4, dealt: bool = False) -> None:
    """dealt: the work is in the kernels, not in bytes, so rows go to as many tasks as there are cores for."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = LAYERS[layer](spark, sf_dir)
        own = own.repartition(4 * spark.sparkContext.defaultParallelism, "id") if dealt else own
        out = own.select("id", *[c.alias(n) for n, c in columns().items()])
        return out.select("id", *[F.round(n, digits).alias(n) if t == "double" else F.col(n) for n, t in out.dtypes[1:]])

    QUERIES[name] = run
    if sql:
        ORACLES[name] = with_layers("SELECT id, " + ", ".join(f"{e} AS {n}" for n, e in sql.items()) + f" FROM {layer}", layer)


def r(e: str, digits: int = 4) -> str:
    return f"round({e}, {digits})"


GEO = lambda: F.col("g")
FIX = lambda: box_json(*OTHER)
OWN = "(xmax - xmin) * (ymax - ymin)"
MEET = "(greatest(0.0, least(xmax, 55.75) - greatest(xmin, -60.25)) * greatest(0.0, least(ymax, 45.25) - greatest(ymin, -40.5)))"
FIXED_AREA = "116.0 * 85.75"
TOUCH = "xmin <= 55.75 AND xmax >= -60.25 AND ymin <= 45.25 AND ymax >= -40.5"
INSIDE = "xmin >= -60.25 AND xmax <= 55.75 AND ymin >= -40.5 AND ymax <= 45.25"
n_of = lambda g: F.size(F.try_variant_get(F.try_parse_json(g), "$.coordinates", "array<variant>"))

kernel("union", "nation_box", lambda: {"a": K.area(K.union(GEO(), FIX()))}, {"a": r(f"{OWN} + {FIXED_AREA} - {MEET}")})
kernel("intersection", "nation_box", lambda: {"a": F.coalesce(K.area(K.intersection(GEO(), FIX())), F.lit(0.0))}, {"a": r(MEET)})
kernel("difference", "nation_box", lambda: {"a": F.coalesce(K.area(K.difference(FIX(), GEO())), F.lit(0.0))}, {"a": r(f"{FIXED_AREA} - {MEET}")})
kernel("symmetric_difference", "nation_box", lambda: {"a": K.area(K.symmetric_difference(GEO(), FIX()))}, {"a": r(f"{OWN} + {FIXED_AREA} - 2 * {MEET}")})
kernel("intersects", "nation_box", lambda: {"yes": K.intersects(GEO(), FIX()), "no": K.is_disjoint(GEO(), FIX())}, {"yes": TOUCH, "no": f"NOT ({TOUCH})"})
kernel("contains", "nation_box", lambda: {"in_fixed": K.contains(FIX(), GEO()), "within": K.is_within(GEO(), FIX()), "covers": K.covers(GEO(), FIX()), "covered": K.covered_by(GEO(), FIX())}, {"in_fixed": INSIDE, "within": INSIDE, "covers": "false", "covered": INSIDE})
kernel("is_overlapping", "nation_box", lambda: {"yes": K.is_overlapping(GEO(), FIX())}, {"yes": f"{MEET} > 0 AND NOT ({INSIDE})"})
kernel("touches", "nation_box", lambda: {"beside": K.touches(GEO(), box_json(F.col("xmax"), F.col("ymin"), F.col("xmax") + 3.0, F.col("ymax"))), "over": K.touches(GEO(), box_json(F.col("xmax") - 1.0, F.col("ymin"), F.col("xmax") + 3.0, F.col("ymax")))}, {"beside": "true", "over": "false"})
_through = lambda: J.line_json(F.array(L.xy(F.col("xmin") - 1, F.col("ymin") + 2), L.xy(F.col("xmax") + 1, F.col("ymin") + 3)))
_inner = lambda: J.line_json(F.array(L.xy(F.col("xmin") + 1, F.col("ymin") + 2), L.xy(F.col("xmax") - 1, F.col("ymin") + 3)))
kernel("crosses", "nation_box", lambda: {"through": K.crosses(_through(), GEO()), "inside": K.crosses(_inner(), GEO())}, {"through": "true", "inside": "false"})
kernel("clipped", "nation_box", lambda: {"a": F.coalesce(K.area(K.clipped(OTHER)(GEO())), F.lit(0.0))}, {"a": r(MEET)})
_two = lambda: F.format_string('{"type":"MultiPolygon","coordinates":[%s,%s]}', F.get_json_object(BOX(), "$.coordinates"), F.get_json_object(box_json(F.col("xmin") + 10, F.col("ymin") + 5, F.col("xmax") + 10, F.col("ymax") + 5), "$.coordinates"))
kernel("unary_union", "nation_box", lambda: {"a": K.area(K.unary_union(_two())), "valid": K.coverage_is_valid(_two())}, {"a": r(f"2 * {OWN} - (xmax - xmin - 10) * (ymax - ymin - 5)"), "valid": "false"})
_tiles = lambda: F.format_string('{"type":"MultiPolygon","coordinates":[%s,%s]}', F.get_json_object(BOX(), "$.coordinates"), F.get_json_object(box_json(F.col("xmax"), F.col("ymin"), F.col("xmax") + 4, F.col("ymax")), "$.coordinates"))
kernel("coverage_union", "nation_box", lambda: {"a": K.area(K.coverage_union(_tiles())), "valid": K.coverage_is_valid(_tiles())}, {"a": r("(xmax + 4 - xmin) * (ymax - ymin)"), "valid": "true"})
kernel("mask", "nation_box", lambda: {"a": K.area(K.mask()(GEO()))}, {"a": r(f"64800 - {OWN}")})
_bow = lambda: J.polygon_json(F.array(L.xy(F.col("xmin"), F.col("ymin")), L.xy(F.col("xmax"), F.col("ymax")), L.xy(F.col("xmax"), F.col("ymin")), L.xy(F.col("xmin"), F.col("ymax")), L.xy(F.col("xmin"), F.col("ymin"))))
kernel("kinks", "nation_box", lambda: {"n": n_of(K.kinks(_bow())), "none": K.kinks(GEO()).isNull()}, {"n": "1", "none": "true"})
kernel("unkinked", "nation_box", lambda: {"n": n_of(K.unkinked(_bow())), "a": K.area(K.unkinked(_bow()))}, {"n": "2", "a": r(f"{OWN} / 2", 2)}, 2)
kernel("made_valid", "nation_box", lambda: {"a": K.area(K.made_valid(_bow()))}, {"a": r(f"{OWN} / 4")})
_far = lambda: box_json(F.lit(170.0), F.col("ymin"), F.lit(-170.0), F.col("ymax"))
kernel("cut_at_antimeridian", "nation_box", lambda: {"n": n_of(K.cut_at_antimeridian(_far())), "a": K.area(K.cut_at_antimeridian(_far()))}, {"n": "2", "a": r("20 * (ymax - ymin)")})
kernel("polygonized", "nation_box", lambda: {"n": n_of(K.polygonized(_two())), "a": K.area(K.polygonized(_two()))}, {"n": "3", "a": r(f"2 * {OWN} - (xmax - xmin - 10) * (ymax - ymin - 5)")})
kernel("convex_hull", "customer_ring", lambda: {"a": K.area(K.convex_hull(GEO())), "holds": K.contains(K.convex_hull(GEO()), GEO())}, None)
kernel("convex_hull_box", "nation_box", lambda: {"a": K.area(K.convex_hull(GEO()))}, {"a": r(OWN)})
kernel("oriented_envelope", "nation_box", lambda: {"a": K.area(K.oriented_envelope(GEO()))}, {"a": r(OWN)})
kernel("minimum_bounding_circle", "nation_box", lambda: {"radius": K.bounding_radius(GEO()), "ring": F.coalesce(n_of(K.bounding_circle()(GEO())), F.lit(0))}, {"radius": r("sqrt(pow(xmax - xmin, 2) + pow(ymax - ymin, 2)) / 2"), "ring": "1"})
kernel("maximum_inscribed_circle", "nation_box", lambda: {"radius": K.inscribed_radius(GEO()), "ring": n_of(K.inscribed_circle()(GEO()))}, {"radius": r("least(xmax - xmin, ymax - ymin) / 2", 0), "ring": "1"}, 0)
kernel("pole_of_inaccessibility", "nation_box", lambda: {"y": F.get_json_object(K.pole_of_inaccessibility(GEO()), "$.coordinates[1]").cast("double")}, {"y": r("(ymin + ymax) / 2", 0)}, 0)
kernel("point_on_feature", "nation_box", lambda: {"x": F.get_json_object(K.point_on_feature(GEO()), "$.coordinates[0]").cast("double")}, {"x": r("(xmin + xmax) / 2")})
kernel("tessellated", "customer_ring", lambda: {"n": n_of(K.tessellated(GEO())), "a": K.area(K.tessellated(GEO()))}, {"n": "6", "a": r(f"abs({S.shoelace('ring')})")})
_corners = lambda: F.format_string('{"type":"MultiPoint","coordinates":[[%s,%s,1],[%s,%s,2],[%s,%s,3],[%s,%s,4],[%s,%s,5]]}', *[F.col(c) for c in ("xmin", "ymin", "xmax", "ymin", "xmax", "ymax", "xmin", "ymax")], (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2)
kernel("tin", "nation_box", lambda: {"n": n_of(K.tin(_corners())), "cloud": n_of(K.tin_to_point_cloud(_corners())), "a": K.area(K.tin(_corners()))}, {"n": "4", "cloud": "4", "a": r(OWN)})
kernel("concave_hull", "nation_box", lambda: {"all": K.area(K.concave_hull(9e6)(_corners())), "none": K.concave_hull(10.0)(_corners()).isNull()}, {"all": r(OWN), "none": "true"})
kernel("voronoi", "nation_box", lambda: {"n": n_of(K.voronoi((-180, -90, 180, 90))(_corners())), "a": K.area(K.voronoi((-180, -90, 180, 90))(_corners()))}, {"n": "5", "a": "64800.0"})
kernel("polygon_tangents", "nation_box", lambda: {"n": n_of(K.tangent_points(GEO(), point(F.col("xmax") + 5, F.col("ymin") - 5))), "inside": K.tangent_points(GEO(), point(F.col("xmin") + 1, F.col("ymin") + 1)).isNull()}, {"n": "2", "inside": "true"})
_unit = lambda: box_json(0.0, 0.0, 1.0, 2.0)
kernel("minkowski_sum", "nation_box", lambda: {"a": K.area(K.minkowski_sum(GEO(), _unit())), "d": K.area(K.minkowski_difference(GEO(), _unit()))}, {"a": r("(xmax - xmin + 1) * (ymax - ymin + 2)"), "d": r("(xmax - xmin + 1) * (ymax - ymin + 2)")})
kernel("polygon_to_line", "nation_box", lambda: {"n": n_of(K.polygon_to_lines(GEO())), "b": n_of(K.boundary(GEO()))}, {"n": "5", "b": "5"})
kernel("buffered_point", "customer_inner", lambda: {"a": K.area(K.buffered(10_000, 128)(GEO())) * 111.325 * 111.325 * F.cos(F.radians("lat"))}, {"a": "round(128 / 2.0 * 100 * sin(2 * pi() / 128), 2)"}, 2)
_flat = lambda: J.line_json(F.array(L.xy(F.col("lon"), F.lit(0.0)), L.xy(F.col("lon") + 1, F.lit(0.0))))
kernel("buffered_line", "customer_inner", lambda: {"butt": K.area(K.buffered(1000, end="butt")(_flat())) * 111.325**2, "square": K.area(K.buffered(1000, end="square")(_flat())) * 111.325**2}, {"butt": "round(2 * 111.325, 3)", "square": "round(2 * 113.325, 3)"}, 3)
_low = lambda: box_json(F.col("lon"), -0.5, F.col("lon") + 1, 0.7)
kernel("buffered_inset", "customer_inner", lambda: {"smaller": K.area(K.buffered(-5000)(_low())), "gone": K.buffered(-90_000)(_low()).isNull(), "round_grows": K.area(K.buffered(5000)(_low())) > 1.2, "bevel": K.area(K.buffered(5000, join="bevel")(_low())) < K.area(K.buffered(5000, 64)(_low()))}, {"smaller": "round((1 - 10 / 111.325) * (1.2 - 10 / 111.325), 3)", "gone": "true", "round_grows": "true", "bevel": "true"}, 3, dealt=True)
kernel("bezier_spline", "order_line", lambda: {"n": n_of(K.bezier_spline(10)(GEO())), "x0": F.get_json_object(K.bezier_spline(10)(GEO()), "$.coordinates[10][0]").cast("double")}, {"n": "CAST(10 * (len(line) - 1) + 1 AS INTEGER)", "x0": r("line[2].x")})
_grid = json.dumps({"type": "MultiPoint", "coordinates": [[x, y, x * 1.0] for x in range(6) for y in range(6)]})
kernel("isolines", "nation_box", lambda: {"x": F.get_json_object(K.isolines([2.5])(F.lit(_grid)), "$.features[0].geometry.coordinates[0][0][0]").cast("double"), "b": F.get_json_object(K.isolines([2.5])(F.lit(_grid)), "$.features[0].properties.break").cast("double")}, {"x": "2.5", "b": "2.5"})
kernel("simplified", "order_line", lambda: {"n_same": n_of(K.simplified(0.001, True)(GEO())), "n_ends": n_of(K.simplified(5e8, True)(GEO()))}, {"n_same": "CAST(len(line) AS INTEGER)", "n_ends": "2"})
kernel("simplified_ring", "customer_ring", lambda: {"less": K.area(K.simplified(20_000)(GEO())) > 0, "hull": K.area(K.polygon_hull_simplified(0.3)(GEO())) > 0, "valid": K.area(K.topology_preserved_simplified(20_000)(GEO())) > 0}, {"less": "true", "hull": "true", "valid": "true"})
kernel("coverage_simplified", "nation_box", lambda: {"a": K.area(K.coverage_simplified(100.0)(_tiles()))}, {"a": r("(xmax + 4 - xmin) * (ymax - ymin)")})
kernel("chunked", "order_line", lambda: {"n": n_of(K.chunked(1_000_000)(GEO()))}, {"n": f"CAST(greatest(1, ceil({S.line_length('line')} / 1000000)) AS INTEGER)"})
kernel("slice_along", "order_line", lambda: {"x": F.get_json_object(K.slice_along(0, 1e12)(GEO()), "$.coordinates[0][0]").cast("double"), "n": n_of(K.slice_along(0, 1e12)(GEO()))}, {"x": r("line[1].x"), "n": "CAST(len(line) AS INTEGER)"})
_ends = lambda: F.format_string('{"type":"MultiPoint","coordinates":[[%s,%s],[%s,%s]]}', F.col("line")[0]["x"], F.col("line")[0]["y"], F.element_at("line", -1)["x"], F.element_at("line", -1)["y"])
kernel("line_slice", "order_line", lambda: {"n": n_of(K.slice_between(GEO(), _ends()))}, {"n": "CAST(len(line) AS INTEGER)"})
_at = lambda: point(F.col("line")[1]["x"], F.col("line")[1]["y"])
kernel("line_split", "order_line", lambda: {"n": n_of(K.line_split()(GEO(), _at()))}, {"n": "CASE WHEN len(line) > 2 THEN 2 ELSE 1 END"})
_half = lambda: point((F.col("line")[0]["x"] + F.col("line")[1]["x"]) / 2, (F.col("line")[0]["y"] + F.col("line")[1]["y"]) / 2)
kernel("distance_along", "order_line", lambda: {"d": K.distance_along(GEO(), _half())}, {"d": r(S.distance("line[1].x", "line[1].y", "(line[1].x + line[2].x) / 2", "(line[1].y + line[2].y) / 2"), 2)}, 2)
kernel("line_offset", "nation_box", lambda: {"y": F.get_json_object(K.offset(111_325.0)(J.line_json(F.array(L.xy(F.col("xmin"), F.col("ymin")), L.xy(F.col("xmax"), F.col("ymin"))))), "$.coordinates[0][1]").cast("double")}, {"y": r("ymin - 1")})
_edge = lambda: J.line_json(F.array(L.xy(F.col("xmin") + 1, F.col("ymin")), L.xy(F.col("xmax") + 9, F.col("ymin"))))
kernel("overlapping_segments", "nation_box", lambda: {"n": n_of(K.overlapping_segments(GEO(), _edge())), "x": F.get_json_object(K.shared_paths(_edge(), GEO()), "$.coordinates[0][1][0]").cast("double")}, {"n": "1", "x": r("xmax")})
_folded = lambda: J.line_json(F.array(L.xy(F.col("xmin"), F.lit(0.0)), L.xy(F.col("xmin") + 2, F.lit(0.0)), L.xy(F.col("xmin") + 1, F.lit(0.0))))
kernel("estimated_overlap", "nation_box", lambda: {"m": K.estimated_overlap()(_folded())}, {"m": f"round(radians(1.0) * {S.R}, 2)"}, 2)
_joined = lambda: F.format_string('{"type":"MultiLineString","coordinates":[[[0,0],[1,1]],[[2,0],[1,1]],[[5,5],[6,%s]]]}', F.col("ymin"))
kernel("line_merged", "nation_box", lambda: {"n": n_of(K.line_merged(_joined()))}, {"n": "2"})
kernel("intersections", "nation_box", lambda: {"n": n_of(K.intersections(GEO(), _through()))}, {"n": "2"})
kernel("frechet", "order_line", lambda: {"same": K.frechet(GEO(), GEO()), "m": K.frechet(J.line_json(F.concat(F.slice("line", 1, 1), F.slice("line", 1, 1))), GEO())}, {"same": "0.0", "m": r(f"list_max(list_transform(line, lambda c: {S.distance('line[1].x', 'line[1].y', 'c.x', 'c.y')}))", 2)}, 2)
kernel("nearest_on_feature", "nation_box", lambda: {"inside": K.nearest_distance(GEO(), point(F.col("xmin") + 1, F.col("ymin") + 1)), "south": K.nearest_distance(GEO(), point(F.col("xmin") + 1, F.col("ymin") - 1))}, {"inside": "0.0", "south": f"round(radians(1.0) * {S.R}, 2)"}, 2)

# Codecs
kernel("wkb_round_trip", "customer_inner", lambda: {"x": F.get_json_object(J.from_wkb(J.to_wkb(GEO())), "$.coordinates[0]").cast("double"), "big": F.get_json_object(J.from_wkb(J.to_wkb_big_endian(GEO())), "$.coordinates[1]").cast("double"), "srid": F.hex(F.substring(J.to_ewkb(GEO()), 6, 4)), "n": F.length(J.to_wkb(GEO()))}, {"x": r("lon"), "big": r("lat"), "srid": "'E6100000'", "n": "21"})
kernel("wkt_round_trip", "customer_ring", lambda: {"n": n_of(J.from_wkt(J.to_wkt(GEO()))), "a": K.area(J.from_wkt(J.to_wkt(GEO())))}, {"n": "1", "a": r(f"abs({S.shoelace('ring')})")})
kernel("wkt_point", "customer_inner", lambda: {"x": J.point_from_wkt(F.format_string("POINT (%s %s)", "lon", "lat"))["x"], "bad": J.point_from_wkt(F.lit("LINESTRING(0 0,1 1)")).isNull()}, {"x": r("lon"), "bad": "true"})
kernel("wkt_line", "order_line", lambda: {"n": n_of(J.from_wkt(L.wkt_line(F.col("line"))))}, {"n": "CAST(len(line) AS INTEGER)"})
kernel("twkb_decode", "nation_box", lambda: {"y": F.get_json_object(J.from_twkb(F.unhex(F.lit("02000202020808"))), "$.coordinates[1][1]").cast("double")}, {"y": "5.0"})
kernel("polyline_round_trip", "order_line", lambda: {"x": F.get_json_object(J.from_polyline(J.to_polyline(GEO())), "$.coordinates[1][0]").cast("double"), "n": n_of(J.from_polyline(J.to_polyline(GEO())))}, {"x": r("line[2].x"), "n": "CAST(len(line) AS INTEGER)"})
kernel("sniffed_geometry", "customer_inner", lambda: {"text": F.get_json_object(J.from_any_text(J.to_wkt(GEO())), "$.type"), "hex": F.get_json_object(J.from_any_text(F.hex(J.to_wkb(GEO()))), "$.type"), "bytes": F.get_json_object(J.from_any_bytes(J.to_wkb(GEO())), "$.type"), "json": F.get_json_object(J.from_any_text(GEO()), "$.type")}, {"text": "'Point'", "hex": "'Point'", "bytes": "'Point'", "json": "'Point'"})


def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature collection written as text and read back."""
    rows = customer_inner(spark, sf_dir).select(F.col("id").alias("feature_index"), point(F.col("lon"), F.col("lat")).alias("geometry"), F.parse_json(F.to_json(F.struct("segment", "nation"))).alias("properties"))
    back = J.features_of(J.collection(rows))
    return J.read_type(back, "Point").select(F.col("feature_index").cast("int").alias("feature_index"), F.try_variant_get("properties", "$.segment", "string").alias("segment"), F.round(F.get_json_object("geometry", "$.coordinates[0]").cast("double"), 4).alias("x"))


QUERIES["geojson_features"] = geojson_features
ORACLES["geojson_features"] = with_layers("SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS feature_index, segment, round(lon, 4) AS x FROM customer_inner", "customer_inner")


def dissolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dissolved(points(spark, sf_dir, "nation_box").select("region", BOX().alias("geometry")), "region")
    return out.select("region", F.round(K.area("geometry"), 4).alias("a"))


QUERIES["dissolve"] = dissolve
ORACLES["dissolve"] = with_layers(f"SELECT region, round(sum({OWN}), 4) AS a FROM nation_box GROUP BY region", "nation_box")


# Graph kernels on the nation network


def graph(name: str, f, schema: str, sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return per_component(nation_edges(spark, sf_dir), f, schema)

    QUERIES[name] = run
    if sql:
        ORACLES[name] = f"WITH {EDGE_SQL.strip()}, walk AS (WITH RECURSIVE w(node, d, hops) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS DOUBLE), 0 UNION SELECT twoway.dst, w.d + twoway.weight, w.hops + 1 FROM w JOIN twoway ON twoway.src = w.node WHERE w.hops < 9) SELECT * FROM w) {sql}"


_FAR = "SELECT node AS target, min(d) AS length FROM walk WHERE node > 0 GROUP BY node"


def _routes(finder):
    return lambda g: [(int(t), float(routing.length(g, p))) for t in sorted(g) if t > 0 and 0 in g and (p := finder(g, 0, t))]


graph("graph_dijkstra", _routes(routing.shortest_path), "target long, length double", _FAR)
graph("graph_a_star", _routes(lambda g, s, t: routing.shortest_path(g, s, t, estimate=lambda v: 0.0 if v == t else 1.0)), "target long, length double", _FAR)
graph("graph_bidirectional", _routes(routing.bidirectional_path), "target long, length double", _FAR)
graph("graph_via_contraction", _routes(routing.path_via_contraction), "target long, length double", _FAR)
graph("graph_multi_criteria", lambda g: [(int(t), float(len(p) - 1)) for t in sorted(g) if t > 0 and 0 in g and (p := routing.shortest_path(g, 0, t, cost=lambda a, b, w: 1.0))], "target long, length double", "SELECT node AS target, CAST(min(hops) AS DOUBLE) AS length FROM walk WHERE node > 0 GROUP BY node")
graph("graph_k_shortest", lambda g: [(k, float(routing.length(g, p))) for k, p in enumerate(routing.k_shortest_paths(g, 0, 7, 4))] if 0 in g and 7 in g else [], "k int, length double")
graph("graph_dfs", lambda g: [(k, int(v)) for k, v in enumerate(routing.depth_first(g, min(g)))], "place int, node long")
graph("graph_strong_components", lambda g: [(k, int(v)) for k, part in enumerate(routing.strongly_connected(g)) for v in part], "part int, node long")
graph("graph_bridges", lambda g: [(int(a), int(b)) for a, b in sorted(routing.low_links(g)[0])], "src long, dst long")
graph("graph_articulation_points", lambda g: [(int(v),) for v in sorted(routing.low_links(g)[1])], "node long")
graph("graph_contracted", lambda g: [(int(a), int(b), float(w)) for a, row in sorted(routing.contracted(g)[0].items()) for b, w in sorted(row.items()) if a < b], "src long, dst long, weight double")
graph("graph_cycles", lambda g: [(k, len(c) - 1) for k, c in enumerate(routing.cycles(g, min(g), 6))], "k int, nodes int")
graph("graph_postman", lambda g: [(k, int(v)) for k, v in enumerate(routing.postman_tour(g))], "place int, node long")
graph("graph_eulerian_path", lambda g: [(k, int(v)) for k, v in enumerate(routing.eulerian_path(g))], "place int, node long")
graph("graph_tour", lambda g: [(k, int(v)) for k, v in enumerate(routing.salesperson_tour(g, sorted(g)[:6]))], "place int, node long")


def graph_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return betweenness(nation_edges(spark, sf_dir)).select("node", F.round("centrality", 6).alias("centrality"))


QUERIES["graph_betweenness"] = graph_betweenness
