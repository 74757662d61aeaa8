"""Queries on points, boxes and tiles: one projection each, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geodesy as G
from geoloom.functions import tiles as T
from geoloom.plans import catalog
from geoloom.plans import sqlgeo as S
from geoloom.plans.layers import points, with_layers

QUERIES: dict = {}
ORACLES: dict = {}

X = lambda: F.col("lon")
Y = lambda: F.col("lat")
PX = lambda: F.lit(10.5)
PY = lambda: F.lit(48.2)
BOX = lambda: tuple(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))
FIXED = lambda: tuple(F.lit(v) for v in (-60.25, -40.5, 55.75, 45.25))


def _row(x: Column, digits: int) -> Column:
    return F.round(x, digits)


def projection(name: str, layer: str, columns: Callable[[], dict[str, Column]], sql: dict[str, str], digits: int = 3, where: tuple[Callable[[], Column], str] | None = None) -> None:
    """Register a query that projects id and columns from a layer; doubles are rounded on both sides."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = points(spark, sf_dir, layer)
        df = df.where(where[0]()) if where else df
        out = df.select("id", *[c.alias(n) for n, c in columns().items()])
        return out.select("id", *[F.round(n, digits).alias(n) if t == "double" else F.col(n) for n, t in out.dtypes[1:]])

    query.__name__ = name
    QUERIES[name] = query
    body = "SELECT id, " + ", ".join(f"{e} AS {n}" for n, e in sql.items()) + f" FROM {layer}" + (f" WHERE {where[1]}" if where else "")
    ORACLES[name] = with_layers(body, layer)


def rounded(e: str, digits: int = 3) -> str:
    return f"round({e}, {digits})"


P = ("lon", "lat", "10.5", "48.2")
projection("distance", "customer_pt", lambda: {"d": G.distance(X(), Y(), PX(), PY())}, {"d": rounded(S.distance(*P))})
projection("rhumb_distance", "customer_pt", lambda: {"d": G.rhumb_distance(X(), Y(), PX(), PY())}, {"d": rounded(S.rhumb_distance(*P))})
projection("bearing", "customer_pt", lambda: {"initial": G.bearing(X(), Y(), PX(), PY()), "arriving": G.final_bearing(X(), Y(), PX(), PY())},
           {"initial": rounded(S.bearing(*P), 6), "arriving": rounded(S.mod360(S.bearing("10.5", "48.2", "lon", "lat") + " + 180.0"), 6)}, 6)
projection("azimuth", "customer_pt", lambda: {"a": G.azimuth(G.bearing(X(), Y(), PX(), PY()))}, {"a": rounded(S.mod360(S.bearing(*P) + " + 360.0"), 6)}, 6)
projection("angle_between", "customer_pt", lambda: {"turn": G.angle_between(G.azimuth(G.bearing(PX(), PY(), X(), Y())), G.azimuth(G.bearing(X(), Y(), F.lit(-40.0), F.lit(12.0))))},
           {"turn": rounded(S.wrap(f"({S.mod360(S.bearing('lon', 'lat', '-40.0', '12.0') + ' + 360.0')}) - ({S.mod360(S.bearing('10.5', '48.2', 'lon', 'lat') + ' + 360.0')})"), 5)}, 5)
projection("rhumb_bearing", "customer_pt", lambda: {"b": G.rhumb_bearing(X(), Y(), PX(), PY())}, {"b": rounded(S.rhumb_bearing(*P), 6)}, 6)
_d = lambda: G.destination(X(), Y(), F.lit(250_000.0), F.lit(37.0))
projection("destination", "customer_pt", lambda: {"x": _d()["x"], "y": _d()["y"]}, {"x": rounded(S.dest_lon("lon", "lat", "250000.0", "37.0"), 7), "y": rounded(S.dest_lat("lat", "250000.0", "37.0"), 7)}, 7)
_d2 = lambda: G.in_direction_of(X(), Y(), PX(), PY(), F.lit(90_000.0))
projection("coordinate_in_direction", "customer_pt", lambda: {"x": _d2()["x"], "y": _d2()["y"]}, {"x": rounded(S.dest_lon("lon", "lat", "90000.0", S.bearing(*P)), 6), "y": rounded(S.dest_lat("lat", "90000.0", S.bearing(*P)), 6)}, 6)
_d3 = lambda: G.rhumb_destination(X(), Y(), F.lit(150_000.0), F.lit(63.0))
_dp = f"(150000.0 / {S.R} * cos(radians(63.0)))"
_y2 = f"degrees(radians(lat) + {_dp})"
projection("rhumb_destination", "customer_pt", lambda: {"x": _d3()["x"], "y": _d3()["y"]},
           {"x": rounded(f"(CASE WHEN lon + degrees(150000.0 / {S.R} * sin(radians(63.0)) / ({_dp} / {S.psi('lat', _y2)})) IS NOT NULL THEN lon + degrees(150000.0 / {S.R} * sin(radians(63.0)) / ({_dp} / {S.psi('lat', _y2)})) END)", 6), "y": rounded(_y2, 6)}, 6,
           (lambda: F.abs(X()) < 170, "abs(lon) < 170"))
_m = lambda: G.midpoint(X(), Y(), PX(), PY())
_half = f"({S.distance(*P)} / 2)"
projection("midpoint", "customer_pt", lambda: {"x": _m()["x"], "y": _m()["y"]}, {"x": rounded(S.dest_lon("lon", "lat", _half, S.bearing(*P)), 5), "y": rounded(S.dest_lat("lat", _half, S.bearing(*P)), 5)}, 5)
_m2 = lambda: G.to_mercator(X(), Y())
projection("project_mercator", "customer_pt", lambda: {"x": _m2()["x"], "y": _m2()["y"]}, {"x": rounded("lon * 20037508.342789244 / 180"), "y": rounded("ln(tan((90 + lat) * pi() / 360)) / pi() * 20037508.342789244")})
_m3 = lambda: G.from_mercator(G.to_mercator(X(), Y())["x"], G.to_mercator(X(), Y())["y"])
projection("unproject_mercator", "customer_pt", lambda: {"x": _m3()["x"], "y": _m3()["y"]}, {"x": rounded("lon", 7), "y": rounded("lat", 7)}, 7)
_e = lambda: G.to_ecef(X(), Y(), F.lit(120.0))
_n = "(6378137.0 / sqrt(1 - 0.00669437999014 * pow(sin(radians(lat)), 2)))"
projection("project_ecef", "customer_pt", lambda: {"x": _e()["x"], "y": _e()["y"], "z": _e()["z"]},
           {"x": rounded(f"({_n} + 120) * cos(radians(lat)) * cos(radians(lon))"), "y": rounded(f"({_n} + 120) * cos(radians(lat)) * sin(radians(lon))"), "z": rounded(f"({_n} * (1 - 0.00669437999014) + 120) * sin(radians(lat))")})
_u = lambda: G.from_ecef(_e()["x"], _e()["y"], _e()["z"])
projection("unproject_ecef", "customer_pt", lambda: {"x": _u()["x"], "y": _u()["y"], "z": _u()["z"]}, {"x": rounded("lon", 6), "y": rounded("lat", 6), "z": "120.0"}, 6)
projection("ecef_distance", "customer_pt", lambda: {"d": G.ecef_distance((_e()["x"], _e()["y"], _e()["z"]), (F.lit(4.2e6), F.lit(1e5), F.lit(4.7e6)))},
           {"d": rounded(f"sqrt(pow(4.2e6 - ({_n} + 120) * cos(radians(lat)) * cos(radians(lon)), 2) + pow(1e5 - ({_n} + 120) * cos(radians(lat)) * sin(radians(lon)), 2) + pow(4.7e6 - ({_n} * (1 - 0.00669437999014) + 120) * sin(radians(lat)), 2))")})
projection("normalise_longitude", "customer_pt", lambda: {"x": G.normalise(X() * 2.5)}, {"x": rounded(f"CASE WHEN abs(lon * 2.5) > 180 THEN {S.wrap('lon * 2.5')} ELSE lon * 2.5 END", 6)}, 6)
projection("clamp_to_world", "customer_pt", lambda: {"x": G.clamp(X() * 1.5, -180.0, 180.0), "y": G.clamp(Y() * 1.5, -90.0, 90.0)}, {"x": rounded("greatest(-180, least(180, lon * 1.5))", 6), "y": rounded("greatest(-90, least(90, lat * 1.5))", 6)}, 6)
_g = lambda: G.metres_to_degrees(F.lit(5000.0), Y())
_h = lambda: G.degrees_to_metres(F.lit(0.25), Y())
projection("degrees_metres", "customer_pt", lambda: {"dx": _g()["x"], "dy": _g()["y"], "mx": _h()["x"], "my": _h()["y"]},
           {"dx": rounded("5000.0 / (40075016.6855785 / 360 * cos(radians(lat)))", 5), "dy": rounded("5000.0 / (40075016.6855785 / 360)", 5), "mx": rounded("0.25 * 40075016.6855785 / 360 * cos(radians(lat))", 5), "my": rounded("0.25 * 40075016.6855785 / 360", 5)}, 5)
projection("convert_units", "customer_pt", lambda: {u: G.convert_length(F.abs(F.col("acctbal")) * 1.0001371, "meters", u) for u in ("feet", "miles", "yards", "inches", "kilometers", "nauticalMiles")},
           {"feet": rounded("abs(acctbal) * 1.0001371 * 3.28084"), "miles": rounded("abs(acctbal) * 1.0001371 / 1609.344"), "yards": rounded("abs(acctbal) * 1.0001371 * 1.0936"), "inches": rounded("abs(acctbal) * 1.0001371 * 39.370"), "kilometers": rounded("abs(acctbal) * 1.0001371 / 1000"), "nauticalMiles": rounded("abs(acctbal) * 1.0001371 / 1852")})
projection("convert_area", "customer_pt", lambda: {u: G.convert_area(F.abs(F.col("acctbal")) * 1.0001371 * 1e4, "meters", u) for u in ("acres", "feet", "yards")},
           {"acres": rounded("abs(acctbal) * 1.0001371 * 1e4 * 0.000247105"), "feet": rounded("abs(acctbal) * 1.0001371 * 1e4 * 10.763910417"), "yards": rounded("abs(acctbal) * 1.0001371 * 1e4 * 1.195990046")})
_p = lambda: G.from_pixel(X() * 100 + 20000, Y() * 100 + 10000, F.lit(8))
projection("pixel_coordinate", "customer_pt", lambda: {"x": _p()["x"], "y": _p()["y"], "mpp": G.metres_per_pixel(F.lit(8), Y())},
           {"x": rounded("(lon * 100 + 20000) / 65536 * 360 - 180", 6), "y": rounded("degrees(2 * atan(exp(pi() * (1 - 2 * (lat * 100 + 10000) / 65536))) - pi() / 2)", 6), "mpp": rounded("cos(radians(lat)) * 40075016.6855785 / 65536", 6)}, 6)
_dms = lambda: F.concat(F.floor(F.abs(Y())).cast("string"), F.lit("°"), F.lit("30'15.5\"N "), F.floor(F.abs(X())).cast("string"), F.lit("°12'45\"W"))
projection("parse_dms", "customer_pt", lambda: {"x": G.from_dms(_dms())["x"], "y": G.from_dms(_dms())["y"]}, {"x": rounded("-(floor(abs(lon)) + 12 / 60.0 + 45 / 3600.0)", 6), "y": rounded("floor(abs(lat)) + 30 / 60.0 + 15.5 / 3600.0", 6)}, 6)
_utm = lambda: G.from_utm(F.lit(500000.0), F.abs(Y()) * 100000, (F.col("id") % 60 + 1).cast("int"), F.lit(True))
projection("parse_utm", "customer_pt", lambda: {"x": _utm()["x"], "south": G.from_utm(F.lit(500000.0), F.lit(10_000_000.0), F.lit(31), F.lit(False))["y"]}, {"x": "round(CAST((id % 60) * 6 - 177 AS DOUBLE), 6)", "south": "0.0"}, 6)
_pz = lambda: G.plane_z(X(), Y(), (F.lit(-170.0), F.lit(-80.0), F.lit(10.0)), (F.lit(170.0), F.lit(-80.0), F.lit(20.0)), (F.lit(0.0), F.lit(84.0), F.lit(60.0)))
_w = "((lat + 80) / 164)"
_v = f"((lon + 170 * (1 - {_w})) / 340)"
projection("planepoint", "customer_pt", lambda: {"z": _pz()}, {"z": rounded(f"CASE WHEN {_v} >= 0 AND 1 - {_v} - {_w} >= 0 AND {_w} >= 0 THEN 10 * (1 - {_v} - {_w}) + 20 * {_v} + 60 * {_w} END", 4)}, 4)

# Tiles
TX = lambda: T.tile_x(X(), 10)
TY = lambda: T.tile_y(Y(), 10)
STX, STY = S.tile_x("lon", 10), S.tile_y("lat", 10)
projection("tile_of_coordinate", "customer_pt", lambda: {"tx": TX(), "ty": TY(), "tms": T.tms_row(TY(), F.lit(10))}, {"tx": STX, "ty": STY, "tms": f"CAST(1023 - {STY} AS INTEGER)"})
projection("tile_quadkey", "customer_pt", lambda: {"key": T.quadkey(TX(), TY(), 10)}, {"key": "concat(" + ", ".join(f"CAST(({STX} >> {k}) % 2 + 2 * (({STY} >> {k}) % 2) AS VARCHAR)" for k in range(9, -1, -1)) + ")"})
_q = lambda: T.from_quadkey(T.quadkey(TX(), TY(), 10))
projection("tile_from_quadkey", "customer_pt", lambda: {"tx": _q()["x"], "ty": _q()["y"], "tz": _q()["z"]}, {"tx": STX, "ty": STY, "tz": "10"})
_s = lambda: T.from_string(F.concat_ws("/", F.lit("10"), TX(), TY()))
projection("tile_from_string", "customer_pt", lambda: {"tx": _s()["x"], "ty": _s()["y"], "tz": _s()["z"], "bad": T.from_string(F.lit("a/1"))["x"].isNull()}, {"tx": STX, "ty": STY, "tz": "10", "bad": "true"})
_b = lambda: T.tile_box(TX(), TY(), F.lit(10))
projection("tile_bounding_box", "customer_pt", lambda: dict(zip(("x1", "y1", "x2", "y2"), _b())),
           {"x1": rounded(f"{STX} / 1024.0 * 360 - 180", 6), "y1": rounded(f"degrees(2 * atan(exp(pi() * (1 - 2 * ({STY} + 1) / 1024.0))) - pi() / 2)", 6), "x2": rounded(f"({STX} + 1) / 1024.0 * 360 - 180", 6), "y2": rounded(f"degrees(2 * atan(exp(pi() * (1 - 2 * {STY} / 1024.0))) - pi() / 2)", 6)}, 6)
_c = lambda: T.tile_centre(TX(), TY(), F.lit(10))
projection("tile_centre", "customer_pt", lambda: {"x": _c()["x"], "y": _c()["y"]}, {"x": rounded(f"({STX} + 0.5) / 1024.0 * 360 - 180", 6), "y": rounded(f"degrees(2 * atan(exp(pi() * (1 - 2 * ({STY} + 0.5) / 1024.0))) - pi() / 2)", 6)}, 6)
_pt = lambda: T.parent(TX(), TY(), F.lit(10))
projection("tile_relations", "customer_pt", lambda: {"px": _pt()["x"], "py": _pt()["y"], "n_children": F.size(T.children(TX(), TY(), F.lit(10))), "n_siblings": F.size(T.siblings(TX(), TY(), F.lit(10))), "n_ancestors": F.size(T.ancestors(TX(), TY(), F.lit(10))),
                                             "n_below": F.size(T.descendants(TX(), TY(), F.lit(10), F.lit(12))), "child_x": T.children(TX(), TY(), F.lit(10))[3]["x"], "top": T.ancestors(TX(), TY(), F.lit(10))[8]["x"]},
           {"px": f"{STX} // 2", "py": f"{STY} // 2", "n_children": "4", "n_siblings": "3", "n_ancestors": "10", "n_below": "16", "child_x": f"2 * {STX} + 1", "top": f"{STX} // 512"})
projection("tile_neighbours", "customer_pt", lambda: {"n": F.size(T.neighbours(TX(), TY(), F.lit(10))), "sum_x": F.aggregate(T.neighbours(TX(), TY(), F.lit(10)), F.lit(0), lambda t, c: t + c["x"])},
           {"n": f"CASE WHEN {STY} IN (0, 1023) THEN 6 ELSE 9 END", "sum_x": f"CAST((({STX} + 1023) % 1024 + {STX} + ({STX} + 1) % 1024) * (CASE WHEN {STY} IN (0, 1023) THEN 2 ELSE 3 END) AS INTEGER)"})
projection("tile_is_ancestor", "customer_pt", lambda: {"yes": T.is_ancestor(F.lit(1), F.lit(1), F.lit(1), TX(), TY(), F.lit(10))}, {"yes": f"{STX} >= 512 AND {STY} >= 512"})
projection("tile_metres_per_pixel", "customer_pt", lambda: {"m": T.tile_metres_per_pixel(TY(), F.lit(10))}, {"m": rounded(f"cos(2 * atan(exp(pi() * (1 - 2 * ({STY} + 0.5) / 1024.0))) - pi() / 2) * 40075016.6855785 / 262144", 6)}, 6)

# Boxes
projection("box_contains_point", "customer_pt", lambda: {"inside": T.box_contains(FIXED(), X(), Y()), "across": T.box_contains((F.lit(150.0), F.lit(-50.0), F.lit(-120.0), F.lit(60.0)), X(), Y())},
           {"inside": "lon BETWEEN -60.25 AND 55.75 AND lat BETWEEN -40.5 AND 45.25", "across": "(lon >= 150 OR lon <= -120) AND lat BETWEEN -50 AND 60"})
projection("box_position", "customer_pt", lambda: {"bits": T.box_position(FIXED(), X(), Y())},
           {"bits": "CASE WHEN lon BETWEEN -60.25 + 116 * 0.35 AND -60.25 + 116 * 0.65 AND lat BETWEEN -40.5 + 85.75 * 0.35 AND -40.5 + 85.75 * 0.65 THEN 1 ELSE (CASE WHEN lat > -40.5 + 85.75 * 0.65 THEN 2 ELSE 0 END) + (CASE WHEN lon > -60.25 + 116 * 0.65 THEN 4 ELSE 0 END) + (CASE WHEN lat < -40.5 + 85.75 * 0.35 THEN 8 ELSE 0 END) + (CASE WHEN lon < -60.25 + 116 * 0.35 THEN 16 ELSE 0 END) + (CASE WHEN lon BETWEEN -60.25 AND 55.75 AND lat BETWEEN -40.5 AND 45.25 THEN 0 ELSE 32 END) END"})
projection("box_intersects", "nation_box", lambda: {"meets": T.boxes_intersect(BOX(), FIXED()), "within": T.box_within(BOX(), FIXED()), "across": T.crosses_antimeridian(BOX())}, {"meets": "xmin <= 55.75 AND xmax >= -60.25 AND ymin <= 45.25 AND ymax >= -40.5", "within": "xmin >= -60.25 AND xmax <= 55.75 AND ymin >= -40.5 AND ymax <= 45.25", "across": "false"})
_i = lambda: T.box_intersection(BOX(), FIXED())
_un = lambda: T.box_union(BOX(), FIXED())
projection("box_algebra", "nation_box", lambda: {"ix": _i()["xmin"], "iy": _i()["ymax"], "ux": _un()["xmax"], "uy": _un()["ymin"], "pad": T.box_padded(BOX(), F.lit(1.5))["xmin"], "sq": T.box_squared(BOX())["ymin"]},
           {"ix": rounded("CASE WHEN xmin <= 55.75 AND xmax >= -60.25 AND ymin <= 45.25 AND ymax >= -40.5 THEN greatest(xmin, -60.25) END"), "iy": rounded("CASE WHEN xmin <= 55.75 AND xmax >= -60.25 AND ymin <= 45.25 AND ymax >= -40.5 THEN least(ymax, 45.25) END"), "ux": rounded("greatest(xmax, 55.75)"), "uy": rounded("least(ymin, -40.5)"), "pad": rounded("xmin - 1.5"), "sq": rounded("ymin - ((xmax - xmin) - (ymax - ymin)) / 2")})
_bc = lambda: T.box_centre(BOX())
projection("center", "nation_box", lambda: {"x": _bc()["x"], "y": _bc()["y"]}, {"x": rounded(S.dest_lon("xmin", "ymin", f"({S.distance('xmin', 'ymin', 'xmax', 'ymax')} / 2)", S.bearing("xmin", "ymin", "xmax", "ymax")), 5), "y": rounded(S.dest_lat("ymin", f"({S.distance('xmin', 'ymin', 'xmax', 'ymax')} / 2)", S.bearing("xmin", "ymin", "xmax", "ymax")), 5)}, 5)
_ct = lambda: T.common_tile(BOX(), 20)
projection("tile_of_box", "nation_box", lambda: {"z": _ct()["z"], "x": _ct()["x"]},
           {"z": "CAST(list_max(list_filter(range(0, 21), lambda k: (" + S.tile_x("xmin", 20) + " >> (20 - k)) = (" + S.tile_x("xmax", 20) + " >> (20 - k)) AND (" + S.tile_y("ymin", 20) + " >> (20 - k)) = (" + S.tile_y("ymax", 20) + " >> (20 - k)))) AS INTEGER)",
            "x": "CAST(" + S.tile_x("xmin", 20) + " >> (20 - list_max(list_filter(range(0, 21), lambda k: (" + S.tile_x("xmin", 20) + " >> (20 - k)) = (" + S.tile_x("xmax", 20) + " >> (20 - k)) AND (" + S.tile_y("ymin", 20) + " >> (20 - k)) = (" + S.tile_y("ymax", 20) + " >> (20 - k))))::INTEGER) AS INTEGER)"})

QUERIES["near_by_tile"] = catalog.flagship
ORACLES["near_by_tile"] = with_layers(f"SELECT {S.tile_x('lon', 5)} AS tx, {S.tile_y('lat', 5)} AS ty, count(*) AS n, round(avg(acctbal), 4) AS avg_acctbal FROM customer_pt WHERE {S.distance(*P)} <= 5000000 GROUP BY 1, 2", "customer_pt")
