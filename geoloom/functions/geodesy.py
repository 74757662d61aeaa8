"""Geodesy on plain columns: every function takes and returns Column expressions.

Longitudes and latitudes are degrees (EPSG:4326), lengths metres. Nothing here
leaves the JVM, so all of it stays inside whole-stage code generation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radii and circumference in metres, ellipsoid and mercator bounds.
EARTH_RADIUS = 6_371_008.8
EQUATORIAL_RADIUS = 6_378_137.0
EARTH_CIRCUMFERENCE = 40_075_016.6855785
ECCENTRICITY_SQUARED = 0.00669437999014
ORIGIN_SHIFT = 20_037_508.342789244
METRES_PER_DEGREE = 111_325.0
MAX_MERCATOR_LATITUDE = 85.05112877980659

#: Units per metre, and square units per square metre.
UNITS_PER_METRE = {
    "centimeters": 100.0, "degrees": 1.0 / 111_325.0, "feet": 3.28084, "inches": 39.370, "kilometers": 1.0 / 1000.0, "meters": 1.0,
    "miles": 1.0 / 1609.344, "millimeters": 1000.0, "nauticalMiles": 1.0 / 1852.0, "radians": 1.0 / EARTH_RADIUS, "yards": 1.0936,
}
UNITS_PER_SQUARE_METRE = {
    "acres": 0.000247105, "centimeters": 10_000.0, "feet": 10.763910417, "inches": 1550.003100006, "kilometers": 0.000001,
    "meters": 1.0, "miles": 0.000000386, "millimeters": 1_000_000.0, "yards": 1.195990046,
}
SPELLINGS = {"centimetres": "centimeters", "kilometres": "kilometers", "metres": "meters", "millimetres": "millimeters"}


def wrap180(d: Column) -> Column:
    """Degrees folded into [-180, 180)."""
    return F.pmod(d + 180.0, F.lit(360.0)) - 180.0


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Great-circle distance (haversine)."""
    a = F.pow(F.sin(F.radians(y2 - y1) / 2), 2) + F.pow(F.sin(F.radians(x2 - x1) / 2), 2) * F.cos(F.radians(y1)) * F.cos(F.radians(y2))
    return 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)) * EARTH_RADIUS


def distance_by_sine(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The same by arc sine, term by term as sqlgeo.distance, so that distances which rounding alone tells apart are in the same order."""
    square = lambda c: c * c
    a = square(F.sin(F.radians(y2 - y1) / 2)) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * square(F.sin(F.radians(x2 - x1) / 2))
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def planar_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def ecef_distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(sum((q - p) * (q - p) for p, q in zip(a, b)))


def _stretched(y1: Column, y2: Column) -> Column:
    """Difference of isometric latitudes."""
    return F.log(F.tan(F.radians(y2) / 2 + math.pi / 4) / F.tan(F.radians(y1) / 2 + math.pi / 4))


def rhumb_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Length of the line of constant bearing, the short way round."""
    x2 = F.when(x2 - x1 > 180, x2 - 360).when(x1 - x2 > 180, x2 + 360).otherwise(x2)
    dy, dx, psi = F.radians(y2 - y1), F.radians(F.abs(x2 - x1)), _stretched(y1, y2)
    q = F.when(F.abs(psi) > 1e-12, dy / psi).otherwise(F.cos(F.radians(y1)))
    return F.sqrt(dy * dy + q * q * dx * dx) * EARTH_RADIUS


def bearing(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Initial bearing, -180 to 180."""
    dx, p1, p2 = F.radians(x2 - x1), F.radians(y1), F.radians(y2)
    return F.degrees(F.atan2(F.sin(dx) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dx)))


def final_bearing(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Bearing on arrival, 0 to 360."""
    return F.pmod(bearing(x2, y2, x1, y1) + 180.0, F.lit(360.0))


def azimuth(b: Column) -> Column:
    """A bearing as 0 to 360."""
    return F.pmod(b + 360.0, F.lit(360.0))


def angle_between(first: Column, second: Column) -> Column:
    """Turn from one azimuth to another, -180 to 180."""
    return wrap180(second - first)


def rhumb_bearing(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx = F.radians(x2 - x1)
    dx = F.when(dx > math.pi, dx - 2 * math.pi).when(dx < -math.pi, dx + 2 * math.pi).otherwise(dx)
    b = F.pmod(F.degrees(F.atan2(dx, _stretched(y1, y2))) + 360.0, F.lit(360.0))
    return F.when(b > 180, b - 360.0).otherwise(b)


def destination(x: Column, y: Column, metres: Column, bearing_: Column) -> Column:
    """struct(x, y) reached along a great circle."""
    p, t, d = F.radians(y), F.radians(bearing_), metres / EARTH_RADIUS
    y2 = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(t))
    x2 = F.radians(x) + F.atan2(F.sin(t) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(y2))
    return F.struct(F.degrees(x2).alias("x"), F.degrees(y2).alias("y"))


def in_direction_of(x: Column, y: Column, tx: Column, ty: Column, metres: Column) -> Column:
    return destination(x, y, metres, bearing(x, y, tx, ty))


def rhumb_destination(x: Column, y: Column, metres: Column, bearing_: Column) -> Column:
    """struct(x, y) reached on a constant bearing; latitudes past a pole fold back."""
    p, t, d = F.radians(y), F.radians(bearing_), metres / EARTH_RADIUS
    dp = d * F.cos(t)
    p2 = p + dp
    p2 = F.when(p2 > math.pi / 2, math.pi - p2).when(p2 < -math.pi / 2, -math.pi - p2).otherwise(p2)
    psi = F.log(F.tan(p2 / 2 + math.pi / 4) / F.tan(p / 2 + math.pi / 4))
    q = F.when(F.abs(psi) > 1e-11, dp / psi).otherwise(F.cos(p))
    x2 = wrap180(F.degrees(F.radians(x) + d * F.sin(t) / q))
    x2 = F.when(x2 - x > 180, x2 - 360.0).when(x - x2 > 180, x2 + 360.0).otherwise(x2)
    return F.struct(x2.alias("x"), F.degrees(p2).alias("y"))


def midpoint(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """struct(x, y) half-way along the great circle."""
    half = distance(x1, y1, x2, y2) / 2
    return destination(x1, y1, half, bearing(x1, y1, x2, y2))


def normalise(x: Column) -> Column:
    """Longitude within [-180, 180]; values already inside stay."""
    return F.when((x < -180) | (x > 180), wrap180(x)).otherwise(x)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def to_mercator(x: Column, y: Column) -> Column:
    """EPSG:4326 to EPSG:3857."""
    my = F.log(F.tan((90.0 + y) * math.pi / 360.0)) * 180.0 / math.pi * ORIGIN_SHIFT / 180.0
    return F.struct((x * ORIGIN_SHIFT / 180.0).alias("x"), my.alias("y"))


def from_mercator(x: Column, y: Column) -> Column:
    lat = 180.0 / math.pi * (2 * F.atan(F.exp(y / ORIGIN_SHIFT * math.pi)) - math.pi / 2)
    return F.struct((x / ORIGIN_SHIFT * 180.0).alias("x"), lat.alias("y"))


def to_ecef(x: Column, y: Column, z: Column) -> Column:
    """EPSG:4326 with height to EPSG:4978."""
    lam, phi = F.radians(x), F.radians(y)
    n = EQUATORIAL_RADIUS / F.sqrt(1 - ECCENTRICITY_SQUARED * F.sin(phi) * F.sin(phi))
    return F.struct(
        ((n + z) * F.cos(phi) * F.cos(lam)).alias("x"), ((n + z) * F.cos(phi) * F.sin(lam)).alias("y"), ((n * (1 - ECCENTRICITY_SQUARED) + z) * F.sin(phi)).alias("z")
    )


def from_ecef(x: Column, y: Column, z: Column) -> Column:
    """EPSG:4978 to struct(x, y, z) by ten fixed-point steps on the latitude."""
    p = F.sqrt(x * x + y * y)
    start = F.atan2(z, p * (1 - ECCENTRICITY_SQUARED))

    def step(phi: Column, _: Column) -> Column:
        n = EQUATORIAL_RADIUS / F.sqrt(1 - ECCENTRICITY_SQUARED * F.sin(phi) * F.sin(phi))
        return F.atan2(z + ECCENTRICITY_SQUARED * n * F.sin(phi), p)

    phi = F.aggregate(F.sequence(F.lit(1), F.lit(10)), start, step)
    n = EQUATORIAL_RADIUS / F.sqrt(1 - ECCENTRICITY_SQUARED * F.sin(phi) * F.sin(phi))
    return F.struct(F.degrees(F.atan2(y, x)).alias("x"), F.degrees(phi).alias("y"), (p / F.cos(phi) - n).alias("z"))


def metres_to_degrees(metres: Column, latitude: Column) -> Column:
    """struct(x, y): degrees of longitude and latitude that a length spans there."""
    per = EARTH_CIRCUMFERENCE / 360.0
    return F.struct((metres / (per * F.cos(F.radians(latitude)))).alias("x"), (metres / per).alias("y"))


def degrees_to_metres(degrees: Column, latitude: Column) -> Column:
    per = EARTH_CIRCUMFERENCE / 360.0
    return F.struct((degrees * per * F.cos(F.radians(latitude))).alias("x"), (degrees * per).alias("y"))


def unit(name: str) -> str:
    return SPELLINGS.get(name, name)


def convert_length(value: Column, source: str, target: str) -> Column:
    """A non-negative length in another unit; null for negative ones."""
    ratio = UNITS_PER_METRE[unit(target)] / UNITS_PER_METRE[unit(source)]
    return F.when(value >= 0, value * ratio)


def convert_area(value: Column, source: str, target: str) -> Column:
    return F.when(value >= 0, value / UNITS_PER_SQUARE_METRE[unit(source)] * UNITS_PER_SQUARE_METRE[unit(target)])


def metres_per_pixel(zoom: Column, latitude: Column, tile_side: int = 256) -> Column:
    return F.cos(F.radians(latitude)) * EARTH_CIRCUMFERENCE / (F.pow(F.lit(2.0), zoom) * tile_side)


def from_pixel(px: Column, py: Column, zoom: Column, tile_side: int = 256) -> Column:
    """struct(x, y) in degrees of a world pixel."""
    size = F.pow(F.lit(2.0), zoom) * tile_side
    return from_mercator(px / size * 2 * ORIGIN_SHIFT - ORIGIN_SHIFT, ORIGIN_SHIFT - py / size * 2 * ORIGIN_SHIFT)


DMS = r"(\d{1,3})[°\s]+(\d{1,2})['′\s]+([\d.]+)[\"″\s]*\s*([NSns])\s+(\d{1,3})[°\s]+(\d{1,2})['′\s]+([\d.]+)[\"″\s]*\s*([EWew])"


def from_dms(text: Column) -> Column:
    """struct(x, y) of degrees, minutes and seconds such as 48°51'30.5"N 2°21'0"E; null where it isn't one."""
    part = lambda k: F.regexp_extract(text, DMS, k)
    value = lambda k: F.expr("cast(null as double)") if k < 0 else part(k).try_cast("double") + part(k + 1).try_cast("double") / 60.0 + part(k + 2).try_cast("double") / 3600.0
    sign = lambda k, plus: F.when(F.upper(part(k)) == plus, 1.0).otherwise(-1.0)
    return F.when(text.rlike(DMS), F.struct((sign(8, "E") * value(5)).alias("x"), (sign(4, "N") * value(1)).alias("y")))


def from_utm(easting: Column, northing: Column, zone: Column, north: Column) -> Column:
    """struct(x, y) of UTM coordinates, by the usual series on the WGS84 ellipsoid."""
    e2 = ECCENTRICITY_SQUARED
    ep2, k0 = e2 / (1 - e2), 0.9996
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    mu = (northing - F.when(north, 0.0).otherwise(10_000_000.0)) / k0 / (EQUATORIAL_RADIUS * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    phi = mu
    for k, c in ((2, 3 * e1 / 2 - 27 * e1**3 / 32), (4, 21 * e1**2 / 16 - 55 * e1**4 / 32), (6, 151 * e1**3 / 96), (8, 1097 * e1**4 / 512)):
        phi = phi + c * F.sin(k * mu)
    s = 1 - e2 * F.pow(F.sin(phi), 2)
    n, r, t, c = EQUATORIAL_RADIUS / F.sqrt(s), EQUATORIAL_RADIUS * (1 - e2) / F.pow(s, 1.5), F.pow(F.tan(phi), 2), ep2 * F.pow(F.cos(phi), 2)
    d = (easting - 500_000.0) / (n * k0)
    lat = phi - n * F.tan(phi) / r * (
        d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * F.pow(d, 4) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * F.pow(d, 6) / 720
    )
    lon = (d - (1 + 2 * t + c) * F.pow(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * F.pow(d, 5) / 120) / F.cos(phi)
    return F.struct(((zone - 1) * 6 - 177 + F.degrees(lon)).alias("x"), F.degrees(lat).alias("y"))


def plane_z(px: Column, py: Column, a: tuple, b: tuple, c: tuple) -> Column:
    """Height at a point of the plane through three (x, y, z) corners; null outside the triangle."""
    d = (b[1] - c[1]) * (a[0] - c[0]) + (c[0] - b[0]) * (a[1] - c[1])
    u = ((b[1] - c[1]) * (px - c[0]) + (c[0] - b[0]) * (py - c[1])) / d
    v = ((c[1] - a[1]) * (px - c[0]) + (a[0] - c[0]) * (py - c[1])) / d
    w = 1 - u - v
    return F.when((u >= -1e-12) & (v >= -1e-12) & (w >= -1e-12), u * a[2] + v * b[2] + w * c[2])
