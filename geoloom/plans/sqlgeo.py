"""SQL text of the geodesic formulas, for the checks on DuckDB."""

from __future__ import annotations

R = 6371008.8


def rad(e: str) -> str:
    return f"radians({e})"


def distance(x1: str, y1: str, x2: str, y2: str) -> str:
    """Haversine by arc sine."""
    return f"(2 * {R} * asin(least(1.0, sqrt(pow(sin(radians(({y2}) - ({y1})) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians(({x2}) - ({x1})) / 2), 2)))))"


def bearing(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"degrees(atan2(sin(radians(({x2}) - ({x1}))) * cos(radians({y2})), cos(radians({y1})) * sin(radians({y2})) - sin(radians({y1})) * cos(radians({y2})) * cos(radians(({x2}) - ({x1})))))"


def mod360(e: str) -> str:
    return f"(({e}) - 360.0 * floor(({e}) / 360.0))"


def wrap(e: str) -> str:
    return f"({mod360(f'({e}) + 180.0')} - 180.0)"


def dest_lat(y: str, d: str, b: str) -> str:
    return f"degrees(asin(sin(radians({y})) * cos(({d}) / {R}) + cos(radians({y})) * sin(({d}) / {R}) * cos(radians({b}))))"


def dest_lon(x: str, y: str, d: str, b: str) -> str:
    return f"(({x}) + degrees(atan2(sin(radians({b})) * sin(({d}) / {R}) * cos(radians({y})), cos(({d}) / {R}) - sin(radians({y})) * sin(radians({dest_lat(y, d, b)})))))"


def psi(y1: str, y2: str) -> str:
    return f"(ln(tan(pi() / 4 + radians({y2}) / 2)) - ln(tan(pi() / 4 + radians({y1}) / 2)))"


def rhumb_distance(x1: str, y1: str, x2: str, y2: str) -> str:
    dx = f"radians(abs({wrap(f'({x2}) - ({x1})')}))"
    q = f"(CASE WHEN abs({psi(y1, y2)}) > 1e-12 THEN radians(({y2}) - ({y1})) / {psi(y1, y2)} ELSE cos(radians({y1})) END)"
    return f"(sqrt(pow(radians(({y2}) - ({y1})), 2) + pow({q} * {dx}, 2)) * {R})"


def rhumb_bearing(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"degrees(atan2(radians({wrap(f'({x2}) - ({x1})')}), {psi(y1, y2)}))"


def tile_x(x: str, z: int) -> str:
    return f"CAST(greatest(0, least({2**z - 1}, floor((({x}) / 360.0 + 0.5) * {2**z}))) AS INTEGER)"


def tile_y(y: str, z: int) -> str:
    c = f"least(85.05112877980659, greatest(-85.05112877980659, {y}))"
    return f"CAST(greatest(0, least({2**z - 1}, floor((0.5 - ln(tan(pi() / 4 + radians({c}) / 2)) / pi() / 2) * {2**z}))) AS INTEGER)"


def segs(line: str, body: str) -> str:
    """Sum over a line's segments of an expression in a and b."""
    return f"list_sum(list_transform(range(1, len({line})), lambda i: {body.replace('$a', f'{line}[i]').replace('$b', f'{line}[i + 1]')}))"


def line_length(line: str) -> str:
    return segs(line, distance("$a.x", "$a.y", "$b.x", "$b.y"))


def shoelace(line: str) -> str:
    return f"({segs(line, '($a.x * $b.y - $b.x * $a.y)')} / 2)"


def inside(ring: str, x: str, y: str) -> str:
    """Even-odd crossing test."""
    hit = f"(({ring}[i].y > {y}) <> ({ring}[i + 1].y > {y})) AND {x} < ({ring}[i + 1].x - {ring}[i].x) * ({y} - {ring}[i].y) / ({ring}[i + 1].y - {ring}[i].y) + {ring}[i].x"
    return f"(len(list_filter(range(1, len({ring})), lambda i: {hit})) % 2 = 1)"
