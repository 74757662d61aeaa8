"""WKT, WKB, TWKB and polyline codecs on GeoJSON-like dicts. Positions are [x, y], [x, y, z] or [x, y, z, m]."""

from __future__ import annotations

import math
import re
import struct

NAMES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
CODES = {v: k for k, v in NAMES.items()}
TRIANGLE = 17


def depth(kind: str) -> int:
    """Levels of nesting of a type's coordinates."""
    return {"Point": 0, "LineString": 1, "MultiPoint": 1, "Polygon": 2, "MultiLineString": 2, "MultiPolygon": 3}[kind]


def map_positions(c, levels: int, f):
    return f(c) if levels == 0 else [map_positions(x, levels - 1, f) for x in c]


def transformed(g: dict, f) -> dict:
    """The geometry with f applied to every position."""
    if g["type"] == "GeometryCollection":
        return {**g, "geometries": [transformed(m, f) for m in g["geometries"]]}
    return {**g, "coordinates": map_positions(g["coordinates"], depth(g["type"]), f)}


def to_mercator(p):
    s = 20037508.342789244
    return [p[0] * s / 180, math.log(math.tan((90 + p[1]) * math.pi / 360)) / math.pi * s, *p[2:]]


def from_mercator(p):
    s = 20037508.342789244
    return [p[0] / s * 180, math.degrees(2 * math.atan(math.exp(p[1] / s * math.pi)) - math.pi / 2), *p[2:]]


def reproject(g: dict, source: int, target: int) -> dict:
    mercator = {3857, 102100, 102113, 900913, 3587, 3785, 41001, 54004}
    source, target = (3857 if s in mercator else s for s in (source, target))
    if source == target or 0 in (source, target):
        return g
    return transformed(g, to_mercator if target == 3857 else from_mercator)


# WKT

_TOKEN = re.compile(r"\s*([A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),;=])")


def parse_wkt(text: str, target: int = 4326) -> dict:
    """SRID=n; prefixes, Z, M and ZM, empty geometries, both ways to write a MULTIPOINT, LINEARRING and TRIANGLE."""
    tokens = _TOKEN.findall(text)
    at, srid = 0, 4326
    if tokens[:2] and tokens[0].upper() == "SRID":
        srid, at = int(tokens[2]), 4
    names = {n.upper(): n for n in CODES} | {"LINEARRING": "LineString", "TRIANGLE": "Polygon"}

    def expect(ch):
        nonlocal at
        if at >= len(tokens) or tokens[at] != ch:
            raise ValueError(f"expected {ch} in WKT")
        at += 1

    def position(dims):
        nonlocal at
        own = []
        while at < len(tokens) and tokens[at] not in "(),":
            own.append(float(tokens[at]))
            at += 1
        if len(own) < 2:
            raise ValueError("a position needs two numbers")
        return [own[0], own[1], None, own[2]] if dims == "M" and len(own) == 3 else own

    def listed(item):
        nonlocal at
        expect("(")
        out = [item()]
        while tokens[at] == ",":
            at += 1
            out.append(item())
        expect(")")
        return out

    def geometry():
        nonlocal at
        word = tokens[at].upper()
        at += 1
        dims = ""
        for suffix in ("ZM", "Z", "M"):
            if word not in names and word.endswith(suffix) and word[: -len(suffix)] in names:
                word, dims = word[: -len(suffix)], suffix
                break
        if word not in names:
            raise ValueError(f"unknown WKT type {word}")
        if at < len(tokens) and tokens[at].upper() in ("Z", "M", "ZM"):
            dims = tokens[at].upper()
            at += 1
        kind = names[word]
        if at < len(tokens) and tokens[at].upper() == "EMPTY":
            at += 1
            return {"type": kind, "geometries" if kind == "GeometryCollection" else "coordinates": []}
        one = lambda: position(dims)
        if kind == "Point":
            return {"type": kind, "coordinates": listed(one)[0]}
        if kind == "MultiPoint":
            return {"type": kind, "coordinates": listed(lambda: listed(one)[0] if tokens[at] == "(" else one())}
        if kind == "LineString":
            return {"type": kind, "coordinates": listed(one)}
        if kind in ("Polygon", "MultiLineString"):
            return {"type": kind, "coordinates": listed(lambda: listed(one))}
        if kind == "MultiPolygon":
            return {"type": kind, "coordinates": listed(lambda: listed(lambda: listed(one)))}
        return {"type": kind, "geometries": listed(geometry)}

    out = geometry()
    if at != len(tokens):
        raise ValueError("text after the geometry")
    return reproject(out, srid, target)


def _number(v: float) -> str:
    return str(int(v)) if float(v).is_integer() and abs(v) < 1e15 else repr(float(v))


def write_wkt(g: dict, srid: int | None = None) -> str:
    head = f"SRID={srid};" if srid is not None else ""
    kind = g["type"]
    if not g.get("geometries" if kind == "GeometryCollection" else "coordinates"):
        return f"{head}{kind.upper()} EMPTY"
    if kind == "GeometryCollection":
        return head + "GEOMETRYCOLLECTION(" + ",".join(write_wkt(m) for m in g["geometries"]) + ")"
    first = g["coordinates"]
    for _ in range(depth(kind)):
        first = first[0]
    dims = {2: "", 3: " Z", 4: " ZM" if first[2:3] != [None] else " M"}[len(first)]
    position = lambda p: " ".join(_number(v) for v in p if v is not None)
    nested = lambda c, levels: position(c) if levels == 0 else "(" + ",".join(nested(x, levels - 1) for x in c) + ")"
    body = f"({position(first)})" if kind == "Point" else nested(g["coordinates"], depth(kind))
    return f"{head}{kind.upper()}{dims}{' ' if dims else ''}{body}"


# WKB


def parse_wkb(data: bytes, source: int | None = None, target: int = 4326) -> dict:
    """ISO and EWKB codes, either byte order, SRID flag; triangles become polygons."""

    def read(at):
        order = "<" if data[at] == 1 else ">"
        (code,) = struct.unpack_from(order + "I", data, at + 1)
        at += 5
        z, m, with_srid = bool(code & 0x80000000), bool(code & 0x40000000), bool(code & 0x20000000)
        code &= 0x1FFFFFFF
        iso, code = divmod(code, 1000)
        z, m = z or iso in (1, 3), m or iso in (2, 3)
        srid = None
        if with_srid:
            (srid,) = struct.unpack_from(order + "I", data, at)
            at += 4
        if code not in NAMES and code != TRIANGLE:
            raise ValueError(f"unexpected WKB type {code}")

        def count():
            nonlocal at
            (n,) = struct.unpack_from(order + "I", data, at)
            at += 4
            return n

        def position():
            nonlocal at
            n = 2 + z + m
            own = list(struct.unpack_from(f"{order}{n}d", data, at))
            at += 8 * n
            if not all(map(math.isfinite, own[:2])):
                raise ValueError("a position isn't finite")
            rest = [v if math.isfinite(v) else None for v in own[2:]]
            return own[:2] + ([None, *rest] if m and not z else rest)

        many = lambda item: [item() for _ in range(count())]
        if code == 1:
            return {"type": "Point", "coordinates": position()}, at, srid
        if code == 2:
            return {"type": "LineString", "coordinates": many(position)}, at, srid
        if code in (3, TRIANGLE):
            return {"type": "Polygon", "coordinates": many(lambda: many(position))}, at, srid
        members = []
        for _ in range(count()):
            g, at, _ = read(at)
            members.append(g)
        if code == 7:
            return {"type": "GeometryCollection", "geometries": members}, at, srid
        return {"type": NAMES[code], "coordinates": [g["coordinates"] for g in members]}, at, srid

    try:
        g, _, srid = read(0)
    except (struct.error, IndexError) as e:
        raise ValueError("WKB is cut off") from e
    return reproject(g, source if source is not None else srid if srid is not None else 4326, target)


def write_wkb(g: dict, little: bool = True, srid: int | None = None) -> bytes:
    """EWKB, one byte order throughout; the SRID flag on the outer header only. Coordinates are written as they are."""
    order = "<" if little else ">"

    def first(g):
        if g["type"] == "GeometryCollection":
            return first(g["geometries"][0]) if g["geometries"] else [0, 0]
        c = g["coordinates"]
        for _ in range(depth(g["type"])):
            if not c:
                return [0, 0]
            c = c[0]
        return c

    shape = first(g)
    z, m = len(shape) > 2 and shape[2] is not None, len(shape) > 3
    flags = 0x80000000 * z | 0x40000000 * m

    def header(kind, own=None):
        code = CODES[kind] | flags | (0x20000000 if own is not None else 0)
        return bytes([little]) + struct.pack(order + "I", code) + (struct.pack(order + "I", own) if own is not None else b"")

    def position(p):
        own = [p[0], p[1]] + ([p[2] if len(p) > 2 and p[2] is not None else math.nan] if z else []) + ([p[3] if len(p) > 3 else math.nan] if m else [])
        return struct.pack(f"{order}{len(own)}d", *own)

    many = lambda items, f: struct.pack(order + "I", len(items)) + b"".join(map(f, items))

    def write(g, own=None):
        kind = g["type"]
        head = header(kind, own)
        if kind == "Point":
            return head + position(g["coordinates"])
        if kind == "LineString":
            return head + many(g["coordinates"], position)
        if kind == "Polygon":
            return head + many(g["coordinates"], lambda r: many(r, position))
        if kind == "GeometryCollection":
            return head + many(g["geometries"], write)
        single = kind.removeprefix("Multi")
        return head + many(g["coordinates"], lambda c: write({"type": single, "coordinates": c}))

    return write(g, srid)


# TWKB


def parse_twkb(data: bytes) -> dict:
    """Types 1 to 7 with optional box, size, ids and extended dimensions."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            if at >= len(data):
                raise ValueError("TWKB is cut off")
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            if not b & 0x80:
                return value
            shift += 7

    signed = lambda: (lambda v: (v >> 1) ^ -(v & 1))(varint())

    def read():
        nonlocal at
        if at + 2 > len(data):
            raise ValueError("TWKB is cut off")
        kind, raw = data[at] & 15, data[at] >> 4
        flags = data[at + 1]
        at += 2
        scales = [10.0 ** ((raw >> 1) ^ -(raw & 1))] * 2
        z = m = False
        if flags & 8:
            more = data[at]
            at += 1
            z, m = bool(more & 1), bool(more & 2)
            scales += [10.0 ** (more >> 2 & 7)] * z + [10.0 ** (more >> 5 & 7)] * m
        if flags & 2:
            varint()
        if flags & 1:
            for _ in range(2 * len(scales)):
                signed()
        if kind not in NAMES:
            raise ValueError(f"unexpected TWKB type {kind}")
        if flags & 16:
            return {"type": NAMES[kind], "geometries" if kind == 7 else "coordinates": []}
        now = [0] * len(scales)

        def position():
            for k in range(len(now)):
                now[k] += signed()
            own = [v / s for v, s in zip(now, scales)]
            return [own[0], own[1], None, own[2]] if m and not z else own

        many = lambda item, n=None: [item() for _ in range(varint() if n is None else n)]

        def members(item):
            n = varint()
            if flags & 4:
                many(signed, n)
            return many(item, n)

        if kind == 7:
            return {"type": "GeometryCollection", "geometries": members(read)}
        body = {1: position, 2: lambda: many(position), 3: lambda: many(lambda: many(position)), 4: lambda: members(position), 5: lambda: members(lambda: many(position)), 6: lambda: members(lambda: many(lambda: many(position)))}[kind]()
        return {"type": NAMES[kind], "coordinates": body}

    return read()


# Polyline


def encode_polyline(line, factor: float = 1e5) -> str:
    """Encoded latitude, longitude differences."""
    out, before = [], (0, 0)
    for p in line:
        now = (round_half_away(p[1] * factor), round_half_away(p[0] * factor))
        for a, b in zip(before, now):
            v = (b - a) << 1
            v = ~v if b < a else v
            while v >= 0x20:
                out.append(chr((0x20 | v & 0x1F) + 63))
                v >>= 5
            out.append(chr(v + 63))
        before = now
    return "".join(out)


def round_half_away(v: float) -> int:
    return int(math.floor(abs(v) + 0.5)) * (1 if v >= 0 else -1)


def decode_polyline(text: str, factor: float = 1e5) -> list:
    values, value, shift = [], 0, 0
    for ch in text:
        b = ord(ch) - 63
        if b < 0:
            raise ValueError("a bad character in a polyline")
        value |= (b & 0x1F) << shift
        shift += 5
        if not b & 0x20:
            values.append(~(value >> 1) if value & 1 else value >> 1)
            value = shift = 0
    if shift or len(values) % 2:
        raise ValueError("a polyline is cut off")
    out, y, x = [], 0, 0
    for dy, dx in zip(values[::2], values[1::2]):
        y, x = y + dy, x + dx
        out.append([x / factor, y / factor])
    return out


def sniff(value) -> dict:
    """A geometry from GeoJSON, WKT or hexadecimal text, or from GeoJSON, WKB or TWKB bytes."""
    import json

    if isinstance(value, str):
        text = value.strip()
        if text.startswith("{"):
            return json.loads(text)
        if re.match(r"(?i)(SRID=|[A-Z]*(POINT|LINE|POLYGON|COLLECTION|TRIANGLE))", text):
            return parse_wkt(text)
        value = bytes.fromhex(text)
    if value[:1] == b"{":
        return json.loads(value)
    try:
        return parse_wkb(value)
    except ValueError:
        return parse_twkb(value)
