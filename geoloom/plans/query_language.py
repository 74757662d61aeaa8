"""A small query language over feature properties and location, compiled to columns.

Text is tokenised, parsed into postfix form and run on a stack of symbolic
values, whose result is one boolean Column; Catalyst sees ordinary predicates.

    .a.b  .[0]  ."x y"       property path (missing is null)
    == != > >= < <= =~ =* =^ =$   comparisons; =~ /regex/i, =* contains, =^ starts, =$ ends
    .a in [x, "y", 3]        membership
    and, or                  equal precedence, left to right
    not, exists              after their operand; not may also come before it
    near(lat, lon, metres)   within(minLon, minLat, maxLon, maxLat)   intersects(...)
    words                    full-text search in top-level string properties

A null operand makes a comparison false, never null. Postfix operators bind to
the nearest operand; with compat=True they apply to the whole expression so far.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geodesy as G
from geoloom.functions import tiles as T


class QuerySyntaxError(ValueError):
    pass


@dataclass(frozen=True)
class Token:
    kind: str
    value: object


COMPARISONS = ("==", "!=", ">=", "<=", "=~", "=*", "=^", "=$", ">", "<")
SHAPES = {"near": 3, "within": 4, "intersects": 4}
_WORD = re.compile(r"[^\s()\[\],]+")


def _quoted(text: str, at: int) -> tuple[str, int]:
    mark, out, at = text[at], [], at + 1
    while at < len(text):
        ch = text[at]
        if ch == "\\" and at + 1 < len(text):
            out.append(text[at + 1])
            at += 2
        elif ch == mark:
            return "".join(out), at + 1
        else:
            out.append(ch)
            at += 1
    raise QuerySyntaxError("a quote isn't closed")


def _number(word: str) -> object:
    for kind in (int, float):
        try:
            return kind(word)
        except ValueError:
            pass
    return word


def _path(text: str, at: int) -> tuple[list, int]:
    parts: list = []
    while at < len(text) and (text[at] == "." or (text[at] == "[" and parts)):
        at += text[at] == "."
        if at < len(text) and text[at] in "\"'":
            part, at = _quoted(text, at)
            parts.append(part)
        elif at < len(text) and text[at] == "[":
            end = text.find("]", at)
            if end < 0 or not text[at + 1 : end].strip().isdigit():
                raise QuerySyntaxError("a bad index in a path")
            parts.append(int(text[at + 1 : end]))
            at = end + 1
        else:
            m = re.compile(r"[^\s.()\[\],=!<>]+").match(text, at)
            if not m:
                raise QuerySyntaxError("an empty path")
            parts.append(int(m[0]) if m[0].isdigit() else m[0])
            at = m.end()
    return parts, at


def tokenise(text: str) -> list[Token]:
    out: list[Token] = []
    at = 0
    while at < len(text):
        ch = text[at]
        if ch.isspace() or ch == ",":
            at += 1
        elif ch in "()":
            out.append(Token(ch, ch))
            at += 1
        elif ch in "\"'":
            value, at = _quoted(text, at)
            out.append(Token("literal", value))
        elif ch == "." and not re.match(r"\.\d", text[at:]) or (ch == "." and at + 1 < len(text) and text[at + 1] == "["):
            path, at = _path(text, at)
            out.append(Token("path", tuple(path)))
        elif ch == "[":
            at += 1
            items: list = []
            while True:
                while at < len(text) and (text[at].isspace() or text[at] == ","):
                    at += 1
                if at >= len(text):
                    raise QuerySyntaxError("a list isn't closed")
                if text[at] == "]":
                    at += 1
                    break
                if text[at] in "\"'":
                    value, at = _quoted(text, at)
                    items.append(value)
                else:
                    m = _WORD.match(text, at)
                    if not m:
                        raise QuerySyntaxError("a bad list item")
                    items.append(_number(m[0]))
                    at = m.end()
            out.append(Token("set", tuple(items)))
        elif ch == "/" and out and out[-1].value == "=~":
            end = at + 1
            while end < len(text) and (text[end] != "/" or text[end - 1] == "\\"):
                end += 1
            if end >= len(text):
                raise QuerySyntaxError("a pattern isn't closed")
            flag = text[end + 1 : end + 2] == "i"
            out.append(Token("literal", ("(?i)" if flag else "") + text[at + 1 : end].replace("\\/", "/")))
            at = end + 1 + flag
        else:
            op = next((c for c in COMPARISONS if text.startswith(c, at)), None)
            if op:
                out.append(Token("comparison", op))
                at += len(op)
                continue
            m = _WORD.match(text, at)
            word = m[0]
            low = word.lower()
            at = m.end()
            if low in ("and", "or", "not", "exists", "in"):
                out.append(Token(low, low))
            elif low in SHAPES and text[at : at + 1] == "(":
                end = text.find(")", at)
                numbers = [_number(x) for x in re.split(r"[\s,]+", text[at + 1 : end].strip())] if end > 0 else []
                if len(numbers) != SHAPES[low] or not all(isinstance(x, (int, float)) for x in numbers):
                    raise QuerySyntaxError(f"{low} takes {SHAPES[low]} numbers")
                out.append(Token(low, tuple(float(x) for x in numbers)))
                at = end + 1
            else:
                out.append(Token("literal", _number(word)))
    return out


def to_postfix(tokens: list[Token], compat: bool = False) -> list[Token]:
    """Postfix order. Groups are parsed on their own and stay one operand."""
    out, at = _group(tokens, 0, compat)
    if at != len(tokens):
        raise QuerySyntaxError("a parenthesis too many")
    return out


def _group(tokens: list[Token], at: int, compat: bool) -> tuple[list[Token], int]:
    out: list[Token] = []
    pending: Token | None = None
    comparison: Token | None = None
    negate = False
    while at < len(tokens) and tokens[at].kind != ")":
        t = tokens[at]
        at += 1
        if t.kind == "(":
            inner, at = _group(tokens, at, compat)
            if at >= len(tokens):
                raise QuerySyntaxError("a parenthesis isn't closed")
            at += 1
            out += inner
        elif t.kind in ("and", "or"):
            if pending:
                out.append(pending)
            pending = t
            continue
        elif t.kind == "comparison":
            comparison = t
            continue
        elif t.kind == "in":
            if at >= len(tokens) or tokens[at].kind != "set":
                raise QuerySyntaxError("in takes a list")
            out += [tokens[at], t]
            at += 1
        elif t.kind == "exists":
            if compat and pending:
                out.append(pending)
                pending = None
            out.append(t)
        elif t.kind == "not":
            before_operand = not out or (at >= 2 and tokens[at - 2].kind in ("and", "or", "(", "not"))
            if before_operand:
                negate = not negate
                continue
            if compat and pending:
                out.append(pending)
                pending = None
            out.append(t)
        else:
            out.append(t)
        if comparison and t.kind not in ("in", "exists", "not"):
            out.append(comparison)
            comparison = None
        following = tokens[at].kind if at < len(tokens) else ")"
        if negate and following not in ("comparison", "in", "exists"):
            out.append(Token("not", "not"))
            negate = False
        if pending and following in ("and", "or", ")") and not compat:
            out.append(pending)
            pending = None
    if pending:
        out.append(pending)
    if comparison:
        raise QuerySyntaxError("a comparison without a right side")
    return out, at


@dataclass
class Value:
    """A symbolic operand: a variant column, a Python literal, a list or a boolean column."""

    kind: str
    of: object


NUMBERS = ("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")


class Compiler:
    """properties: a VARIANT column; lon and lat: the feature's centroid; box: its bounding box columns."""

    def __init__(self, properties: Column, lon: Column | None = None, lat: Column | None = None, box: T.Box | None = None, exact_intersects=None):
        self.properties, self.lon, self.lat, self.box, self.exact = properties, lon, lat, box, exact_intersects

    def _variant(self, path: tuple) -> Column:
        steps = "".join(f"[{p}]" if isinstance(p, int) else "['" + str(p).replace("'", "\\'") + "']" for p in path)
        return F.try_variant_get(self.properties, "$" + steps, "variant")

    def _kind(self, v: Column) -> Column:
        return F.schema_of_variant(v)

    def number(self, v: Value) -> Column:
        if v.kind == "literal":
            return F.lit(float(v.of)) if isinstance(v.of, (int, float)) else F.lit(None).cast("double")
        if v.kind == "boolean":
            return F.lit(None).cast("double")
        kind = self._kind(v.of)
        return F.when(kind.isin(*NUMBERS) | kind.startswith("DECIMAL"), F.try_variant_get(v.of, "$", "double"))

    def string(self, v: Value) -> Column:
        if v.kind == "literal":
            return F.lit(v.of) if isinstance(v.of, str) else F.lit(None).cast("string")
        if v.kind == "boolean":
            return F.lit(None).cast("string")
        kind = self._kind(v.of)
        return F.when(kind == "STRING", F.try_variant_get(v.of, "$", "string")).when(kind == "BOOLEAN", F.try_variant_get(v.of, "$", "string"))

    def truth(self, v: Value) -> Column:
        if v.kind == "boolean":
            return v.of
        if v.kind == "literal":
            return F.lit(True)
        kind = self._kind(v.of)
        return F.coalesce(v.of.isNotNull() & ((kind != "BOOLEAN") | F.coalesce(F.try_variant_get(v.of, "$", "boolean"), F.lit(False))) & (kind != "VOID"), F.lit(False))

    def compare(self, a: Value, op: str, b: Value) -> Column:
        no = F.lit(False)
        na, nb, sa, sb = self.number(a), self.number(b), self.string(a), self.string(b)
        if op in ("==", "!="):
            same = F.coalesce(na == nb, sa == sb, no)
            both = (na.isNotNull() | sa.isNotNull()) & (nb.isNotNull() | sb.isNotNull())
            return same if op == "==" else both & ~same
        if op in (">", ">=", "<", "<="):
            test = {">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__}[op]
            return F.coalesce(test(na, nb), test(sa, sb), no)
        if op == "=~":
            if b.kind != "literal":
                return no
            return F.coalesce(sa.rlike(str(b.of)), no)
        fn = {"=*": F.contains, "=^": F.startswith, "=$": F.endswith}[op]
        return F.coalesce(fn(F.lower(sa), F.lower(sb)), no)

    def member(self, a: Value, items: tuple) -> Column:
        found = F.lit(False)
        for item in items:
            found = found | self.compare(a, "==", Value("literal", item))
        return found

    def shape(self, t: Token) -> Column:
        if t.kind == "near":
            lat, lon, metres = (F.lit(x) for x in t.value)
            span = t.value[2] / G.METRES_PER_DEGREE
            close = (self.lat >= t.value[0] - span * 1.01) & (self.lat <= t.value[0] + span * 1.01)
            return F.coalesce(close & (G.distance(self.lon, self.lat, lon, lat) <= metres), F.lit(False))
        own = self.box or (self.lon, self.lat, self.lon, self.lat)
        asked = tuple(F.lit(x) for x in t.value)
        if t.kind == "within":
            return F.coalesce(T.box_within(own, asked), F.lit(False))
        meets = T.boxes_intersect(own, asked)
        return F.coalesce(meets & self.exact(*t.value) if self.exact else meets, F.lit(False))

    def full_text(self, words: list) -> Column:
        term = " ".join(str(w) for w in words).lower()
        if not term:
            return F.lit(False)
        values = F.map_values(F.try_variant_get(self.properties, "$", "map<string,variant>"))
        hit = lambda v: F.coalesce((F.schema_of_variant(v) == "STRING") & F.contains(F.lower(F.try_variant_get(v, "$", "string")), F.lit(term)), F.lit(False))
        return F.coalesce(F.exists(values, hit), F.lit(False))

    def run(self, postfix: list[Token]) -> Column:
        if postfix and all(t.kind == "literal" for t in postfix):
            return self.full_text([t.value for t in postfix])
        stack: list[Value] = []
        false = Value("boolean", F.lit(False))
        for t in postfix:
            if t.kind == "literal":
                stack.append(Value("literal", t.value))
            elif t.kind == "set":
                stack.append(Value("set", t.value))
            elif t.kind == "path":
                stack.append(Value("value", self._variant(t.value)))
            elif t.kind in SHAPES:
                stack.append(Value("boolean", self.shape(t)))
            elif t.kind in ("not", "exists"):
                if not stack:
                    return F.lit(False)
                v = stack.pop()
                if t.kind == "not":
                    stack.append(Value("boolean", ~self.truth(v)))
                else:
                    stack.append(Value("boolean", F.coalesce(v.of.isNotNull() & (F.schema_of_variant(v.of) != "VOID"), F.lit(False)) if v.kind == "value" else F.lit(True)))
            else:
                if len(stack) < 2:
                    return F.lit(False)
                b, a = stack.pop(), stack.pop()
                if t.kind == "in":
                    stack.append(Value("boolean", self.member(a, b.of)) if b.kind == "set" else false)
                elif t.kind == "and":
                    stack.append(Value("boolean", self.truth(a) & self.truth(b)))
                elif t.kind == "or":
                    stack.append(Value("boolean", self.truth(a) | self.truth(b)))
                else:
                    stack.append(Value("boolean", self.compare(a, t.value, b)))
        return self.truth(stack[0]) if len(stack) == 1 else F.lit(False)


def compile_query(term: str, compiler: Compiler, compat: bool = False) -> Column:
    return compiler.run(to_postfix(tokenise(term), compat))


def query(features: DataFrame, term: str, properties: str = "properties", lon: str = "lon", lat: str = "lat", box: tuple[str, str, str, str] | None = None, compat: bool = False) -> DataFrame:
    """The features that a query term matches; raises QuerySyntaxError on a bad term."""
    own = Compiler(F.col(properties), F.col(lon), F.col(lat), tuple(F.col(c) for c in box) if box else None)
    return features.where(compile_query(term, own, compat))
