"""GeoJSON and the binary and text geometry formats as Spark sources, sinks and functions.

A feature is a row: feature_index, id, geometry (GeoJSON text), properties
(VARIANT), so properties stay on the JVM and kernels get one string.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.kernels import codecs


def features_of(text: DataFrame, value: str = "value") -> DataFrame:
    """Rows of any GeoJSON text -> one row per feature; bare geometries are features without properties.

    The document is parsed once as VARIANT; collections are exploded in order.
    """
    doc = text.select(F.monotonically_increasing_id().alias("document"), F.try_parse_json(value).alias("v")).where("v is not null")
    kind = F.try_variant_get("v", "$.type", "string")
    as_list = F.when(kind == "FeatureCollection", F.try_variant_get("v", "$.features", "array<variant>")).otherwise(F.array("v"))
    one = doc.select("document", F.posexplode(as_list).alias("feature_index", "f"))
    is_feature = F.try_variant_get("f", "$.type", "string") == "Feature"
    geometry = F.when(is_feature, F.try_variant_get("f", "$.geometry", "variant")).otherwise(F.col("f"))
    out = one.select(
        "document", "feature_index",
        F.try_variant_get("f", "$.id", "string").alias("id"),
        F.to_json(geometry).alias("geometry"),
        F.try_variant_get(geometry, "$.type", "string").alias("type"),
        F.when(is_feature, F.try_variant_get("f", "$.properties", "variant")).alias("properties"),
        F.when(is_feature, F.try_variant_get("f", "$.bbox", "array<double>")).alias("bbox"),
    )
    return out.where(F.col("type").isin(*codecs.CODES))


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Features of whole GeoJSON files, or of newline-delimited ones, which split across tasks."""
    return features_of(spark.read.text(path, wholetext=not lines))


def read_type(features: DataFrame, *types: str) -> DataFrame:
    return features.where(F.col("type").isin(*types))


def as_feature(geometry: Column, properties: Column | None = None, id_: Column | None = None) -> Column:
    """GeoJSON text of a feature from a geometry's text and properties as VARIANT."""
    props = F.coalesce(F.to_json(properties), F.lit("{}")) if properties is not None else F.lit("{}")
    own = F.concat(F.lit('{"type":"Feature",'), F.coalesce(F.concat(F.lit('"id":'), F.to_json(F.struct(id_.alias("i"))).substr(F.lit(6), F.length(F.to_json(F.struct(id_.alias("i")))) - 6), F.lit(",")), F.lit("")) if id_ is not None else F.lit(""))
    return F.concat(own, F.lit('"properties":'), props, F.lit(',"geometry":'), geometry, F.lit("}"))


def write_geojson_lines(features: DataFrame, path: str) -> None:
    """One feature a line, written in parallel."""
    props = F.col("properties") if "properties" in features.columns else None
    features.select(as_feature(F.col("geometry"), props).alias("value")).write.text(path)


def collection(features: DataFrame) -> DataFrame:
    """One row with a FeatureCollection's text; for results that fit one value."""
    props = F.col("properties") if "properties" in features.columns else None
    own = features.select("feature_index", as_feature(F.col("geometry"), props).alias("f"))
    listed = own.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("feature_index", "f"))), lambda s: s["f"]), ",").alias("fs"))
    return listed.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "fs", F.lit("]}")).alias("value"))


def point_json(x: Column, y: Column) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(x.cast("double"), y.cast("double")).alias("coordinates")))


def line_json(line: Column) -> Column:
    return F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(line, lambda c: F.array(c["x"], c["y"])).alias("coordinates")))


def polygon_json(*rings: Column) -> Column:
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(*[F.transform(r, lambda c: F.array(c["x"], c["y"])) for r in rings]).alias("coordinates")))


def _each(f):
    def safe(v):
        if v is None or (isinstance(v, float) and v != v):
            return None
        try:
            return f(v)
        except (ValueError, KeyError, TypeError, IndexError):
            return None

    return lambda s: s.map(safe)


def _udf(kind: str, f):
    run = _each(f)

    @F.pandas_udf({"string": T.StringType(), "binary": T.BinaryType()}[kind])
    def apply(s: pd.Series) -> pd.Series:
        return run(s).astype(object)

    return apply


#: Column functions; null for null or malformed input.
to_wkb = _udf("binary", lambda t: codecs.write_wkb(json.loads(t)))
to_ewkb = _udf("binary", lambda t: codecs.write_wkb(json.loads(t), srid=4326))
to_wkb_big_endian = _udf("binary", lambda t: codecs.write_wkb(json.loads(t), little=False))
from_wkb = _udf("string", lambda b: json.dumps(codecs.parse_wkb(bytes(b))))
to_wkt = _udf("string", lambda t: codecs.write_wkt(json.loads(t)))
from_wkt = _udf("string", lambda t: json.dumps(codecs.parse_wkt(t)))
from_twkb = _udf("string", lambda b: json.dumps(codecs.parse_twkb(bytes(b))))
from_any_text = _udf("string", lambda t: json.dumps(codecs.sniff(t)))
from_any_bytes = _udf("string", lambda b: json.dumps(codecs.sniff(bytes(b))))
to_polyline = _udf("string", lambda t: codecs.encode_polyline(json.loads(t)["coordinates"]))
from_polyline = _udf("string", lambda t: json.dumps({"type": "LineString", "coordinates": codecs.decode_polyline(t)}))


def point_from_wkt(text: Column) -> Column:
    """struct(x, y) of a plain POINT without Python; null for anything else."""
    n = r"([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    pattern = rf"(?i)^\s*POINT\s*\(\s*{n}\s+{n}\s*\)\s*$"
    part = lambda k: F.regexp_extract(text, pattern, k).try_cast("double")
    return F.when(text.rlike(pattern), F.struct(part(1).alias("x"), part(2).alias("y")))
