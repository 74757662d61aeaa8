"""Queries on collections of features: joins, groups, clusters, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import lines as L
from geoloom.operators import grids, spatial
from geoloom.plans import sqlgeo as S
from geoloom.plans.layers import customer_inner, customer_rings, order_lines, points, with_layers

QUERIES: dict = {}
ORACLES: dict = {}


def register(sql: str | None, *layers: str, more: str = ""):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_layers(sql, *layers, more=more)
        return f

    return keep


def nation_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = points(spark, sf_dir, "nation_box")
    return box.select("id", "region", L.box_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")).alias("ring"))


IN_BOX = "p.lon BETWEEN b.xmin AND b.xmax AND p.lat BETWEEN b.ymin AND b.ymax"


@register(f"SELECT p.id, b.id AS box FROM customer_pt p JOIN nation_box b ON {IN_BOX}", "customer_pt", "nation_box")
def spatial_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = nation_rings(spark, sf_dir).withColumnRenamed("id", "box")
    return spatial.points_in_polygons(points(spark, sf_dir, "customer_pt"), rings).select("id", "box")


@register(f"SELECT id FROM customer_pt p WHERE EXISTS (SELECT 1 FROM nation_box b WHERE {IN_BOX})", "customer_pt", "nation_box")
def points_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.points_in_polygons(points(spark, sf_dir, "customer_pt"), nation_rings(spark, sf_dir), how="left_semi").select("id")


@register(f"SELECT b.id, coalesce(string_agg(CAST(p.id AS VARCHAR), ',' ORDER BY p.id), '') AS inside FROM nation_box b LEFT JOIN customer_pt p ON {IN_BOX} GROUP BY b.id", "customer_pt", "nation_box")
def collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spatial.collect(nation_rings(spark, sf_dir), points(spark, sf_dir, "customer_pt").withColumn("v", F.col("id").cast("string")), "id", "v", "id", "inside")
    return out.select("id", F.array_join("inside", ",").alias("inside"))


@register(f"SELECT c.id, s.id AS supplier, round({S.distance('c.lon', 'c.lat', 's.lon', 's.lat')}, 2) AS d FROM customer_pt c JOIN supplier_pt s ON {S.distance('c.lon', 'c.lat', 's.lon', 's.lat')} <= 400000", "customer_pt", "supplier_pt")
def distance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = points(spark, sf_dir, "customer_pt").select(F.col("id").alias("lid"), "lon", "lat")
    right = points(spark, sf_dir, "supplier_pt").select(F.col("id").alias("rid"), F.col("lon").alias("rlon"), F.col("lat").alias("rlat"))
    return spatial.within_distance(left, right, 400_000).select(F.col("lid").alias("id"), F.col("rid").alias("supplier"), F.round("distance", 2).alias("d"))


@register(f"SELECT id, round({S.distance('lon', 'lat', '10.5', '48.2')}, 2) AS d FROM customer_pt WHERE {S.distance('lon', 'lat', '10.5', '48.2')} <= 1500000", "customer_pt")
def radius_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.functions import geodesy as G

    d = G.distance(F.col("lon"), F.col("lat"), F.lit(10.5), F.lit(48.2))
    return points(spark, sf_dir, "customer_pt").select("id", F.round(d, 2).alias("d"), d.alias("x")).where("x <= 1500000").orderBy("x").drop("x")


@register("SELECT id FROM customer_pt WHERE lon BETWEEN -20 AND 31 AND lat BETWEEN -9 AND 44", "customer_pt")
def box_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir, "customer_pt").where("lon between -20 and 31 and lat between -9 and 44").select("id")


@register(f"SELECT c.id, round(min({S.distance('c.lon', 'c.lat', 's.lon', 's.lat')}), 2) AS d FROM customer_pt c, supplier_pt s GROUP BY c.id", "customer_pt", "supplier_pt")
def nearest_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = points(spark, sf_dir, "customer_pt").select(F.col("id").alias("lid"), "lon", "lat")
    right = points(spark, sf_dir, "supplier_pt").select(F.col("id").alias("rid"), F.col("lon").alias("rlon"), F.col("lat").alias("rlat"))
    return spatial.nearest(left, right, 500_000).select(F.col("lid").alias("id"), F.round("distance", 2).alias("d"))


@register("SELECT nation, count(*) AS n FROM customer_pt WHERE nation IS NOT NULL GROUP BY nation", "customer_pt")
def divide_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir, "customer_pt").where("nation is not null").groupBy("nation").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT nation, round(min(lon), 6) AS xmin, round(min(lat), 6) AS ymin, round(max(lon), 6) AS xmax, round(max(lat), 6) AS ymax FROM customer_pt GROUP BY nation", "customer_pt")
def bounding_box_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir, "customer_pt").groupBy("nation").agg(*[F.round(f(c), 6).alias(n) for f, c, n in ((F.min, "lon", "xmin"), (F.min, "lat", "ymin"), (F.max, "lon", "xmax"), (F.max, "lat", "ymax"))])


@register("SELECT nation, round(sum(lon * acctbal) / sum(acctbal), 6) AS x, round(sum(lat * acctbal) / sum(acctbal), 6) AS y FROM customer_pt WHERE acctbal > 0 GROUP BY nation", "customer_pt")
def center_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spatial.centre_mean(points(spark, sf_dir, "customer_pt"), "acctbal", ["nation"])
    return out.select("nation", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _weiszfeld(rounds: int) -> str:
    steps = ["m0 AS (SELECT avg(lon) AS x, avg(lat) AS y FROM customer_pt)"]
    for k in range(rounds):
        d = "sqrt(pow(lon - x, 2) + pow(lat - y, 2))"
        steps.append(f"m{k + 1} AS (SELECT sum(lon / {d}) / sum(1 / {d}) AS x, sum(lat / {d}) / sum(1 / {d}) AS y FROM customer_pt, m{k})")
    return ", ".join(steps)


@register("SELECT round(x, 5) AS x, round(y, 5) AS y FROM m10", "customer_pt", more=_weiszfeld(10))
def center_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = spatial.centre_median(points(spark, sf_dir, "customer_pt"), tolerance=0.0)
    return spark.createDataFrame([(x, y)], "x double, y double").select(F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@register("SELECT key, value, count(*) AS n FROM (SELECT 'nation' AS key, CAST(nation AS VARCHAR) AS value FROM customer_pt GROUP BY nation UNION ALL SELECT 'segment', '\"' || segment || '\"' FROM customer_pt GROUP BY segment) GROUP BY ALL", "customer_pt")
def properties_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = points(spark, sf_dir, "customer_pt").select(F.parse_json(F.to_json(F.struct("nation", "segment"))).alias("properties"))
    return spatial.properties_summary(features).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT id, CAST(i - 1 AS INTEGER) AS part, round(line[i].x, 6) AS x FROM order_line, unnest(range(1, len(line) + 1)) AS u(i)", "order_line")
def flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.flattened(order_lines(spark, sf_dir), "line").select("id", "part", F.round("geometry.x", 6).alias("x"))


@register("SELECT count(*) AS n, round(sum(c.x), 3) AS x FROM (SELECT unnest(ring) AS c FROM customer_ring)", "customer_ring")
def all_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_rings(spark, sf_dir).select(F.explode("ring").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c.x"), 3).alias("x"))


@register("SELECT least(100, count(*)) AS n FROM customer_pt", "customer_pt")
def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.sample(points(spark, sf_dir, "customer_pt"), 100, 7, "id").agg(F.count(F.lit(1)).alias("n"))


@register(None)
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.kmeans(points(spark, sf_dir, "supplier_pt"), 7, rounds=20).select("id", "cluster", F.round("centroid.x", 5).alias("x"), F.round("centroid.y", 5).alias("y"))


DBSCAN = f"""
near AS (SELECT a.id AS a, b.id AS b FROM customer_pt a JOIN customer_pt b ON a.id <> b.id AND abs(a.lat - b.lat) < 5 AND {S.distance('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 450000),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 3),
link AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (WITH RECURSIVE r(id, root) AS (SELECT id, id FROM core UNION SELECT link.b, r.root FROM r JOIN link ON link.a = r.id WHERE r.root <= link.b) SELECT * FROM r),
label AS (SELECT id, min(root) AS cluster FROM reach GROUP BY id),
edge AS (SELECT near.b AS id, min(cluster) AS cluster FROM near JOIN label ON near.a = label.id WHERE near.b NOT IN (SELECT id FROM core) GROUP BY near.b)
"""


@register("SELECT p.id, CASE WHEN l.id IS NOT NULL THEN 'core' WHEN e.id IS NOT NULL THEN 'edge' ELSE 'noise' END AS dbscan, coalesce(l.cluster, e.cluster, -1) AS cluster FROM customer_pt p LEFT JOIN label l ON p.id = l.id LEFT JOIN edge e ON p.id = e.id", "customer_pt", more=DBSCAN.strip())
def dbscan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.dbscan(points(spark, sf_dir, "customer_pt"), 450_000, 3).select("id", "dbscan", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))


# Grids: cell counts and corners follow from plain arithmetic.
BOX = (-10.0, 40.0, 10.0, 52.0)


def _grid_sql(columns: str, rows: str, x: str, y: str) -> str:
    return f"SELECT CAST(c AS INTEGER) AS col, CAST(r AS INTEGER) AS row, round({x}, 5) AS x, round({y}, 5) AS y FROM unnest(range(0, CAST({columns} AS BIGINT))) AS a(c), unnest(range(0, CAST({rows} AS BIGINT))) AS b(r)"


_W, _H = f"(100000.0 / {S.distance('-10.0', '46.0', '10.0', '46.0')} * 20)", f"(100000.0 / {S.distance('0.0', '40.0', '0.0', '52.0')} * 12)"
_NC, _NR = f"floor(20 / {_W})", f"floor(12 / {_H})"


@register(_grid_sql(f"({_NC} + 1)", f"({_NR} + 1)", f"-10 + (20 - {_NC} * {_W}) / 2 + c * {_W}", f"40 + (12 - {_NR} * {_H}) / 2 + r * {_H}"))
def point_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.point_grid(spark, BOX, 100_000).select("col", "row", F.round("lon", 5).alias("x"), F.round("lat", 5).alias("y"))


def _first(df: DataFrame) -> DataFrame:
    return df.select("col", "row", F.round(F.col("ring")[0]["x"], 5).alias("x"), F.round(F.col("ring")[0]["y"], 5).alias("y"))


_rw, _rh = "(80000.0 / 111325)", "(60000.0 / 111325)"


@register(_grid_sql(f"floor(20 / {_rw})", f"floor(12 / {_rh})", f"-10 + (20 - floor(20 / {_rw}) * {_rw}) / 2 + c * {_rw}", f"40 + (12 - floor(12 / {_rh}) * {_rh}) / 2 + r * {_rh}"))
def rectangle_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first(grids.rectangle_grid(spark, BOX, 80_000, 60_000))


@register(_grid_sql(f"floor(20 / {_rw})", f"floor(12 / {_rw})", f"-10 + (20 - floor(20 / {_rw}) * {_rw}) / 2 + c * {_rw}", f"40 + (12 - floor(12 / {_rw}) * {_rw}) / 2 + r * {_rw}"))
def square_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first(grids.square_grid(spark, BOX, 80_000))


@register(f"SELECT 2 * CAST({_NC} AS BIGINT) * CAST({_NR} AS BIGINT) AS n, round(CAST({_NC} AS BIGINT) * CAST({_NR} AS BIGINT) * {_W} * {_H}, 4) AS area")
def triangle_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.triangle_grid(spark, BOX, 100_000).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.abs(L.planar_area(F.col("ring")))), 4).alias("area"))


_hc, _hr = f"(floor((20 - 2 * {_W}) / (1.5 * {_W})) + 1)", f"floor((12 - sqrt(3) * {_H}) / (sqrt(3) * {_H}))"


@register(f"SELECT CAST({_hc} * {_hr} AS BIGINT) AS n, round({_hc} * {_hr} * 1.5 * sqrt(3) * {_W} * {_H}, 4) AS area")
def hex_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.hex_grid(spark, BOX, 100_000).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.abs(L.planar_area(F.col("ring")))), 4).alias("area"))


@register(f"SELECT CAST(6 * {_hc} * {_hr} AS BIGINT) AS n, round({_hc} * {_hr} * 1.5 * sqrt(3) * {_W} * {_H}, 4) AS area")
def hex_triangle_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.hex_grid(spark, BOX, 100_000, triangles=True).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.abs(L.planar_area(F.col("ring")))), 4).alias("area"))


@register("SELECT count(*) AS n FROM (SELECT -10 + (20 - floor(20 / (80000.0 / 111325)) * (80000.0 / 111325)) / 2 + (c + 0.5) * (80000.0 / 111325) AS x, 40 + (12 - floor(12 / (80000.0 / 111325)) * (80000.0 / 111325)) / 2 + (r + 0.5) * (80000.0 / 111325) AS y FROM unnest(range(0, 27)) AS a(c), unnest(range(0, 16)) AS b(r)) WHERE x BETWEEN -5 AND 3 AND y BETWEEN 42 AND 49")
def masked_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = L.box_ring(F.lit(-5.0), F.lit(42.0), F.lit(3.0), F.lit(49.0))
    return grids.masked(grids.square_grid(spark, BOX, 80_000), mask).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT 5000 AS n, true AS inside")
def random_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.random_points(spark, BOX, 5000, 3).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("lon").between(-10, 10) & F.col("lat").between(40, 52)).alias("inside"))


@register("SELECT 300 AS n, 5 AS vertices")
def random_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.random_lines(spark, BOX, 300, 5, 3).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("line")).alias("vertices"))


@register("SELECT 300 AS n, true AS valid")
def random_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.random_polygons(spark, BOX, 300, 8, 3).agg(F.count(F.lit(1)).alias("n"), F.bool_and(L.is_valid_ring(F.col("ring")) & ~L.is_clockwise(F.col("ring"))).alias("valid"))


@register("SELECT id FROM customer_inner WHERE acctbal > 0 UNION ALL SELECT -1", "customer_inner")
def feature_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, map and append on a collection are Spark's where, select and unionByName."""
    kept = customer_inner(spark, sf_dir).where("acctbal > 0").select("id")
    return kept.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("id")))
