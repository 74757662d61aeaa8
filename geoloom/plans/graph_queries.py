"""Graph queries over networks derived from orders and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators import graphs
from geoloom.plans.layers import order_lines, points, table, with_layers

QUERIES: dict = {}
ORACLES: dict = {}

#: Edges between nations: n to 2n + 1, 2n + 2 (mod 25) and n + 5, with whole weights.
EDGE_SQL = """
edges AS (
  SELECT src, dst, min(weight) AS weight FROM (
    SELECT least(a, b) AS src, greatest(a, b) AS dst, CAST(1 + (a * 7 + b * 3) % 11 AS DOUBLE) AS weight FROM (
      SELECT CAST(n_nationkey AS BIGINT) AS a, CAST((2 * n_nationkey + 1) % 25 AS BIGINT) AS b FROM nation
      UNION ALL SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey + 5 AS BIGINT) FROM nation WHERE n_nationkey < 15) WHERE a <> b
  ) GROUP BY src, dst
), twoway AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges)
"""


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("a"))
    raw = n.select("a", ((2 * F.col("a") + 1) % 25).alias("b")).unionByName(n.where("a < 15").select("a", (F.col("a") + 5).alias("b"))).where("a <> b")
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    return raw.select(lo.alias("src"), hi.alias("dst"), (1 + (F.col("a") * 7 + F.col("b") * 3) % 11).cast("double").alias("weight")).groupBy("src", "dst").agg(F.min("weight").alias("weight")).withColumn("is_directed", F.lit(False))


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to part (as negative ids), one per pair in lineitem."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("src"), (-F.col("l_partkey") - 1).alias("dst")).distinct().select("src", "dst", F.lit(1.0).alias("weight"), F.lit(False).alias("is_directed"))


def register(sql: str | None, *layers: str, more: str = EDGE_SQL):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_layers(sql, *layers, more=more.strip())
        return f

    return keep


@register("SELECT (SELECT count(DISTINCT (round(c.x * 111325, 0), round(c.y * 111325, 0))) FROM (SELECT unnest(line) AS c FROM order_line)) AS nodes, (SELECT CAST(sum(len(list_filter(range(1, len(line)), lambda i: line[i].x <> line[i + 1].x OR line[i].y <> line[i + 1].y))) AS BIGINT) FROM order_line) AS edges", "order_line", more="")
def graph_construct(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graphs.construct(order_lines(spark, sf_dir))
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).join(edges.agg(F.count(F.lit(1)).alias("edges")))


@register("SELECT src AS node, count(*) AS degree FROM twoway GROUP BY src")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.degrees(nation_edges(spark, sf_dir))


@register("SELECT src AS node, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbours FROM twoway GROUP BY src")
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.neighbours(nation_edges(spark, sf_dir)).select("node", F.array_join("neighbours", ",").alias("neighbours"))


@register("SELECT src, dst, weight FROM edges")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = nation_edges(spark, sf_dir)
    swapped = own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "is_directed")
    return graphs.unique_edges(own.unionByName(swapped)).select("src", "dst", "weight")


@register("SELECT src, dst FROM edges WHERE src % 2 = 0 AND dst % 2 = 0")
def graph_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = spark.range(25).select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return graphs.subgraph(nodes, nation_edges(spark, sf_dir), nodes.where("id % 2 = 0"))[1].select("src", "dst")


REACH = ", reach AS (WITH RECURSIVE r(node, root) AS (SELECT DISTINCT src, src FROM b2 UNION SELECT b2.dst, r.root FROM r JOIN b2 ON b2.src = r.node) SELECT node, min(root) AS component FROM r GROUP BY node)"


@register("SELECT node, component FROM reach", more="b2 AS (SELECT src, dst FROM (SELECT CAST(n_nationkey AS BIGINT) AS src, CAST((n_nationkey * 4 + 2) % 25 AS BIGINT) AS dst FROM nation) UNION SELECT CAST((n_nationkey * 4 + 2) % 25 AS BIGINT), CAST(n_nationkey AS BIGINT) FROM nation)" + REACH)
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("src"))
    return graphs.components(n.select("src", ((F.col("src") * 4 + 2) % 25).alias("dst")))


@register(None)
def graph_components_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.components(trade_edges(spark, sf_dir)).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT node, min(level) AS level FROM walk GROUP BY node", more=EDGE_SQL.strip() + ", walk AS (WITH RECURSIVE w(node, level) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT twoway.dst, w.level + 1 FROM w JOIN twoway ON twoway.src = w.node WHERE w.level < 8) SELECT * FROM w)")
def graph_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.bfs_levels(nation_edges(spark, sf_dir), 0)


@register("SELECT node, min(d) AS distance FROM walk GROUP BY node", more=EDGE_SQL.strip() + ", walk AS (WITH RECURSIVE w(node, d, hops) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS DOUBLE), 0 UNION SELECT twoway.dst, w.d + twoway.weight, w.hops + 1 FROM w JOIN twoway ON twoway.src = w.node WHERE w.hops < 9) SELECT * FROM w)")
def graph_shortest_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.shortest_distances(nation_edges(spark, sf_dir), 0).select("node", "distance")


@register(None)
def graph_dead_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.pruned_dead_ends(trade_edges(spark, sf_dir)).select("src", "dst")


@register(None)
def graph_spanning_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.minimum_spanning_tree(nation_edges(spark, sf_dir))


@register("SELECT CASE WHEN odd = 0 THEN 'circuit' WHEN odd = 2 THEN 'path' ELSE 'none' END AS kind, odd FROM (SELECT CAST(sum(d % 2) AS BIGINT) AS odd FROM (SELECT count(*) AS d FROM twoway GROUP BY src))")
def graph_eulerianity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.eulerianity(nation_edges(spark, sf_dir)).select("kind", "odd")


@register("SELECT src, dst, min(weight) AS weight FROM (SELECT src, dst, weight FROM edges UNION ALL SELECT src, dst, weight / 2 FROM edges WHERE src < 5) GROUP BY src, dst")
def graph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = spark.range(25).select("id", F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    own = nation_edges(spark, sf_dir)
    other = own.where("src < 5").withColumn("weight", F.col("weight") / 2)
    return graphs.merged([(nodes, own), (nodes, other)])[1].select("src", "dst", "weight")


@register("SELECT src, dst, CAST(least(floor((src % 5) / 4.0 * 2), 1) + 2 * least(floor((src // 5) / 4.0 * 3), 2) AS INTEGER) AS tile, least(floor((src % 5) / 4.0 * 2), 1) + 2 * least(floor((src // 5) / 4.0 * 3), 2) <> least(floor((dst % 5) / 4.0 * 2), 1) + 2 * least(floor((dst // 5) / 4.0 * 3), 2) AS crosses FROM edges")
def graph_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = spark.range(25).select("id", (F.col("id") % 5).cast("double").alias("x"), F.floor(F.col("id") / 5).cast("double").alias("y"))
    return graphs.partition(nodes, nation_edges(spark, sf_dir), 3, 2)[1].select("src", "dst", "tile", "crosses")


@register("SELECT CAST(src % 5 AS DOUBLE) AS x1, CAST(dst % 5 AS DOUBLE) AS x2, weight, false AS oneway FROM edges")
def graph_to_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = spark.range(25).select("id", (F.col("id") % 5).cast("double").alias("x"), F.floor(F.col("id") / 5).cast("double").alias("y"))
    out = graphs.to_features(nation_edges(spark, sf_dir), nodes)
    return out.select(F.col("line")[0]["x"].alias("x1"), F.col("line")[1]["x"].alias("x2"), "weight", "oneway")


@register("SELECT 1 AS path, sum(weight) AS length FROM twoway WHERE (src, dst) IN ((0, 1), (1, 3), (3, 7))")
def graph_path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = spark.createDataFrame([(1, k, n) for k, n in enumerate((0, 1, 3, 7))], "path int, place int, node long")
    return graphs.path_length(path, nation_edges(spark, sf_dir))


@register("SELECT id FROM supplier_pt WHERE lon BETWEEN 0 AND 60", "supplier_pt", more="")
def graph_node_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir, "supplier_pt").where("lon between 0 and 60").select("id")
