"""Geographic layers derived from the relational tables by integer arithmetic.

Each layer has a Spark form and a SQL form (common table expressions for the
checks); both give the same numbers. Distances and the like are rounded by the
queries, not here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

D = "CAST(100 AS DOUBLE)"

POINT_SQL = {
    "customer_pt": f"SELECT c_custkey AS id, ((c_custkey * 7919) % 36000) / {D} - 179.9963 AS lon, ((c_custkey * 104729) % 17000) / {D} - 84.9971 AS lat, c_nationkey AS nation, c_mktsegment AS segment, c_acctbal AS acctbal FROM customer",
    "supplier_pt": f"SELECT s_suppkey AS id, ((s_suppkey * 6101 + 17) % 36000) / {D} - 179.9913 AS lon, ((s_suppkey * 15101 + 11) % 17000) / {D} - 84.9937 AS lat, s_nationkey AS nation, s_acctbal AS acctbal FROM supplier",
    "order_pt": f"SELECT o_orderkey AS id, o_custkey AS cust, o_orderdate AS ts, ((o_orderkey * 7919) % 9000) / {D} - 44.9963 AS lon, ((o_orderkey * 104729) % 6000) / {D} - 29.9971 AS lat, o_totalprice AS price FROM orders",
    "nation_box": "SELECT n_nationkey AS id, n_regionkey AS region, (n_nationkey % 5) * 60 - 149.871 AS xmin, floor(n_nationkey / CAST(5 AS DOUBLE)) * 30 - 74.913 AS ymin, (n_nationkey % 5) * 60 - 99.501 AS xmax, floor(n_nationkey / CAST(5 AS DOUBLE)) * 30 - 52.803 AS ymax FROM nation",
}
TABLE_OF = {"customer_pt": "customer", "supplier_pt": "supplier", "order_pt": "orders", "nation_box": "nation"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    select = POINT_SQL[name]
    head, source = select[len("SELECT ") :].rsplit(" FROM ", 1)
    own = table(spark, sf_dir, source)
    depth, start, parts = 0, 0, []
    for k, ch in enumerate(head):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(head[start:k].strip())
            start = k + 1
    parts.append(head[start:].strip())
    doubles = {"lon", "lat", "xmin", "ymin", "xmax", "ymax"}
    out = []
    for p in parts:
        expr, name_ = p.rsplit(" AS ", 1)
        c = F.expr(expr)
        out.append((c.cast("double") if name_ in doubles else c).alias(name_))
    return own.select(*out)


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id (customer), line: the customer's order points by date and key, where there are two or more."""
    pts = points(spark, sf_dir, "order_pt").groupBy("cust").agg(F.sort_array(F.collect_list(F.struct("ts", "id", "lon", "lat"))).alias("p"))
    line = F.transform("p", lambda c: F.struct(c["lon"].alias("x"), c["lat"].alias("y")))
    return pts.where(F.size("p") > 1).select(F.col("cust").alias("id"), line.alias("line"))


LINE_SQL = "SELECT cust AS id, list({'x': lon, 'y': lat} ORDER BY ts, id) AS line FROM order_pt GROUP BY cust HAVING count(*) > 1"


def customer_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lon, lat, nation, ring: a closed counter-clockwise star-shaped octagon around an inner point of each customer."""
    pts = customer_inner(spark, sf_dir)
    radius = lambda k: 1 + ((F.col("id") * 31 + (k % 8) * 17) % 50) / F.lit(25.0)
    vertex = lambda k: F.struct((F.col("lon") + radius(k) * F.cos(F.radians((k % 8) * 45.0))).alias("x"), (F.col("lat") + radius(k) * F.sin(F.radians((k % 8) * 45.0))).alias("y"))
    return pts.withColumn("ring", F.transform(F.sequence(F.lit(0), F.lit(8)), vertex))


def customer_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer_pt moved to longitudes within 170 and latitudes within 75, so that rings stay inside the world."""
    return points(spark, sf_dir, "customer_pt").withColumn("lon", F.col("lon") * 0.9).withColumn("lat", F.col("lat") * 0.8)


INNER_SQL = "SELECT id, lon * 0.9 AS lon, lat * 0.8 AS lat, nation, segment, acctbal FROM customer_pt"
RING_SQL = (
    "SELECT id, lon, lat, nation, list_transform(range(0, 9), lambda k: {'x': lon + (1 + ((id * 31 + (k % 8) * 17) % 50) / 25.0) * cos(radians((k % 8) * 45.0)), "
    "'y': lat + (1 + ((id * 31 + (k % 8) * 17) % 50) / 25.0) * sin(radians((k % 8) * 45.0))}) AS ring FROM customer_inner"
)

ALL_SQL = {**POINT_SQL, "order_line": LINE_SQL, "customer_inner": INNER_SQL, "customer_ring": RING_SQL}
NEEDS = {"order_line": ["order_pt"], "customer_inner": ["customer_pt"], "customer_ring": ["customer_pt", "customer_inner"]}


def with_layers(body: str, *names: str, more: str = "") -> str:
    """A SELECT with the layers it names as common table expressions."""
    order: list[str] = []
    for n in names:
        for k in (*NEEDS.get(n, []), n):
            if k not in order:
                order.append(k)
    parts = [f"{n} AS ({ALL_SQL[n]})" for n in order] + ([more] if more else [])
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body
