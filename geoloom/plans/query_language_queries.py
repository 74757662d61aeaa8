"""Query-language terms over customers and events, each checked against a plain WHERE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.plans import sqlgeo as S
from geoloom.plans.layers import points, table, with_layers
from geoloom.plans.query_language import query

QUERIES: dict = {}
ORACLES: dict = {}


def customer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as features whose properties are nested."""
    own = F.struct(
        F.col("id").alias("id"), F.col("segment").alias("segment"), F.struct(F.col("acctbal").alias("balance"), F.col("nation").alias("nation")).alias("account"),
        F.array(F.lit("pt"), F.lower("segment")).alias("tags"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("Customer "), F.col("id"))).alias("name"), (F.col("id") % 2 == 0).alias("even"),
    )
    return points(spark, sf_dir, "customer_pt").withColumn("properties", F.parse_json(F.to_json(own)))


def term(name: str, text: str, where: str, compat: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(customer_features(spark, sf_dir), text, compat=compat).select("id")

    QUERIES[name] = run
    ORACLES[name] = with_layers(f"SELECT id FROM customer_pt WHERE {where}", "customer_pt")


term("query_equals", '.segment == "BUILDING"', "segment = 'BUILDING'")
term("query_not_equals", ".account.nation != 7", "nation <> 7")
term("query_missing_is_false", '.name != "Customer 3"', "id % 3 = 0 AND id <> 3")
term("query_less", ".account.balance < 1000.5 and .id >= 20", "acctbal < 1000.5 AND id >= 20")
term("query_string_order", '.segment > "FURNITURE"', "segment > 'FURNITURE'")
term("query_regex", ".segment =~ /^(build|auto)/i", "regexp_matches(segment, '^(BUILD|AUTO)')")
term("query_contains", '.segment =* "uild"', "contains(lower(segment), 'uild')")
term("query_starts_ends", '.segment =^ "mach" or .segment =$ "hold"', "lower(segment) LIKE 'mach%' OR lower(segment) LIKE '%hold'")
term("query_in", '.account.nation in [1, 3, 5] and .segment in ["BUILDING", "MACHINERY"]', "nation IN (1, 3, 5) AND segment IN ('BUILDING', 'MACHINERY')")
term("query_left_to_right", ".account.nation == 1 or .account.nation == 2 and .even == true", "(nation = 1 OR nation = 2) AND id % 2 = 0")
term("query_group", ".even == true and (.account.nation == 1 or .account.nation == 2)", "id % 2 = 0 AND nation IN (1, 2)")
term("query_not", ".account.nation == 4 not", "nation <> 4")
term("query_not_prefix", "not .account.nation == 4 and .even", "nation <> 4 AND id % 2 = 0")
term("query_exists", ".name exists and .account.balance > 0", "id % 3 = 0 AND acctbal > 0")
term("query_compat_not", ".even and .account.nation == 3 not", "NOT (id % 2 = 0 AND nation = 3)", True)
term("query_array_path", '.tags.[1] == "building" and .tags[0] == "pt"', "segment = 'BUILDING'")
term("query_full_text", "customer 1", "id % 3 = 0 AND CAST(id AS VARCHAR) LIKE '1%'")
term("query_near", "near(48.2, 10.5, 3000000)", S.distance("lon", "lat", "10.5", "48.2") + " <= 3000000")
term("query_within", "within(-60, -40, 55, 45) and .even", "lon BETWEEN -60 AND 55 AND lat BETWEEN -40 AND 45 AND id % 2 = 0")
term("query_intersects", "intersects(-20, -20, 20, 20)", "lon BETWEEN -20 AND 20 AND lat BETWEEN -20 AND 20")


def query_event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = table(spark, sf_dir, "events").withColumn("properties", F.parse_json("props")).withColumn("lon", F.lit(0.0)).withColumn("lat", F.lit(0.0))
    return query(features, ".k >= 50 and .k < 80").select("event_id")


QUERIES["query_event_props"] = query_event_props
ORACLES["query_event_props"] = "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) >= 50 AND CAST(json_extract(props, '$.k') AS INTEGER) < 80"
