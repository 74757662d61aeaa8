"""Registered queries of the geographic engine, with the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

#: Modules that define QUERIES (name -> query) and ORACLES (name -> SQL).
PARTS = ("scalar_queries", "line_queries", "collection_queries", "query_language_queries", "graph_queries", "kernel_queries", "shape_queries")


def _gather(kind: str) -> dict:
    out: dict = {}
    for part in PARTS:
        out.update(getattr(importlib.import_module(f"geoloom.plans.{part}"), kind))
    return out


def queries() -> dict[str, Query]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLES")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers within 5,000 km of a point, counted with their balances by map tile."""
    from geoloom.functions import geodesy as G
    from geoloom.functions import tiles as T
    from geoloom.plans.layers import points

    near = points(spark, sf_dir, "customer_pt").where(G.distance(F.col("lon"), F.col("lat"), F.lit(10.5), F.lit(48.2)) <= 5_000_000)
    keyed = near.select(T.tile_x(F.col("lon"), 5).alias("tx"), T.tile_y(F.col("lat"), 5).alias("ty"), "acctbal")
    return keyed.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("acctbal"), 4).alias("avg_acctbal"))
