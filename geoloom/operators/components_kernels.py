"""Graph kernels applied per connected component, and per source over a shared graph."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.kernels import routing
from geoloom.operators import graphs

#: Largest edge table that a task holds whole; larger graphs take the iterative operators in graphs.
MOST_EDGES = 5_000_000


def checked(edges: DataFrame) -> None:
    n = edges.limit(MOST_EDGES + 1).count()
    if n > MOST_EDGES:
        raise ValueError(f"over {MOST_EDGES} edges; use the iterative operators")


def per_component(edges: DataFrame, kernel: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    """kernel(adjacency) -> rows, once for each connected component."""
    label = graphs.components(edges)
    keyed = edges.join(label, edges["src"] == label["node"]).select("component", "src", "dst", "weight", "is_directed")
    names = [f.name for f in keyed.sparkSession.createDataFrame([], schema).schema]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = routing.adjacency(pdf[["src", "dst", "weight", "is_directed"]].itertuples(index=False))
        return pd.DataFrame(kernel(g), columns=names)

    return keyed.groupBy("component").applyInPandas(run, schema)


def betweenness(edges: DataFrame) -> DataFrame:
    """(node, centrality): sources dealt over tasks, each with the graph at hand; halved where undirected."""
    checked(edges)
    rows = [tuple(r) for r in edges.select("src", "dst", "weight", "is_directed").collect()]
    g = routing.adjacency(rows)
    shared = edges.sparkSession.sparkContext.broadcast(g)
    half = not any(r[3] for r in rows)

    def run(batches):
        for pdf in batches:
            out: dict = dict.fromkeys(pdf["node"].tolist(), 0.0)
            for v in pdf["node"]:
                for u, share in routing.betweenness_from(shared.value, int(v)).items():
                    out[u] = out.get(u, 0.0) + share
            yield pd.DataFrame({"node": list(out), "c": list(out.values())})

    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    parts = nodes.repartition(8, "node").mapInPandas(run, "node long, c double")
    return parts.groupBy("node").agg((F.sum("c") / (2 if half else 1)).alias("centrality"))
