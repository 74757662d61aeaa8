"""Graphs as node and edge tables: relational and iterative operators.

Edges are (src, dst, weight, is_directed); an undirected edge is stored once and
looked at both ways. Iterations write each round to the session's checkpoint
folder where one is set, so lineage stays short and lost executors cost a round.
"""

from __future__ import annotations

import itertools
import os
import tempfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import geodesy as G
from geoloom.operators.hubs import hub_join, hubs_of


def settled(df: DataFrame) -> DataFrame:
    """df behind a reliable checkpoint in the configured folder (a temporary one only on a single machine)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = os.path.join(tempfile.gettempdir(), "geoloom-checkpoints")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def rounds(most: int | None) -> Iterator[int]:
    """0, 1, ...; raises when a caller that isn't done asks for more than `most` rounds (None: no bound)."""
    for k in itertools.count():
        if k == most:
            raise RuntimeError(f"not settled after {most} rounds")
        yield k


def both_ways(edges: DataFrame) -> DataFrame:
    """src, dst, weight of every stored direction."""
    back = edges.where(~F.col("is_directed")).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return edges.select("src", "dst", "weight").unionByName(back)


def construct(lines: DataFrame, tolerance: float = 1.0, directed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, x, y), edges) of lines (id, line[, oneway]): a node for each grid cell of the tolerance, an edge for each segment."""
    scale = G.METRES_PER_DEGREE / tolerance
    key = lambda c: F.struct(F.round(c["x"] * scale).cast("long").alias("kx"), F.round(c["y"] * scale).cast("long").alias("ky"))
    n = F.size("line")
    pairs = F.zip_with(F.slice("line", F.lit(1), n - 1), F.slice("line", F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    oneway = F.lower(F.col("oneway").cast("string")).isin("yes", "1", "true") if directed and "oneway" in lines.columns else F.lit(False)
    seg = lines.where(n > 1).select("id", F.posexplode(pairs).alias("place", "s"), oneway.alias("is_directed"))
    seg = seg.select("id", "place", "is_directed", key(F.col("s.a")).alias("ka"), key(F.col("s.b")).alias("kb"), "s").where("ka <> kb")
    ends = seg.select(F.col("ka").alias("k"), F.struct("id", "place", F.lit(0).alias("e"), F.col("s.a.x").alias("x"), F.col("s.a.y").alias("y")).alias("first")).unionByName(
        seg.select(F.col("kb").alias("k"), F.struct("id", "place", F.lit(1).alias("e"), F.col("s.b.x").alias("x"), F.col("s.b.y").alias("y")).alias("first"))
    )
    spots = ends.groupBy("k").agg(F.min("first").alias("first"))
    nodes = spots.select(F.xxhash64("k").alias("id"), F.col("first.x").alias("x"), F.col("first.y").alias("y"))
    weight = G.distance(F.col("s.a.x"), F.col("s.a.y"), F.col("s.b.x"), F.col("s.b.y"))
    edges = seg.select(F.xxhash64("ka").alias("src"), F.xxhash64("kb").alias("dst"), weight.alias("weight"), "is_directed", F.col("id").alias("feature"))
    return nodes, edges


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("src").agg(F.count(F.lit(1)).alias("degree")).withColumnRenamed("src", "node")


def neighbours(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("neighbours")).withColumnRenamed("src", "node")


def unique_edges(edges: DataFrame) -> DataFrame:
    """Undirected edges once, whichever way they're stored; the least weight of parallel ones."""
    a = F.when(F.col("is_directed"), F.col("src")).otherwise(F.least("src", "dst"))
    b = F.when(F.col("is_directed"), F.col("dst")).otherwise(F.greatest("src", "dst"))
    return edges.select(a.alias("src"), b.alias("dst"), "weight", "is_directed").groupBy("src", "dst", "is_directed").agg(F.min("weight").alias("weight")).select("src", "dst", "weight", "is_directed")


def subgraph(nodes: DataFrame, edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Induced by keep(id)."""
    inside = edges.join(keep.select(F.col("id").alias("src")), "src", "left_semi").join(keep.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes.join(keep.select("id"), "id", "left_semi"), inside.select(*edges.columns)


def star_components(links: DataFrame, keep: Callable[[DataFrame], DataFrame], max_rounds: int | None = None) -> DataFrame:
    """(a, b) pairs -> (node, root): the least node of each node's component, for nodes on a pair of two.

    Alternating stars: a round links every node's larger neighbours to its least
    neighbour, then every node and its smaller neighbours to the least of them; at
    the end all pairs lead to roots. Rounds grow with the logarithm of a
    component's length. `keep` writes a round's table, so lineage stays short, and
    hubs are joined apart, so no node's pairs meet in one task.
    """
    now = keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = state(now)
    for _ in rounds(max_rounds):
        if not seen[0]:
            break
        # A node has no more smaller neighbours after the first step than before it, so its hubs are known here.
        above, below = hubs_of(now, ["b", "a"], seen[0])
        least = now.groupBy("a").agg(F.min("b").alias("m"))
        large = hub_join(now, least.withColumnRenamed("a", "b"), "b", above, "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = hub_join(large, least, "a", below).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = keep(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        before, seen = seen, state(now)
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(src, dst) -> (node, component): the least node reachable, ignoring direction."""
    alone = edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component")).distinct()
    found = settled(star_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), settled, max_rounds).withColumnRenamed("root", "component"))
    return found.unionByName(alone.join(found.select("node"), "node", "left_anti"))


def bfs_levels(edges: DataFrame, start: int, max_rounds: int | None = None) -> DataFrame:
    """(node, level) of the nodes reachable from start; the frontier is joined with the edges each round."""
    spark = edges.sparkSession
    out = both_ways(edges).select("src", "dst").distinct()
    seen = spark.createDataFrame([(start, 0)], "node long, level long")
    frontier = seen
    for level in map((1).__add__, rounds(max_rounds)):
        reached = frontier.join(out, frontier["node"] == out["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = settled(reached.select("node", F.lit(level).cast("long").alias("level")))
        if frontier.isEmpty():
            break
        seen = settled(seen.unionByName(frontier))
    return seen


def shortest_distances(edges: DataFrame, start: int, max_rounds: int | None = None) -> DataFrame:
    """(node, distance, previous) from start: Bellman-Ford on the frontier of improved nodes."""
    spark = edges.sparkSession
    out = settled(both_ways(edges).groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    # no best path has more edges than there are nodes, so only a negative cycle takes longer
    max_rounds = out.select("src").union(out.select("dst")).distinct().count() + 2 if max_rounds is None else max_rounds
    best = spark.createDataFrame([(start, 0.0, None)], "node long, distance double, previous long")
    frontier = best
    for _ in rounds(max_rounds):
        offer = frontier.join(out, frontier["node"] == out["src"]).select(F.col("dst").alias("node"), (F.col("distance") + F.col("weight")).alias("distance"), F.col("src").alias("previous"))
        offer = offer.groupBy("node").agg(F.min(F.struct("distance", "previous")).alias("o")).select("node", F.col("o.distance").alias("d"), F.col("o.previous").alias("p"))
        better = settled(offer.join(best, "node", "left").where("distance is null or d < distance - 1e-12").select("node", F.col("d").alias("distance"), F.col("p").alias("previous")))
        if better.isEmpty():
            break
        best = settled(best.join(better.select("node"), "node", "left_anti").unionByName(better))
        frontier = better
    return best


def pruned_dead_ends(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Edges left after removing nodes with one neighbour until there are none (the 2-core)."""
    left = settled(edges)
    for _ in rounds(max_rounds):
        pairs = left.select("src", "dst").unionByName(left.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
        leaf = pairs.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(F.col("src").alias("leaf"))
        leaf = settled(leaf)
        if leaf.isEmpty():
            break
        left = settled(left.join(leaf, left["src"] == leaf["leaf"], "left_anti").join(leaf, left["dst"] == leaf["leaf"], "left_anti"))
    return left


def minimum_spanning_tree(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Spanning forest (src, dst, weight) by Boruvka's rounds; ties by weight, then src, then dst."""
    pool = settled(unique_edges(edges.withColumn("is_directed", F.lit(False))).where("src <> dst").select("src", "dst", "weight"))
    label = settled(pool.select(F.col("src").alias("node")).unionByName(pool.select(F.col("dst").alias("node"))).distinct().withColumn("tree", F.col("node")))
    chosen = None
    for _ in range(max_rounds):
        a, b = label.select(F.col("node").alias("src"), F.col("tree").alias("ta")), label.select(F.col("node").alias("dst"), F.col("tree").alias("tb"))
        outer = pool.join(a, "src").join(b, "dst").where("ta <> tb")
        pick = F.min(F.struct("weight", "src", "dst")).alias("e")
        best = outer.groupBy(F.col("ta").alias("t")).agg(pick).unionByName(outer.groupBy(F.col("tb").alias("t")).agg(pick))
        best = settled(best.groupBy("t").agg(F.min("e").alias("e")).select("e.src", "e.dst", "e.weight").distinct())
        if best.isEmpty():
            break
        chosen = best if chosen is None else chosen.unionByName(best)
        merged = components(best.join(a, "src").join(b, "dst").select(F.col("ta").alias("src"), F.col("tb").alias("dst")))
        label = settled(label.join(merged, label["tree"] == merged["node"], "left").select(label["node"], F.coalesce("component", "tree").alias("tree")))
    return chosen if chosen is not None else pool


def eulerianity(edges: DataFrame) -> DataFrame:
    """One row: kind (circuit, path or none), odd (nodes of odd degree), parts (components with edges)."""
    odd = degrees(edges.withColumn("is_directed", F.lit(False))).agg(F.coalesce(F.sum(F.col("degree") % 2), F.lit(0)).alias("odd"))
    parts = components(edges).agg(F.countDistinct("component").alias("parts"))
    kind = F.when((F.col("parts") <= 1) & (F.col("odd") == 0), "circuit").when((F.col("parts") <= 1) & (F.col("odd") == 2), "path").otherwise("none")
    return odd.join(parts, F.lit(True)).select(kind.alias("kind"), "odd", "parts")


def merged(graphs: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Union of graphs whose nodes share an id scheme; the lightest of parallel edges stays."""
    nodes, edges = graphs[0]
    for n, e in graphs[1:]:
        nodes, edges = nodes.unionByName(n), edges.unionByName(e)
    return nodes.groupBy("id").agg(F.min(F.struct("x", "y")).alias("c")).select("id", "c.x", "c.y"), unique_edges(edges)


def partition(nodes: DataFrame, edges: DataFrame, rows: int, columns: int) -> tuple[DataFrame, DataFrame]:
    """(nodes with tile, edges with tile and crosses): half-open grid tiles over the nodes' extent."""
    e = nodes.agg(F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2")).first()
    part = lambda v, low, high, n: F.least(F.floor((F.col(v) - low) / ((high - low) or 1.0) * n), F.lit(n - 1)).cast("int")
    placed = nodes.withColumn("tile", part("y", e["y1"], e["y2"], rows) * columns + part("x", e["x1"], e["x2"], columns))
    a, b = placed.select(F.col("id").alias("src"), F.col("tile").alias("ta")), placed.select(F.col("id").alias("dst"), F.col("tile").alias("tb"))
    own = edges.join(a, "src").join(b, "dst")
    return placed, own.select(*edges.columns, F.col("ta").alias("tile"), (F.col("ta") != F.col("tb")).alias("crosses"))


def to_features(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One line feature per unique edge, with weight and oneway."""
    a, b = nodes.select(F.col("id").alias("src"), F.struct("x", "y").alias("a")), nodes.select(F.col("id").alias("dst"), F.struct("x", "y").alias("b"))
    own = unique_edges(edges).join(a, "src").join(b, "dst")
    return own.select(F.array("a", "b").alias("line"), "weight", F.col("is_directed").alias("oneway"))


def path_length(path: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, place, node) rows -> (path, length): the sum of the edge weights between successive nodes."""
    w = Window.partitionBy("path").orderBy("place")
    steps = path.withColumn("dst", F.lead("node").over(w)).where("dst is not null").withColumnRenamed("node", "src")
    out = both_ways(edges).groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    return steps.join(out, ["src", "dst"], "left").groupBy("path").agg(F.sum("weight").alias("length"))
