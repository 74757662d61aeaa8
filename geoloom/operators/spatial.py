"""Spatial joins and collection operators on DataFrames.

Joins between layers are equi-joins on square grid cells followed by an exact
test. The side with an extent is replicated to the cells that its box covers,
the point side to its own cell, so a pair meets once and needs no distinct. A
box over MOST_CELLS cells takes cells of twice the size, and so on, and points
look once into each size that is in use; AQE splits a hot cell. Shapes may cross
the antimeridian.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geodesy as G
from geoloom.functions import lines as L


def cell(v: Column, size: float | Column) -> Column:
    return F.floor(v / size).cast("long")


#: Most cells that one shape is replicated to, but for one more row and column where it lies across cells' edges.
MOST_CELLS, MOST_LEVEL = 256, 24


def turns(low: Column, high: Column) -> Column:
    """[low, high] of longitudes that may pass 180 as an array of ranges (a, b) within [-180, 180]."""
    part = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    middle = part(F.greatest(low, F.lit(-180.0)), F.least(high, F.lit(180.0)))
    return F.array_compact(F.array(middle, F.when(high > 180, part(F.lit(-180.0), F.least(high - 360.0, F.lit(180.0)))), F.when(low < -180, part(F.greatest(low + 360.0, F.lit(-180.0)), F.lit(180.0)))))


def cover(df: DataFrame, xmin: Column, ymin: Column, xmax: Column, ymax: Column, size: float) -> DataFrame:
    """df once for each cell (_level, _cx, _cy) that the box touches; a box whose xmin exceeds xmax crosses the antimeridian."""
    high = F.when(xmin > xmax, xmax + 360.0).otherwise(xmax)
    span = lambda k, extent: extent / (size * F.pow(F.lit(2.0), k)) + 1
    fits = F.filter(F.sequence(F.lit(0), F.lit(MOST_LEVEL)), lambda k: span(k, high - xmin) * span(k, ymax - ymin) <= MOST_CELLS)
    out = df.withColumn("_level", F.coalesce(F.try_element_at(fits, F.lit(1)), F.lit(MOST_LEVEL)))
    wide = size * F.pow(F.lit(2.0), F.col("_level"))
    columns = F.array_distinct(F.flatten(F.transform(turns(xmin, high), lambda t: F.sequence(cell(t["a"], wide), cell(t["b"], wide)))))
    return out.withColumn("_cx", F.explode(columns)).withColumn("_cy", F.explode(F.sequence(cell(ymin, wide), cell(ymax, wide))))


def points_in_polygons(points: DataFrame, polygons: DataFrame, ring: str = "ring", size: float = 5.0, how: str = "inner") -> DataFrame:
    """points (lon, lat, ...) x polygons (ring, ...) where the ring holds the point; boundaries are inside.

    how="left_semi" gives the points inside any polygon.
    """
    boxed = polygons.withColumn("_b", L.bounds(L.unwrapped(F.col(ring))))
    cells = cover(boxed, F.col("_b.xmin"), F.col("_b.ymin"), F.col("_b.xmax"), F.col("_b.ymax"), size)
    levels = sorted(r[0] for r in cells.select("_level").distinct().collect())
    lon, lat = F.col("lon"), F.col("lat")
    in_box = lambda x: (x >= F.col("_b.xmin")) & (x <= F.col("_b.xmax"))
    near = (in_box(lon) | in_box(lon + 360.0) | in_box(lon - 360.0)) & (lat >= F.col("_b.ymin")) & (lat <= F.col("_b.ymax"))
    on = (F.col("_at") == F.col("_level")) & (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy")) & near & L.ring_contains(F.col(ring), lon, lat)

    def joined(own: DataFrame, at: list, kind: str) -> DataFrame:
        wide = size * F.pow(F.lit(2.0), F.col("_at"))
        own = own.withColumn("_at", F.explode(F.array(*[F.lit(k) for k in at]).cast("array<int>")))
        own = own.withColumn("_px", cell(lon, wide)).withColumn("_py", cell(lat, wide))
        return own.join(cells.where(F.col("_level").isin(at)), on, kind).drop("_at", "_px", "_py", "_level", "_cx", "_cy", "_b")

    if how != "left_semi" or len(levels) < 2:
        return joined(points, levels, how)
    # A point inside polygons of several levels counts once: each level is asked for what the ones before haven't found.
    found = [joined(points, levels[:1], "left_semi")]
    rest = points
    for before, at in zip(levels, levels[1:]):
        rest = joined(rest, [before], "left_anti")
        found.append(joined(rest, [at], "left_semi"))
    return functools.reduce(DataFrame.unionByName, found)


def shapes_join(left: DataFrame, right: DataFrame, size: float = 5.0, test: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """left (lid, left_shape, left_box) x right (rid, right_shape, right_box) whose shapes meet, or for which test(left, right) holds.

    Shapes are GeoJSON, boxes are structs (xmin, ymin, xmax, ymax) with xmin above
    xmax across the antimeridian. Both sides go to the cells of their boxes, so a
    large side is replicated by its own size only; a pair that shares several
    cells is kept in the one of its boxes' common corner, and only pairs whose
    boxes meet reach the exact test.
    """
    from geoloom.functions import shapes as K

    # Both sides use one size: the least level at which neither needs more than MOST_CELLS for its largest shape.
    def wide(df: DataFrame, box: str) -> Column:
        b = F.col(box)
        return F.greatest(F.when(b["xmin"] > b["xmax"], b["xmax"] + 360.0).otherwise(b["xmax"]) - b["xmin"], b["ymax"] - b["ymin"])

    extent = max((df.agg(F.max(wide(df, box))).first()[0] or 0.0) for df, box in ((left, "left_box"), (right, "right_box")))
    while (extent / size + 1) ** 2 > MOST_CELLS:
        size *= 2
    put = lambda df, box: cover(df, *[F.col(f"{box}.{c}") for c in ("xmin", "ymin", "xmax", "ymax")], size).drop("_level")
    pairs = put(left, "left_box").join(put(right, "right_box"), ["_cx", "_cy"])
    a, b = F.col("left_box"), F.col("right_box")
    plain = (a["xmin"] <= a["xmax"]) & (b["xmin"] <= b["xmax"])
    corner = (F.col("_cx") == cell(F.greatest(a["xmin"], b["xmin"]), size)) & (F.col("_cy") == cell(F.greatest(a["ymin"], b["ymin"]), size))
    meet = (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])
    once = pairs.where(plain & corner & meet).drop("_cx", "_cy")
    across = pairs.where(~plain).drop("_cx", "_cy").dropDuplicates(["lid", "rid"])
    return once.unionByName(across).where((test or K.intersects)(F.col("left_shape"), F.col("right_shape")))


def collect(polygons: DataFrame, points: DataFrame, polygon_id: str, value: str, order: str, out: str, size: float = 5.0) -> DataFrame:
    """polygons with an array of a property of the points inside each, in point order; empty where there are none."""
    slim = points.select("lon", "lat", F.col(order).alias("_o"), F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    inside = points_in_polygons(slim, polygons.select(polygon_id, "ring"), size=size)
    lists = inside.groupBy(polygon_id).agg(F.transform(F.sort_array(F.collect_list(F.struct("_o", "_v"))), lambda s: s["_v"]).alias(out))
    joined = polygons.join(lists, polygon_id, "left")
    return joined.withColumn(out, F.coalesce(out, F.array().cast(lists.schema[out].dataType)))


def within_distance(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """left (lid, lon, lat) x right (rid, rlon, rlat) no farther apart than `metres`, with the distance.

    Latitude bands as high as the distance, and in each band longitude cells as
    wide as it is at the band's far edge; the left side looks in its own and the
    neighbouring cells, and longitudes wrap.
    """
    band = metres / (G.EARTH_RADIUS * 3.141592653589793 / 180.0) * 1.0001
    row = lambda lat: F.floor((lat + 90.0) / band).cast("long")
    edge = lambda r: F.least(F.greatest(F.abs(r * band - 90.0), F.abs((r + 1) * band - 90.0)) + band, F.lit(89.9))
    # Width at which two points a distance apart are in neighbouring cells of the row.
    columns = lambda r: F.greatest(F.floor(360.0 / (2 * F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(metres / G.EARTH_RADIUS / 2)) / F.cos(F.radians(edge(r)))))) * 1.0001)), F.lit(1)).cast("long")
    column = lambda lon, r: F.least(F.floor((G.normalise(lon) + 180.0) / 360.0 * columns(r)).cast("long"), columns(r) - 1)
    stored = right.withColumn("_r", row(F.col("rlat"))).withColumn("_c", column(F.col("rlon"), F.col("_r")))
    asked = left.withColumn("_r", F.explode(F.array(*[row(F.col("lat")) + k for k in (-1, 0, 1)])))
    near = F.array_distinct(F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]), lambda k: F.pmod(column(F.col("lon"), F.col("_r")) + k, columns(F.col("_r")))))
    # Dealt by cell in any case: a small right side would be broadcast and leave the work to the splits of the left one.
    asked = asked.withColumn("_c", F.explode(near)).repartition("_r", "_c")
    d = G.distance(F.col("lon"), F.col("lat"), F.col("rlon"), F.col("rlat"))
    return asked.join(stored, ["_r", "_c"]).withColumn("distance", d).where(F.col("distance") <= metres).drop("_r", "_c")


def nearest(left: DataFrame, right: DataFrame, start: float = 200_000.0) -> DataFrame:
    """The nearest right point of each left one (lid, rid, distance), by widening searches for those still without.

    A round is written before the next, which asks for the points left over only.
    """
    from geoloom.operators.graphs import settled

    found, left_over, metres = None, left, start
    while True:
        near = within_distance(left_over, right, metres)
        best = near.groupBy("lid").agg(F.min(F.struct("distance", "rid")).alias("b")).select("lid", F.col("b.rid").alias("rid"), F.col("b.distance").alias("distance"))
        best = settled(best)
        found = best if found is None else found.unionByName(best)
        left_over = settled(left_over.join(best.select("lid"), "lid", "left_anti"))
        if metres > 20_100_000 or left_over.isEmpty():
            return found
        metres *= 3


def flattened(multi: DataFrame, parts: str) -> DataFrame:
    """One row per member of a multi-geometry, with its place."""
    return multi.select("*", F.posexplode(parts).alias("part", "geometry")).drop(parts)


def properties_summary(features: DataFrame, properties: str = "properties") -> DataFrame:
    """key, value of every distinct top-level property value."""
    exploded = features.select(F.explode(F.try_variant_get(F.col(properties), "$", "map<string,variant>")).alias("key", "value"))
    return exploded.select("key", F.to_json("value").alias("value")).distinct()


def sample(features: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """Exactly n features (or all), chosen by a seeded hash of their key."""
    return features.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def centre_mean(points: DataFrame, weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Weighted mean of the coordinates; weights of zero or less are skipped."""
    w = F.col(weight) if weight else F.lit(1.0)
    used = points.where(w > 0) if weight else points
    return used.groupBy(*(by or [])).agg((F.sum(F.col("lon") * w) / F.sum(w)).alias("x"), (F.sum(F.col("lat") * w) / F.sum(w)).alias("y"))


def centre_median(points: DataFrame, weight: str | None = None, tolerance: float = 10.0, rounds: int = 10) -> tuple[float, float]:
    """Geometric median in degree space by Weiszfeld's iteration from the mean: one small aggregate a round."""
    start = centre_mean(points, weight).first()
    x, y = start["x"], start["y"]
    if x is None:
        return x, y
    w = F.col(weight) if weight else F.lit(1.0)
    used = (points.where(w > 0) if weight else points).select("lon", "lat", w.cast("double").alias("w"))
    for _ in range(rounds):
        d = F.sqrt((F.col("lon") - x) * (F.col("lon") - x) + (F.col("lat") - y) * (F.col("lat") - y))
        pull = F.when(d > 0, F.col("w") / d).otherwise(0.0)
        row = used.agg(F.sum(F.col("lon") * pull).alias("x"), F.sum(F.col("lat") * pull).alias("y"), F.sum(pull).alias("p")).first()
        if not row["p"]:
            break
        nx, ny = row["x"] / row["p"], row["y"] / row["p"]
        moved = ((nx - x) ** 2 + (ny - y) ** 2) ** 0.5
        x, y = nx, ny
        if moved <= tolerance / G.METRES_PER_DEGREE:
            break
    return x, y


def kmeans(points: DataFrame, k: int, key: str = "id", seed_index: int = 0, rounds: int = 100) -> DataFrame:
    """points with cluster and centroid: starts from k consecutive points by key, haversine assignment, planar means.

    The k centroids are the only thing on the driver; assignment is an expression.
    """
    first = points.orderBy(key).offset(seed_index).limit(k).select("lon", "lat").collect()
    centres = [(r["lon"], r["lat"]) for r in first]

    def assigned(c: list) -> Column:
        return F.array_min(F.array(*[F.struct(G.distance(F.col("lon"), F.col("lat"), F.lit(x), F.lit(y)).alias("d"), F.lit(i).alias("cluster")) for i, (x, y) in enumerate(c)]))["cluster"]

    for _ in range(rounds):
        means = {r["cluster"]: (r["x"], r["y"]) for r in points.groupBy(assigned(centres).alias("cluster")).agg(F.avg("lon").alias("x"), F.avg("lat").alias("y")).collect()}
        new = [means.get(i, c) for i, c in enumerate(centres)]
        if max((abs(a - c) + abs(b - d) for (a, b), (c, d) in zip(new, centres)), default=0.0) < 1e-12:
            break
        centres = new
    where = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in centres])
    return points.withColumn("cluster", assigned(centres)).withColumn("centroid", F.element_at(where, F.col("cluster") + 1))


def _reach_cells(metres: float) -> tuple[Callable, Callable]:
    """(put, near): columns (_r, _c) of cells whose points are all within `metres` of each other, and the array of cells that hold what is within it of a cell.

    By the haversine formula, where the squared half sines of a cell's height and of
    its width at its lower latitude are half that of the distance each at most.
    """
    half = math.sin(min(metres / G.EARTH_RADIUS, math.pi) / 2)
    side = half / math.sqrt(2) * 0.999
    height = math.degrees(2 * math.asin(side))
    rows = math.ceil(180.0 / height)
    low = lambda r: F.greatest(F.lit(0.0), F.least(F.abs(r * height - 90.0), F.abs((r + 1) * height - 90.0)) * F.when((r * height < 90.0) & ((r + 1) * height > 90.0), 0.0).otherwise(1.0))
    high = lambda r: F.least(F.lit(90.0), F.greatest(F.abs(r * height - 90.0), F.abs((r + 1) * height - 90.0)))
    turn = lambda sine, lat: 2 * F.degrees(F.asin(F.least(F.lit(1.0), F.lit(sine) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-12)))))
    columns = lambda r: F.ceil(360.0 / turn(side, low(r))).cast("long")
    column = lambda turned, n: F.floor(turned / 360.0 * n).cast("long")

    def put(df: DataFrame) -> DataFrame:
        own = df.withColumn("_r", F.least(F.floor((F.col("lat") + 90.0) / height).cast("long"), F.lit(rows - 1)))
        n = columns(F.col("_r"))
        return own.withColumn("_c", F.least(column(G.normalise(F.col("lon")) + 180.0, n), n - 1))

    def near(df: DataFrame) -> DataFrame:
        """df with (_nr, _nc) once for each cell in reach of (_r, _c), itself included."""
        own = df.withColumn("_nr", F.explode(F.sequence(F.greatest(F.col("_r") - 2, F.lit(0)), F.least(F.col("_r") + 2, F.lit(rows - 1)))))
        n, m = columns(F.col("_r")), columns(F.col("_nr"))
        wide = turn(half * 1.0001, F.greatest(high(F.col("_r")), high(F.col("_nr"))) + 1e-9)
        first, last = column(F.col("_c") * 360.0 / n - wide - 1e-9, m), column((F.col("_c") + 1) * 360.0 / n + wide + 1e-9, m)
        some = F.sequence(first, F.least(last, first + m - 1))
        return own.withColumn("_nc", F.explode(F.array_distinct(F.transform(some, lambda k: F.pmod(k, m)))))

    return put, near


def dbscan(points: DataFrame, metres: float, min_points: int = 3) -> DataFrame:
    """id, dbscan (core, edge, noise), cluster (least core id of the cluster; null for noise).

    A core point has min_points others within reach; an edge point takes the
    least cluster that reaches it.

    Pairs of points are never listed. All points of a cell are within reach of each
    other, so those of a cell of over min_points are core points, and the core
    points of a cell are one cluster. The neighbours of the other points, at most
    min_points a cell, are counted as they are joined. Clusters are components of
    cells: two are linked where their outermost core points reach each other, or
    else, if they aren't in one component by then, where any of their points do.
    """
    from geoloom.operators.graphs import components, settled

    put, near = _reach_cells(metres)
    known = F.col("id").isNotNull() & F.coalesce(~F.isnan(F.col("lon") + F.col("lat")), F.lit(False))
    own = put(points.where(known).select("id", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")))
    full = settled(own.join(own.groupBy("_r", "_c").agg(F.count(F.lit(1)).alias("_n")), ["_r", "_c"]))
    asked = near(full.where(F.col("_n") <= min_points).select("id", "lon", "lat", "_r", "_c"))
    reach = lambda a, b: G.distance(a["lon"], a["lat"], b["lon"], b["lat"]) <= metres

    def reached(left: DataFrame, right: DataFrame) -> DataFrame:
        """left (id, lon, lat, _nr, _nc) with the id and columns of what is within reach in its cells."""
        other = right.select(F.struct("lon", "lat").alias("_q"), F.col("id").alias("_other"), F.col("_r").alias("_nr"), F.col("_c").alias("_nc"), *[c for c in right.columns if c not in ("id", "lon", "lat", "_r", "_c", "_n", "_core")])
        return left.join(other, ["_nr", "_nc"]).where(reach(F.struct("lon", "lat"), F.col("_q")))

    counts = reached(asked, full).where("id <> _other").groupBy("id").agg(F.count(F.lit(1)).alias("_k"))
    few = full.where(F.col("_n") <= min_points).join(counts, "id", "left").withColumn("_core", F.coalesce(F.col("_k") >= min_points, F.lit(False))).select(*full.columns, "_core")
    marked = settled(full.where(F.col("_n") > min_points).withColumn("_core", F.lit(True)).unionByName(few))
    core, rest = marked.where("_core"), marked.where("not _core")

    # A cell is known by its least core id, so a component's least node is the cluster.
    at = F.struct("lon", "lat")
    outer = F.array_distinct(F.array(F.min_by(at, "lat"), F.max_by(at, "lat"), F.min_by(at, "lon"), F.max_by(at, "lon")))
    cells = settled(core.groupBy("_r", "_c").agg(F.min("id").alias("_node"), outer.alias("_outer"), F.min("lat").alias("_low"), F.max("lat").alias("_high")))
    other = cells.select(*[F.col(c).alias(f"{c}2") for c in cells.columns]).withColumnsRenamed({"_r2": "_nr", "_c2": "_nc"})
    pairs = near(cells).join(other, ["_nr", "_nc"]).where("_node < _node2")
    pairs = settled(pairs.withColumn("_met", F.exists("_outer", lambda p: F.exists("_outer2", lambda q: reach(p, q)))).drop("_outer", "_outer2"))
    links = pairs.where("_met").select(F.col("_node").alias("src"), F.col("_node2").alias("dst")).unionByName(cells.select(F.col("_node").alias("src"), F.col("_node").alias("dst")))
    label = components(links)
    of = lambda a, b: label.select(F.col("node").alias(a), F.col("component").alias(b))
    apart = pairs.where("not _met").join(of("_node", "_k1"), "_node").join(of("_node2", "_k2"), "_node2").where("_k1 <> _k2")
    band = math.degrees(metres / G.EARTH_RADIUS) * 1.0001
    in_band = lambda lat, low, high: (lat >= F.col(low) - band) & (lat <= F.col(high) + band)
    left = apart.join(core.select("lon", "lat", "_r", "_c"), ["_r", "_c"]).where(in_band(F.col("lat"), "_low2", "_high2"))
    more = settled(reached(left.drop("_r", "_c").withColumn("id", F.lit(0)), core).where(in_band(F.col("_q.lat"), "_low", "_high")).select(F.col("_node").alias("src"), F.col("_node2").alias("dst")).distinct())
    if not more.isEmpty():
        label = components(links.unionByName(more))

    clustered = core.join(cells.select("_r", "_c", F.col("_node").alias("node")).join(label, "node").select("_r", "_c", F.col("component").alias("cluster")), ["_r", "_c"]).select("id", "lon", "lat", "_r", "_c", "cluster")
    edge = reached(near(rest.select("id", "lon", "lat", "_r", "_c")), clustered).groupBy("id").agg(F.min("cluster").alias("cluster"))
    outside = rest.select("id").join(edge, "id", "left").select("id", F.when(F.col("cluster").isNotNull(), "edge").otherwise("noise").alias("dbscan"), "cluster")
    noise = points.where(~known).select("id", F.lit("noise").alias("dbscan"), F.lit(None).cast(points.schema["id"].dataType).alias("cluster"))
    return clustered.select("id", F.lit("core").alias("dbscan"), "cluster").unionByName(outside).unionByName(noise)
