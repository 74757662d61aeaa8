"""Clusters by cells against all pairs of points."""

import random

import pytest

from geoloom.kernels.predicates import haversine
from geoloom.operators import spatial


def by_all_pairs(pts, metres, least):
    near = {i: [j for j, q in pts.items() if j != i and haversine(p, q) <= metres] for i, p in pts.items()}
    core, label = {i for i in pts if len(near[i]) >= least}, {}
    for i in sorted(core):
        stack = [] if i in label else [i]
        label.setdefault(i, i)
        while stack:
            for j in near[stack.pop()]:
                if j in core and j not in label:
                    label[j] = label[i]
                    stack.append(j)
    reached = {i: min((label[j] for j in near[i] if j in core), default=None) for i in pts}
    return {i: ("core", label[i]) if i in core else ("noise" if reached[i] is None else "edge", reached[i]) for i in pts}


@pytest.mark.parametrize("metres, n, place", [
    (450e3, 250, lambda r: (r.uniform(-180, 180), r.uniform(-90, 90))),
    (100e3, 200, lambda r: (r.choice((0, 3, 179.5, -179.5)) + r.gauss(0, 0.6), r.choice((0, 50, -89)) + r.gauss(0, 0.4))),
])
def test_clusters(spark, metres, n, place):
    r = random.Random(n)
    pts = {i: ((p[0] + 180) % 360 - 180, max(-90.0, min(90.0, p[1]))) for i, p in enumerate(place(r) for _ in range(n))}
    df = spark.createDataFrame([(i, *p) for i, p in pts.items()] + [(n, None, 1.0)], "id long, lon double, lat double")
    assert {x["id"]: (x["dbscan"], x["cluster"]) for x in spatial.dbscan(df, metres).collect()} == by_all_pairs(pts, metres, 3) | {n: ("noise", None)}


def test_many_points_in_one_place_list_no_pairs(spark):
    """Thirty thousand points within a metre, which have 450 million pairs."""
    df = spark.range(30_000).selectExpr("id", "id * 1e-10 AS lon", "0.0D AS lat")
    assert [tuple(r) for r in spatial.dbscan(df, 1000.0).groupBy("dbscan", "cluster").count().collect()] == [("core", 0, 30_000)]
