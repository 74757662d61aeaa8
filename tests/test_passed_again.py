"""Lines that pass a place again, repeat a vertex or run back to their start, and points just off an edge."""

from geoloom.kernels import planar as P
from geoloom.kernels import predicates as Q


def test_points_beside_an_edge(spark):
    """Three metres off an edge of 22 degrees is not on it."""
    from pyspark.sql import functions as F

    from geoloom.functions import lines as L

    ring = [(173.0, 45.087), (171.3, 67.197), (179.0, 67.0), (179.0, 45.087), (173.0, 45.087)]
    off, on = (172.2637, 54.6629), ((173.0 + 171.3) / 2, (45.087 + 67.197) / 2)
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in ring],)], "line array<struct<x: double, y: double>>")
    row = df.select(*[f("line", F.lit(x), F.lit(y)) for x, y in (off, on) for f in (lambda c, x, y: L.on_line(F.col(c), x, y), lambda c, x, y: L.ring_contains(F.col(c), x, y))]).first()
    assert list(row) == [False, False, True, True]
    assert not P.in_ring(off, ring) and P.in_ring(on, ring) and not Q.on_line(off, ring) and Q.on_line(on, ring)


def test_distance_to_the_first_pass():
    there_and_back = [(0.0, 0.0), (3.0, 1.0), (0.0, 0.0), (5.0, 5.0)]
    half = (1.5, 0.5)
    assert abs(Q.distance_along(there_and_back, half) - Q.haversine((0.0, 0.0), half)) < 1e-6
    assert Q.distance_along(there_and_back, (0.0, 0.0)) == 0


def test_crossings_of_a_line_that_comes_back(spark):
    from pyspark.sql import functions as F

    from geoloom.functions import lines as L

    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in ((0.0, 0.0), (0.0, 2.0), (0.0, 0.0), (1.0, 2.0))],)], "line array<struct<x: double, y: double>>")
    other = F.array(L.xy(F.lit(-5.0), F.lit(1.0)), L.xy(F.lit(5.0), F.lit(1.0)))
    assert list(df.select(F.size(L.intersections(F.col("line"), other)), F.size(L.intersections(F.col("line"), other, distinct=False))).first()) == [2, 3]


def test_slice_of_a_line_that_comes_back():
    for line in ([(0.0, 0.0), (0.0, 0.0), (3.0, 1.0), (5.0, 5.0)], [(0.0, 0.0), (3.0, 1.0), (0.0, 0.0), (4.0, 4.0), (3.0, 1.0)], [(0.0, 0.0), (3.0, 1.0), (7.0, 2.0), (7.0, 2.0)]):
        assert Q.slice_between(line, line[0], line[-1]) == line
    assert Q.slice_between([(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (3.0, 0.0)], (1.0, 0.0), (2.0, 0.0)) == [(1.0, 0.0), (2.0, 0.0)]


def test_split_at_a_place_passed_again():
    for line in ([(0.0, 0.0), (0.0, 0.0), (3.0, 1.0)], [(0.0, 0.0), (3.0, 1.0), (5.0, 5.0), (3.0, 1.0)], [(0.0, 0.0), (3.0, 1.0), (0.0, 0.0), (3.0, 1.0), (4.0, 4.0)]):
        assert Q.split_at(line, [line[1]]) == [line[:2], line[1:]]
    line = [(0.0, 0.0), (3.0, 1.0), (5.0, 5.0)]
    assert Q.split_at(line, [line[0], line[2]]) == [line] and len(Q.split_at(line, [(1.5, 0.5), (1.5, 0.500001)])) == 2


def test_slice_along_keeps_repeated_vertices():
    line = [(0.0, 0.0), (0.0, 0.0), (1.0, 0.0), (1.0, 0.0), (1.0, 0.0), (2.0, 0.0), (2.0, 0.0)]
    assert Q.slice_along(line, 0, 1e12) == line
    parts = Q.chunked(line, Q.haversine((0.0, 0.0), (1.0, 0.0)))
    assert [len(p) for p in parts] == [5, 3] and abs(sum(map(Q.length, parts)) - Q.length(line)) < 1e-6


def test_simplified_closed_line():
    """A closed line keeps its ends, a ring four points."""
    line = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    assert P.simplify(line, 5e8, True, ring=False) == [line[0], line[-1]] and len(P.simplify(line, 5e8, True)) == 4


def test_rotated_and_scaled_are_steps_of_rhumb_lines(spark):
    """The staged expressions give what distance, bearing and destination give one after the other, and stay small."""
    from pyspark.sql import functions as F

    from geoloom.functions import geodesy as G
    from geoloom.functions import lines as L

    pts = [(10.0, 50.0), (11.5, 51.0), (179.5, -20.0), (-170.0, 88.0), (10.0, 49.0), (9.0, 50.0)]
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in pts], 10.0, 50.0)], "line array<struct<x: double, y: double>>, lon double, lat double")
    px, py = F.col("lon"), F.col("lat")
    got = df.select(L.rotated(F.col("line"), 33.0, px, py).alias("r"), L.scaled(F.col("line"), 1.7, px, py).alias("s"))
    row = got.first()
    for k, (x, y) in enumerate(pts):
        c = (F.lit(x), F.lit(y))
        d, b = G.rhumb_distance(px, py, *c), G.rhumb_bearing(px, py, *c)
        for own, want in ((row["r"], G.rhumb_destination(px, py, d, b + 33.0)), (row["s"], G.rhumb_destination(px, py, d * 1.7, b))):
            w = df.select(want.alias("w")).first()["w"] if k else {"x": x, "y": y}
            assert abs(own[k]["x"] - w["x"]) < 1e-9 and abs(own[k]["y"] - w["y"]) < 1e-9
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_nearest_segment_of_a_shared_vertex(spark):
    """Two segments meet in the nearest vertex: the same one as by the SQL, where rounding alone tells their distances apart."""
    import duckdb
    from pyspark.sql import functions as F

    from geoloom.functions import lines as L
    from geoloom.plans.line_queries import ORACLES

    hundredths = [[(k * 7919 % 9000, k * 104729 % 6000) for k in keys] for keys in ((237020, 289059, 255852, 289969, 185475), (237021, 289060, 255853, 289970, 185476))]
    lines = [[{"x": x / 100 - 44.9963, "y": y / 100 - 29.9971} for x, y in own] for own in hundredths]
    df = spark.createDataFrame(list(enumerate(lines)), "id int, line array<struct<x: double, y: double>>")
    got = df.select("id", L.nearest_on_line(F.col("line"), F.lit(3.21), F.lit(4.56))["index"]).orderBy("id").collect()
    rows = ", ".join(f"({k}, [{', '.join(repr(p) for p in own)}])" for k, own in enumerate(lines))
    select = "SELECT id" + ORACLES["point_to_line_distance"].rpartition(" FROM order_line")[0].rpartition("SELECT id")[2]
    want = duckdb.connect().sql(f"SELECT id, segment FROM ({select} FROM (VALUES {rows}) t(id, line)) ORDER BY id").fetchall()
    assert [tuple(r) for r in got] == want
