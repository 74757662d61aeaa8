"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from geoloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return out


def cells(df, order):
    return sorted(tuple("NULL" if v is None or v != v else repr(v.item() if hasattr(v, "item") else v) for v in r) for r in df[order].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, con, name):
    got, want = catalog.queries()[name](spark, sf_dir).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert cells(got, order) == cells(want, order)


def test_registries_need_no_session():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_spanning_tree_is_minimal(spark, sf_dir):
    from geoloom.plans.graph_queries import nation_edges

    edges = [(r["weight"], r["src"], r["dst"]) for r in nation_edges(spark, sf_dir).collect()]
    root: dict = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    want = 0.0
    n = 0
    for w, a, b in sorted(edges):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want, n = want + w, n + 1
    got = catalog.queries()["graph_spanning_tree"](spark, sf_dir).collect()
    assert len(got) == n and sum(r["weight"] for r in got) == want


def test_pushed_filters_and_pruned_columns(spark, sf_dir):
    plan = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal > 0").select("c_custkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,0.0)]" in plan and "c_name" not in plan
    own = catalog.queries()["query_in"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in own and "Python" not in own


def test_trade_graph_is_whole(spark, tmp_path):
    """Orders of every number count: a ring with a tail, and a pair on its own, by brute force."""
    pairs = [(1, 1), (1, 2), (2, 2), (2, 3), (3, 3), (3, 1), (3, 4), (4, 4), (9, 9)]
    lines = [(40 + k, a, b) for k, (a, b) in enumerate(pairs + pairs[:3])]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = {(a, -b - 1) for a, b in pairs}
    groups = [{v} for v in {v for e in edges for v in e}]
    for e in edges:
        hit = [g for g in groups if g & set(e)]
        groups = [g for g in groups if g not in hit] + [set().union(*hit)]
    got = catalog.queries()["graph_components_large"](spark, str(tmp_path)).collect()
    assert sorted((r["component"], r["n"]) for r in got) == sorted((min(g), len(g)) for g in groups)
    core = set(edges)
    while leaf := {v for e in core for v in e if sum(v in f for f in core) == 1}:
        core = {e for e in core if not leaf & set(e)}
    assert {(r["src"], r["dst"]) for r in catalog.queries()["graph_dead_ends"](spark, str(tmp_path)).collect()} == core


def test_graph_rounds_never_stop_silently(spark):
    from geoloom.operators import graphs

    chain = spark.createDataFrame([(k, k + 1, 1.0, False) for k in range(5)], "src long, dst long, weight double, is_directed boolean")
    for walk in (lambda **m: graphs.bfs_levels(chain, 0, **m), lambda **m: graphs.shortest_distances(chain, 0, **m)):
        assert walk().count() == 6
        with pytest.raises(RuntimeError):
            walk(max_rounds=2)
    with pytest.raises(RuntimeError):
        graphs.pruned_dead_ends(chain, max_rounds=1)
    with pytest.raises(RuntimeError):
        graphs.components(chain, max_rounds=1)
