"""The pipeline against plain Python, and the SQL of single operators."""

import re

import duckdb
import pytest

import corpus_pipeline
from geoloom.llm import registry

TABLES = ("documents", "conversations")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = registry.queries()[name](spark, sf_dir).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    rows = lambda df: sorted(map(repr, df[order].astype(object).values.tolist()))
    assert rows(got) == rows(want)


def test_pipeline(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    ids = {r["doc_id"] for r in got}
    assert ids and ids <= set(docs)
    shingles = {i: frozenset(zip(*[docs[i].split()[k:] for k in range(5)])) for i in ids}
    own = sorted(ids)
    for k, a in enumerate(own):
        for b in own[:k]:
            x, y = shingles[a], shingles[b]
            assert 10 * len(x & y) < 8 * len(x | y)
    from geoloom.llm import bpe

    codec = bpe.codec(*bpe.vocabulary())
    secret = re.compile(r'AKIA[0-9A-Z]{16}|(?<=token = ")[0-9a-f]{40}|(?<=password=)[0-9a-f]{18}')
    for r in got:
        text = b"".join(codec.decode(r["ids"])).decode()
        assert text == secret.sub("[SECRET]", docs[r["doc_id"]]) and r["n_tokens"] * 4 == len(r["ids"])


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "secret_scan", "source_mix", "token_ids"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(20), sf_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
