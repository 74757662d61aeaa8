"""Mixing sources to target weights (operator 8).

Tokens are summed per source, targets follow from weights by water filling
under a repetition cap, and each document is emitted floor(rate) times plus one
hash-seeded Bernoulli copy whose probability is the fraction of the rate.

Defined cases: a null text has size 0; the null source is a source of its own,
ordered last; a source without words has target 0 and rate 0; rows that repeat
a doc_id share one draw, so they are copied alike; a null doc_id draws as the
empty string; an empty table gives an empty result. Other columns of the input
pass through the row form untouched (working columns carry the prefix _mix_, with
more underscores where a column has that). The ordering of sources runs in one
task, over one row a source: meant for up to a few million sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.llm.common import apart, free_name, free_prefix, quoted, table, word_count

CAP = 3
WEIGHTS = 3
SEED = 20


def source_targets(sized: DataFrame, cap: int = CAP, weights: int = WEIGHTS) -> DataFrame:
    """(source, size) rows -> (source, source_size, target), one row per source.

    The source with the least cap per weight fills first. A source is at its cap
    if its cap is no more than its weighted share of what the fuller ones leave;
    that test is monotone in cap per weight, so one ordered pass settles it. The
    windows run over one row per source, after the partial aggregation.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("w", ((F.row_number().over(by_name) - 1) % weights + 1).cast("long"))
    scale = 1
    for k in range(2, weights + 1):
        scale *= k
    per = per.withColumn("cap", F.col("source_size") * cap).withColumn("key", F.col("cap") * F.expr(f"{scale} div w"))
    before = Window.orderBy("key", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = per.select(
        "source", "source_size", "w", "cap", "key",
        F.sum("source_size").over(whole).alias("all_size"),
        F.sum("w").over(whole).alias("all_w"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"),
    )
    full = F.col("key") * (F.col("all_w") - F.col("w_before")) <= scale * (F.col("all_size") - F.col("cap_before"))
    per = per.withColumn("full", full)
    per = per.withColumn("full_cap", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0)))
    per = per.withColumn("full_w", F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))).over(whole), F.lit(0)))
    share = ((F.col("all_size") - F.col("full_cap")) * F.col("w")).cast("double") / (F.col("all_w") - F.col("full_w")).cast("double")
    return per.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A uniform number in [0, 1) that depends on the id and the seed alone."""
    key = F.concat(F.lit(f"mix:{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_sources(docs: DataFrame, cap: int = CAP, weights: int = WEIGHTS, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text, source, ...) with size, source_size, target, copies.

    keep: input columns to carry; by default all of them. The per-source table
    joins by Spark's own size check: broadcast below the session's threshold, a
    sort-merge join with skew handling beyond it.
    """
    own = docs if keep is None else docs.select(*quoted(list(dict.fromkeys([*keep, "doc_id", "text", "source"]))))
    return apart(own, "_mix_", lambda x: _mixed(x, cap, weights, seed, x.columns if keep is None else keep))


def _mixed(docs: DataFrame, cap: int, weights: int, seed: int, keep: list[str]) -> DataFrame:
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_source"), word_count(F.col("text")).alias("_mix_size"))
    sized = docs.select("source", word_count(F.col("text")).alias("size"))
    targets = source_targets(sized, cap, weights).select(
        F.col("source").alias("_mix_key"), F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target")
    )
    joined = rows.join(targets, F.col("_mix_source").eqNullSafe(F.col("_mix_key")))
    rate = F.when(F.col("_mix_source_size") > 0, F.col("_mix_target") / F.col("_mix_source_size")).otherwise(F.lit(0.0))
    extra = (draw(F.col("_mix_id"), seed) < rate - F.floor(rate)).cast("long")
    return joined.select(
        *[F.col(f"`{c}`") for c in keep], "_mix_size", "_mix_source_size", "_mix_target", (F.floor(rate) + extra).alias("_mix_copies")
    )


def emit_copies(mixed: DataFrame, keep: list[str]) -> DataFrame:
    """One row per copy, of the columns to keep; mixed is mix_sources of a table with those."""
    copies, n = free_prefix(keep, "_mix_") + "copies", free_name(mixed.columns, "_copy")
    return mixed.where(F.col(copies) > 0).select(*quoted(keep), F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias(n)).select(*quoted(keep))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select(
        "doc_id",
        F.col("_mix_size").alias("size"),
        F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"),
        (F.col("_mix_size") * F.col("_mix_copies")).alias("taken"),
    )


ORACLE = r"""
WITH s AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source
), weighted AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w FROM per
), t AS (SELECT CAST(sum(source_size) AS BIGINT) AS total FROM per),
steps AS (
  SELECT *, 3 * source_size AS cap,
    coalesce(sum(3 * source_size) OVER o, 0) AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before, sum(w) OVER () AS all_w
  FROM weighted WINDOW o AS (ORDER BY 3 * source_size * (6 // w), source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), flagged AS (
  SELECT *, cap * (6 // w) * (all_w - w_before) <= 6 * (total - cap_before) AS is_full FROM steps, t
), targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE
    CAST((total - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0)) * w AS DOUBLE)
    / CAST(all_w - coalesce(sum(CASE WHEN is_full THEN w END) OVER (), 0) AS DOUBLE) END AS target
  FROM flagged
), rated AS (
  SELECT s.doc_id, s.size, targets.source_size, targets.target,
    CASE WHEN targets.source_size > 0 THEN target / targets.source_size ELSE 0.0 END AS rate,
    CAST(CAST('0x' || substr(md5('mix:20:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM s JOIN targets ON s.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""
