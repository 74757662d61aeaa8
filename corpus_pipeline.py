"""A corpus pipeline: rules, near duplicates, secrets, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each stage's result to the shared scratch folder and reads it back as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import bpe, mixing, ngram_join, quality, secrets
from geoloom.llm.common import free_name, free_prefix, materialize, quoted, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep.

    Null, empty and blank texts have fewer words than the rules ask for and go;
    repeated rows go or stay together; there are no ties to settle; an empty table
    gives an empty one; other columns, of whatever name, come through.
    """
    kept = free_prefix(docs.columns, "_q_") + "kept"
    return quality.judge(docs).where(F.col(kept)).select(*quoted(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least doc_id.

    Null, empty and blank texts are no one's duplicates and all stay. Among rows
    with words one of each group stays, whatever its ids: a null doc_id comes
    last, ties (rows of one doc_id) go by a digest of the text, and of rows equal
    in both one stays. An empty table gives an empty one; other columns, of
    whatever name, come through.
    """
    return ngram_join.keep_first(docs, ngram_join.jaccard_join(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked and n_chars counted anew where that happened.

    Null and empty texts stay as they are; repeated rows are masked alike; a value
    is masked wherever its text has it; there are no ties to settle; an empty
    table gives an empty one; other columns, of whatever name, come through.
    """
    scanned, new_text = secrets.scan(docs), free_name(docs.columns, "_masked")
    scanned = scanned.withColumn(new_text, secrets.masked("text", free_prefix(docs.columns, "_s_") + "findings"))
    changed = ~F.col(new_text).eqNullSafe(F.col("text"))
    new = {"text": F.col(new_text), "n_chars": F.when(changed, F.length(new_text).cast("long")).otherwise(F.col("n_chars"))}
    return scanned.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target rate asks for: none to three times.

    Null and empty texts have size 0 and are copied like others of their source; a
    null source is a source of its own; rows that repeat a doc_id, or have none,
    share one draw; sources come by code point, so none tie; an empty table gives
    an empty one; other columns, of whatever name, come through.
    """
    return mixing.emit_copies(mixing.mix_sources(docs), docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of every row.

    A null text is the empty text, without ids; repeated rows give repeated rows;
    a null doc_id stays null; there are no ties to settle; an empty table gives an
    empty one; other columns are ignored.
    """
    return bpe.digest_documents(docs, *bpe.vocabulary(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: The join, the forest and the tokenizer have no SQL form; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
