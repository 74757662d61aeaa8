"""What the corpus operators share: tables, words and scratch tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import files

_FOLDERS: set[str] = set()

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder below the application's own in the cluster's shared checkpoint folder; that one is removed when the driver exits.

    Only where no folder is configured (tests on one machine) is one chosen here.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "geoloom-scratch")
    own = f"{base.rstrip('/')}/geoloom-{spark.sparkContext.applicationId}"
    if own not in _FOLDERS:
        _FOLDERS.add(own)
        atexit.register(files.remove_folder, own if "://" in own else f"file://{own}")
    return f"{own}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to a scratch table and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(names: list[str]) -> list[Column]:
    """Columns by name, whatever characters the names hold."""
    return [F.col(f"`{c}`") for c in names]


def free_name(columns: list[str], name: str) -> str:
    """name, with an underscore more before it for as long as a column has it (whatever its case)."""
    held = {c.lower() for c in columns}
    while name.lower() in held:
        name = "_" + name
    return name


def free_prefix(columns: list[str], prefix: str) -> str:
    """prefix, with an underscore more before it for as long as a column's name begins with it."""
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return prefix


def apart(docs: DataFrame, prefix: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs), which adds columns that begin with prefix; they begin with free_prefix(docs.columns, prefix) here.

    Columns of docs whose names clash are put aside under other names meanwhile.
    """
    free = free_prefix(docs.columns, prefix)
    if free == prefix:
        return work(docs)
    aside = {c: free_name(docs.columns, f"aside_{k}") for k, c in enumerate(docs.columns) if c.lower().startswith(prefix)}
    out = work(docs.select(*[F.col(f"`{c}`").alias(aside.get(c, c)) for c in docs.columns]))
    back = {v: k for k, v in aside.items()}
    return out.select(*[F.col(f"`{c}`").alias(back.get(c) or (free + c[len(prefix) :] if c.startswith(prefix) else c)) for c in out.columns])


def word_count(text: Column) -> Column:
    """Number of words as long; null counts as no words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal text of an id, modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def fenced(df: DataFrame, keep: list[str]) -> DataFrame:
    """df, its columns other than `keep` behind a generator.

    A filter on a computed column is otherwise moved below the projections that
    compute it, with their expressions put inside each other, and an array that
    a lambda refers to would then be computed for each of its elements.
    """
    own, fence = [c for c in df.columns if c not in keep], free_name(df.columns, "_fence")
    packed = F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in own]))).alias(fence)
    return df.select(*[F.col(f"`{c}`") for c in keep], packed).select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{fence}`.`{c}`") for c in own])
