"""Joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is a hub if it has over a SHARE-th of all rows, and LEAST_ROWS at least; so there are fewer than SHARE hubs.
SHARE, LEAST_ROWS = 1000, 1000


def hubs_of(rows: DataFrame, keys: list[str], total: int) -> list[list]:
    """The hub values of each key column among `total` rows, fewer than SHARE of each, in one job."""
    most = max(LEAST_ROWS, total // SHARE)
    if total <= most:
        return [[] for _ in keys]
    counts = [rows.groupBy(F.col(k).alias("key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("key").isNotNull() & (F.col("n") > most)).select(F.lit(at).alias("at"), "key") for at, k in enumerate(keys)]
    every = counts[0]
    for more in counts[1:]:
        every = every.unionByName(more)
    found = every.collect()
    return [[r["key"] for r in found if r["at"] == at] for at in range(len(keys))]


def hub_join(rows: DataFrame, values: DataFrame, key: str, hubs: list, how: str = "inner") -> DataFrame:
    """rows with their key's row of values, of which there is one at most.

    The values of hubs, fewer than SHARE rows, are broadcast, so a hub's rows stay
    where they are; the other rows are dealt by key.
    """
    if not hubs:
        return rows.join(values, key, how)
    is_hub = F.coalesce(F.col(key).isin(hubs), F.lit(False))
    plain = rows.where(~is_hub).join(values.where(~F.col(key).isin(hubs)), key, how)
    return plain.unionByName(rows.where(is_hub).join(F.broadcast(values.where(F.col(key).isin(hubs))), key, how))
