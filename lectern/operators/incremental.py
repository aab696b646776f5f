"""Incremental maintenance: idempotent upserts, change sets, guarded delta imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key isn't shipped, and the new rows, once each: applying it twice changes nothing."""
    fresh = new.dropDuplicates([key])
    return old.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, change (insert, update, delete) between two states."""
    o, n = old.select(key, F.col(value).alias("_o"), F.lit(1).alias("_a")), new.select(key, F.col(value).alias("_n"), F.lit(1).alias("_b"))
    both = o.join(n, key, "full").where(~F.col("_o").eqNullSafe(F.col("_n")))
    return both.select(key, F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "delete").otherwise("update").alias("change"))


def import_delta(store: DataFrame, shipped: DataFrame, deleted: DataFrame, key: str, most_deleted: float = 0.2) -> DataFrame:
    """The store after a delta; refuses one that deletes more than a share of it."""
    n, gone = store.count(), store.join(deleted.select(key).distinct(), key, "left_semi").count()
    if n and gone > most_deleted * n:
        raise ValueError(f"the delta deletes {gone} of {n} rows")
    return upsert(store.join(deleted.select(key), key, "left_anti"), shipped, key)
