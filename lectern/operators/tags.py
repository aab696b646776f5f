"""Filters and facets over (doc_id, tag): semi and anti joins, never NOT IN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tagged(df: DataFrame, tags: DataFrame, *wanted: str) -> DataFrame:
    """Rows with any of the tags."""
    return df.join(tags.where(F.col("tag").isin(*wanted)).select("doc_id"), "doc_id", "left_semi")


def untagged(df: DataFrame, tags: DataFrame, *unwanted: str) -> DataFrame:
    """Rows with none of the tags."""
    return df.join(tags.where(F.col("tag").isin(*unwanted)).select("doc_id"), "doc_id", "left_anti")


def with_all(df: DataFrame, tags: DataFrame, *wanted: str) -> DataFrame:
    """Rows with all of the tags."""
    full = tags.where(F.col("tag").isin(*wanted)).groupBy("doc_id").agg(F.countDistinct("tag").alias("n")).where(F.col("n") == len(set(wanted)))
    return df.join(full, "doc_id", "left_semi")


def from_source(df: DataFrame, tags: DataFrame, source: str | None = None) -> DataFrame:
    """``all`` or None: everything; ``aquifer``: only that resource; ``door43``: all but it."""
    if source in (None, "all"):
        return df
    if source == "aquifer":
        return tagged(df, tags, "resource:aquifer")
    if source == "door43":
        return untagged(df, tags, "resource:aquifer")
    raise ValueError(f"unknown source {source!r}")


def intersected(df: DataFrame, *filters: DataFrame | None) -> DataFrame:
    """Rows whose id is in every given filter; None doesn't constrain."""
    for f in filters:
        if f is not None:
            df = df.join(f.select("doc_id"), "doc_id", "left_semi")
    return df


def with_prefix(tags: DataFrame, prefix: str) -> DataFrame:
    """doc_id, value of the tags with a prefix."""
    return tags.where(F.col("tag").startswith(prefix)).select("doc_id", F.substring("tag", len(prefix) + 1, 1000).alias("value"))


def facets(tags: DataFrame, prefix: str) -> DataFrame:
    """value, n: documents for each value of a namespace."""
    return with_prefix(tags, prefix).groupBy("value").agg(F.countDistinct("doc_id").alias("n"))


def language_gate(df: DataFrame, tags: DataFrame, language: str, fallback: str = "en") -> DataFrame:
    """Bible documents only in the language; others in it or the fallback; untagged documents stay."""
    own = tags.groupBy("doc_id").agg(F.collect_set(F.when(F.col("tag").startswith("lang:"), F.substring("tag", 6, 100))).alias("langs"), F.max((F.col("tag") == "kind:bible").cast("int")).alias("bible"))
    has = lambda x: F.array_contains("langs", x)
    passed = F.when(F.col("langs").isNull() | (F.size("langs") == 0), True).when(F.col("bible") == 1, has(language)).otherwise(has(language) | has(fallback))
    return df.join(own, "doc_id", "left").where(passed).select(df.columns)


def kind_of(tags: DataFrame) -> DataFrame:
    """doc_id, kind: the least kind tag of each document."""
    return with_prefix(tags, "kind:").groupBy("doc_id").agg(F.min("value").alias("kind"))


def namespace(tag: Column) -> Column:
    return F.split_part(tag, F.lit(":"), F.lit(1))


def source_tree(tags: DataFrame, refs: DataFrame, namespace: str = "source") -> DataFrame:
    """source, book, documents, passages: what each source of a namespace holds, by book. refs: doc_id, s, e."""
    own = tags.where(F.col("tag").startswith(f"{namespace}:")).select("doc_id", F.substring("tag", len(namespace) + 2, 1 << 30).alias("source")).distinct()
    placed = own.join(refs, "doc_id").groupBy("source", F.floor(F.col("s") / 1000000).alias("book"), "doc_id").agg(F.count("*").alias("m"))
    return placed.groupBy("source", "book").agg(F.count("*").alias("documents"), F.sum("m").alias("passages"))
