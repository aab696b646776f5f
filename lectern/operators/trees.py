"""Perspective trees over a store: each is a table of paths, and its roots, its children and their counts are aggregates of it.

A tree's table has ``level1``, ``level2`` and ``leaf``; the root lists level1, one step down lists level2, two list the leaves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import SPACES, initial
from lectern.operators import tags

#: Trees that an overview leaves out, since clients build them, and those it shows one level of.
SKIPPED, SHALLOW = ("bible", "pericope"), ("term", "topic")


def _paths(df: DataFrame, one: Column, two: Column, leaf: Column) -> DataFrame:
    return df.select(one.cast("string").alias("level1"), two.cast("string").alias("level2"), leaf.cast("string").alias("leaf"))


def _documents(store, kind: str) -> DataFrame:
    """doc_id, title of the documents of a kind."""
    return tags.tagged(store.titles(), store.tags(), f"kind:{kind}")


def _letter(text: Column) -> Column:
    return initial(F.trim(text, F.lit(SPACES)))


def _book(ref: Column) -> Column:
    return F.floor(ref / 1000000)


def _chapter(ref: Column) -> Column:
    return F.floor(ref / 1000) % 1000


def _named(store, prefix: str) -> DataFrame:
    return tags.with_prefix(store.tags(), prefix).distinct()


BUILDERS: dict[str, Callable[[object], DataFrame]] = {
    "source": lambda s: _paths(_named(s, "source:").join(s.refs(), "doc_id"), F.col("value"), _book(F.col("s")), F.col("doc_id")),
    "kind": lambda s: _paths(_named(s, "kind:").join(_named(s, "lang:").withColumnRenamed("value", "lang"), "doc_id"), F.col("value"), F.col("lang"), F.col("doc_id")),
    "term": lambda s: _paths(_documents(s, "term"), _letter(F.col("title")), F.col("title"), F.col("doc_id")),
    "methodology": lambda s: _paths(_documents(s, "methodology").join(_named(s, "source:"), "doc_id"), F.col("value"), _letter(F.col("title")), F.col("doc_id")),
    "pericope": lambda s: _paths(s.refs(), _book(F.col("s")), F.col("s"), F.col("doc_id")),
    "aquifer": lambda s: _paths(tags.tagged(_named(s, "kind:"), s.tags(), "resource:aquifer").join(s.refs(), "doc_id"), F.col("value"), _book(F.col("s")), F.col("doc_id")),
    "bible": lambda s: _paths(s.refs(), _book(F.col("s")), _chapter(F.col("s")), F.col("s") % 1000),
    "topic": lambda s: _paths(s.topics(), _letter(F.col("name")), F.col("name"), F.col("topic_id")),
    "entity": lambda s: _paths(s.entities(), F.col("type"), _letter(F.col("name")), F.col("id")),
    "lexicon": lambda s: _paths(s.words(), F.substring("strong", 1, 1), F.substring("strong", 2, 1), F.col("strong")),
    "morphology": lambda s: _paths(s.words(), F.col("book"), F.col("chapter"), F.col("morph")),
    "transcript": lambda s: _paths(s.table("conversations"), F.col("role"), F.col("conv_id") % 10, F.col("conv_id")),
}


def _table(store, name: str) -> DataFrame:
    try:
        return BUILDERS[name](store).where("level1 IS NOT NULL")
    except KeyError:
        raise ValueError(f"unknown tree {name!r}") from None


def descend(store, name: str, *path: str) -> DataFrame:
    """id, n: the children of a node with how many leaves each holds; a path of two gives the leaves. An unknown path has no children."""
    if len(path) > 2:
        raise ValueError("a path has two steps at most")
    own = _table(store, name)
    for level, step in zip(("level1", "level2"), path):
        own = own.where(F.col(level) == step)
    return own.groupBy(F.col(("level1", "level2", "leaf")[len(path)]).alias("id")).agg(F.countDistinct("leaf").alias("n"))


def overview(store) -> DataFrame:
    """tree, parent, id, n: the roots' children of all trees but those left out, and their children; ``parent`` is null for the first level."""
    out = None
    for name in BUILDERS:
        if name in SKIPPED:
            continue
        own = _table(store, name).distinct()
        rows = own.groupBy("level1").agg(F.countDistinct("leaf").alias("n")).select(F.lit(None).cast("string").alias("parent"), F.col("level1").alias("id"), "n")
        if name not in SHALLOW:
            rows = rows.unionByName(own.groupBy("level1", "level2").agg(F.count("*").alias("n")).select(F.col("level1").alias("parent"), F.col("level2").alias("id"), "n"))
        rows = rows.select(F.lit(name).alias("tree"), "parent", "id", "n")
        out = rows if out is None else out.unionByName(rows)
    return out
