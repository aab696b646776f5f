"""Joins on closed integer intervals, by equi-joins on bins instead of nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = 1000


def _bin(c: Column, size: int) -> Column:
    return F.floor(c / size).cast("long")


def overlap_join(left: DataFrame, right: DataFrame, ls: str = "s", le: str = "e", rs: str = "ts", re: str = "te", size: int = BIN) -> DataFrame:
    """All pairs of rows whose intervals overlap, each once.

    Both sides go to every bin that they touch; a pair counts in the later of the two first bins. A bin of
    a passage key is a chapter, so only ranges over chapters go to several. Skewed bins are AQE's to split.
    """
    l = left.withColumn("_bin", F.explode(F.sequence(_bin(F.col(ls), size), _bin(F.col(le), size))))
    r = right.withColumn("_bin", F.explode(F.sequence(_bin(F.col(rs), size), _bin(F.col(re), size))))
    met = (F.col(ls) <= F.col(re)) & (F.col(rs) <= F.col(le)) & (F.col("_bin") == F.greatest(_bin(F.col(ls), size), _bin(F.col(rs), size)))
    return l.join(r, "_bin").where(met).drop("_bin")


def overlapping(df: DataFrame, intervals: list[tuple[int, int]], s: str = "s", e: str = "e") -> DataFrame:
    """Rows that overlap any of a few literal intervals."""
    met = F.lit(False)
    for a, b in intervals:
        met = met | ((F.col(s) <= b) & (F.col(e) >= a))
    return df.where(met)


def within(points: DataFrame, ranges: DataFrame, key: str, s: str = "s", e: str = "e", size: int = BIN) -> DataFrame:
    """Points joined with the ranges that hold them."""
    r = ranges.withColumn("_bin", F.explode(F.sequence(_bin(F.col(s), size), _bin(F.col(e), size))))
    return points.withColumn("_bin", _bin(F.col(key), size)).join(r, "_bin").where(F.col(key).between(F.col(s), F.col(e))).drop("_bin")


def points(df: DataFrame, s: str = "s", e: str = "e", most: int = 200) -> DataFrame:
    """One row a key of every interval up to ``most`` wide, for equi-joins."""
    return df.where(F.col(e) - F.col(s) <= most).withColumn("ref", F.explode(F.sequence(s, e)))
