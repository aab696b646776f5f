"""Retrieval evaluation: interval and tag recall, refusals, denoise scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.intervals import overlap_join


def overlaps(a_s: Column, a_e: Column, b_s: Column, b_e: Column) -> Column:
    return (a_s <= b_e) & (b_s <= a_e)


def passage_recall(expected: DataFrame, found: DataFrame) -> DataFrame:
    """case_id, recall: the share of a case's intervals (case_id, s, e) that a found one (case_id, ts, te) overlaps."""
    e = expected.withColumn("x", F.monotonically_increasing_id()) if "x" not in expected.columns else expected
    hit = overlap_join(e, found.withColumnRenamed("case_id", "fc")).where("case_id = fc").select("case_id", "s", "e").distinct().withColumn("hit", F.lit(1))
    return expected.join(hit, ["case_id", "s", "e"], "left").groupBy("case_id").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"))


def tag_recall(expected: Column, found: Column) -> Column:
    """Share of expected tags found; 1 where none are expected."""
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.round(F.size(F.array_intersect(expected, found)) / F.size(expected), 4))


def is_refusal(answer: Column) -> Column:
    """Whether an answer declines."""
    return F.lower(answer).rlike(r"(cannot|can't|unable to|don't have)\b.{0,40}\b(answer|help|information|find)")
