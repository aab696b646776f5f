"""Acceptance checks: constraints of a table measured in one pass, as rows or as a guard before it is published."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lectern.sources import store


class Constraint(NamedTuple):
    """A named aggregate with the least and the greatest value that pass."""

    name: str
    value: Column
    least: float | None = None
    most: float | None = None

    def passed(self, value: float | None) -> bool:
        return value is not None and (self.least is None or value >= self.least) and (self.most is None or value <= self.most)


class Refused(ValueError):
    """What a table failed; it was not published."""


def rows(name: str = "rows", least: int = 1, most: int | None = None) -> Constraint:
    return Constraint(name, F.count("*"), least, most)


def never(name: str, bad: Column) -> Constraint:
    """No row for which ``bad`` holds; null counts as bad."""
    return Constraint(name, F.count_if(F.coalesce(bad, F.lit(True))), 0, 0)


def always(name: str, good: Column) -> Constraint:
    return never(name, ~good)


def measured(df: DataFrame, table: str, constraints: list[Constraint]) -> DataFrame:
    """subject, constraint, value, passed: one row a constraint, from one aggregate over the table."""
    one = df.agg(*[c.value.cast("double").alias(f"c{i}") for i, c in enumerate(constraints)])

    def verdict(i: int, c: Constraint) -> Column:
        v = F.col(f"c{i}")
        ok = v.isNotNull() & (F.lit(True) if c.least is None else v >= c.least) & (F.lit(True) if c.most is None else v <= c.most)
        return F.struct(F.lit(table).alias("subject"), F.lit(c.name).alias("constraint"), v.alias("value"), F.coalesce(ok, F.lit(False)).alias("passed"))

    return one.select(F.explode(F.array(*[verdict(i, c) for i, c in enumerate(constraints)])).alias("x")).select("x.*")


def repeated(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """The same row for the keys that occur more than once; counts are summed up before they are shuffled."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").cast("double").alias("value"))
    return n.select(F.lit(table).alias("subject"), F.lit(f"unique {', '.join(keys)}").alias("constraint"), "value", (F.col("value") == 0).alias("passed"))


def missing(df: DataFrame, table: str, key: str, known: DataFrame) -> DataFrame:
    """The same row for the keys that another table doesn't have."""
    n = df.select(key).distinct().join(known.select(key).distinct(), key, "left_anti").agg(F.count("*").cast("double").alias("value"))
    return n.select(F.lit(table).alias("subject"), F.lit(f"known {key}").alias("constraint"), "value", (F.col("value") == 0).alias("passed"))


def published(df: DataFrame, folder: str, constraints: list[Constraint], write: Callable[[DataFrame, str], None] | None = None) -> str:
    """Write a version and publish it if all constraints hold for the rows written, measured while they are written.

    Else :class:`Refused`, and readers keep the version before. Constraints may not hold distinct aggregates.
    """
    seen = Observation()
    watched = df.observe(seen, *[c.value.cast("double").alias(f"c{i}") for i, c in enumerate(constraints)])

    def build(path: str) -> dict:
        if write:
            write(watched, f"{path}/table")
        else:
            watched.write.parquet(f"{path}/table")
        values = {c.name: seen.get[f"c{i}"] for i, c in enumerate(constraints)}
        failed = [c.name for c in constraints if not c.passed(values[c.name])]
        if failed:
            raise Refused(", ".join(failed))
        return values

    return store.publish(df.sparkSession, folder, build)
