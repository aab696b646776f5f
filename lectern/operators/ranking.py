"""Ordered operators: ranks, shares, islands, chunks. Orders are total, so results don't depend on the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators.graph import cut


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def per_key(df: DataFrame, keys: list[str], n: int, *order: Column, name: str = "rn") -> DataFrame:
    """The first n rows of each key, with their number. Spark keeps n a task and key before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col(name) <= n)


def page(df: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def share(df: DataFrame, value: str, keys: list[str], name: str = "share", digits: int = 3) -> DataFrame:
    """Value over the total of its keys."""
    return df.withColumn(name, F.round(F.col(value) / F.sum(value).over(Window.partitionBy(*keys)), digits))


def decayed(df: DataFrame, start: float, slope: float, *order: Column, keys: list[str] | None = None, name: str = "score") -> DataFrame:
    """start - slope * i / n for the i-th (from 0) of n ordered rows of a key."""
    w = Window.partitionBy(*(keys or [F.lit(0)]))
    i = F.row_number().over(w.orderBy(*order)) - 1
    return df.withColumn(name, F.round(F.lit(start) - F.lit(slope) * i / F.count("*").over(w), 6))


def islands(df: DataFrame, keys: list[str], at: str, gap: int, name: str = "island") -> DataFrame:
    """Numbers runs of rows of a key whose neighbours are at most ``gap`` apart."""
    w = Window.partitionBy(*keys).orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(w) <= gap, 0).otherwise(1)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def carried(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """The last non-null value so far."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def first_wins(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return per_key(df, keys, 1, *order, name="_rn").drop("_rn")


def sliding(df: DataFrame, words: str, size: int = 800, overlap: int = 150) -> DataFrame:
    """chunk, start, words of overlapping slices; the last starts before the end even where it adds nothing."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(size - overlap))
    return df.select("*", F.posexplode(starts).alias("chunk", "start")).withColumn("slice", F.slice(words, F.col("start") + 1, size))


def numbered(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """The rows with their place from 0 in a total order, without a task that holds them all.

    The sort deals ranges to tasks, each row gets its number within its task, and the tasks' sizes (one row each) are
    added in front. The sorted rows are written once, so that both steps see the same ranges.
    """
    own = cut(df.orderBy(*order).withColumn("_n", F.monotonically_increasing_id()))  # task << 33 | row
    task = F.shiftright("_n", 33)
    sizes = own.groupBy(task.alias("_t")).agg(F.count("*").alias("_c"))
    before = sizes.select("_t", F.coalesce(F.sum("_c").over(Window.orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    placed = own.withColumn("_t", task).join(F.broadcast(before), "_t")
    return placed.withColumn(name, F.col("_b") + F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))).drop("_n", "_t", "_b")


def suffixed(df: DataFrame, slug: str, key: str, out: str) -> DataFrame:
    """Names made unique: by ``key``, a slug's first row keeps it, later ones get ``-n`` of one counter over all collisions."""
    first = df.groupBy(slug).agg(F.min(key).alias("_first"))
    known = df.join(first, slug)
    again = numbered(known.where(F.col(key) > F.col("_first")).drop("_first"), F.col(key), name="_p")
    once = known.where(F.col(key) == F.col("_first")).drop("_first")
    named = again.withColumn(out, F.concat(F.col(slug), F.lit("-"), (F.col("_p") + 1).cast("string"))).drop("_p")
    return named.unionByName(once.withColumn(out, F.col(slug)))
