"""Event-time windows, for tables and streams alike. ``ts`` may be a timestamp without zone; streams need ``zoned`` first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def zoned(events: DataFrame, late: str | None = None) -> DataFrame:
    """``ts`` as a UTC timestamp, with a watermark for streams."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return out.withWatermark("ts", late) if late else out


def tumbling(events: DataFrame, width: str, *keys: str) -> DataFrame:
    """start, keys, n."""
    return events.groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sliding(events: DataFrame, width: str, step: str, *keys: str) -> DataFrame:
    """start, keys, n, total of overlapping windows."""
    return events.groupBy(F.window("ts", width, step).alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """user_id, first, n: runs of a user's events less than ``gap`` apart."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("first"), "n")


def over_rate(events: DataFrame, most: int, width: str = "60 seconds") -> DataFrame:
    """start, user_id, n of fixed windows with more than ``most`` requests."""
    return tumbling(events, width, "user_id").where(F.col("n") > most)
