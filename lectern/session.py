"""Session factory: UTC, adaptive execution, and a vector capability probe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "lectern", **conf: str) -> SparkSession:
    """A session with the settings that the engine's results rely on; ``conf`` adds or overrides."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.sources.partitionOverwriteMode": "dynamic"} | conf
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()


def has_vectors(df: DataFrame, column: str = "embedding") -> bool:
    """Whether a table can be searched by vector; callers degrade to text search without it."""
    return column in df.columns
