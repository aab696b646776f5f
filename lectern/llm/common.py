"""Helpers shared by the corpus operators: durable intermediates, text access, fixed hash constants."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that the cluster shares for intermediates; a temporary one only for a local master without any."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def columns(df: DataFrame) -> list[str]:
    """The column names, quoted, so that dots and spaces in them stay part of the name."""
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


def map_rows(docs: DataFrame, run) -> DataFrame:
    """mapInArrow over all columns, whatever their names: Spark's own resolves names with dots as fields."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lectern_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what :func:`materialise` wrote, once nothing reads it any more."""
    path = getattr(df, "_lectern_path", None)
    if path:
        jvm = df.sparkSession._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished queries before the next large one starts; a local master keeps them."""
    if not spark.sparkContext.master.startswith("local"):
        for _ in range(2):
            gc.collect()
            spark._jvm.System.gc()
            time.sleep(0.3)  # the cleaner works in the background


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a worker holds the Python objects of few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def byte_blocks(rows: Iterator[tuple], most: int = 1 << 17) -> Iterator[list[tuple]]:
    """Group (key, bytes, ...) rows so that a block holds about ``most`` bytes, or one longer row."""
    held, size = [], 0
    for row in rows:
        if held and size + len(row[1]) > most:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row[1])
    if held:
        yield held
