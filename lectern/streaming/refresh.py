"""Incremental ingest, build and embed of a growing table of documents, as a stream that takes what is new and stops.

Each micro-batch writes its own folder ``batch=<id>`` of each table and replaces it when it runs again, so a batch that is
retried, or a rerun from the checkpoint, changes nothing. Readers resolve the tables: the newest batch of a document
wins, its chunks are those written with it, and a vector belongs to the digest of a text, so equal texts are embedded once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from lectern.sources.sinks import encoded

TABLES = {
    "documents": "doc_id long, digest string, batch long",
    "chunks": "doc_id long, chunk_index int, body string, digest string, batch long",
    "vectors": "digest string, embedding array<double>, batch long",
}


class Refresh:
    """The store below ``root``; ``encode`` turns texts into vectors, ``model`` names it and may not change."""

    def __init__(self, spark: SparkSession, root: str, encode: Callable[[list[str]], list[list[float]]], model: str):
        self.spark, self.root, self.encode, self.model = spark, root, encode, model

    def table(self, name: str) -> DataFrame:
        """All batches of a table, as written."""
        return self.spark.read.schema(TABLES[name]).option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}/batch=*") if self._any(name) else self.spark.createDataFrame([], TABLES[name])

    def _any(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.exists(path) and len(fs.listStatus(path)) > 0

    def documents(self, before: int | None = None) -> DataFrame:
        """The current version of each document, or the one before a batch."""
        own = self.table("documents")
        own = own if before is None else own.where(F.col("batch") < before)
        return own.groupBy("doc_id").agg(F.max_by("digest", "batch").alias("digest"), F.max("batch").alias("batch"))

    def chunks(self) -> DataFrame:
        return self.table("chunks").join(self.documents().select("doc_id", "batch"), ["doc_id", "batch"], "left_semi")

    def vectors(self) -> DataFrame:
        """digest, embedding: one row a text."""
        return self.table("vectors").select("digest", "embedding")

    def batch(self, new: DataFrame, number: int) -> None:
        """Ingest one batch of documents (doc_id, text): of an id that repeats within it the greatest digest counts."""
        digest = F.sha2(F.coalesce("text", F.lit("")), 256)
        own = new.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", digest.alias("digest"))
        one = own.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("digest")))).where("n = 1").drop("n")
        changed = one.join(self.documents(number).select("doc_id", F.col("digest").alias("old")), "doc_id", "left").where("old IS NULL OR old != digest").drop("old")
        changed = self._written("documents", number, changed.select("doc_id", "digest"), changed)
        lines = changed.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "body")).where(F.trim("body") != "")
        self._written("chunks", number, lines.select("doc_id", "chunk_index", "body", F.sha2("body", 256).alias("digest")))
        mine = self.table("chunks").where(F.col("batch") == number)
        known = self.table("vectors").where(F.col("batch") < number).select("digest")
        todo = mine.select("digest", "body").dropDuplicates(["digest"]).join(known, "digest", "left_anti")
        self._written("vectors", number, encoded(todo, "digest", "body", self.encode))

    def _written(self, name: str, number: int, df: DataFrame, then: DataFrame | None = None) -> DataFrame | None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={number}")
        if then is not None:  # what was written decides, so that all tables of a batch agree
            mine = self.spark.read.parquet(f"{self.root}/{name}/batch={number}").select("doc_id")
            return then.join(mine, "doc_id", "left_semi")
        return None

    def run(self, source: str, schema: StructType, files: int = 1000) -> int:
        """Take all new files of a folder of Parquet files in batches of some files; returns how many batches ran."""
        self._guard()
        stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
        query = stream.select("doc_id", "text").writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return sum(1 for p in query.recentProgress if p["numInputRows"])

    def _guard(self) -> None:
        """Refuse to mix vectors of two models in one store."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/model.txt")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            out = fs.create(path, False)
            out.write(bytearray(self.model.encode()))
            out.close()
        stored = self.spark.read.text(str(path.toString()), wholetext=True).first()[0]
        if stored != self.model:
            raise ValueError(f"the store holds vectors of {stored}, not of {self.model}")
