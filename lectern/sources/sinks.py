"""Sinks: the store's tables, a full index build with counts, vector tables, orphan removal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import terms
from lectern.operators import postings
from lectern.sources import store

#: Tables of a store and their columns.
SCHEMAS = {
    "documents": "id string, path string, title string, metadata string, corpus string",
    "chunks": "id string, doc_id string, chunk_index int, body string",
    "passage_refs": "doc_id string, s long, e long",
    "tags": "doc_id string, tag string",
    "vectors": "id string, embedding array<float>",
}
#: The tags that send a document to a partition of its own, by precedence.
PARTITIONS = (("resource:aquifer", "aquifer"), ("kind:bible", "bible"), ("kind:lexicon", "lexicon"), ("kind:morphology", "morphology"))

#: Keys that were counted first and may be broadcast.
COUNTED = 100_000


def init_schema(spark: SparkSession, database: str = "default") -> None:
    """Create the store's tables where they are missing; existing ones stay."""
    for table, columns in SCHEMAS.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{table} ({columns}) USING parquet")


def corpus_column(tags: str = "tags"):
    out = F.lit("main")
    for tag, corpus in reversed(PARTITIONS):
        out = F.when(F.array_contains(tags, tag), corpus).otherwise(out)
    return out


def once(df: DataFrame, key: str) -> DataFrame:
    """One row of each key. Only the keys are shuffled, and the rows of those that are repeated."""
    again = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1").select("_key")
    n = again.count()
    if not n:
        return df
    again, same = F.broadcast(again) if n <= COUNTED else again, F.col(key).eqNullSafe(F.col("_key"))
    return df.join(again, same, "left_anti").unionByName(df.join(again, same, "left_semi").dropDuplicates([key]))


def tables_of(documents: DataFrame) -> dict[str, DataFrame]:
    """The store's tables out of scanned documents (id, path, title, body, tags, s, e, metadata), without repeats."""
    d = once(documents, "id")
    return {
        "documents": d.select("id", "path", "title", "metadata", corpus_column().alias("corpus")),
        "chunks": d.where("body IS NOT NULL").select(F.concat("id", F.lit(":0000")).alias("id"), F.col("id").alias("doc_id"), F.lit(0).alias("chunk_index"), "body"),
        "passage_refs": d.select(F.col("id").alias("doc_id"), F.explode(F.arrays_zip("s", "e")).alias("x")).select("doc_id", "x.s", "x.e").dropDuplicates(),
        "tags": d.select(F.col("id").alias("doc_id"), F.explode("tags").alias("tag")).dropDuplicates(),
    }


def build_index(documents: DataFrame, root: str) -> dict[str, int]:
    """Write all tables below ``root``, documents by corpus, and return their counts."""
    spark, counts = documents.sparkSession, {}
    for name, df in tables_of(documents).items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("corpus") if name == "documents" else writer).parquet(f"{root}/{name}")
        counts[name] = spark.read.parquet(f"{root}/{name}").count()
    return counts


def publish_index(documents: DataFrame, folder: str, vectors: DataFrame | None = None) -> str:
    """A whole index as one version of ``folder``, seen only when all of it is there: tables, vectors without orphans, and for
    each corpus postings with statistics of its own. The manifest has all counts. documents: as ``tables_of``; vectors: id, embedding.

    The texts are parsed once for all corpora, into files that go when the postings are there."""
    spark = documents.sparkSession

    def build(path: str) -> dict:
        counts = build_index(documents, path)
        chunks = spark.read.parquet(f"{path}/chunks")
        if vectors is not None:
            without_orphans(vectors, chunks).write.parquet(f"{path}/vectors")
            counts["vectors"] = spark.read.parquet(f"{path}/vectors").count()
        corpus = spark.read.parquet(f"{path}/documents").select(F.col("id").alias("doc_id"), "corpus")
        own = chunks.select(F.col("id").alias("chunk_id"), "doc_id", "body").join(corpus, "doc_id")
        own.select("chunk_id", terms(F.col("body")).alias("words"), "corpus").write.partitionBy("corpus").parquet(f"{path}/bags")
        bags = spark.read.parquet(f"{path}/bags").withColumn("words", F.col("words").alias("words", metadata={"stored": True}))
        names = [name for _, name in PARTITIONS] + ["main"]
        fts = {name: postings.build(bags.where(F.col("corpus") == name), f"{path}/fts/{name}") for name in names}
        store.drop(spark, f"{path}/bags")
        return {"counts": counts, "fts": fts}

    return store.publish(spark, folder, build)


def without_orphans(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """The vectors whose chunk still exists."""
    return vectors.join(chunks.select("id"), "id", "left_semi")


def embed_missing(chunks: DataFrame, vectors: DataFrame, encode: Callable[[list[str]], list[list[float]]], model: str, stored_model: str | None = None) -> DataFrame:
    """id, embedding of the chunks with text that have none; refuses to mix models. ``encode`` gets batches of texts."""
    if stored_model not in (None, model):
        raise ValueError(f"the store holds vectors of {stored_model}, not of {model}")
    todo = chunks.where(F.trim("body") != "").join(vectors.select("id"), "id", "left_anti").select("id", "body")
    return encoded(todo, "id", "body", encode).select("id", F.col("embedding").cast("array<float>").alias("embedding"))


def encoded(texts: DataFrame, key: str, text: str, encode: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """key (text), embedding of each row, encoded in batches."""

    def run(batches):
        for pdf in batches:
            yield pdf[[key]].assign(embedding=encode(pdf[text].tolist()))

    return texts.select(F.col(key).cast("string").alias(key), text).mapInPandas(run, f"`{key}` string, embedding array<double>")


def embed_contexts(rows: DataFrame, key: str, text: str, encode: Callable[[list[str]], list[list[float]]], model: str, stored: DataFrame | None = None, stored_model: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(new, joined): vectors (digest, embedding) of the distinct texts that ``stored`` lacks, and key, digest, embedding of all rows.

    Equal texts are told by their SHA-256 and encoded once; blank and null texts have no vector. Refuses to mix models.
    ``new`` is to be written before ``joined`` is read, which encodes it again otherwise.
    """
    if stored_model not in (None, model):
        raise ValueError(f"the store holds vectors of {stored_model}, not of {model}")
    own = rows.where(F.trim(text) != "").select(key, text, F.sha2(F.col(text), 256).alias("digest"))
    todo = own.select("digest", text).dropDuplicates(["digest"])
    if stored is not None:
        todo = todo.join(stored.select("digest"), "digest", "left_anti")
    new = encoded(todo, "digest", text, encode)
    every = new if stored is None else new.unionByName(stored.select("digest", F.col("embedding").cast("array<double>").alias("embedding")))
    return new, own.select(key, "digest").join(every, "digest")


def hashed(texts: list[str], dims: int = 64) -> list[list[float]]:
    """A deterministic stand-in for an encoder: signed feature hashing of words to a unit vector."""
    from zlib import crc32

    out = []
    for t in texts:
        v = [0.0] * dims
        for w in t.lower().split():
            h = crc32(w.encode())
            v[h % dims] += 1.0 if h >> 31 else -1.0
        size = sum(x * x for x in v) ** 0.5 or 1.0
        out.append([x / size for x in v])
    return out
