"""The retrievers: each gives ranked hits (query_id, chunk_id, rank, score, retriever) for fusion.

Queries are tables too: passages (query_id, qs, qe), terms (term), tags. Every order ends in the chunk id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import fts
from lectern.operators.fusion import ranked
from lectern.operators.intervals import overlap_join, within
from lectern.operators.postings import Postings
from lectern.operators.tags import tagged, untagged


def canonical(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_id of each document's first chunk."""
    return chunks.groupBy("doc_id").agg(F.min_by("chunk_id", "chunk_index").alias("chunk_id"))


def by_text(bags: DataFrame, terms: DataFrame, retriever: str = "fts", limit: int = 50) -> DataFrame:
    return ranked(fts.bm25(bags, terms), retriever, limit=limit)


def by_title(title_bags: DataFrame, terms: DataFrame, chunks: DataFrame, limit: int = 20) -> DataFrame:
    """BM25 over titles, scored by place."""
    hit = ranked(fts.bm25(title_bags, terms, "doc_id").withColumnRenamed("doc_id", "chunk_id"), "title", limit=limit)
    n = hit.agg(F.count("*").alias("n"))
    placed = hit.crossJoin(F.broadcast(n)).withColumn("score", F.round(1 - (F.col("rank") - 1) / F.col("n"), 6)).withColumnRenamed("chunk_id", "doc_id")
    return placed.join(canonical(chunks), "doc_id").select("query_id", "chunk_id", "rank", "score", "retriever")


def by_index(index: Postings, terms: list[str], retriever: str = "fts", limit: int = 50) -> DataFrame:
    """The best chunks out of a stored index, without the blocks that cannot hold one."""
    return ranked(index.best(terms, limit), retriever, limit=limit)


def by_title_index(index: Postings, terms: list[str], heads: DataFrame, limit: int = 20) -> DataFrame:
    """The best titles out of a stored index (its units are document ids), scored by place. heads: doc_id, chunk_id."""
    hit = ranked(index.best(terms, limit, "chunk_id"), "title", limit=limit)
    n = hit.agg(F.count("*").alias("n"))
    placed = hit.crossJoin(F.broadcast(n)).withColumn("score", F.round(1 - (F.col("rank") - 1) / F.col("n"), 6)).withColumnRenamed("chunk_id", "doc_id")
    return placed.join(heads.select("doc_id", "chunk_id"), "doc_id").select("query_id", "chunk_id", "rank", "score", "retriever")


def by_passage(refs: DataFrame, chunks: DataFrame, tags: DataFrame, passages: DataFrame, limit: int = 50) -> DataFrame:
    """Documents that overlap a passage and are at most 3000 wide, narrowest first; no bible or morphology."""
    own = untagged(refs.where("e - s <= 3000"), tags, "kind:bible", "kind:morphology")
    met = overlap_join(own, passages, rs="qs", re="qe").groupBy("query_id", "doc_id").agg(F.min(F.col("e") - F.col("s")).alias("width"))
    scored = met.join(canonical(chunks), "doc_id").withColumn("score", F.round(1 - 0.5 * F.least("width", F.lit(500)) / 500.0, 6))
    return ranked(scored, "passage", F.col("width"), F.col("chunk_id"), limit=limit, query="query_id")


def by_tags(tags: DataFrame, chunks: DataFrame, wanted: list[str], isolated: str = "resource:aquifer", limit: int = 50) -> DataFrame:
    ids = untagged(tagged(chunks.select("doc_id").distinct(), tags, *wanted), tags, isolated)
    return ranked(ids.join(canonical(chunks), "doc_id").withColumn("score", F.lit(1.0)), "tag", F.col("chunk_id"), limit=limit)


def by_kind_text(bags: DataFrame, tags: DataFrame, kind: str, terms: DataFrame | list[str], retriever: str, limit: int = 50) -> DataFrame:
    """BM25 within the documents of a kind, with their own statistics."""
    return by_tagged_text(bags, tags, f"kind:{kind}", terms, retriever, limit)


def by_tagged_text(bags: DataFrame, tags: DataFrame, tag: str, terms: DataFrame | list[str], retriever: str, limit: int = 50) -> DataFrame:
    """BM25 within the documents of a tag, with their own statistics. terms: the words of a query, or a table of them."""
    words = terms if isinstance(terms, list) else [r["term"] for r in terms.select("term").collect()]
    own = tags.where(F.col("tag") == tag).select("doc_id").distinct()
    return ranked(fts.bm25_within(bags, own, words), retriever, limit=limit)


def tiered(retriever: str, *tiers: tuple[DataFrame, float], limit: int = 50) -> DataFrame:
    """The best tier of each chunk: exact matches above partial ones."""
    out = None
    for df, score in tiers:
        own = df.select("chunk_id", F.lit(score).alias("score"))
        out = own if out is None else out.unionByName(own)
    return ranked(out.groupBy("chunk_id").agg(F.max("score").alias("score")), retriever, limit=limit)


def by_topic(topics: DataFrame, name: str, refs: DataFrame, chunks: DataFrame, limit: int = 50) -> DataFrame:
    """Documents over the intervals of the topics of a name (else prefix)."""
    low = F.lower("name")
    exact = topics.where(low == name.lower())
    near = exact.unionByName(topics.where(low.startswith(name.lower())).join(exact.select(F.lit(1).alias("one")).limit(1), F.lit(True), "left_anti"))
    met = overlap_join(refs, near.select(F.col("s").alias("ts"), F.col("e").alias("te"))).groupBy("doc_id").agg(F.min("ts").alias("at"))
    return ranked(met.join(canonical(chunks), "doc_id").withColumn("score", F.lit(1.0)), "topic", F.col("at"), F.col("chunk_id"), limit=limit)


def by_cross_reference(xref: DataFrame, sources: DataFrame, refs: DataFrame, chunks: DataFrame, limit: int = 50) -> DataFrame:
    """Documents over the targets of source verses: editorial ones first, then by rank, nulls last."""
    own = xref.join(sources.select("source"), "source", "left_semi")
    order = F.struct(F.when(F.col("attribution") == "F", 0).otherwise(1).alias("p"), F.coalesce("rank", F.lit(1 << 40)).alias("r"), "ts")
    # the best of each target, and each interval of a document once: pairs grow with distinct intervals, not with lines and documents
    best = own.groupBy("ts", "te").agg(F.min(order).alias("best"))
    at = overlap_join(refs.select("s", "e").distinct(), best).groupBy("s", "e").agg(F.min("best").alias("best"))
    met = refs.select("doc_id", "s", "e").join(at, ["s", "e"]).groupBy("doc_id").agg(F.min("best").alias("best"))
    return ranked(met.join(canonical(chunks), "doc_id").withColumn("score", F.lit(1.0)), "xref", F.col("best"), F.col("chunk_id"), limit=limit)


def minted(ranges: DataFrame, limit: int = 20) -> DataFrame:
    """Synthetic verse hits of ranges within a chapter, at most ``limit``."""
    verse = ranges.where(F.floor(F.col("s") / 1000) == F.floor(F.col("e") / 1000)).select(F.explode(F.sequence("s", "e")).alias("ref")).distinct()
    hit = ranked(verse.select(F.concat(F.lit("verse:"), F.col("ref").cast("string")).alias("chunk_id"), F.lit(1.0).alias("score")), "cfabric", F.col("chunk_id"), limit=limit)
    return hit.withColumn("score", F.round(1 - (F.col("rank") - 1) / limit, 6))


def by_speaker(bags: DataFrame, terms: DataFrame, refs: DataFrame, speakers: DataFrame, name: str, limit: int = 40) -> DataFrame:
    """BM25 hits whose passage begins inside the ranges of a speaker."""
    said = within(refs.select("doc_id", F.col("s").alias("ref")), speakers.where(F.col("speaker") == name).select("s", "e"), "ref").select("doc_id").distinct()
    ids = bags.select("chunk_id", "doc_id").join(said, "doc_id").select("chunk_id")
    return ranked(fts.bm25(bags, terms).join(ids, "chunk_id"), "speaker", limit=limit)


def by_domain(tokens: DataFrame, members: DataFrame, limit: int = 50) -> DataFrame:
    """Chunks by how many distinct members of a domain (at most 60 terms) they hold."""
    n = tokens.join(F.broadcast(members.select("term")), "term").groupBy("chunk_id").agg(F.countDistinct("term").cast("double").alias("score"))
    return ranked(n, "semdomain", limit=limit)


def by_entity(edges: DataFrame, entities: DataFrame, relation: str, per: int = 5) -> DataFrame:
    """The entities that a relation leads to, at most ``per`` an entity, decaying by a running counter."""
    e = edges.where(F.col("relation") == relation).join(entities.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    from pyspark.sql.window import Window

    out = e.withColumn("k", F.row_number().over(Window.partitionBy("target_id").orderBy("source_id"))).where(F.col("k") <= per)
    return ranked(out.select(F.col("source_id").alias("chunk_id"), (1.0 - F.col("k") / 10.0).alias("score")), "entity", F.desc("score"), F.col("chunk_id"), limit=100)
