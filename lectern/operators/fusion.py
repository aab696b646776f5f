"""Rank fusion of retrievers: hits are (query_id, chunk_id, rank from 1, score, retriever)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators.ranking import numbered

K = 60
#: Weights by intent of the retrievers, in this order; a missing intent counts as thematic.
RETRIEVERS = ("fts", "title", "passage", "scripture", "tag", "vector", "lexicon", "morphology", "entity", "bible", "topic", "xref", "cfabric", "aquifer", "speaker", "semdomain")
WEIGHTS = {
    "thematic": (1.0, 0.5, 1.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.5, 0.0, 0.0, 0.0, 0.5, 0.0, 0.8),
    "entity_lookup": (1.0, 2.5, 0.8, 0.0, 1.5, 1.0, 0.0, 0.0, 0.5, 0.5, 0.0, 0.0, 0.0, 0.2, 0.0, 0.0),
    "passage_specific": (1.0, 0.6, 1.2, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.5, 1.5, 0.2, 0.0, 0.0),
    "passage_book": (1.0, 0.6, 1.1, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.5, 0.0, 0.0, 0.5, 0.2, 0.0, 0.0),
    "methodology": (1.0, 1.5, 1.0, 0.0, 1.0, 1.2, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    "word_study": (0.3, 0.5, 0.0, 0.0, 0.5, 0.5, 3.0, 1.5, 0.0, 0.0, 0.0, 0.0, 2.0, 0.2, 0.0, 1.0),
    "morphology": (0.3, 0.3, 0.5, 0.0, 0.5, 0.0, 1.0, 3.0, 0.0, 0.5, 0.0, 0.0, 2.5, 0.2, 0.0, 0.0),
    "genealogy": (0.5, 1.0, 0.0, 0.0, 1.0, 0.5, 0.0, 0.0, 3.0, 0.5, 0.0, 0.0, 0.0, 0.2, 0.0, 0.0),
    "topic": (0.5, 0.5, 0.5, 0.0, 0.5, 0.5, 0.0, 0.0, 0.0, 0.5, 3.0, 0.0, 0.0, 0.4, 0.0, 0.5),
    "xref": (0.5, 0.5, 0.5, 0.0, 0.5, 0.5, 0.0, 0.0, 0.0, 0.5, 0.0, 3.0, 0.0, 0.2, 0.0, 0.0),
    "speaker": (0.5, 0.3, 0.0, 0.0, 0.5, 0.5, 0.0, 0.0, 0.0, 0.5, 0.0, 0.0, 0.0, 0.3, 3.0, 0.0),
}


def weights(spark: SparkSession) -> DataFrame:
    """intent, retriever, weight: a small dimension table."""
    rows = [(i, r, w) for i, ws in WEIGHTS.items() for r, w in zip(RETRIEVERS, ws)]
    return spark.createDataFrame(rows, "intent string, retriever string, weight double")


def ranked(df: DataFrame, retriever: str, *order, limit: int = 50, query: str | None = None) -> DataFrame:
    """Hits of one retriever out of (chunk_id, score[, query_id]): the first ``limit`` of each query."""
    q = F.col(query) if query else F.lit(0).cast("long")
    out = df.withColumn("query_id", q).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*(order or (F.desc("score"), F.col("chunk_id"))))).cast("long"))
    return out.where(F.col("rank") <= limit).select("query_id", "chunk_id", "rank", F.col("score").cast("double").alias("score"), F.lit(retriever).alias("retriever"))


def rrf(hits: DataFrame, weighted: DataFrame | None = None, k: int = K) -> DataFrame:
    """query_id, chunk_id, score, retrievers: sum of w / (k + rank); weights of 0 drop a retriever."""
    if weighted is None:
        hits = hits.withColumn("weight", F.lit(1.0))
    else:
        hits = hits.join(F.broadcast(weighted.select("retriever", "weight").where("weight > 0")), "retriever")
    return hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("weight") / (F.lit(k) + F.col("rank"))), 8).alias("score"), F.array_sort(F.collect_set("retriever")).alias("retrievers"))


def folded(base: DataFrame, sims: DataFrame, k: int = K) -> DataFrame:
    """chunk_id, score of a base order and a cosine order, ranks from 0, fused."""
    both = base.join(sims, "chunk_id")
    by_score, by_similarity = places(both, "score"), places(both, "sim")
    return by_score.join(by_similarity, "chunk_id").select("chunk_id", F.round(1.0 / (k + F.col("score_at")) + 1.0 / (k + F.col("sim_at")), 8).alias("score"))


def places(df: DataFrame, value: str) -> DataFrame:
    """chunk_id and its place from 0 by falling value, ties by id; no task sorts the table, however many values are equal."""
    return numbered(df.select("chunk_id", value), F.desc(value), F.col("chunk_id"), name=f"{value}_at").drop(value)


def branches(fused: DataFrame, kinds: DataFrame, per_branch: int = 8) -> DataFrame:
    """kind, chunk_id, score, relative, place, total: hits by kind, each branch capped after counting."""
    w = Window.partitionBy("query_id", "kind")
    out = fused.join(kinds, "chunk_id").withColumn("total", F.count("*").over(w)).withColumn("relative", F.round(F.col("score") / F.max("score").over(w), 4)).withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "chunk_id")).cast("long"))
    return out.where(F.col("place") <= per_branch).select("query_id", "kind", "chunk_id", "score", "relative", "place", "total")


#: The branches in order and the kinds that each groups; unmapped kinds go to the last.
BRANCHES = {
    "lexicon": ("lexicon",), "study": ("study-note", "book-intro"), "terms": ("term", "translator-note", "question"), "verses": ("bible", "scripture"), "morphology": ("morphology",), "methodology": ("methodology",),
    "media": ("video-transcript", "section-heading"), "other": (),
}


def branched(fused: DataFrame, kinds: DataFrame, featured: tuple[str, ...] = (), anchored: DataFrame | None = None, sims: DataFrame | None = None, per_branch: int = 8, k: int = K) -> DataFrame:
    """branch, featured, place, chunk_id, score, total: hits by branch, featured branches first, each capped after counting.

    fused: chunk_id, score, gated already. kinds: chunk_id, kind. anchored (chunk_id, m): articles of the query's codes, which lead the terms by
    falling m unless they are there. sims (chunk_id, sim): the query's cosines; where a branch has two or more, its order and
    that of the cosines are fused, but for the terms, whose lead is deliberate. A branch without hits has one empty row if
    it is featured, else none.
    """
    home = F.lit("other")
    for branch, own in BRANCHES.items():
        if own:
            home = F.when(F.col("kind").isin(*own), branch).otherwise(home)
    hits = fused.select("chunk_id", "score").join(kinds.groupBy("chunk_id").agg(F.min("kind").alias("kind")), "chunk_id", "left").select("chunk_id", "score", home.alias("branch"))
    order = Window.partitionBy("branch").orderBy(F.desc("score"), "chunk_id")  # fused hits: some fifty for each retriever
    based = hits.withColumn("base", F.row_number().over(order) - 1)
    if sims is None:
        placed = based.withColumn("by", F.col("base").cast("double"))
    else:
        near = based.join(sims.select("chunk_id", "sim"), "chunk_id", "left")
        w = Window.partitionBy("branch")
        rank = F.when(F.col("sim").isNotNull(), F.row_number().over(w.orderBy(F.desc_nulls_last("sim"), "base")) - 1)
        folded = near.withColumn("c", rank).withColumn("m", F.count("sim").over(w))
        value = 1.0 / (k + F.col("base")) + F.coalesce(1.0 / (k + F.col("c")), F.lit(0.0))
        placed = folded.withColumn("by", F.when((F.col("m") < 2) | (F.col("branch") == "terms"), F.col("base").cast("double")).otherwise(-F.round(value, 12))).drop("sim", "c", "m")
    rows = placed.select("branch", "chunk_id", "score", F.struct(F.lit(1).alias("t"), "by", F.col("base").cast("long").alias("b"), "chunk_id").alias("at"))
    if anchored is not None:
        lead = anchored.groupBy("chunk_id").agg(F.max("m").alias("m")).join(hits.where("branch = 'terms'").select("chunk_id"), "chunk_id", "left_anti").orderBy(F.desc("m"), "chunk_id").limit(30)
        rows = rows.unionByName(lead.select(F.lit("terms").alias("branch"), "chunk_id", F.lit(1.0).alias("score"), F.struct(F.lit(0).alias("t"), (-F.col("m")).cast("double").alias("by"), F.lit(0).cast("long").alias("b"), "chunk_id").alias("at")))
    w = Window.partitionBy("branch")
    shown = rows.withColumn("total", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy("at")).cast("long")).where(F.col("place") <= per_branch).drop("at")
    every = fused.sparkSession.createDataFrame([(b, b in featured, i) for i, b in enumerate(BRANCHES)], "branch string, featured boolean, number int")
    out = F.broadcast(every).join(shown, "branch", "left").where("chunk_id IS NOT NULL OR featured")
    return out.select("branch", "featured", "number", F.coalesce("place", F.lit(0)).alias("place"), "chunk_id", "score", F.coalesce("total", F.lit(0)).alias("total"))
