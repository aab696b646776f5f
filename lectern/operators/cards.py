"""Cards: candidate summaries by strategy, ordered by confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The same cards as DuckDB SQL over titles, refs and tags.
SQL = "SELECT doc_id, kind, title, confidence, confidence >= 0.7 AS featured FROM (SELECT t.doc_id, k.kind, t.title, round(CASE WHEN e - s < 10 THEN 0.9 WHEN e - s < 100 THEN 0.7 ELSE 0.4 END - length(t.title) / 1000.0, 4) AS confidence FROM titles t JOIN refs USING (doc_id) JOIN (SELECT doc_id, min(tag[6:]) AS kind FROM tags WHERE tag LIKE 'kind:%' GROUP BY 1) k USING (doc_id))"


def assemble(titles: DataFrame, refs: DataFrame, tags: DataFrame, featured: float = 0.7) -> DataFrame:
    """doc_id, kind, title, confidence, featured: narrow passages are surer."""
    from lectern.operators.tags import kind_of

    w = F.col("e") - F.col("s")
    sure = F.when(w < 10, 0.9).when(w < 100, 0.7).otherwise(0.4) - F.length("title") / 1000.0
    c = titles.join(refs, "doc_id").join(kind_of(tags), "doc_id").select("doc_id", "kind", "title", F.round(sure, 4).alias("confidence"))
    return c.withColumn("featured", F.col("confidence") >= featured)


def layout(cards: DataFrame) -> DataFrame:
    """kind, n, layout by the number of cards."""
    n = cards.groupBy("kind").agg(F.count("*").alias("n"))
    return n.withColumn("layout", F.when(F.col("n") >= 200, "tree").when(F.col("n") >= 50, "deck").otherwise("hero"))
