"""Query expansion over glosses, surfaces, bridges and domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def reverse_index(words: DataFrame) -> DataFrame:
    """word, strong, quality: 2 for a content gloss, 1 for others; the best of each pair."""
    return words.select(F.col("surface").alias("word"), "strong", (F.col("is_content") + 1).alias("quality")).groupBy("word", "strong").agg(F.max("quality").alias("quality"))


def concepts(index: DataFrame, keyness: DataFrame, per_word: int = 2, total: int = 4, floor: float = -1.0) -> DataFrame:
    """word, strong, keyness: for each word its best codes by keyness, then the best of all."""
    k = index.join(keyness, "strong").where(F.col("keyness") >= floor)
    own = k.withColumn("rn", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("quality"), F.desc("keyness"), "strong"))).where(F.col("rn") <= per_word)
    return own.orderBy(F.desc("keyness"), "word", "strong").limit(total).select("word", "strong", "keyness")


def family(surfaces: DataFrame, floor: float = 0.15, per_word: int = 4) -> DataFrame:
    """word, other: surfaces (surface, strong, share) of one code that both take at least ``floor`` of it."""
    own = surfaces.where(F.col("share") >= floor)
    pairs = own.select(F.col("surface").alias("word"), "strong").join(own.select(F.col("surface").alias("other"), "strong", "share"), "strong").where("word <> other")
    best = pairs.groupBy("word", "other").agg(F.max("share").alias("share"))
    return best.withColumn("rn", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("share"), "other"))).where(F.col("rn") <= per_word).select("word", "other")


def bridge(counts: DataFrame, frequency: DataFrame, common: int = 1500, least: int = 2, per_key: int = 2) -> DataFrame:
    """s, p, n of bridge counts without the commonest keys."""
    own = counts.where(F.col("n") >= least).join(frequency.where(F.col("freq") < common), "s", "left_semi")
    return own.withColumn("rn", F.row_number().over(Window.partitionBy("s").orderBy(F.desc("n"), "p"))).where(F.col("rn") <= per_key).select("s", "p", "n")


def siblings(domains: DataFrame, share: float = 0.5, most: int = 80, per: int = 2) -> DataFrame:
    """strong, other: codes of one primary domain (strong, domain, share, centrality), the most central first."""
    own = domains.where(F.col("share") >= share)
    size = own.groupBy("domain").agg(F.count("*").alias("size")).where(F.col("size") <= most)
    d = own.join(size, "domain")
    pairs = d.select("strong", "domain").join(d.select(F.col("strong").alias("other"), "domain", "centrality"), "domain").where("strong <> other")
    return pairs.withColumn("rn", F.row_number().over(Window.partitionBy("strong").orderBy(F.desc("centrality"), "other"))).where(F.col("rn") <= per).select("strong", "other")
