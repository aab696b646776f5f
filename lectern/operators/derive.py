"""Derived tables over word stores: shares, senses, registries, attestations, consolidation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_or_frequent(counts: DataFrame, key: str, value: str, least: int = 2) -> DataFrame:
    """key, value, n, share of (key, value, n): the first of each key, and all of ``least`` or more."""
    w = Window.partitionBy(key)
    out = counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 3)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), value)))
    return out.where((F.col("rn") == 1) | (F.col("n") >= least)).drop("rn")


def sense_inventory(occurrences: DataFrame) -> DataFrame:
    """lex, stem, sense, n, label, rank, share: the first sense of each stem, and all that occur twice."""
    c = occurrences.groupBy("lex", "stem", "sense").agg(F.count("*").alias("n"), F.min("surface").alias("label"))
    w = Window.partitionBy("lex", "stem")
    out = c.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "sense")).cast("long")).withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 3))
    return out.where("rank = 1 OR n >= 2")


def concept_registry(words: DataFrame) -> DataFrame:
    """strong, n, gloss, elaboration, surfaces: of each code its count, first gloss, and the most content codes that share a gloss."""
    g = words.select("strong", "surface", "is_content").distinct()
    e = g.groupBy("surface").agg(F.countDistinct(F.when(F.col("is_content") == 1, F.col("strong"))).alias("k"))
    n = words.groupBy("strong").agg(F.count("*").alias("n"))
    return g.join(e, "surface").groupBy("strong").agg(F.min("surface").alias("gloss"), F.max("k").alias("elaboration"), F.countDistinct("surface").alias("surfaces")).join(n, "strong").select("strong", "n", "gloss", "elaboration", "surfaces")


def attestation(words: DataFrame) -> DataFrame:
    """strong, surface, method (or all), n, verses: both tiers in one pass."""
    ref = F.col("book") * 1000000 + F.col("chapter") * 1000 + F.col("verse")
    base = words.withColumn("ref", ref)
    tier = base.groupBy("strong", "surface", F.col("morph").alias("method")).agg(F.count("*").alias("n"), F.countDistinct("ref").alias("verses"))
    return tier.unionByName(base.groupBy("strong", "surface").agg(F.count("*").alias("n"), F.countDistinct("ref").alias("verses")).withColumn("method", F.lit("all")))


def three_tiers(words: DataFrame, often: int = 20, share: float = 0.7) -> DataFrame:
    """surface, strong: by the surface where it is frequent, by a majority of its lemma, by a unique skeleton."""
    exact = words.groupBy("surface").agg(F.min("strong").alias("a"), F.count("*").alias("n")).where(F.col("n") >= often).drop("n")
    v = words.groupBy("lemma", "strong").agg(F.count("*").alias("n"))
    vote = v.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("lemma"))).where(F.col("share") >= share).groupBy("lemma").agg(F.min("strong").alias("b"))
    skeleton = words.groupBy(F.substring("lemma", 1, 3).alias("k")).agg(F.min("strong").alias("c"), F.countDistinct("strong").alias("n")).where("n = 1").drop("n")
    own = words.select("surface", "lemma").distinct()
    return own.join(exact, "surface", "left").join(vote, "lemma", "left").join(skeleton, F.substring("lemma", 1, 3) == F.col("k"), "left").select("surface", F.coalesce("a", "b", "c").alias("strong")).distinct()


def consolidated(points: DataFrame, gap: int = 2) -> DataFrame:
    """s, e, n, best: runs of keys at most ``gap`` apart.

    A gap that small never leaves a chapter, so islands form by chapter, and no single task sorts all keys.
    """
    chapter = Window.partitionBy("chapter").orderBy("s")
    p = points.withColumn("chapter", F.floor(F.col("s") / 1000))
    new = F.when(F.col("s") - F.lag("s").over(chapter) <= gap, 0).otherwise(1)
    i = p.withColumn("new", new).withColumn("island", F.sum("new").over(chapter.rowsBetween(Window.unboundedPreceding, 0)))
    return i.groupBy("chapter", "island").agg(F.min("s").alias("s"), F.max("s").alias("e"), F.count("*").alias("n"), F.min("doc_id").alias("best")).drop("chapter", "island")


def article_text(documents: DataFrame, reachable: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text without heading marks, of the documents whose key is reachable."""
    plain = F.regexp_replace(text, r"(?md)^#+ *", "")
    return documents.join(reachable.select(key).distinct(), key, "left_semi").select(key, plain.alias("text"))


def flat_dictionary(files: DataFrame) -> DataFrame:
    """lang, code, gloss: the entries of dictionary files (lang, body as a JSON list of entries); a malformed file has none."""
    entries = F.from_json("body", "array<struct<code string, gloss string>>")
    return files.select("lang", F.explode(entries).alias("x")).select("lang", "x.code", "x.gloss").where("code IS NOT NULL")
