"""Operators over word stores (book, chapter, verse, idx, surface, strong, lemma, morph)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSE = ["book", "chapter", "verse"]


def construction(words: DataFrame, first: str, second: str) -> DataFrame:
    """For each word of the first form, the nearest later one of the second in its verse."""
    a = words.where(F.col("morph") == first).select(*VERSE, F.col("idx").alias("first"))
    b = words.where(F.col("morph") == second).select(*VERSE, F.col("idx").alias("second"))
    return a.join(b, VERSE).where("second > first").groupBy(*VERSE, "first").agg(F.min("second").alias("second"))


def frame_filter(df: DataFrame, **wanted) -> DataFrame:
    """Rows that meet every given feature; None, and columns that the table lacks, don't constrain. One at least is needed."""
    used = {k: v for k, v in wanted.items() if v is not None}
    if not used:
        raise ValueError("a search needs one feature at least")
    for k, v in used.items():
        if k in df.columns:
            df = df.where(F.col(k).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(k) == v)
    return df


def positional(words: DataFrame, source: str = "P") -> DataFrame:
    """The proportional place among a verse's other words of each word of a form."""
    n = words.groupBy(*VERSE).agg(F.count("*").alias("n"))
    last = words.where(F.col("morph") != source).groupBy(*VERSE).agg(F.max("idx").alias("last"))
    w = words.where(F.col("morph") == source).join(n, VERSE).join(last, VERSE)
    return w.select(*VERSE, "idx", F.least(F.floor(F.col("idx") * (F.col("last") + 1) / F.col("n")), F.col("last")).cast("long").alias("target"))


def node(prefix: str = ""):
    c = lambda x: F.col(prefix + x)
    return c("book") * 100000000 + c("chapter") * 100000 + c("verse") * 100 + c("idx")


def lexeme_feed(words: DataFrame, order: str = "frequency", limit: int = 50, seed: int = 0) -> DataFrame:
    """lemma, n, node: one representative, its first, of each lexeme; ``frequency``, ``rare`` or ``random`` first."""
    n = words.groupBy("lemma").agg(F.count("*").alias("n"), F.min(node()).alias("node"))
    by = {"frequency": [F.desc("n"), F.col("lemma")], "rare": [F.col("n"), F.col("lemma")], "random": [F.xxhash64(F.col("lemma"), F.lit(seed))]}[order]
    return n.orderBy(*by).limit(limit)


def passage(words: DataFrame, book: int, chapter: int, start: int = 1, end: int | None = None) -> DataFrame:
    """The verses of a range with their words in order."""
    own = words.where((F.col("book") == book) & (F.col("chapter") == chapter) & (F.col("verse") >= start))
    if end is not None:
        own = own.where(F.col("verse") <= end)
    return verses(own)


def verses(words: DataFrame) -> DataFrame:
    """book, chapter, verse, text: the words of each verse in order."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "surface")))
    return words.groupBy(*VERSE).agg(F.array_join(F.transform(ordered, lambda x: x["surface"]), " ").alias("text"))


def syntax_tree(words: DataFrame) -> DataFrame:
    """book, chapter, verse, clauses: a verse's phrases of four words, each with its words."""
    phrase = words.withColumn("phrase", F.floor(F.col("idx") / 4).cast("long")).groupBy(*VERSE, "phrase").agg(F.array_sort(F.collect_list(F.struct("idx", "surface", "morph"))).alias("words"))
    return phrase.groupBy(*VERSE).agg(F.array_sort(F.collect_list(F.struct("phrase", "words"))).alias("clauses"))
