"""Smaller jobs: speaker ranges, series, topic verses, denoise scores, code fields, bare names, chunking strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import slug
from lectern.operators.ranking import per_key, sliding
from lectern.sources.places import verse_key
from lectern.sources.scans import strongs_code


def speaker_ranges(projections: DataFrame, characters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ranges, skipped): speaker, alt, s, e, kind, delivery, divine (``Y`` or empty), each once; and one row with the number of rows that don't count.

    projections: start, end (``GEN.1.1``), speaker, alt, kind, delivery. A row counts with both verses and a speaker; ends are put in order.
    characters: name, divine (true if any row says so).
    """
    # equal rows are parsed once; the keys come out of a generator, so that no later step writes their expressions out again
    once = projections.groupBy("start", "end", *[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("speaker", "alt", "kind", "delivery")]).agg(F.count("*").alias("n"))
    own = once.select("*", F.inline(F.array(F.struct(verse_key(F.col("start")).alias("a"), verse_key(F.col("end")).alias("b")))))
    good = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("speaker") != "")
    known = characters.groupBy(F.col("name").alias("speaker")).agg(F.bool_or("divine").alias("d"))
    ranges = own.where(good).select("speaker", "alt", F.least("a", "b").alias("s"), F.greatest("a", "b").alias("e"), "kind", "delivery").distinct()
    named = ranges.join(known, "speaker", "left").select("speaker", "alt", "s", "e", "kind", "delivery", F.when(F.col("d"), "Y").otherwise("").alias("divine"))
    return named, own.agg(F.coalesce(F.sum(F.when(~good, F.col("n"))), F.lit(0)).alias("skipped"))


def series(documents: DataFrame, prefix: str) -> DataFrame:
    """series, slug, label, n: documents (series, title) by video; titles that differ in their strategy suffix count together.

    A title loses what stands before a dash if it begins with ``prefix``, and a bracket at its end. The label is the least title's.
    """
    title = F.col("title")
    bare = F.when(title.startswith(prefix) & F.contains(title, F.lit("—")), F.trim(F.regexp_replace(title, "^[^—]*—", ""))).otherwise(title)
    plain = F.when(bare.rlike(r"\(.*\)$"), F.trim(F.regexp_replace(bare, r"\([^(]*\)$", ""))).otherwise(bare)
    one = documents.groupBy("series", "title").agg(F.count("*").alias("m")).withColumn("label", plain)
    return one.groupBy("series", slug(F.col("label")).alias("slug")).agg(F.min_by("label", "title").alias("label"), F.sum("m").alias("n"))


def topic_verses(topics: DataFrame, asked: DataFrame, most_topics: int = 3, most: int = 10) -> DataFrame:
    """q, refs: the first verses of the topics of a name, at most ``most_topics`` of them, else of those that begin with it. asked: q, name."""
    low = F.lower("name")
    own = topics.select("topic_id", low.alias("n"), "s")
    names = own.select("topic_id", "n").distinct()
    wanted = asked.select("q", low.alias("w"))
    exact = wanted.join(names, F.col("w") == F.col("n")).select("q", "topic_id")
    rest = wanted.join(exact.select("q").distinct(), "q", "left_anti").withColumn("_p", F.substring("w", 1, 3))
    begin = names.withColumn("_p", F.substring("n", 1, 3)).join(rest, "_p").where(F.col("n").startswith(F.col("w"))).select("q", "topic_id")
    met = per_key(exact.unionByName(begin), ["q"], most_topics, F.col("topic_id")).join(own, "topic_id")
    few = per_key(met, ["q"], most, F.col("s"), F.col("topic_id"))
    return few.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "topic_id"))), lambda x: x["s"]).alias("refs"))


def denoised(results: DataFrame, subjects: DataFrame, noise: DataFrame) -> DataFrame:
    """q, noise, subject_first, subject_present of ranked codes (q, rank, code); subjects and noise: q, code."""
    own = results.join(subjects.select("q", "code", F.lit(True).alias("s")).distinct(), ["q", "code"], "left").join(noise.select("q", "code", F.lit(True).alias("n")).distinct(), ["q", "code"], "left")
    first = F.coalesce(F.min_by(F.coalesce("s", F.lit(False)), "rank"), F.lit(False))
    return own.groupBy("q").agg(F.count("n").alias("noise"), first.alias("subject_first"), (F.count("s") > 0).alias("subject_present"))


def codes_in(field: Column) -> Column:
    """All codes of a composite field, padded, sorted, each once."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(field, F.lit("")), F.lit(r"[GH]\d+[A-Za-z]?"), F.lit(0)), lambda c: strongs_code(c))))


def morphology_in(field: Column) -> Column:
    """What stands behind the first equals sign, else the whole field."""
    own = F.coalesce(field, F.lit(""))
    return F.trim(F.when(F.contains(own, F.lit("=")), F.regexp_replace(own, "^[^=]*=", "")).otherwise(own))


def bare_forms(name: Column, prepositions: tuple[str, ...]) -> Column:
    """The forms of a book's name without a leading preposition, and with a plain ordinal, that differ from it; each once."""
    first = F.trim(F.regexp_replace(name, "^(?:" + "|".join(prepositions) + r")\s+", ""))
    second = F.trim(F.regexp_replace(name, r"^(\d)\s*-?[ея]\s+", "$1 "))
    return F.array_distinct(F.filter(F.array(first, second), lambda f: f != name))


def strategies(documents: DataFrame, size: int = 800, overlap: int = 150) -> DataFrame:
    """strategy, id, body: documents (doc_id, text) cut by line, as wholes and by sliding windows; ids name the strategy, document and place."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "body")).where(F.trim("body") != "")
    words = documents.select("doc_id", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("w"))
    windows = sliding(words, "w", size, overlap).select("doc_id", F.col("chunk").alias("i"), F.array_join("slice", " ").alias("body"))
    out = None
    for name, df in (("line", lines), ("document", documents.where("text IS NOT NULL").select("doc_id", F.lit(0).alias("i"), F.col("text").alias("body"))), ("window", windows)):
        own = df.select(F.lit(name).alias("strategy"), F.concat_ws(":", F.lit(name), F.col("doc_id").cast("string"), F.lpad(F.col("i").cast("string"), 5, "0")).alias("id"), "body")
        out = own if out is None else out.unionByName(own)
    return out


def strategy_statistics(chunks: DataFrame) -> DataFrame:
    """strategy, chunks, first, last, words, least, most, mean of chunks (strategy, id, body)."""
    n = F.size(F.regexp_extract_all("body", F.lit(r"\S+"), F.lit(0))).cast("long")
    return chunks.select("strategy", "id", n.alias("n")).groupBy("strategy").agg(F.count("*").alias("chunks"), F.min("id").alias("first"), F.max("id").alias("last"), F.sum("n").alias("words"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 2).alias("mean"))
