"""The word-aligned reader: alignment records between the tokens of a source corpus and of a version.

records: source_corpus, version, method (``manual`` or ``transfer``), place, source (ids), target (ids). sources: source_corpus, id,
strong, lemma; the letter before an id in a record or a corpus doesn't count. targets: version, id (BBCCCVVVWWW), text, skip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bare(token: Column) -> Column:
    """A token id without the letters in front."""
    return F.regexp_replace(token, "^[A-Za-z]+", "")


def verse_of_token(token: Column) -> Column:
    """The verse that a target id begins with; null if it doesn't."""
    head = F.substring(token, 1, 8)
    return F.when(head.rlike(r"^\d{8}$"), head.cast("long"))


def _picked(records: DataFrame, sources: DataFrame) -> DataFrame:
    """The records with the first of their source tokens that has a code; records without one go."""
    known = sources.where("strong IS NOT NULL AND strong != ''").groupBy("source_corpus", bare(F.col("id")).alias("_b")).agg(F.max_by(F.struct("id", "strong", "lemma"), "id").alias("_s"))
    own = ["source_corpus", "version", "method", "place"]
    each = records.select(*own, F.posexplode("source").alias("_p", "_id")).withColumn("_b", bare(F.col("_id")))
    first = each.join(known, ["source_corpus", "_b"]).groupBy(*own).agg(F.min_by("_s", "_p").alias("_s"))
    return records.select(*own, "target").join(first, own).select(*own, "target", F.col("_s.id").alias("source_id"), F.col("_s.strong").alias("strong"), F.col("_s.lemma").alias("lemma"))


def attestations(records: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Every method's attestation of a target token: ref, target_id, source_id, surface, strong, lemma, method, source_corpus, version."""
    each = _picked(records, sources).withColumn("target_id", F.explode("target"))
    known = targets.select("version", F.col("id").alias("target_id"), F.coalesce("text", F.lit("")).alias("surface"), verse_of_token(F.col("id")).alias("ref")).where("ref IS NOT NULL")
    return each.join(known, ["version", "target_id"]).select("ref", "target_id", "source_id", "surface", "strong", "lemma", "method", "source_corpus", "version")


def preferred(records: DataFrame) -> DataFrame:
    """Of each source corpus and version the manual records, if it has any, else all."""
    manual = records.where("method = 'manual'").select("source_corpus", "version").distinct()
    return records.where("method = 'manual'").unionByName(records.where("method != 'manual'").join(manual, ["source_corpus", "version"], "left_anti"))


def aligned_verses(records: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """version, ref, text, strongs, tokens: each verse rebuilt from its tokens, which take the first code that aligns to them.

    Source corpora come by name, records by place. A token flagged ``skip`` has no space after it.
    """
    codes = _picked(preferred(records), sources).select("version", "source_corpus", "place", "strong", F.explode("target").alias("id"))
    first = codes.groupBy("version", "id").agg(F.min_by("strong", F.struct("source_corpus", "place")).alias("strong"))
    own = targets.select("version", "id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("skip", F.lit(False)).alias("skip"), verse_of_token(F.col("id")).alias("ref")).where("ref IS NOT NULL")
    verse = own.join(first, ["version", "id"], "left").groupBy("version", "ref").agg(F.array_sort(F.collect_list(F.struct("id", "text", "skip", "strong"))).alias("t"))
    text = F.trim(F.array_join(F.transform("t", lambda x: F.concat(x["text"], F.when(x["skip"], "").otherwise(" "))), ""))
    strongs = F.array_sort(F.array_distinct(F.filter(F.transform("t", lambda x: x["strong"]), lambda c: c.isNotNull())))
    return verse.select("version", "ref", text.alias("text"), strongs.alias("strongs"), F.transform("t", lambda x: F.struct(x["text"].alias("surface"), x["strong"])).alias("tokens"))
