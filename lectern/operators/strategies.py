"""The five kinds of cards that answer an analysed question, each a builder over its stores.

Questions are rows of ``intents.analysed`` (key and its columns). Every builder gives key, kind, confidence, synthesis, headline, anchor and
drill, at most one card a question: ``synthesis`` is the line that may ground an answer, null where the kind only shows;
``headline`` is the line that is shown. A question that a kind doesn't fit, or whose facts aren't found, has no card.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import refs
from lectern.operators.graph import cut
from lectern.operators.ranking import per_key

#: How prominent a concept is by intent, the intents that want another card, and the default.
PROMINENCE = {"word_study": 1.0, "thematic": 0.7, "topic": 0.6}
SUPPRESSED = ("genealogy", "entity_lookup", "speaker", "methodology")
DEFAULT = 0.5
#: The nouns of relations, and those that hold in both directions.
NOUNS = {"father-of": "father", "mother-of": "mother", "sibling-of": "sibling", "partner-of": "partner"}
SYMMETRIC = ("partner-of", "sibling-of")


def _card(df: DataFrame, key: str, kind: str, confidence: Column, synthesis: Column, headline: Column, anchor: Column, drill: Column) -> DataFrame:
    return df.select(key, F.lit(kind).alias("kind"), confidence.cast("double").alias("confidence"), synthesis.cast("string").alias("synthesis"), headline.alias("headline"), anchor.cast("string").alias("anchor"), drill.cast("string").alias("drill"))


def speaker(asked: DataFrame, key: str, speakers: DataFrame) -> DataFrame:
    """Who is quoted, whether it is divine speech, and in how many passages. speakers: speaker, s, e, divine. Shown only."""
    known = speakers.groupBy(F.lower("speaker").alias("_w")).agg(F.bool_or("divine").alias("divine"), F.countDistinct("s", "e").alias("n"))
    own = asked.where("speaker IS NOT NULL").join(known, F.lower("speaker") == F.col("_w"))
    line = F.concat(F.lit("SPEAKER — "), F.concat_ws(" | ", "speaker", F.when(F.col("divine"), "red-letter / divine speech"), F.when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" quoted passages — answer from their actual words")))))
    return _card(own, key, "speaker", F.lit(1.0), F.lit(None), line, F.col("speaker"), F.concat(F.lit("/speaker/"), "speaker"))


def entity(asked: DataFrame, key: str, entities: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """The richest entity of a name (else of a prefix) with its summary, or its relatives: the relation is the answer.

    entities: id, type, name, metadata (JSON); edges: source_id, target_id, relation. Only an answer grounds; a summary is shown.
    """
    wanted = F.coalesce("related.name", F.get(F.transform(F.filter("tags", lambda x: x.startswith("term:")), lambda x: F.substring(x, 6, 1 << 20)), F.lit(0)))
    own = asked.where(F.col("intent").isin("entity_lookup", "genealogy")).select(key, F.lower(wanted).alias("_n"), F.col("related.relation").alias("relation")).where("_n IS NOT NULL")
    low = F.lower("name")
    names = own.select("_n").distinct()
    exact = entities.join(names, low == F.col("_n")).withColumn("_t", F.lit(0))
    rest = names.join(exact.select("_n").distinct(), "_n", "left_anti").withColumn("_p", F.substring("_n", 1, 3))
    prefix = entities.withColumn("_p", F.substring(low, 1, 3)).join(rest, "_p").where(low.startswith(F.col("_n"))).withColumn("_t", F.lit(1)).drop("_p")  # names meet by their first letters
    met = per_key(exact.unionByName(prefix), ["_n"], 1, F.col("_t"), F.desc(F.length(F.coalesce("metadata", F.lit("")))), F.col("id")).select("_n", "id", "type", "name", "metadata")
    found = cut(own.join(met, "_n"))  # read four times below
    base = F.regexp_replace("relation", "-rev$", "")
    inward = F.col("relation").endswith("-rev")
    by = ["id", "_base", "_in"]
    found = found.withColumn("_base", base).withColumn("_in", inward)
    hop = found.where("relation IS NOT NULL").select(*by).distinct()  # relatives belong to an entity, however many ask for them
    a = hop.where(F.col("_in") | F.col("_base").isin(*SYMMETRIC)).join(edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), F.col("relation").alias("_base")), ["id", "_base"])
    b = hop.where(~F.col("_in") | F.col("_base").isin(*SYMMETRIC)).join(edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), F.col("relation").alias("_base")), ["id", "_base"])
    others = a.unionByName(b).select(*by, "other").distinct().join(entities.select(F.col("id").alias("other"), F.col("name").alias("relative")), "other").select(*by, "relative").distinct()
    few = per_key(others, by, most, F.col("relative")).groupBy(*by).agg(F.array_sort(F.collect_list("relative")).alias("relatives"))
    text = F.trim(F.coalesce(F.get_json_object("metadata", "$.description"), F.lit("")))
    summary = F.substring(F.regexp_extract(F.regexp_replace(text, r"\[([^\]]+)\]\([^)]+\)", "$1"), r"(?s)^(.*?[.!?])(?=\s|$)|^(.*)$", 0), 1, 160)
    own = found.join(few, by, "left")
    noun = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in NOUNS.items() for x in kv]), base), base)
    who = F.when(F.size("relatives") > 0, F.array_join("relatives", ", ")).otherwise("—")
    head = F.when(inward, noun).when(noun.isin("father", "mother"), "children").otherwise(F.concat(noun, F.lit("s")))
    told = F.concat(F.lit("ENTITY — "), head, F.lit(" of "), "name", F.lit(" → "), who)
    plain = F.concat(F.lit("ENTITY — "), "name", F.lit(" ("), "type", F.lit(")"), F.when(F.length(summary) > 0, F.concat(F.lit(": "), summary)).otherwise(""))
    line = F.when(F.col("relation").isNotNull(), told).otherwise(plain)
    return _card(own, key, "entity", F.lit(1.0), F.when(F.size("relatives") > 0, line), line, F.col("name"), F.lit(None))


def passage(asked: DataFrame, key: str, words: DataFrame, speakers: DataFrame, most: int = 6) -> DataFrame:
    """The content words of the cited verse, or of a range's opening verse, rarest meaning first.

    words: ref, idx, word, gloss, keyness, language; only words with a keyness above 0 and a gloss count. speakers: speaker, s, e, divine.
    """
    single = F.get(F.filter("passages", lambda p: p["s"] == p["e"]), F.lit(0))["s"]
    first = F.get("passages", F.lit(0))["s"]
    own = asked.where(F.col("intent").isin("passage_specific", "passage_book")).select(key, F.coalesce(single, first).alias("ref"), single.isNull().alias("opening")).where("ref IS NOT NULL")
    content = words.where("keyness > 0 AND gloss IS NOT NULL AND gloss != ''").join(own.select("ref").distinct(), "ref", "left_semi")
    top = per_key(content, ["ref"], most, F.desc("keyness"), F.col("idx"), F.col("word"))
    told = top.groupBy("ref").agg(F.min("language").alias("language"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("keyness")).alias("k"), "idx", "word", "gloss"))), lambda x: F.concat(x["word"], F.lit("="), x["gloss"])), " · ").alias("shown"))
    said = speakers.withColumn("ref", F.explode(F.sequence("s", F.least("e", F.col("s") + 999)))).groupBy("ref").agg(F.min_by(F.struct("speaker", "divine"), F.struct(F.col("e") - F.col("s"), "speaker")).alias("by"))
    met = own.join(told, "ref").join(said, "ref", "left")
    at = refs.human(F.col("ref"), F.col("ref"))
    voice = F.when(F.col("by").isNotNull(), F.concat(F.lit(" ["), F.col("by.speaker"), F.when(F.col("by.divine"), ", red-letter").otherwise(""), F.lit("]"))).otherwise("")
    line = F.concat(F.lit("PASSAGE "), at, F.when(F.col("opening"), " (opening)").otherwise(""), F.lit(" ("), "language", F.lit(")"), voice, F.lit(" — "), "shown")
    place = F.concat_ws("/", F.lit("/verse"), refs.code_of(refs.book_of(F.col("ref"))), refs.chapter_of(F.col("ref")).cast("string"), refs.verse_of(F.col("ref")).cast("string"))
    return _card(met, key, "passage", F.lit(1.0), line, line, at, place)


def cross_references(asked: DataFrame, key: str, xref: DataFrame, most: int = 8) -> DataFrame:
    """The first cross-references of the one verse that a question asks them for. xref: source, ts, te, rank."""
    single = F.get(F.filter("passages", lambda p: p["s"] == p["e"]), F.lit(0))["s"]
    own = asked.where("intent = 'xref'").select(key, single.alias("source")).where("source IS NOT NULL")
    known = xref.join(own.select("source").distinct(), "source", "left_semi")
    top = per_key(known, ["source"], most, F.asc_nulls_last("rank"), F.col("ts"), F.col("te"))
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("rank", F.lit(1 << 40)).alias("r"), "ts", "te")))
    told = top.groupBy("source").agg(F.array_join(F.transform(ordered, lambda x: refs.human(x["ts"], x["te"])), ", ").alias("shown"))
    at = refs.human(F.col("source"), F.col("source"))
    line = F.concat(F.lit("CROSS-REFS "), at, F.lit(" → "), "shown")
    return _card(own.join(told, "source"), key, "xref", F.lit(1.0), line, line, at, F.lit(None))


def concept(asked: DataFrame, key: str, index: DataFrame, studies: DataFrame) -> DataFrame:
    """The concept that a question turns on: that of its code, else of its keywords' codes the one of greatest keyness.

    index: word, code. studies: code, gloss, senses, equivalents, keyness, domain, siblings. A bare look-up of a word or
    code, and a concept without siblings, is shown but doesn't ground.
    """
    own = asked.where(~F.col("intent").isin(*SUPPRESSED)).select(key, "intent", "codes", (F.size(F.concat("words", "codes")) > 0).alias("bare"), F.concat("words", "keywords").alias("w"))
    named = own.select(key, F.explode("codes").alias("code")).withColumn("tier", F.lit(0))
    by_word = own.select(key, F.explode(F.array_distinct("w")).alias("word")).join(index.select("word", "code").distinct(), "word").select(key, "code").distinct().withColumn("tier", F.lit(1))
    known = named.unionByName(by_word).join(studies, "code").where("tier = 0 OR keyness > 0")
    best = per_key(known, [key], 1, F.col("tier"), F.desc_nulls_last("keyness"), F.col("code"))
    met = own.join(best.drop("tier"), key)
    some = lambda label, xs, n, sep: F.when(F.size(xs) > 0, F.concat(F.lit(label), F.array_join(F.slice(xs, 1, n), sep)))
    line = F.concat(F.lit("CONCEPT — "), F.concat_ws(" | ", F.when(F.length("gloss") > 0, F.concat_ws(" = ", "code", "gloss")).otherwise(F.col("code")), some("sense: ", "senses", 4, "; "), some("equiv: ", "equivalents", 2, ", "), F.when(F.col("keyness") > 0, F.concat(F.lit("keyness "), F.round("keyness", 2).cast("string"))), F.when(F.length("domain") > 0, F.concat(F.lit("domain: "), "domain"))))
    sure = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PROMINENCE.items() for x in kv]), F.col("intent")), F.lit(DEFAULT))
    ground = F.when((F.size("siblings") > 0) & ~F.col("bare"), line)
    return _card(met, key, "concept", sure, ground, line, F.col("code"), F.concat(F.lit("/wordstudy/"), "code"))


def ranked(cards: DataFrame, key: str, featured: float = 0.7) -> DataFrame:
    """The cards of each question by falling confidence, then kind, with their place and whether they lead."""
    w = Window.partitionBy(key).orderBy(F.desc("confidence"), "kind")  # five at most
    return cards.withColumn("place", F.row_number().over(w).cast("long")).withColumn("featured", F.col("confidence") >= featured)
