"""Word gates, registries, composites and fills over code-keyed word stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators.ranking import per_key


def word_gates(words: DataFrame, glosses: DataFrame, stops: DataFrame, frames: DataFrame, functions: DataFrame, keyness: DataFrame, floor: float) -> DataFrame:
    """q, word that survive: no stop or frame word; three letters or fewer only with an exact gloss; not where all
    matched codes (the exact ones, if any) are function codes, or all are known to be of low keyness.

    words (q, word), glosses (word, code, quality: 2 exact, 1 part), stops and frames (word), functions (code), keyness (code, score).
    """
    own = words.distinct().join(stops.select("word"), "word", "left_anti").join(frames.select("word"), "word", "left_anti")
    told = glosses.join(functions.select("code", F.lit(True).alias("is_function")), "code", "left").join(keyness.select("code", "score"), "code", "left")
    best = told.groupBy("word").agg(F.max("quality").alias("best"))
    relevant = told.join(best, "word").where(F.col("quality") == F.col("best"))
    verdict = relevant.groupBy("word").agg(F.max("best").alias("best"), F.bool_and(F.coalesce("is_function", F.lit(False))).alias("idle"), F.bool_and(F.coalesce(F.col("score") <= floor, F.lit(False))).alias("low"))
    short = F.length("word") <= 3
    kept = F.when(F.col("best").isNull(), ~short).otherwise(~(short & (F.col("best") < 2)) & ~F.col("idle") & ~F.col("low"))
    return own.join(verdict, "word", "left").where(kept).select("q", "word")


def concept_table(words: DataFrame, glosses: DataFrame, articles: DataFrame, keyness: DataFrame) -> DataFrame:
    """code, lemma, n, function, keyness, articles, key_term, gloss, elaboration of every code of a word store.

    words (code, lemma, n, is_content; any number of rows for each lemma), glosses (code, word), articles (code, slug, head, key), keyness (code, score).
    The lemma is the most frequent; only articles whose head names the code count; elaboration is the largest number
    of content codes that share one of the code's gloss words.
    """
    lemmas = words.groupBy("code", "lemma").agg(F.sum("n").alias("m"), F.max("is_content").alias("c"))
    base = lemmas.groupBy("code").agg(F.min_by("lemma", F.struct(-F.col("m"), "lemma")).alias("lemma"), F.sum("m").alias("n"), (F.max("c") == 0).alias("function"))
    own = articles.groupBy("code").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("head"), F.col("slug")))), " ").alias("articles"), F.bool_or("key").alias("key_term"))
    g = glosses.distinct()
    content = base.where("NOT function").select("code")
    shared = g.join(content, "code", "left_semi").groupBy("word").agg(F.count("*").alias("shared"))
    spread = g.join(shared, "word").groupBy("code").agg(F.max("shared").alias("elaboration"))
    first = g.groupBy("code").agg(F.min("word").alias("gloss"))
    out = base.join(keyness.select("code", F.col("score").alias("keyness")), "code", "left").join(own, "code", "left").join(first, "code", "left").join(spread, "code", "left")
    return out.select("code", "lemma", "n", "function", "keyness", F.coalesce("articles", F.lit("")).alias("articles"), F.coalesce("key_term", F.lit(False)).alias("key_term"), "gloss", F.coalesce("elaboration", F.lit(0)).cast("long").alias("elaboration"))


def word_study(words: DataFrame, domains: DataFrame, keyness: DataFrame, siblings: int = 6) -> DataFrame:
    """code, gloss, n, keyness, domains, siblings, stems, books of every code.

    words (code, surface, stem, book), domains (code, domain), keyness (code, score). Siblings are the most frequent
    codes of the code's first domain.
    """
    seen = words.groupBy("code", "surface").agg(F.count("*").alias("m"))
    base = seen.groupBy("code").agg(F.min_by("surface", F.struct(-F.col("m"), "surface")).alias("gloss"), F.sum("m").alias("n"))
    named = lambda key, name: words.groupBy("code", key).agg(F.count("*").alias("m")).groupBy("code").agg(F.array_sort(F.collect_list(F.concat_ws("=", F.col(key).cast("string"), F.col("m").cast("string")))).alias(name))
    d = domains.distinct()
    first = d.groupBy("code").agg(F.min("domain").alias("domain"))
    ranked = per_key(first.join(base.select("code", "n"), "code"), ["domain"], siblings + 1, F.desc("n"), F.col("code")).select("domain", F.col("code").alias("other"), "rn")
    near = first.join(ranked, "domain").where("code != other")
    near = per_key(near.drop("rn").join(ranked.select("domain", "other", F.col("rn").alias("place")), ["domain", "other"]), ["code"], siblings, F.col("place")).groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "other"))), lambda x: x["other"]).alias("siblings"))
    lists = d.groupBy("code").agg(F.array_sort(F.collect_list("domain")).alias("domains"))
    out = base.join(keyness.select("code", F.col("score").alias("keyness")), "code", "left").join(lists, "code", "left").join(near, "code", "left").join(named("stem", "stems"), "code", "left").join(named("book", "books"), "code", "left")
    none = F.array().cast("array<string>")
    return out.select("code", "gloss", "n", "keyness", F.coalesce("domains", none).alias("domains"), F.coalesce("siblings", none).alias("siblings"), "stems", "books")


def concept_samples(index: DataFrame, occurrences: DataFrame, codes: int = 5, samples: int = 3) -> DataFrame:
    """word, code, place, refs: a gloss word's most frequent codes with their first occurrences.

    index (word, code, n), occurrences (code, ref).
    """
    top = per_key(index, ["word"], codes, F.desc("n"), F.col("code"), name="place")
    few = per_key(occurrences.distinct(), ["code"], samples, F.col("ref")).groupBy("code").agg(F.array_sort(F.collect_list("ref")).alias("refs"))
    return top.join(few, "code", "left").select("word", "code", "place", "refs")


def filled(existing: DataFrame, new: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """The table with gaps filled, nothing overwritten, and the report (change, n): filled, added, differs, same."""
    both = existing.select(key, F.col(value).alias("_old"), F.lit(True).alias("_has")).join(new.select(key, F.col(value).alias("_new")).dropDuplicates([key]), key, "full")
    change = F.when(F.col("_new").isNull(), "kept").when(F.col("_has").isNull(), "added").when(F.col("_old").isNull(), "filled").when(F.col("_old") == F.col("_new"), "same").otherwise("differs")
    return both.select(key, F.coalesce("_old", "_new").alias(value)), both.groupBy(change.alias("change")).agg(F.count("*").alias("n"))


def seeds(articles: DataFrame, functions: DataFrame, least: float = 0.5, most: int = 4) -> DataFrame:
    """code, slug, seeds: the article that holds at least a share of a code's uses, not of function codes, and the
    first terms of its title. articles (code, slug, title, n)."""
    w = Window.partitionBy("code")
    share = articles.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), "slug", "title")))
    own = share.where((F.col("rn") == 1) & (F.col("share") >= least)).join(functions.select("code"), "code", "left_anti")
    return own.select("code", "slug", F.slice(F.filter(F.split(F.lower("title"), r"[^a-z]+"), lambda x: x != ""), 1, most).alias("seeds"))


def localised(labels: DataFrame, key: str, language: str, fallback: str = "English") -> DataFrame:
    """key, label: in a language, else in the fallback. labels (key, language, label)."""
    pick = lambda lang: F.max(F.when(F.col("language") == lang, F.col("label")))
    return labels.groupBy(key).agg(F.coalesce(pick(language), pick(fallback)).alias("label"))


def representative(entries: DataFrame, key: str) -> DataFrame:
    """key, gloss: the default entry's, else the first that isn't empty. entries (key, place, is_default, gloss)."""
    order = F.struct((~F.col("is_default")).cast("int").alias("d"), "place")
    return entries.where(F.length(F.trim("gloss")) > 0).groupBy(key).agg(F.min_by("gloss", order).alias("gloss"))


def sub_intents(text: Column) -> dict[str, Column]:
    """The parts that a question's shape gives away; each is null where its shape isn't there."""
    low = F.lower(text)
    part = lambda pattern, group=1: F.nullif(F.regexp_extract(low, pattern, group), F.lit(""))
    topic = F.regexp_replace(part(r"(?:teach|say)s? about ([a-z ]+?)\??$"), "^(the|a|an) ", "")
    return {
        "term": F.when(F.size(F.split(text, r"\s+")) <= 10, part(r"^(?:who|what) (?:is|are|was|were) (?:the |a |an )?([a-z][a-z-]+)\??$")),
        "relation": F.coalesce(part(r"(father|mother|son|daughter|brother|wife) of [a-z]+"), part(r"[a-z]+'s (father|mother|son|daughter|brother|wife)")),
        "name": F.coalesce(part(r"(?:father|mother|son|daughter|brother|wife) of ([a-z]+)"), part(r"([a-z]+)'s (?:father|mother|son|daughter|brother|wife)")),
        "topic": F.when(F.size(F.split(topic, " ")) <= 4, topic),
        "code": F.upper(part(r"(?:greek|hebrew) word ([gh][0-9]+)")),
        "xref": F.when(low.rlike("cross.?references?|parallel (verses|passages)"), F.lit(True)).otherwise(False),
        "morphology": F.when(low.rlike("verb stem|participle|part of speech|tense"), F.lit(True)).otherwise(False),
        "methodology": F.when(low.rlike("^how (do|should) (i|we) translate"), F.lit(True)).otherwise(False),
        "book": part(r"\b(?:in|throughout|the book of) ([a-z]+)\b"),
    }


def intent_of(parts: dict[str, Column]) -> Column:
    """The most specific intent of :func:`sub_intents`, else thematic."""
    has = lambda k: parts[k].isNotNull()
    return F.when(has("code"), "word_study").when(parts["morphology"], "morphology").when(has("relation") & has("name"), "genealogy").when(parts["xref"], "xref").when(has("topic"), "topic").when(parts["methodology"], "methodology").when(has("term"), "entity_lookup").when(has("book"), "passage_book").otherwise("thematic")


def aggregate_results(results: DataFrame) -> DataFrame:
    """One row: total, passed, failed, pass_rate, the recalls' means and the correct refusals; no results, no rates."""
    mean = lambda c: F.round(F.avg(c), 3).alias(f"{c}_mean")
    return results.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.round(F.avg(F.col("passed").cast("int")), 3).alias("pass_rate"), mean("passage_recall"), mean("tag_recall"), F.count_if("refusal_correct").alias("refusal_correct_count"))
