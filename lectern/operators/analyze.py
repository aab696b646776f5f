"""Query analysis: intents, language, references and speakers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.refs import BOOKS

#: Two stopwords a language, enough for the gate.
LANGUAGE_WORDS = (("en", "the"), ("en", "and"), ("de", "der"), ("de", "die"), ("es", "que"), ("es", "los"), ("fr", "les"), ("fr", "des"))
#: Scripts that settle the language at once.
SCRIPTS = (("rus", "[а-яА-Я]"), ("arb", "[ء-ي]"), ("hin", "[ऀ-ॿ]"), ("ben", "[ঀ-৿]"), ("heb", "[א-ת]"))


def intent(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The first rule whose words occur, else thematic."""
    out = None
    for name, words in rules:
        met = text.rlike(rf"(^|\s){words}(\s|$)")
        out = F.when(met, name) if out is None else out.when(met, name)
    return out.otherwise("thematic")


def script_language(text: Column) -> Column:
    """The language that a script gives away, else null."""
    out = F.lit(None).cast("string")
    for lang, pattern in reversed(SCRIPTS):
        out = F.when(text.rlike(pattern), lang).otherwise(out)
    return out


def detect_language(tokens: DataFrame, spark: SparkSession, floor: float = 0.15, default: str = "en") -> DataFrame:
    """doc_id, detected: the language of most stopwords, if they are at least ``floor`` of the words."""
    words = spark.createDataFrame(list(LANGUAGE_WORDS), "lang string, term string")
    hits = tokens.join(F.broadcast(words), "term").groupBy("doc_id", "lang").agg(F.count("*").alias("hits"))
    best = hits.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("hits"), "lang"))).where("rn = 1")
    n = tokens.groupBy("doc_id").agg(F.count("*").alias("n"))
    return n.join(best, "doc_id", "left").select("doc_id", F.when(F.col("hits") / F.col("n") >= floor, F.col("lang")).otherwise(default).alias("detected"))


_REFERENCE = re.compile(r"((?:(?:[1-3]\s*)?[^\W\d_]+\s+){1,7})(\d{1,3})(?::(\d{1,3})(?:\s*[-–]\s*(?:(\d{1,3}):)?(\d{1,3}))?)?")


def parse_references(text: str, names: dict[str, int] | None = None) -> list[tuple[int, int]]:
    """Intervals of the references in a question: the longest known name before the numbers wins; a chapter alone is 1..999."""
    names = names or {code.lower(): i + 1 for i, code in enumerate(BOOKS)}
    out = []
    for m in _REFERENCE.finditer(text):
        words = re.sub(r"(?<=\d)\s+", "", m[1].lower()).split()
        book = next((names[" ".join(words[i:])] for i in range(len(words)) if " ".join(words[i:]) in names), None)
        if book is None:
            continue
        base, chapter = book * 1000000, int(m[2])
        if m[3] is None:
            s, e = base + chapter * 1000 + 1, base + chapter * 1000 + 999
        else:
            s = base + chapter * 1000 + int(m[3])
            e = base + int(m[4] or chapter) * 1000 + int(m[5]) if m[5] else s
        out.append((min(s, e), max(s, e)))
    return out


def speaker(question: str, names: list[str], generic: frozenset[str] = frozenset({"man", "woman", "people"})) -> str | None:
    """The longest known name that speaks: possessive, before a verb of speech, or after "words of"."""
    low = question.lower()
    for name in sorted(names, key=lambda n: (-len(n), n)):
        n = re.escape(name.lower())
        if name.lower() not in generic and re.search(rf"\b{n}(?:'s\b|\s+(?:said|says|say|spoke|speak|told|answered)\b)|\bwords of {n}\b", low):
            return name
    return None


def references(questions: DataFrame, key: str, text: str) -> DataFrame:
    """key, place, s, e: the intervals that each question names, numbered from 0. Arrow batches, no shuffle."""
    kind = dict(questions.dtypes)[key]

    def run(batches):
        for pdf in batches:
            own = [(k, i, s, e) for k, q in zip(pdf[key], pdf[text]) for i, (s, e) in enumerate(parse_references(q or ""))]
            yield pd.DataFrame(own, columns=[key, "place", "s", "e"])

    return questions.select(key, text).mapInPandas(run, f"`{key}` {kind}, place long, s long, e long")


def spoken_by(questions: DataFrame, names: DataFrame, key: str, text: str, generic: tuple[str, ...] = ("man", "woman", "people")) -> DataFrame:
    """key, speaker: as ``speaker``, for a table of questions (key, text) and one of names (name); null where nobody speaks.

    Questions meet names by the name's first word, so that no question is compared with every name.
    """
    low, quoted = F.lower(text), F.concat(F.lit(r"\Q"), F.lower("name"), F.lit(r"\E"))
    said = F.concat(F.lit(r"\b"), quoted, F.lit(r"('s\b|\s+(said|says|say|spoke|speak|told|answered)\b)|\bwords of "), quoted, F.lit(r"\b"))
    first = names.where(~F.lower("name").isin(*generic)).select("name", F.regexp_extract(F.lower("name"), r"\w+", 0).alias("_w")).distinct()
    words = questions.select(key, low.alias("_q"), F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(r"\w+"), 0))).alias("_w"))
    best = words.join(first, "_w").where(F.regexp_like("_q", said)).groupBy(key).agg(F.min_by("name", F.struct(-F.length("name"), "name")).alias("speaker"))
    return questions.select(key).join(best, key, "left")


def analyse(question: str, names: list[str] = ()) -> dict:
    """Keywords, intervals, speaker and intent of one question."""
    passages = parse_references(question)
    said = speaker(question, list(names))
    narrow = any(e - s < 999 for s, e in passages)
    kind = "passage_specific" if narrow else "passage_book" if passages else "speaker" if said else "thematic"
    return {"keywords": [w for w in re.findall(r"[^\W\d_]{3,}", question.lower())], "passages": passages, "speaker": said, "intent": kind}
