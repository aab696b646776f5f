"""Question analysis as column expressions: passages, keywords, what a question's shape gives away, and its intent.

:func:`analysed` works on a table of questions without a Python worker; one question is a table of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.refs import ALIASES
from lectern.functions.vocabulary import ENGLISH, GENERIC_SPEAKERS, SCRIPTS, SPEECH, WORD, Vocabulary

REFERENCE = r"((?:(?:[1-3]\s*)?\p{L}+\s+){1,7})(\d{1,3})(?::(\d{1,3})(?:\s*[-–]\s*(?:(\d{1,3}):)?(\d{1,3}))?)?"
NONE = "array<struct<s:bigint,e:bigint>>"


def _aliases(names: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])


def _words(text: Column) -> Column:
    """A name's words in lower case; a leading number is one word with what follows."""
    return F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"(\d)\s+", "$1"), r"\s+", " ")), " ")


def passages(text: Column, names: dict[str, int] | None = None) -> Column:
    """The intervals (s, e) of all references: the longest known name before the numbers wins; a chapter alone is 1..999."""
    book_by = _aliases(names or ALIASES)

    def read(m: Column) -> Column:
        part = lambda k: F.nullif(F.regexp_extract(m, REFERENCE, k), F.lit("")).cast("long")
        words = _words(F.regexp_extract(m, REFERENCE, 1))
        tails = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.try_element_at(book_by, F.array_join(F.slice(words, i, F.size(words)), " ")))
        book = F.get(F.filter(tails, lambda b: b.isNotNull()), F.lit(0)).cast("long")
        base, chapter = book * 1000000, part(2)
        s = base + chapter * 1000 + F.coalesce(part(3), F.lit(1))
        e = F.when(part(3).isNull(), base + chapter * 1000 + 999).when(part(5).isNull(), s).otherwise(base + F.coalesce(part(4), chapter) * 1000 + part(5))
        return F.when(chapter.between(1, 999), F.struct(F.least(s, e).alias("s"), F.greatest(s, e).alias("e")))

    found = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), read)
    return F.filter(found, lambda x: x.isNotNull() & x["s"].isNotNull()).cast(NONE)


def whole_books(text: Column, pattern: str, names: dict[str, int] | None = None) -> Column:
    """The intervals of the books that a question names as books, each once."""
    book_by = _aliases(names or ALIASES)
    named = F.transform(F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(1)), lambda n: F.try_element_at(book_by, F.array_join(_words(n), " ")).cast("long"))
    books = F.array_distinct(F.filter(named, lambda b: b.isNotNull()))
    return F.transform(books, lambda b: F.struct((b * 1000000 + 1001).alias("s"), (b * 1000000 + 999999).alias("e"))).cast(NONE)


def keywords(text: Column, vocabulary: Vocabulary = ENGLISH) -> Column:
    """Words of three characters and more in any script, without references, stopwords and frame words, as they come."""
    plain = F.regexp_replace(text, REFERENCE, " ")
    dropped = sorted(set(vocabulary.stopwords) | set(vocabulary.frames))
    return F.filter(F.regexp_extract_all(F.lower(plain), F.lit(WORD + "{3,}"), F.lit(0)), lambda w: ~w.isin(*dropped))


def _group(text: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(text, f"(?i){pattern}", k), F.lit(""))


def terms(text: Column, vocabulary: Vocabulary = ENGLISH) -> Column:
    """The entities of a short question that asks for one, sorted."""
    found = [F.lower(_group(F.trim(text), p, 2)) for p in vocabulary.entity]
    good = lambda w: w.isNotNull() & (F.length(w) >= 3) & ~w.isin(*vocabulary.stopwords)
    short = F.size(F.split(F.trim(text), r"\s+")) <= 10
    return F.when(short, F.array_sort(F.array_distinct(F.filter(F.array(*found), good)))).otherwise(F.array().cast("array<string>"))


def _code(word: Column) -> Column:
    """G26 as G0026."""
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lpad(F.regexp_extract(word, r"\d+", 0).cast("int").cast("string"), 4, "0"))


def word_study(text: Column, vocabulary: Vocabulary = ENGLISH) -> tuple[Column, Column]:
    """(words, codes) that a word-study question names."""
    groups = F.array(*[_group(text, vocabulary.word_study, k) for k in range(1, 7)])
    there = F.filter(groups, lambda g: g.isNotNull())
    is_code = lambda g: g.rlike(r"(?i)^[GH]\d+$")
    words = F.filter(there, lambda g: ~is_code(g) & (F.length(g) >= 2) & ~F.lower(g).isin(*vocabulary.stopwords))
    return F.transform(words, F.lower), F.array_sort(F.array_distinct(F.transform(F.filter(there, is_code), _code)))


def relation(text: Column, vocabulary: Vocabulary = ENGLISH) -> Column:
    """(name, relation) of a question for a relative; null without one."""
    known = F.create_map(*[F.lit(x) for pair in vocabulary.relations.items() for x in pair])

    def of(pattern: str, word: int, name: int) -> Column:
        rel = F.try_element_at(known, F.lower(_group(text, pattern, word)))
        return F.when(rel.isNotNull() & _group(text, pattern, name).isNotNull(), F.struct(_group(text, pattern, name).alias("name"), rel.alias("relation")))

    return F.coalesce(of(vocabulary.genealogy, 1, 3), of(vocabulary.possessive, 2, 1))


def topic(text: Column, vocabulary: Vocabulary = ENGLISH) -> Column:
    """The topic that verses are asked about: without an article, at most four words; null without one."""

    def cleaned(g: Column) -> Column:
        own = F.trim(F.regexp_replace(F.trim(g), r"[?.!,;]+$", ""))
        own = F.trim(F.regexp_replace(own, r"(?i)^(?:the|a|an)\s+", ""))
        if vocabulary.drops_article:
            words = F.split(own, r"\s+")
            own = F.when((F.size(words) > 1) & F.lower(F.get(words, F.lit(0))).isin(*vocabulary.topic_stopwords), F.array_join(F.slice(words, F.lit(2), F.size(words)), " ")).otherwise(own)
        return F.when((own != "") & ~F.lower(own).isin(*vocabulary.topic_stopwords) & (F.size(F.split(own, r"\s+")) <= 4), own)

    return F.coalesce(*[cleaned(_group(text, vocabulary.topic, k)) for k in range(1, 5)])


def xref_source(text: Column, given: Column, vocabulary: Vocabulary = ENGLISH, names: dict[str, int] | None = None) -> Column:
    """The verse whose cross-references are asked for: of the part named, else the first passage; null without such a question."""
    tails = F.array(*[_group(text, vocabulary.xref, k) for k in range(1, 6)])
    first = F.get(F.flatten(F.transform(F.filter(tails, lambda g: g.isNotNull()), lambda g: passages(F.trim(g), names))), F.lit(0))["s"]
    return F.when(text.rlike(f"(?i){vocabulary.xref}"), F.coalesce(first, F.get(given, F.lit(0))["s"]))


def intent(xref: Column, related: Column, studied: Column, morphology: Column, asked: Column, entities: Column, method: Column, spans: Column, speaker: Column) -> Column:
    """The intent by precedence; a speaker overrides where no passage is named."""
    narrow = F.exists(spans, lambda p: p["e"] - p["s"] < 999)
    return (
        F.when(speaker.isNotNull() & (F.size(spans) == 0), "speaker").when(xref.isNotNull(), "xref").when(related.isNotNull(), "genealogy").when(studied, "word_study").when(morphology, "morphology").when(asked.isNotNull(), "topic")
        .when(F.size(entities) > 0, "entity_lookup").when(method, "methodology").when(narrow, "passage_specific").when(F.size(spans) > 0, "passage_book").otherwise("thematic")
    )


def speakers_of(questions: DataFrame, names: DataFrame, key: str, text: str, generic: tuple[str, ...] = GENERIC_SPEAKERS) -> DataFrame:
    """key, speaker: the longest known name (name) that a question lets speak; questions without one have no row.

    A name speaks as a possessive, before a verb of speech, or after "words of" and the like. Questions meet names by the
    name's first word, so no question is compared with every name.
    """
    low, quoted = F.lower(text), F.concat(F.lit(r"\Q"), F.lower("name"), F.lit(r"\E"))
    frames = F.concat(quoted, F.lit(rf"(?:['’]s\b|\s+{SPEECH}\b)|\b(?:did|does|do|will|would)\s+"), quoted, F.lit(rf"\s+{SPEECH}\b|\b(?:words?|sayings?|teachings?|commands?|promises?|message|sermon)\s+(?:of|from|by)\s+"), quoted, F.lit(r"\b"))
    first = names.where(~F.lower("name").isin(*generic)).select("name", F.regexp_extract(F.lower("name"), r"\w+", 0).alias("_w")).distinct()
    words = questions.select(key, low.alias("_q"), F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(r"\w+"), F.lit(0)))).alias("_w"))
    return words.join(first, "_w").where(F.regexp_like("_q", F.concat(F.lit(r"\b"), frames))).groupBy(key).agg(F.min_by("name", F.struct(-F.length("name"), "name")).alias("speaker"))


def analysed(questions: DataFrame, key: str, text: str, speakers: DataFrame | None = None, vocabulary: Vocabulary = ENGLISH, names: dict[str, int] | None = None) -> DataFrame:
    """key, intent, passages, keywords, tags, words, codes, related, topic, xref_source, speaker of each question.

    Null questions count as empty and are thematic. A speaker's own name isn't among the keywords.
    """
    own = questions.select(key, F.trim(F.coalesce(text, F.lit(""))).alias("q"))
    if speakers is None:
        own = own.withColumn("said", F.lit(None).cast("string"))
    else:
        own = own.join(speakers_of(own, speakers, key, "q").withColumnRenamed("speaker", "said"), key, "left")
    q = F.col("q")
    own = own.withColumn("explicit", passages(q, names))
    own = own.withColumn("passages", F.when(F.size("explicit") > 0, F.col("explicit")).otherwise(whole_books(q, vocabulary.book_context, names)))
    words, codes = word_study(q, vocabulary)
    parts = own.select(
        key, "q", "passages", F.when(F.size("passages") == 0, F.col("said")).alias("speaker"), keywords(q, vocabulary).alias("keywords"), terms(q, vocabulary).alias("terms"), words.alias("words"), codes.alias("codes"),
        relation(q, vocabulary).alias("related"), topic(q, vocabulary).alias("topic"), xref_source(q, F.col("passages"), vocabulary, names).alias("xref_source"),
    )
    c = F.col
    kind = intent(c("xref_source"), c("related"), F.size(F.concat("words", "codes")) > 0, q.rlike(f"(?i){vocabulary.morphology}"), c("topic"), c("terms"), q.rlike(f"(?i){vocabulary.methodology}"), c("passages"), c("speaker"))
    named = F.regexp_extract_all(F.lower("speaker"), F.lit(r"\w+"), F.lit(0))
    heard = F.when(c("speaker").isNotNull(), F.array_except("keywords", named)).otherwise(c("keywords"))
    tags = F.concat(F.transform("terms", lambda t: F.concat(F.lit("term:"), t)), F.transform("codes", lambda t: F.concat(F.lit("strongs:"), t)))
    return parts.select(key, kind.alias("intent"), "passages", heard.alias("keywords"), tags.alias("tags"), "words", "codes", "related", "topic", "xref_source", "speaker")


def script(text: Column) -> Column:
    """The language that a script gives away, else null."""
    out = F.lit(None).cast("string")
    for language, pattern in reversed(SCRIPTS):
        out = F.when(text.rlike(pattern), language).otherwise(out)
    return out


def detected(texts: DataFrame, key: str, text: str, stopwords: DataFrame, floor: float = 0.15, default: str = "eng") -> DataFrame:
    """key, language: by script, else the language (lang, word) of most stopwords if they are ``floor`` of the words, else the default.

    Ties go to the first language by name. stopwords is a dimension table of a few hundred rows a language.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{2,}"), F.lit(0))
    own = texts.select(key, script(F.col(text)).alias("by_script"), words.alias("w"))
    hits = own.where("by_script IS NULL").select(key, F.size("w").alias("n"), F.explode("w").alias("word")).join(stopwords.select("lang", "word").distinct(), "word").groupBy(key, "n", "lang").agg(F.count("*").alias("hits"))
    best = hits.groupBy(key, "n").agg(F.min(F.struct((-F.col("hits")).alias("h"), "lang")).alias("b")).where(-F.col("b.h") / F.col("n") >= floor).select(key, F.col("b.lang").alias("by_words"))
    return own.select(key, "by_script").join(best, key, "left").select(key, F.coalesce("by_script", "by_words", F.lit(default)).alias("language"))
