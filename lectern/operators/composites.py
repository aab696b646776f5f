"""The full word study, interlinear verses, concordances over stores and homographs, with their rows.

Stores are word tables (corpus, book, chapter, verse, idx, surface, strong, lemma, morph); everything else is keyed by code or lexeme.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.graph import cut
from lectern.operators.ranking import per_key

#: Bytes of the texts of codes that a task holds, on average.
HELD = 16_000_000


def dominant_domains(domains: DataFrame, least: float = 0.5) -> DataFrame:
    """code, domain: the domain of a code's largest share, where that reaches ``least``. domains: code, domain, share."""
    best = per_key(domains, ["code"], 1, F.desc("share"), F.col("domain"))
    return best.where(F.col("share") >= least).select("code", "domain")


def interlinear(stores: DataFrame, glosses: DataFrame, senses: DataFrame, domains: DataFrame) -> DataFrame:
    """Every word of every store with its gloss, the sense it has there and its code's dominant domain.

    glosses: code, gloss. senses: corpus, book, chapter, verse, code, sense (one a verse and code). domains: code, domain. A part that
    isn't known is null.
    """
    own = stores.withColumnRenamed("strong", "code").join(glosses.select("code", "gloss"), "code", "left")
    return own.join(senses, ["corpus", "book", "chapter", "verse", "code"], "left").join(domains.select("code", "domain"), "code", "left")


def concordance(stores: DataFrame, senses: DataFrame, most: int = 200) -> DataFrame:
    """code, corpus, place, ref, surface, morph, sense, n, truncated: the first occurrences of each code in each store, in canonical order.

    ``n`` counts all; ``truncated`` says whether some aren't shown. The limit is applied before the shuffle too, so a code
    that a third of all words has sends no more rows than others from a task.
    """
    own = stores.select(F.col("strong").alias("code"), "corpus", (F.col("book") * 1000000 + F.col("chapter") * 1000 + F.col("verse")).alias("ref"), "idx", "book", "chapter", "verse", "surface", "morph")
    shown = per_key(own, ["code", "corpus"], most, F.col("ref"), F.col("idx"), F.col("surface"), name="place")
    n = own.groupBy("code", "corpus").agg(F.count("*").alias("n"))
    met = shown.join(n, ["code", "corpus"]).join(senses, ["corpus", "book", "chapter", "verse", "code"], "left")
    return met.select("code", "corpus", F.col("place").cast("long").alias("place"), "ref", "surface", "morph", "sense", "n", (F.col("n") > most).alias("truncated"))


def homographs(lexemes: DataFrame, senses: DataFrame) -> DataFrame:
    """code, lexemes, senses: the lexemes that one code conflates, and for each stem of each its senses, most frequent first.

    lexemes: code, lex. senses: lex, stem, gloss, n. A sense reads ``lex.stem: gloss (share)``.

    A code's texts are one row, so tasks are dealt by their bytes, counted first: a task holds some ``HELD`` of them or one code,
    and nothing is collected before that shuffle.
    """
    share = F.round(F.col("n") / F.col("total"), 3)
    total = senses.groupBy("lex", "stem").agg(F.sum("n").alias("total"))
    told = F.concat("lex", F.lit("."), "stem", F.lit(": "), "gloss", F.lit(" ("), share.cast("string"), F.lit(")"))
    # only the finished texts go to every code of a lexeme, without what they were ordered by
    ordered = F.array_sort(F.collect_list(F.struct("stem", (-F.col("n")).alias("m"), "gloss", told.alias("told"))))
    listed = cut(senses.join(total, ["lex", "stem"]).groupBy("lex").agg(F.transform(ordered, lambda x: x["told"]).alias("told")))
    pairs = cut(lexemes.select("code", "lex").distinct())
    size = listed.select("lex", F.aggregate("told", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 16).alias("size"))
    held = pairs.join(size, "lex").agg(F.sum("size")).first()[0] or 0
    tasks = max(int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(held / HELD))
    own = pairs.join(listed, "lex", "left").repartition(tasks, "code").groupBy("code").agg(F.array_sort(F.collect_list(F.struct("lex", "told"))).alias("x"))
    none = F.array().cast("array<string>")
    return own.select("code", F.transform("x", lambda x: x["lex"]).alias("lexemes"), F.flatten(F.transform("x", lambda x: F.coalesce(x["told"], none))).alias("senses"))


def cross_language(bridge: DataFrame, most: int = 3) -> DataFrame:
    """code, equivalents: the codes of the other language that most often stand for a code. bridge: code, other, n."""
    top = per_key(bridge, ["code"], most, F.desc("n"), F.col("other"))
    return top.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "other"))), lambda x: F.concat(x["other"], F.lit("="), (-x["m"]).cast("string"))).alias("equivalents"))


def full_study(base: DataFrame, domains: DataFrame, articles: DataFrame, bridge: DataFrame, senses: DataFrame, homographs: DataFrame, samples: int = 3) -> DataFrame:
    """The study of every code: that of ``study.word_study`` and articles, domain shares, equivalents, senses with where they occur, lexemes.

    articles: code, slug, title, head; only those whose head names the code. senses: code, sense, ref (one row an occurrence);
    each sense has its count, share and first places.
    """
    shares = domains.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("s"), "domain"))), lambda x: F.concat(x["domain"], F.lit(" "), F.round(-x["s"], 3).cast("string"))).alias("domain_shares"))
    named = articles.where("head").groupBy("code").agg(F.array_sort(F.collect_set(F.concat("slug", F.lit(": "), "title"))).alias("articles"))
    n = senses.groupBy("code", "sense").agg(F.count("*").alias("n"))
    total = n.groupBy("code").agg(F.sum("n").alias("total"))
    first = per_key(senses.distinct(), ["code", "sense"], samples, F.col("ref")).groupBy("code", "sense").agg(F.array_join(F.transform(F.array_sort(F.collect_list("ref")), lambda r: r.cast("string")), ",").alias("refs"))
    told = F.concat(F.col("sense").cast("string"), F.lit(" "), F.col("n").cast("string"), F.lit(" "), F.round(F.col("n") / F.col("total"), 3).cast("string"), F.lit(" "), "refs")
    spread = n.join(total, "code").join(first, ["code", "sense"]).groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "sense", told.alias("told")))), lambda x: x["told"]).alias("distribution"))
    none = F.array().cast("array<string>")
    out = base
    for part in (shares, named, cross_language(bridge), spread, homographs):
        out = out.join(part, "code", "left")
    lists = ["domain_shares", "articles", "equivalents", "distribution", "lexemes", "senses"]
    return out.select(*base.columns, *[F.coalesce(c, none).alias(c) for c in lists])
