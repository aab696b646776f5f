"""Full-text search with tables: postings, BM25, phrases, snippets, a concordance.

BM25 with k1 = 1.2, b = 0.75 and idf = ln(1 + (N - df + 0.5) / (df + 0.5)). It reads bags: one row per unit with
its ``words`` as an array. Lengths and document frequencies are counted inside the rows, so only the words that a
query names are shuffled; statistics are per partition, isolated corpora don't mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K1, B = 1.2, 0.75


def postings(tokens: DataFrame, unit: str = "chunk_id") -> DataFrame:
    """term, unit, tf."""
    return tokens.groupBy("term", unit).agg(F.count("*").alias("tf"))


def named(bags: DataFrame, terms: list[str] | DataFrame, *keys: str) -> DataFrame:
    """keys, dl, term, tf of the query's words in each unit. terms: words, or a table of (term), broadcast."""
    # outer, since the optimizer would else compute the words again for a filter on their size
    every = bags.select(*keys, F.size("words").alias("dl"), F.explode_outer("words").alias("term"))
    own = every.where(F.col("term").isin(*terms)) if isinstance(terms, list) else every.join(F.broadcast(terms.select("term")), "term", "left_semi")
    return own.groupBy(*keys, "dl", "term").agg(F.count("*").alias("tf"))


def scored(own: DataFrame, df: DataFrame, stats: DataFrame, by: list[str], unit: str) -> DataFrame:
    """by, unit, score from the query's postings, their frequencies and the statistics of each partition."""
    known = own.join(F.broadcast(df), [*by, "term"])
    known = known.join(F.broadcast(stats), by) if by else known.crossJoin(F.broadcast(stats))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part: Column = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return known.groupBy(*by, unit).agg(F.round(F.sum(part), 6).alias("score"))


def _statistics(bags: DataFrame, by: list[str]) -> DataFrame:
    """by, n, avgdl over the units that hold a word."""
    return bags.select(*by, F.size("words").alias("dl")).groupBy(*by).agg(F.count_if(F.col("dl") > 0).alias("n"), F.avg(F.when(F.col("dl") > 0, F.col("dl"))).alias("avgdl"))


def bm25(bags: DataFrame, terms: list[str] | DataFrame, unit: str = "chunk_id") -> DataFrame:
    """unit, score of every unit that holds a query term. bags: unit, words, one row a unit."""
    own = named(bags, terms, unit)
    df = own.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))  # reads tf, so that both use one shuffle
    return scored(own, df, _statistics(bags, []), [], unit)


def bm25_within(bags: DataFrame, docs: DataFrame, words: list[str], unit: str = "chunk_id") -> DataFrame:
    """unit, score within some documents (doc_id, without repeats), with their own statistics. bags: unit, doc_id, words.

    A unit travels with its length and the query's words alone, once: the counts below read one shuffle. A unit also
    counts the empty word, which keeps its length; the greatest word of a term drops it after the counts.
    """
    narrow = bags.select(unit, "doc_id", F.size("words").alias("dl"), F.filter("words", lambda w: w.isin(*words)).alias("words"))
    term = F.explode(F.array_append("words", F.lit("")))
    own = narrow.join(docs.select("doc_id"), "doc_id").select(unit, "dl", term.alias("term")).groupBy(unit, "dl", "term").agg(F.count("*").alias("tf"))
    df = own.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"), F.max("term").alias("_t")).where("_t != ''").drop("_t")
    lengths = own.groupBy(unit, "dl").agg(F.sum("tf").alias("tf"))
    held = (F.col("dl") > 0) & (F.col("tf") > 0)  # reads tf, as the others do
    stats = lengths.agg(F.count_if(held).alias("n"), F.avg(F.when(held, F.col("dl"))).alias("avgdl"))
    return scored(own, df, stats, [], unit)


def frequent_terms(bags: DataFrame, n: int = 3, most: float = 0.2) -> DataFrame:
    """term: the n most frequent terms that fewer than ``most`` (1 at most) of the units hold.

    Each unit also counts the empty word once, whose frequency, the greatest, is the number of units. A filter on
    the empty word would go below the counts and make them run twice; the bound on df drops it.
    """
    words = F.when(F.size("words") > 0, F.array_append(F.array_distinct("words"), F.lit("")))
    df = bags.select("words").select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    total = df.agg(F.max("df").alias("total"))
    return df.crossJoin(F.broadcast(total)).where(F.col("df") < most * F.col("total")).orderBy(F.desc("df"), "term").limit(n).select("term")


def ngrams(tokens: DataFrame, n: int, unit: str = "chunk_id") -> DataFrame:
    """unit, pos, gram of n consecutive terms."""
    w = Window.partitionBy(unit).orderBy("pos")
    words = [F.lead("term", i).over(w) if i else F.col("term") for i in range(n)]
    return tokens.select(unit, "pos", *[c.alias(f"_{i}") for i, c in enumerate(words)]).where(F.col(f"_{n - 1}").isNotNull()).select(unit, "pos", F.concat_ws(" ", *[f"_{i}" for i in range(n)]).alias("gram"))


def phrase(tokens: DataFrame, words: list[str], unit: str = "chunk_id") -> DataFrame:
    """unit, n: units with the consecutive words, and how often; only postings of these words are read."""
    first = tokens.where(F.col("term") == words[0]).select(unit, "pos")
    for i, word in enumerate(words[1:], 1):
        first = first.join(tokens.where(F.col("term") == word).select(unit, (F.col("pos") - i).alias("pos")), [unit, "pos"])
    return first.groupBy(unit).agg(F.count("*").alias("n"))


def snippets(tokens: DataFrame, term: str, before: int = 7, after: int = 8, unit: str = "chunk_id") -> DataFrame:
    """unit, snippet: sixteen terms around the first hit, hits in double angle brackets."""
    hit = tokens.where(F.col("term") == term).groupBy(unit).agg(F.min("pos").alias("p"))
    near = tokens.join(hit, unit).where(F.col("pos").between(F.col("p") - before, F.col("p") + after))
    word = F.when(F.col("term") == term, f"<<{term}>>").otherwise(F.col("term"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", word.alias("w"))))
    return near.groupBy(unit).agg(F.array_join(F.transform(ordered, lambda x: x["w"]), " ").alias("snippet"))


def corpus_of(tags: DataFrame) -> DataFrame:
    """doc_id, corpus: the partition that a document's tags send it to; main for the rest."""
    has = lambda x: F.max((F.col("tag") == x).cast("int"))
    own = tags.groupBy("doc_id").agg(has("resource:aquifer").alias("a"), has("kind:bible").alias("b"), has("kind:lexicon").alias("l"), has("kind:morphology").alias("m"))
    return own.select("doc_id", F.when(F.col("a") == 1, "aquifer").when(F.col("b") == 1, "bible").when(F.col("l") == 1, "lexicon").when(F.col("m") == 1, "morphology").otherwise("main").alias("corpus"))


def bm25_by_corpus(bags: DataFrame, corpus: DataFrame, terms: DataFrame) -> DataFrame:
    """corpus, chunk_id, score with each corpus's own statistics."""
    t = bags.join(corpus, "doc_id")
    own = named(t, terms, "corpus", "chunk_id")
    df = own.groupBy("corpus", "term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    return scored(own, df, _statistics(t, ["corpus"]), ["corpus"], "chunk_id")


def concordance(chunks: DataFrame, words: Column) -> DataFrame:
    """word, chunk_id: every word of every chunk once. words: the words of a row, which may repeat.

    A chunk travels as one array, not as a row a word; rows of one chunk meet, and their words are made distinct, in its row.
    """
    own = chunks.select("chunk_id", words.alias("words")).groupBy("chunk_id").agg(F.flatten(F.collect_list("words")).alias("words"))
    return own.select(F.explode(F.array_distinct("words")).alias("word"), "chunk_id")
