"""Operator 6: benchmark decontamination, DataFrame functions only.

A benchmark item's windows are its runs of ``WINDOW`` words (a shorter item is one window). Any
occurrence of a window of n words in a document holds a whole gram of g = min(3, n) words that starts
at a multiple of n - g + 1, so only these grams are looked up, in a broadcast hash set of the windows'
grams. One scan emits the grams of all window sizes together. Around each hit the windows themselves are
compared, and hits are put together by document. Only grams that hit leave their task; no text is shuffled.

The benchmark is broadcast only while its windows have at most ``BROADCAST`` bytes; beyond, the same joins shuffle.

Cases: null or empty text has no words and is clean; items without words have no windows; items with
equal windows are all named; items without an id hit but are not named; rows without an id are returned as clean; rows that share an id share
their hits; empty tables give no rows, or clean documents; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import columns

WINDOW, GRAM = 10, 3
#: Bytes of the benchmark's windows, spelt out, up to which they and their grams are broadcast.
BROADCAST = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Lower-cased words: runs of ASCII letters and digits and of all else beyond ASCII."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _gram_key(words: Column, at: Column, g: int) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(g)])


def _surroundings(n: int, g: int):
    """For a gram's place: its key and the words of all windows around it."""

    def near(p: Column) -> Column:
        lo = F.greatest(p - (n - g), F.lit(0))
        return F.struct(F.lit(n).alias("n"), _gram_key(F.col("w"), p, g).alias("key"), lo.alias("lo"), p.alias("p"), F.slice(F.col("w"), lo + 1, p + n - lo).alias("near"))

    return near


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, n (words of the window), words: the distinct windows of all items."""
    w = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - n + 1)
    return w.select("item_id", n.alias("n"), "w", F.explode(starts).alias("s")).select("item_id", "n", F.expr("slice(w, s, n)").alias("words")).distinct()


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, s (first word, from 0), n (words), item_id: every occurrence of a window in a document."""
    windows = benchmark_windows(benchmark, window)
    spelling = F.array_join("words", " ")
    known = windows.groupBy("n").agg(F.sum(F.octet_length(spelling) + 16)).orderBy("n").collect()  # at most ``window`` rows
    sizes = [r["n"] for r in known] or [window]
    held = (lambda df: F.broadcast(df)) if sum(r[1] for r in known) <= broadcast else (lambda df: df)
    words = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("w"))

    def grams_of(n: int) -> tuple[Column, Column]:
        """Places of a document and of a window that are looked up, as structs and as keys."""
        g = min(GRAM, n)
        places = F.sequence(F.lit(0), F.size("w") - g, F.lit(n - g + 1))
        return F.when(F.size("w") >= n, F.transform(places, _surroundings(n, g))).otherwise(F.array()), F.when(F.col("n") == n, F.transform(F.sequence(F.lit(0), F.lit(n - g)), lambda i: _gram_key(F.col("words"), i, g)))

    scan = [grams_of(n)[0] for n in sizes]
    grams = windows.select("n", F.explode(F.coalesce(*[grams_of(n)[1] for n in sizes])).alias("key")).distinct()
    scanned = words.where(F.size("w") >= min(sizes)).select("doc_id", F.explode(F.concat(*scan) if len(scan) > 1 else scan[0]).alias("x")).select("doc_id", "x.*")
    found = scanned.join(held(grams), ["n", "key"], "left_semi")
    begun = found.where(F.size("near") >= F.col("n")).select("doc_id", "n", "lo", "near", F.explode(F.sequence(F.lit(0), F.least(F.col("p") - F.col("lo"), F.size("near") - F.col("n")))).alias("k"))
    spelt = begun.select("doc_id", "n", (F.col("lo") + F.col("k")).alias("s"), F.array_join(F.slice("near", F.col("k") + 1, F.col("n")), " ").alias("spelt"))
    return spelt.join(held(windows.select("n", "item_id", spelling.alias("spelt"))), ["n", "spelt"]).select("doc_id", "s", "n", "item_id").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: words, words inside hits, items met and their digest."""
    found = hits(docs, benchmark, window)
    covered = found.select("doc_id", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("n") - 1)).alias("at")).distinct().groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    items = found.select("doc_id", "item_id").where("item_id IS NOT NULL").distinct().groupBy("doc_id").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_set(F.col("item_id").cast("string"))), ",").alias("items"))
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return counted.join(covered, "doc_id", "left").join(items, "doc_id", "left").select(
        "doc_id", "n_words", zero("n_hit"), zero("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that hold no window of the benchmark, with all their columns."""
    return docs.join(hits(docs, benchmark, window).select("doc_id").distinct(), "doc_id", "left_anti").select(columns(docs))


def clean_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text of lower-cased words joined by spaces, without the words inside hits."""
    found = hits(docs, benchmark, window).groupBy("doc_id").agg(F.collect_set(F.struct("s", "n")).alias("hit"))
    w = docs.select("doc_id", words_of(F.col("text")).alias("w")).join(found, "doc_id", "left")
    inside = lambda i: F.exists(F.col("hit"), lambda h: (h["s"] <= i) & (i < h["s"] + h["n"]))
    return w.select("doc_id", F.array_join(F.when(F.col("hit").isNull(), F.col("w")).otherwise(F.filter("w", lambda x, i: ~inside(i))), " ").alias("text"))
