"""Matching and its bookkeeping: names to entities, frames by their parts, sequences by blocks, answers to their citations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import fold

INLINE = r"\[([A-Za-z0-9:_\-]+)\]"


def normal_name(name: Column) -> Column:
    """A name for comparison: without accents, brackets' content, numbers and punctuation, in lower case."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(F.regexp_replace(name, r"\([^)]*\)", " ")), r"[^a-z ]+", " "), r"\s+", " "))


def fuzzy(found: DataFrame, known: DataFrame, mentions: DataFrame) -> DataFrame:
    """id, entity, how of each found place (id, name, verses): ``single``, ``overlap`` or ``new``.

    A normalised name with one entity (known: id, name) is that one. With several, the entity that shares most verses (mentions: id, ref) wins,
    the first by id at a tie, and none if none is shared. Without a name that anyone has it is new.
    """
    own = found.select("id", normal_name(F.col("name")).alias("_n"), F.array_sort(F.array_distinct("verses")).alias("verses"))
    named = known.select(F.col("id").alias("entity"), normal_name(F.col("name")).alias("_n")).where("_n != ''")
    counts = named.groupBy("_n").agg(F.count("*").alias("k"), F.min("entity").alias("entity"))
    met = own.join(counts, "_n", "left")
    # places of one name and the same verses have one answer, and of a name's entities with the same verses the first stands for all
    asked = met.where("k > 1").select("_n", "verses").distinct()
    cited = mentions.groupBy(F.col("id").alias("entity")).agg(F.array_sort(F.collect_set("ref")).alias("refs"))
    alike = named.join(asked.select("_n"), "_n", "left_semi").join(cited, "entity").groupBy("_n", "refs").agg(F.min("entity").alias("entity"))
    by_verse = alike.select("_n", "entity", F.explode("refs").alias("ref"))
    shared = asked.select("_n", "verses", F.explode("verses").alias("ref")).join(by_verse, ["_n", "ref"]).groupBy("_n", "verses", "entity").agg(F.count("*").alias("shared"))
    best = shared.groupBy("_n", "verses").agg(F.min_by("entity", F.struct(-F.col("shared"), "entity")).alias("best"))
    out = met.join(best, ["_n", "verses"], "left")
    how = F.when(F.col("k") == 1, "single").when(F.col("best").isNotNull(), "overlap").otherwise("new")
    return out.select("id", F.when(how == "single", F.col("entity")).otherwise(F.col("best")).alias("entity"), how.alias("how"))


def frames_with(frames: DataFrame, words: DataFrame, limit: int = 50, role: str | None = None, argument: Column | None = None, verb: Column | None = None) -> DataFrame:
    """verb_key, verb, arguments, total: the first frames with an argument and a verb that fit, whole, and how many there are.

    frames: verb_key, role, arg_key. words: key, lemma and what the conditions on a word name. At least one condition is needed.
    """
    if role is None and argument is None and verb is None:
        raise ValueError("give at least one condition")
    hit = frames if role is None else frames.where(F.col("role") == role.upper())
    if argument is not None:
        hit = hit.join(words.where(argument).select(F.col("key").alias("arg_key")), "arg_key", "left_semi")
    if verb is not None:
        hit = hit.join(words.where(verb).select(F.col("key").alias("verb_key")), "verb_key", "left_semi")
    keys = hit.select("verb_key").distinct()
    total = keys.agg(F.count("*").alias("total"))
    first = keys.orderBy("verb_key").limit(limit)
    told = frames.join(F.broadcast(first), "verb_key").join(words.select(F.col("key").alias("arg_key"), F.col("lemma").alias("argument")), "arg_key")  # ``limit`` keys
    whole = told.groupBy("verb_key").agg(F.array_sort(F.collect_list(F.concat("role", F.lit("="), "argument"))).alias("arguments"))
    named = whole.join(words.select(F.col("key").alias("verb_key"), F.col("lemma").alias("verb")), "verb_key")
    return named.crossJoin(F.broadcast(total)).select("verb_key", "verb", "arguments", "total")


def cited(answer: Column, listed: Column, valid: Column) -> tuple[Column, Column]:
    """(citations, answer): the valid ids named inline and then listed, each once; the answer without invalid markers, white space collapsed."""
    inline = F.regexp_extract_all(answer, F.lit(INLINE), F.lit(1))
    named = F.filter(F.array_distinct(F.concat(inline, F.coalesce(listed, F.array().cast("array<string>")))), lambda c: F.array_contains(valid, c))
    wrong = F.filter(F.array_distinct(inline), lambda c: ~F.array_contains(valid, c))
    plain = F.aggregate(wrong, answer, lambda s, c: F.replace(s, F.concat(F.lit("["), c, F.lit("]")), F.lit("")))
    return named, F.trim(F.regexp_replace(plain, r"\s{2,}", " "))


def clusters(references: DataFrame, texts: DataFrame, key: str, gap: int = 100, most: int = 1200, least: int = 200) -> DataFrame:
    """key, cluster, references, center, start, end: references at most ``gap`` words apart are one cluster, and each has a window of words.

    references: key, position (character from 0). texts: key, text. The window has ``most`` words around the mean place, cut at the text's ends; one
    of fewer than ``least`` words grows by half of what it lacks on both sides. A position inside a word counts as the text's first word.
    """
    met = references.join(texts, key)
    before = F.substring("text", F.lit(1), F.col("position"))
    begins = (F.col("position") == 0) | F.substring("text", F.col("position"), F.lit(1)).rlike(r"\s")
    place = F.when(begins, F.size(F.regexp_extract_all(before, F.lit(r"\S+"), F.lit(0)))).otherwise(0)
    own = met.select(key, "position", place.alias("w"))
    size = texts.select(key, F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("n"))
    w = Window.partitionBy(key).orderBy("position")  # the references of one text
    new = F.when(F.col("w") - F.lag("w").over(w) <= gap, 0).otherwise(1)
    numbered = own.withColumn("new", new).withColumn("cluster", F.sum("new").over(w) - 1)
    one = numbered.groupBy(key, "cluster").agg(F.count("*").alias("references"), F.floor(F.sum("w") / F.count("*")).cast("long").alias("center")).join(size, key)
    start, end = F.greatest(F.col("center") - most // 2, F.lit(0)), F.least(F.col("center") + most // 2, F.col("n"))
    lacks = F.floor((least - (end - start)) / 2)
    grow = lambda a, b: F.when(end - start < least, a).otherwise(b).cast("long")
    return one.select(key, "cluster", "references", "center", grow(F.greatest(start - lacks, F.lit(0)), start).alias("start"), grow(F.least(end + lacks, F.col("n")), end).alias("end"))


def _blocks(a: list, b: list) -> list[tuple[int, int, int]]:
    """Matching blocks (i, j, length): the longest common stretch, the first in ``a``, then in ``b``, and so on left and right of it."""
    places: dict = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        best, ends = (alo, blo, 0), {}
        for i in range(alo, ahi):
            now = {}
            for j in places.get(a[i], ()):
                if blo <= j < bhi:
                    now[j] = n = ends.get(j - 1, 0) + 1
                    if n > best[2]:
                        best = (i - n + 1, j - n + 1, n)
            ends = now
        i, j, n = best
        if n:
            out.append(best)
            todo += [(alo, i, blo, j), (i + n, ahi, j + n, bhi)]
    return sorted(out)


def block_ops(pairs: DataFrame, key: str) -> DataFrame:
    """key, op, left, right: the stretches of two sequences (key, a, b: arrays of text), in order.

    ``equal``, ``replace``, ``delete`` (only in b) and ``insert`` (only in a); ``left`` and ``right`` are the words on both sides. A row holds one
    pair, whose sequences are compared in its task: align by a unit of bounded length, a verse or a chapter.
    """
    schema = pa.schema([(key, pa.int64()), ("op", pa.string()), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b, i, j = a or [], b or [], 0, 0
                for x, y, n in [*_blocks(a, b), (len(a), len(b), 0)]:
                    if i < x or j < y:
                        rows.append((k, "replace" if i < x and j < y else "insert" if i < x else "delete", a[i:x], b[j:y]))
                    if n:
                        rows.append((k, "equal", a[x : x + n], b[y : y + n]))
                    i, j = x + n, y + n
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return pairs.select(F.col(key).cast("long").alias(key), "a", "b").mapInArrow(run, f"{key} long, op string, left array<string>, right array<string>")


def reconciled(ops: DataFrame, group: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, residual, substitutions) of block operations: by group how many words match; the right words that don't; clean 1:1 substitutions."""
    n = lambda side, *kinds: F.sum(F.when(F.col("op").isin(*kinds), F.size(side)).otherwise(0))
    totals = ops.groupBy(group.alias("group")).agg(n("left", "equal", "replace", "insert").alias("left"), n("right", "equal", "replace", "delete").alias("right"), n("right", "equal").alias("matched"))
    totals = totals.withColumn("pct", F.round(100 * F.col("matched") / F.greatest("right", F.lit(1)), 2))
    residual = ops.where("op IN ('replace', 'delete')").select(F.explode("right").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    even = ops.where("op = 'replace' AND size(left) = size(right)").select(F.explode(F.arrays_zip("left", "right")).alias("x"))
    return totals, residual, even.groupBy(F.col("x.left").alias("left"), F.col("x.right").alias("right")).agg(F.count("*").alias("n"))


def without_markup(gloss: Column) -> Column:
    """An interlinear gloss as words: supplied words in brackets go, dots join."""
    return F.trim(F.regexp_replace(F.replace(F.regexp_replace(F.coalesce(gloss, F.lit("")), r"\[[^\]]*\]", ""), F.lit("."), F.lit(" ")), r"\s+", " "))


def headword_sense(gloss: Column) -> Column:
    """The first alternative of a headword's sense: without a rendering after a colon, a qualifier in front, articles and hyphens."""
    head = F.get(F.split(F.get(F.split(F.coalesce(gloss, F.lit("")), ":", 2), F.lit(0)), "/", 2), F.lit(0))
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(head, r"^\([^)]*\)\s*", ""), r"(?i)^(?:to|a|an|the)\s+", "")), "^-+|-+$", ""))


def real_gloss(gloss: Column, placeholder: str = r"^[A-Z]{2,}$") -> Column:
    """The gloss, or null if it is empty, a hyphen or a placeholder in capitals."""
    own = F.trim(gloss)
    return F.when((own != "") & (own != "-") & ~own.rlike(placeholder), own)
