"""Sense tables: merging senses by vectors, and deriving them from occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators.align import single_linkage
from lectern.operators.linkage import linked as link_items


def merge_by_vector(senses: DataFrame, vectors: DataFrame | None = None, threshold: float = 0.72, across: bool = False, undefined: bool = False) -> DataFrame:
    """lex, merged, n, label: senses (lex long, sense long, n, label) whose vectors (sense, embedding) link within a lexeme.

    The most frequent member names the merged sense. A context-centroid merge is the same with 0.88. Without ``vectors``
    each row of the senses has its own ``embedding``. ``across`` and ``undefined`` are those of ``single_linkage``.
    """
    own = senses if vectors is None else senses.join(vectors, "sense")
    found = single_linkage(own.select("lex", "sense", "embedding"), "lex", "sense", "embedding", threshold, across, undefined)
    found = found.select(F.col("key").alias("_lex"), F.col("item").alias("_sense"), F.col("cluster").alias("merged"))
    same = F.col("sense") == F.col("_sense")
    if across:
        both = senses.join(found.drop("_lex").distinct(), same)
    else:
        both = senses.join(found.distinct(), F.col("lex").eqNullSafe(F.col("_lex")) & same)  # a sense without a lexeme stays alone
    return both.groupBy("lex", "merged").agg(F.sum("n").alias("n"), F.min_by("label", F.struct(-F.col("n"), "sense")).alias("label"))


def anchored(occurrences: DataFrame) -> DataFrame:
    """lex, stem, number, label, n: senses from occurrences (lex, stem, gloss), the label with the fewest dots, then the most frequent."""
    c = occurrences.groupBy("lex", "stem", F.lower("gloss").alias("k"), "gloss").agg(F.count("*").alias("m"))
    dots = F.length("gloss") - F.length(F.replace("gloss", F.lit("."), F.lit("")))
    s = c.groupBy("lex", "stem", "k").agg(F.min_by("gloss", F.struct(dots.alias("d"), -F.col("m"), "gloss")).alias("label"), F.sum("m").alias("n"))
    return s.withColumn("number", F.row_number().over(Window.partitionBy("lex", "stem").orderBy(F.desc("n"), "k")).cast("long")).drop("k")


def by_context(occurrences: DataFrame, curated: DataFrame, threshold: float = 0.88) -> DataFrame:
    """lex, stem, sense, gloss, n, share: senses merged by the centroids of their contexts, most frequent first.

    occurrences: lex, stem, gloss, vector. Glosses are compared in lower case; each has the unit mean of its occurrences'
    vectors, and glosses of one lexeme and stem whose means link by ``threshold`` are one sense. The first sense takes the
    curated gloss (lex, stem, label) if there is one; the others, and it without one, their gloss with the fewest dots,
    then the most frequent. Occurrences without a gloss or a vector, and null or non-finite components, don't count.
    """
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x))
    own = occurrences.where("gloss IS NOT NULL AND trim(gloss) != '' AND vector IS NOT NULL").where(sound).select("lex", "stem", F.lower(F.trim("gloss")).alias("k"), "gloss", "vector")
    by = ["lex", "stem", "k"]
    mean = own.select(*by, F.posexplode("vector").alias("i", "x")).groupBy(*by, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = mean.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vector"))
    name = F.to_json(F.struct(*by))
    items = centre.select(F.to_json(F.struct("lex", "stem")).alias("key"), name.alias("id"), "vector")
    forms = own.groupBy(*by, "gloss").agg(F.count("*").alias("m")).withColumn("id", name)
    joined = forms.join(link_items(items, threshold), "id")
    dots = F.length("gloss") - F.length(F.replace("gloss", F.lit("."), F.lit("")))
    raw = joined.groupBy("lex", "stem", "cluster", "gloss").agg(F.sum("m").alias("m"))
    sense = raw.groupBy("lex", "stem", "cluster").agg(F.sum("m").alias("n"), F.min_by("gloss", F.struct(dots.alias("d"), -F.col("m"), "gloss")).alias("canonical"))
    w = Window.partitionBy("lex", "stem")  # the senses of one lexeme and stem
    ranked = sense.withColumn("sense", F.row_number().over(w.orderBy(F.desc("n"), "cluster")).cast("long")).withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 3))
    known = ranked.join(curated.select("lex", "stem", "label"), ["lex", "stem"], "left")
    return known.select("lex", "stem", "sense", F.when(F.col("sense") == 1, F.coalesce("label", "canonical")).otherwise(F.col("canonical")).alias("gloss"), "n", "share")
