"""Coreference: tokens that refer to earlier tokens, followed to what they stand for, and shown by citation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators.graph import cut


def resolved(links: DataFrame, depth: int = 8) -> DataFrame:
    """node, last, hops: where the chain of each node ends (links: node, refers_to; one link a node at most).

    The frontier moves one link a round and only holds chains that still go on; it ends when empty or after ``depth`` links.
    A chain longer than that, or a circle, has no row. Of several links of a node the least target counts.
    """
    own = cut(links.where("node IS NOT NULL AND refers_to IS NOT NULL").groupBy("node").agg(F.min("refers_to").alias("refers_to")))
    now, out = own.select("node", F.col("refers_to").alias("at")), None
    for hop in range(1, depth + 1):
        met = cut(now.join(own.select(F.col("node").alias("at"), F.col("refers_to").alias("on")), "at", "left").select("node", "at", "on"))
        done = met.where("on IS NULL").select("node", F.col("at").alias("last"), F.lit(hop).cast("long").alias("hops"))
        out = done if out is None else out.unionByName(done)
        now = met.where("on IS NOT NULL").select("node", F.col("on").alias("at"))
        if hop == depth or now.isEmpty():
            return out
    return out


def participants(citations: DataFrame, tokens: DataFrame, links: DataFrame, verses: int = 8, most: int = 12, depth: int = 8) -> DataFrame:
    """question, place, ref, at, word, lemma, refers_to, there: the referring words of the first cited verses of each question.

    citations: question, place, ref. tokens: node, ref, surface, lemma. Of each citation the first ``most`` words by node that lead to a
    token are shown, with that token's lemma and verse.
    """
    first = citations.withColumn("n", F.row_number().over(Window.partitionBy("question").orderBy("place", "ref"))).where(F.col("n") <= verses).drop("n")
    ends = resolved(links, depth).join(tokens.select(F.col("node").alias("last"), F.col("lemma").alias("refers_to"), F.col("ref").alias("there")), "last")
    own = first.join(tokens.select("node", "ref", "surface", "lemma"), "ref").join(ends.select("node", "refers_to", "there"), "node")
    order = Window.partitionBy("question", "place", "ref").orderBy("node")
    shown = own.withColumn("at", F.row_number().over(order).cast("long")).where(F.col("at") <= most)
    return shown.select("question", "place", "ref", "at", F.col("surface").alias("word"), "lemma", "refers_to", "there")
