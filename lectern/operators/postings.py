"""A stored inverted index: term-partitioned postings in blocks with their greatest impact, and statistics.

Units (chunks or documents) belong to shards of some ``SHARD`` units, fewer of long ones, by a hash of their key. A row of ``blocks`` holds at most
``BLOCK`` postings of one term in one shard, by falling impact, with the greatest impact beside it: the BM25 part
without the idf. Files are partitioned by a hash of the term (``part``) and sorted by term, so a query reads the
partitions of its terms and, inside, their row groups. A hot term is spread over its shards, when built and when read.

The best k of a query come without reading all blocks. The k best sums over the most promising blocks are a bound from
below; a block can be skipped when its own greatest impact and the other terms' greatest ones in its shard stay
under that bound, since a unit lies in one shard and in at most one block of a term. A rare word lifts the shards it is in; smaller
shards would be fewer units each, but then most blocks hold one or two postings (1.7 on average with 512 units), and rows, not postings, set the build's time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.fts import B, K1, scored
from lectern.operators.graph import cut

SHARD, BLOCK = 32_768, 128
#: Version of the stored form; a store of another one is built anew.
FORMAT = 2
#: Terms of a partition, most partitions, and units for each further file of a partition.
TERMS, PARTS, FILED = 20_000, 4096, 2_000_000
#: Words of a shard on average, at most, which a task of the build inverts in memory.
GROUPED = 1_000_000


def impact(avgdl: float, tf=None, dl=None):
    """The BM25 part of a posting (tf, dl) without the idf: of the columns of these names, or of two arrays."""
    tf, dl = (F.col("tf"), F.col("dl")) if tf is None else (tf, dl)
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def part_of(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def _ranks(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The rank of each value among the distinct ones, and these in order."""
    own = values.dictionary_encode()
    order = pc.array_sort_indices(own.dictionary)
    ranks = np.empty(len(order), dtype=np.int64)
    ranks[order.to_numpy()] = np.arange(len(order))
    return ranks[own.indices.to_numpy()], own.dictionary.take(order)


def _inverted(avgdl: float, size: int):
    """The blocks of a shard, as a function of the Arrow table of its units (unit, words, shard)."""

    def blocks(t: pa.Table) -> pa.Table:
        words = t.column("words").combine_chunks()
        lengths = pc.list_value_length(words).to_numpy().astype(np.int64)
        known = words.flatten()
        term, terms = _ranks(known.filter(known.is_valid()))
        row = np.repeat(np.arange(len(lengths)), lengths)[pc.is_valid(known).to_numpy(zero_copy_only=False)]
        unit, units = _ranks(t.column("unit").combine_chunks())
        # rows of one key and length are one unit
        each, own = np.unique(unit * (int(lengths.max()) + 1) + lengths, return_inverse=True)
        pairs, tf = np.unique(term * len(each) + own[row], return_counts=True)
        term, own = pairs // len(each), pairs % len(each)
        dl, unit = each[own] % (int(lengths.max()) + 1), each[own] // (int(lengths.max()) + 1)
        i = impact(avgdl, tf, dl)
        best = np.lexsort((-i, term))  # stable: equal ones by unit
        start = np.flatnonzero(np.diff(term, prepend=-1))
        at = np.arange(len(term)) - np.repeat(start, np.diff(start, append=len(term)))
        head = np.flatnonzero(at % size == 0)
        offsets = pa.array(np.append(head, len(term)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (units.take(pa.array(unit[best])), pa.array(tf[best].astype(np.int32)), pa.array(dl[best].astype(np.int32)))]
        whole = [pa.array(x.astype(np.int32)) for x in (np.full(len(head), t.column("shard")[0].as_py()), at[head] // size, np.diff(head, append=len(term)))]
        return pa.table([terms.take(pa.array(term[head])), whole[0], whole[1], pa.array(i[best][head]), whole[2], *lists], ["term", "shard", "block", "most", "n", "unit", "tf", "dl"])

    return blocks


def build(bags: DataFrame, path: str, unit: str = "chunk_id") -> dict:
    """Write the index of bags (unit, words) below ``path``; returns its statistics.

    Null and empty bags and units without a key have no postings; units without words don't count. Repeated keys count
    as one unit whose words add up. Bags whose words' metadata say ``stored`` lie in
    files already; others are written first, since they are read three times.
    """
    held = bags.select(F.col(unit).alias("unit"), "words").where(F.col("unit").isNotNull() & (F.size("words") > 0))
    held = held if bags.schema["words"].metadata.get("stored") else cut(held)
    n, total = held.agg(F.count("*"), F.sum(F.size("words"))).first()
    if not n:
        return {"unit": held.schema["unit"].dataType.simpleString(), "n": 0, "avgdl": 0.0, "terms": 0, "postings": 0, "blocks": 0, "shards": 0, "parts": 0}
    avgdl, shards = total / n, math.ceil(max(n / SHARD, total / GROUPED))
    terms = held.select(F.explode(F.array_distinct("words")).alias("term")).where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"))
    terms.write.parquet(f"{path}/terms")
    known = held.sparkSession.read.parquet(f"{path}/terms")
    distinct, postings = known.agg(F.count("*"), F.sum("df")).first()
    parts = min(PARTS, max(8, distinct // TERMS))
    files = max(8, n // FILED)
    shard = F.pmod(F.xxhash64("unit"), F.lit(shards)).cast("int")
    # units travel as whole rows, and a shard is inverted at once; the tasks of both shuffles grow with the words, whatever the session's number is
    key, tasks = held.schema["unit"].dataType.simpleString(), max(8, total // GROUPED)
    dealt = held.withColumn("shard", shard).repartition(tasks, "shard")
    blocks = dealt.groupBy("shard").applyInArrow(_inverted(avgdl, BLOCK), f"term string, shard int, block int, most double, n int, unit array<{key}>, tf array<int>, dl array<int>")
    rows = blocks.withColumn("part", part_of(F.col("term"), parts)).repartition(tasks, "part", F.col("shard") % files)
    rows.sortWithinPartitions("part", "term", "shard", "block").write.partitionBy("part").parquet(f"{path}/blocks")
    count = held.sparkSession.read.parquet(f"{path}/blocks").count()
    return {"unit": held.schema["unit"].dataType.simpleString(), "n": n, "avgdl": avgdl, "terms": distinct, "postings": postings, "blocks": count, "shards": shards, "parts": parts}


class Postings:
    """A stored index opened for queries."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict):
        self.spark, self.path, self.stats = spark, path, manifest

    def terms(self) -> DataFrame:
        """term, df."""
        return self.spark.read.parquet(f"{self.path}/terms") if self.stats["n"] else self.spark.createDataFrame([], "term string, df long")

    def frequent(self, n: int = 3, most: float = 0.2) -> list[str]:
        """The n most frequent terms that fewer than ``most`` of the units hold."""
        own = self.terms().where(F.col("df") < most * self.stats["n"])
        return [r["term"] for r in own.orderBy(F.desc("df"), "term").limit(n).collect()]

    def blocks(self, terms: list[str]) -> DataFrame:
        """The blocks of some terms: only their partitions are read."""
        if not self.stats["n"] or not terms:
            return self.spark.createDataFrame([], f"term string, shard int, block int, most double, n int, unit array<{self.stats['unit']}>, tf array<int>, dl array<int>")
        named = self.spark.createDataFrame([(t,) for t in sorted(set(terms))], "term string").select("term", part_of(F.col("term"), self.stats["parts"]).alias("part")).collect()
        known = self.spark.read.parquet(f"{self.path}/blocks")
        return known.where(F.col("part").isin(*{r["part"] for r in named}) & F.col("term").isin(*[r["term"] for r in named])).drop("part")

    def _weights(self, terms: list[str]) -> dict[str, float]:
        n = self.stats["n"]
        found = self.terms().where(F.col("term").isin(*(terms or [""]))).collect()  # a row for each word of the query
        return {r["term"]: math.log1p((n - r["df"] + 0.5) / (r["df"] + 0.5)) for r in found}

    def postings(self, blocks: DataFrame) -> DataFrame:
        """term, unit, tf, dl of some blocks."""
        return blocks.select("term", F.explode(F.arrays_zip("unit", "tf", "dl")).alias("x")).select("term", "x.unit", "x.tf", "x.dl")

    def bm25(self, terms: list[str], unit: str = "chunk_id") -> DataFrame:
        """unit, score of every unit that holds a query term."""
        own = self.postings(self.blocks(terms)).withColumnRenamed("unit", unit)
        df = self.terms().where(F.col("term").isin(*(terms or [""])))
        stats = self.spark.createDataFrame([(self.stats["n"], float(self.stats["avgdl"]))], "n long, avgdl double")
        return scored(own, df, stats, [], unit)

    def promising(self, terms: list[str], k: int) -> DataFrame:
        """The blocks that can hold one of the k best units."""
        weights = self._weights(terms)
        blocks = self.blocks(list(weights))
        if not weights:
            return blocks
        weight = F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("term"))
        head = blocks.select("term", "shard", "block", (weight * F.col("most")).alias("bound"))
        first = [(r["term"], r["shard"], r["block"]) for r in head.orderBy(F.desc("bound"), "term", "shard", "block").limit(k).collect()]
        named = self.spark.createDataFrame(first, "term string, shard int, block int")
        part = self.postings(blocks.join(F.broadcast(named), ["term", "shard", "block"], "left_semi")).select("unit", (weight * impact(self.stats["avgdl"])).alias("s"))
        sums = part.groupBy("unit").agg(F.sum("s").alias("s")).orderBy(F.desc("s")).limit(k).agg(F.count("*"), F.min("s")).first()
        if sums[0] < k:
            return blocks
        shard = head.where("block = 0").groupBy("shard").agg(F.sum("bound").alias("all"), F.map_from_entries(F.collect_list(F.struct("term", "bound"))).alias("of"))
        reach = weight * F.col("most") + F.col("all") - F.element_at("of", F.col("term"))
        return blocks.join(shard, "shard").where(reach >= sums[1] - 2e-6).drop("all", "of")  # scores are compared when rounded

    def best(self, terms: list[str], k: int, unit: str = "chunk_id") -> DataFrame:
        """unit, score of the k best units, ties by key; blocks that cannot hold one aren't read."""
        own = self.postings(self.promising(terms, k)).withColumnRenamed("unit", unit)
        df = self.terms().where(F.col("term").isin(*(terms or [""])))
        stats = self.spark.createDataFrame([(self.stats["n"], float(self.stats["avgdl"]))], "n long, avgdl double")
        return scored(own, df, stats, [], unit).orderBy(F.desc("score"), unit).limit(k)
