"""A stored approximate index of vectors: inverted lists as partitions of a table.

Vectors (unit length) go to the lists of their ``COPIES`` nearest centroids; a list is a partition of the stored table, so a
search reads only the lists that it probes. How many that are is tuned when the index is built: the least share whose
recall, measured against an exact scan for a sample of the vectors, reaches the target. Centroids are fitted on a bounded
sample; every vector is stored.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Version of the stored form; a store of another one is built anew.
FORMAT = 2
#: Lists that each vector goes to; vectors that fit centroids and queries that tune the probes, at most; most lists.
COPIES, SAMPLE, PROBED, MOST = 2, 65_536, 256, 8192
#: Bundles that vectors are searched in, at least; vectors of one, at most; queries that meet one at once.
LEAST, BUNDLE, ASKED = 16, 65_536, 4096


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _nearest(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each row, nearest first."""
    return np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :n]


def _fitted(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        held = np.bincount(own, minlength=lists) > 0
        c[held] = _unit(sums[held])
    return c


def sound(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, embedding of the vectors that have a direction: not null or zero, no null or non-finite component."""
    e = F.col(column)
    finite = F.forall(e, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x))
    return vectors.select(F.col(key).alias("vec_id"), e.alias("embedding")).where("vec_id IS NOT NULL").where((F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0))


def build(vectors: DataFrame, path: str, recall: float = 0.98, k: int = 20, deep: int = 160) -> dict:
    """Write the lists of vectors (vec_id, embedding, all of one length) below ``path``; returns the index's description.

    The probes are tuned for the ``k`` nearest, and for the ``deep`` nearest that a post-filtered search fetches.
    """
    own = sound(vectors)
    n = own.count()
    if not n:
        return {"n": 0, "lists": 0, "probes": 0, "recall": None}
    hashed = own.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // SAMPLE))) == 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
    sample = hashed.toArrow()
    x = _unit(_matrix(sample.column("embedding").combine_chunks()))
    lists = int(min(MOST, len(x), max(1, round(1.5 * math.sqrt(n)))))
    centroids = _fitted(x, lists)

    def dealt(batches):
        for batch in batches:
            if batch.num_rows:
                near = _nearest(_unit(_matrix(batch.column(1))), centroids, min(COPIES, lists))
                at = np.repeat(np.arange(batch.num_rows), near.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(near.ravel().astype(np.int32))], ["vec_id", "embedding", "list"])

    copied = own.mapInArrow(dealt, "vec_id long, embedding array<float>, list int")
    # a list may hold a third of all vectors: its rows are dealt over several files
    copied.repartition("list", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // 1_000_000)))).write.partitionBy("list").parquet(f"{path}/lists")
    probes, reached = _tuned(own, hashed.limit(PROBED), centroids, recall, k, lists)
    wide, deeply = _tuned(own, hashed.limit(PROBED), centroids, recall, deep, lists)
    flat = json.dumps([[float(v) for v in c] for c in centroids])
    vectors.sparkSession.createDataFrame([(flat,)], "centroids string").coalesce(1).write.parquet(f"{path}/centroids")
    return {"n": n, "lists": lists, "k": k, "probes": probes, "recall": reached, "deep_probes": max(probes, wide), "deep_recall": deeply, "dimensions": int(x.shape[1])}


def _tuned(own: DataFrame, queries: DataFrame, centroids: np.ndarray, recall: float, k: int, lists: int) -> tuple[int, float]:
    """The fewest lists to probe, and the recall at k they give: for each true neighbour of a query its lists' places are known."""
    from lectern.operators.vectors import ranked_neighbours

    true = ranked_neighbours(queries, own, k).select("q", "vec_id").join(own, "vec_id").select("q", "embedding").toArrow()  # PROBED * k rows
    asked = queries.toArrow()
    if not true.num_rows:
        return lists, 1.0
    order = _nearest(_unit(_matrix(asked.column("embedding").combine_chunks())), centroids, lists)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(lists)[None, :].repeat(len(order), 0), 1)
    row = {q: i for i, q in enumerate(asked.column("vec_id").to_pylist())}
    at = np.array([row[q] for q in true.column("q").to_pylist()])
    homes = _nearest(_unit(_matrix(true.column("embedding").combine_chunks())), centroids, min(COPIES, lists))
    first = place[at[:, None], homes].min(1)
    share = np.cumsum(np.bincount(first, minlength=lists)) / len(first)
    probes = int(np.searchsorted(share, recall)) + 1
    return min(probes, lists), float(share[min(probes, lists) - 1])


class Lists:
    """A stored index opened for searches."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict):
        self.spark, self.path, self.stats = spark, path, manifest

    def _centroids(self) -> np.ndarray:
        return np.array(json.loads(self.spark.read.parquet(f"{self.path}/centroids").first()[0]))

    def lists(self, numbers: list[int] | None = None) -> DataFrame:
        """The stored rows of some lists: the other partitions aren't read."""
        known = self.spark.read.parquet(f"{self.path}/lists")
        return known if numbers is None else known.where(F.col("list").isin(*numbers))

    def search(self, queries: DataFrame, k: int = 20, probes: int | None = None, over: int = 1) -> DataFrame:
        """q, vec_id, sim, rn: the ``k * over`` nearest other vectors by cosine among the probed lists.

        The lists that the queries name are collected (at most one number a list), and only those are read. Their vectors are
        dealt into bundles by hash, both copies of a vector into one, and meet blocks of the queries there; a vector counts for a
        query that probes one of its lists. A bundle gives the k best of each query, which are shuffled: bundles, unlike
        lists, don't grow in number until each holds some ``BUNDLE`` vectors.
        """
        from lectern.operators.vectors import PRODUCTS, greatest

        if not self.stats["n"]:
            return self.spark.createDataFrame([], "q long, vec_id long, sim double, rn long")
        most = k * over
        probes = min(probes or self.stats["probes" if most <= self.stats["k"] else "deep_probes"], self.stats["lists"])
        centroids, lists = self._centroids(), self.stats["lists"]

        def named(batches):
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(_nearest(_unit(_matrix(batch.column(1))), centroids, probes)).astype(np.int32))], ["list"])

        asked = sound(queries).select(F.col("vec_id").cast("long").alias("q"), F.col("embedding").alias("qe"))
        numbers = [r["list"] for r in asked.mapInArrow(named, "list int").distinct().collect()]

        def met(left: pa.Table, right: pa.Table) -> pa.Table:
            schema = pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("sim", pa.float64())])
            if not left.num_rows or not right.num_rows:
                return schema.empty_table()
            names, y = left.column("q").to_numpy(), _unit(_matrix(left.column("qe").combine_chunks()))
            every, home = right.column("vec_id").to_numpy(), right.column("list").to_numpy()
            order = np.argsort(every, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(every[order]) != 0))  # rows of one id are adjacent
            ids, x = every[order][first], _unit(_matrix(right.column("embedding").combine_chunks().take(pa.array(order[first]))))
            out, step = [], max(1, PRODUCTS // len(x))
            for at in range(0, len(y), step):
                part = y[at : at + step]
                wanted = np.zeros((len(part), lists), dtype=bool)
                np.put_along_axis(wanted, _nearest(part, centroids, probes), True, 1)
                seen = np.logical_or.reduceat(wanted[:, home[order]], first, axis=1)
                sims = np.round(part @ x.T, 6)
                sims[~seen | (ids == names[at : at + step, None])] = -np.inf
                row, place = greatest(sims, most)
                out.append((names[at + row], ids[place], sims[row, place]))
            return pa.table([np.concatenate(c) for c in zip(*out)], schema=schema)

        bundles, blocks = max(LEAST, math.ceil(self.stats["n"] / BUNDLE)), max(1, math.ceil(asked.count() / ASKED))
        deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        own = self.lists(numbers).select("vec_id", "embedding", "list", deal("vec_id", bundles).alias("bundle")).withColumn("block", each(blocks))
        dealt = asked.withColumn("block", deal("q", blocks)).withColumn("bundle", each(bundles))
        pairs = dealt.groupBy("block", "bundle").cogroup(own.groupBy("block", "bundle")).applyInArrow(met, "q long, vec_id long, sim double")
        best = pairs.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "vec_id")).cast("long"))
        return best.where(F.col("rn") <= most)


def post_filtered(found: DataFrame, allowed: DataFrame, k: int) -> DataFrame:
    """q, vec_id, sim, rn: of over-fetched neighbours those whose id (vec_id) is allowed, the first k of each query."""
    own = found.join(allowed.select("vec_id").distinct(), "vec_id", "left_semi")
    return own.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "vec_id")).cast("long")).where(F.col("rn") <= k).select("q", "vec_id", "sim", "rn")
