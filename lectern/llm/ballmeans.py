"""Operator 11: ball k-means over integer vectors, exactly Lloyd's rounds with fewer distances.

A cluster is a ball: its centroid and the greatest distance of a member. After each move of the centroids

* centroid j is a neighbour of i only if the ball of i reaches half way to it, |ci - cj| <= 2 r. The new radius is
  bounded by the old one plus the way that the centroid went;
* a member x of i is in the stable core, and stays, if no neighbour has |ci - cj| <= 2 |x - ci|; else it lies in an
  annulus: sorted by |ci - cj|, the neighbours before its place are compared, and no others.

Both bounds include equality, so ties meet their rival. Everything is whole numbers, so all comparisons are
exact. A round reads the vectors with their clusters from the shared folder and writes them with the next ones;
a second pass sums each cluster's members within its partition, and k * dimensions sums come to the driver. No
vector is shuffled, so no cluster, however large, meets in one task. Rounds end early when no centroid moves:
all later ones would give the same. The driver compares all pairs of centroids, so k is meant for thousands.

Cases: vectors that are null, of other length, or hold null or non-finite components are left out; components
whose integer would leave +-2^26 count as +-2^26, so that squared distances stay exact; with fewer vectors than
clusters there are as many clusters as vectors; equal vectors may seed several clusters, of which the first takes
all; vectors without an id are clustered but seed nothing; repeated rows are clustered each; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import discard, materialise

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Integers stay within this, so that a squared distance of 64 components stays under 2^60.
LIMIT = 1 << 26
STATE = "vec_id long, x array<int>, cluster int, distance long"


def integers(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, x: the usable vectors with each component as floor(scale * component)."""
    v = F.col("embedding")
    usable = (F.size(v) == dimensions) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    whole = lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding")).where(v.isNotNull()).where(usable).select("vec_id", F.transform(v, whole).alias("x"))


def seeds(whole: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors whose ids hash smallest, in that order; the driver takes ``clusters`` of them."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = whole.where("vec_id IS NOT NULL").orderBy(h, "x").limit(clusters).collect()
    return np.array([r["x"] for r in first], np.int64)


class Balls:
    """The centroids and, for each, its neighbours by distance with the squared distances."""

    def __init__(self, centroids: np.ndarray, reach: list[int] | None):
        """reach: for each cluster a bound of its squared radius; None before the first assignment."""
        self.centroids, self.near = centroids, None
        if reach is not None:
            self.near = []
            for i, r2 in enumerate(reach):
                d = ((centroids - centroids[i]) ** 2).sum(1)
                js = np.array([j for j in np.argsort(d, kind="stable").tolist() if j != i and d[j] <= 4 * r2], np.int64)
                self.near.append((js, d[js]))

    def nearest(self, x: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
        """(cluster, squared distance, distances computed) of each vector; ties go to the smaller number."""
        if own is None or self.near is None:
            d = np.stack([((x - c) ** 2).sum(1) for c in self.centroids], 1)
            best = d.argmin(1)
            return best, d[np.arange(len(x)), best], d.size
        best, least, done = own.copy(), ((x - self.centroids[own]) ** 2).sum(1), len(x)
        for i in np.unique(own).tolist():
            js, apart = self.near[i]
            members = np.flatnonzero(own == i)
            annulus = np.searchsorted(apart, 4 * least[members], "right")
            for t in range(int(annulus.max(initial=0))):
                at = members[annulus > t]
                d = ((x[at] - self.centroids[js[t]]) ** 2).sum(1)
                done += len(at)
                better = (d < least[at]) | (d == least[at]) & (js[t] < best[at])
                best[at[better]], least[at[better]] = js[t], d[better]
        return best, least, done


def _vectors(column: pa.ListArray, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def _assigned(balls: Balls, dimensions: int, fresh: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = None if fresh else batch.column(2).to_numpy().astype(np.int64)
                cluster, distance, _ = balls.nearest(_vectors(batch.column(1), dimensions), own)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "x", "cluster", "distance"])

    return run


def _moments(clusters: int, dimensions: int):
    """Of a partition: for each cluster its number, greatest and summed distance, and sums of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far, inertia = np.zeros(clusters, np.int64), np.zeros(clusters, np.int64), [0] * clusters
        sums = np.zeros((clusters, dimensions), np.int64)
        for batch in batches:
            x, own, d = _vectors(batch.column(0), dimensions), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for i in np.unique(own).tolist():
                mine = own == i
                n[i] += mine.sum()
                far[i] = max(far[i], d[mine].max())
                inertia[i] += sum(d[mine].tolist())
                sums[i] += x[mine].sum(0)
        at = np.flatnonzero(n)
        lists = pa.array([[str(v) for v in sums[i].tolist()] for i in at.tolist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array(far[at]), pa.array([str(inertia[i]) for i in at.tolist()], pa.string()), lists], ["cluster", "n", "far", "inertia", "sums"])

    return run


def moments(state: DataFrame, clusters: int, dimensions: int) -> dict[int, tuple[int, int, int, list[int]]]:
    """cluster -> (vectors, greatest distance, summed distances, component sums): k rows on the driver."""
    part = state.select("x", "cluster", "distance").mapInArrow(_moments(clusters, dimensions), "cluster int, n long, far long, inertia string, sums array<string>")
    total = lambda c: F.sum(c.cast("decimal(38,0)"))
    head = part.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("far").alias("far"), total(F.col("inertia")).alias("inertia"))
    body = part.select("cluster", F.posexplode("sums").alias("i", "v")).groupBy("cluster", "i").agg(total(F.col("v")).alias("v"))
    body = body.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("sums"))
    return {r["cluster"]: (r["n"], r["far"], int(r["inertia"]), [int(s["v"]) for s in r["sums"]]) for r in head.join(body, "cluster").collect()}


def ball_means(whole: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, dict]:
    """(state, centroids, moments) after so many rounds from the given centroids and one more assignment.

    whole: vec_id, x. state: vec_id, x, cluster, distance, written to the shared folder.
    """
    k, dimensions = centroids.shape
    state = materialise(whole.mapInArrow(_assigned(Balls(centroids, None), dimensions, True), STATE), "balls")
    found = moments(state, k, dimensions)
    for _ in range(rounds):
        moved, reach = centroids.copy(), [0] * k
        for i, (n, far, _, sums) in found.items():
            moved[i] = [s // n for s in sums]
            way = sum((int(a) - int(b)) ** 2 for a, b in zip(moved[i], centroids[i]))
            reach[i] = (isqrt(far) + isqrt(way) + 2) ** 2  # both roots rounded up
        if (moved == centroids).all():
            break
        centroids = moved
        after = materialise(state.mapInArrow(_assigned(Balls(centroids, reach), dimensions, False), STATE), "balls")
        discard(state)
        state, found = after, moments(after, k, dimensions)
    return state, centroids, found


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each usable vector."""
    whole = integers(vectors, dimensions, scale)
    first = seeds(whole, clusters, seed)
    spark, schema = vectors.sparkSession, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(first):
        nothing = whole.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return nothing.where("false").join(spark.createDataFrame([], schema), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    state, centroids, found = ball_means(whole, first, rounds)
    inertia = sum(m[2] for m in found.values())
    named = spark.createDataFrame([(i, m[2], inertia, sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest()) for i, m in found.items()], schema)
    return state.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
