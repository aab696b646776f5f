"""Single linkage by cosine within keys, without a key in one task.

The items of a key are dealt into blocks of some ``BLOCK`` items; every pair of blocks is one group, compared in one
multiplication. A group gives only a spanning forest of the links it finds (each item with the least item of its local
component), so a dense key costs no quadratic output, and connected components over all forests give the clusters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.graph import components

#: Items of a block; a group holds two blocks.
BLOCK = 1024
_FOREST = pa.schema([("u", pa.string()), ("v", pa.string())])


def _forest(threshold: float):
    """Links of the items of one group of two blocks (side 0 and 1, or one block alone) as a spanning forest."""

    def run(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        ids = np.array(group.column("id").to_pylist(), object)
        lengths = np.diff(group.column("v").combine_chunks().offsets.to_numpy())
        links: list[tuple[int, int]] = []
        parent = list(range(len(ids)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        flat = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        start = np.cumsum(lengths) - lengths
        for n in np.unique(lengths).tolist():  # vectors of one length
            at = np.flatnonzero(lengths == n)
            x = flat[start[at][:, None] + np.arange(n)]
            size = np.sqrt((x * x).sum(1))
            good = np.isfinite(size) & (size > 0)
            at, x = at[good], x[good] / size[good, None]
            alone = not (side[at] == 1).any()
            left, right = (at, at) if alone else (at[side[at] == 0], at[side[at] == 1])
            a, b = (x, x) if alone else (x[side[at] == 0], x[side[at] == 1])
            for k in range(0, len(left), 512):
                links += ((int(left[i + k]), int(right[j])) for i, j in zip(*np.nonzero(a[k : k + 512] @ b.T >= threshold)))
        for i, j in links:
            p, q = root(i), root(j)
            if p != q:
                parent[max(p, q)] = min(p, q)
        member = [i for i in range(len(ids)) if root(i) != i]
        return pa.table([pa.array([ids[i] for i in member], pa.string()), pa.array([ids[root(i)] for i in member], pa.string())], schema=_FOREST)

    return run


def forests(items: DataFrame, threshold: float, block: int | None = None) -> DataFrame:
    """u, v: links that connect all items (key, id, vector) of one key with a cosine of ``threshold`` or more."""
    block = block or BLOCK
    own = items.where("vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)").select("key", "id", F.col("vector").cast("array<double>").alias("v"))
    blocks = own.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    dealt = own.join(blocks, "key").withColumn("b", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    # a block meets itself, and each other block once
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.struct(F.least("b", o).alias("i"), F.greatest("b", o).alias("j"), F.when(F.col("b") <= o, 0).otherwise(1).alias("side")))
    groups = dealt.select("key", "id", "v", F.explode(pairs).alias("p")).select("key", "id", "v", "p.i", "p.j", "p.side")
    return groups.groupBy("key", "i", "j").applyInArrow(_forest(threshold), "u string, v string")


def linked(items: DataFrame, threshold: float, block: int | None = None, more: DataFrame | None = None) -> DataFrame:
    """id, cluster: the least id of those that an item (key, id text, vector) is linked with, itself included.

    Rows of one id are one item, whatever their keys. Items whose vector is null, zero, or holds null or non-finite
    components stay alone but for ``more`` links (u, v); vectors of different length don't link.
    """
    links = forests(items, threshold, block)
    found = components(links if more is None else links.unionByName(more))
    named = items.select("id").distinct().join(found.withColumnRenamed("node", "id"), "id", "left")
    return named.select("id", F.coalesce("component", "id").alias("cluster"))
