"""Sequence alignment and clustering where no expression exists: grouped maps over bounded groups (a verse, a book, a lexeme)."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.linkage import linked


#: Cells of a table beyond which its rows are filled by numpy.
SMALL = 1024


def lcs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Longest common subsequence as index pairs; empty codes never match; at a tie the left side advances."""
    if len(a) * len(b) > SMALL:
        table = _long_table(a, b)
    else:
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                table[i][j] = table[i + 1][j + 1] + 1 if a[i] and a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _long_table(a: list[str], b: list[str]) -> np.ndarray:
    """The same table row by row: a cell is the greatest at or after it of the row below and of the matches' diagonal plus one."""
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    right = np.array(b, object)
    at = {c: right == c for c in set(a) if c}
    for i in range(len(a) - 1, -1, -1):
        best = table[i + 1, :-1]
        if a[i]:
            best = np.where(at[a[i]], table[i + 1, 1:] + 1, best)
        table[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
    return table


_PAIRS = pa.schema([("key", pa.int64()), ("i", pa.int64()), ("j", pa.int64())])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple[int, int, int]] = []
        for key, a, b in zip(*(batch.column(c).to_pylist() for c in ("key", "a", "b"))):
            out += ((key, i, j) for i, j in lcs(a, b))
        yield pa.record_batch([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], schema=_PAIRS)


def lcs_align(left: DataFrame, right: DataFrame, key: str, order: str, code: str) -> DataFrame:
    """key, i, j: aligned positions of two code sequences of each key; places of one order follow their codes.

    Keys travel as rows of two arrays, many to a batch of a task, not as a group each.
    """
    codes = F.transform(F.array_sort(F.collect_list(F.struct(order, code))), lambda x: x[code])
    both = left.groupBy(F.col(key).alias("key")).agg(codes.alias("a")).join(right.groupBy(F.col(key).alias("key")).agg(codes.alias("b")), "key")
    return both.mapInArrow(_aligned, "key long, i long, j long")


def single_linkage(df: DataFrame, key: str, item: str, vector: str, threshold: float, across: bool = False, undefined: bool = False) -> DataFrame:
    """key, item, cluster: within each key, items linked by a cosine of ``threshold`` or more, named by the least item.

    Items are whole numbers; rows of one number are one item of their key, or with ``across`` of all keys,
    with the links of all these rows. Those without a number have no cluster. No key is held by one task. A cosine is
    undefined if a vector is zero or holds a non-finite component: it links nothing, or with ``undefined`` all vectors of
    the key, as where NaN counts as greater than any number.
    """
    shift = F.lit(Decimal(1 << 63))  # so that none is below zero
    number = F.lpad((F.col(item).cast("decimal(20,0)") + shift).cast("string"), 20, "0")  # sorts as the number does
    name = number if across else F.when(number.isNotNull(), F.concat_ws("|", F.col(key).cast("string"), number))
    items = df.select(F.col(key).alias("key"), F.col(item).alias("item"), name.alias("id"), F.col(vector).alias("vector"))
    own = items.where("id IS NOT NULL").select("key", "id", "vector")
    found = linked(own, threshold, more=_unordered(own) if undefined else None)
    return items.join(found, "id", "left").select("key", "item", (F.substring_index("cluster", "|", -1).cast("decimal(20,0)") - shift).cast("long").alias("cluster"))


def _unordered(items: DataFrame) -> DataFrame:
    """u, v: links of all vectors of a key with its least one that has no cosine, where there is one."""
    value = lambda x: x.cast("double")
    odd = F.exists("vector", lambda x: F.isnan(value(x)) | (F.abs(value(x)) == float("inf"))) | F.forall("vector", lambda x: value(x) == 0)
    held = items.where("key IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)")
    least = held.where(odd).groupBy("key").agg(F.min("id").alias("v"))
    return held.join(least, "key").select(F.col("id").alias("u"), "v")
