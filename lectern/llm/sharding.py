"""Operator 9: shards through fixed virtual slots, DataFrame functions only.

A record's slot is a hash of its id over a fixed number of slots. One aggregate sums bytes and rows
per slot; a slot-to-shard map, versioned, says where each slot lives, and rebalancing edits the map,
never the hash. The query keeps the law ``bytes``: slots, largest first, go to the lightest shard; it stores the
map as version 1 and places the records by what it reads back. Records with equal texts are not held together:
a group may hold a third of all rows, and shards near equal in bytes must then share it.

Cases: null text counts as no bytes; rows without an id hash like any value; repeated rows take
separate places; equal ids share a slot; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import checkpoint_root

SLOTS, HEADER = 8192, 16


def slot_of(slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int")


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, v (virtual slot)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + HEADER).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"), slot_of(slots).alias("v"))


def slot_sizes(records: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows), at most one row a slot: a list of fixed bound."""
    return [tuple(r) for r in records.groupBy("v").agg(F.sum("size"), F.count("*")).orderBy("v").collect()]


def balanced(sizes: list[tuple[int, int, int]], shards: int, slots: int = SLOTS) -> list[int]:
    """A first map: slots, largest first, each to the lightest shard; empty slots in turn."""
    out = [slot % shards for slot in range(slots)]
    heap = [(0, shard) for shard in range(shards)]
    for slot, size, _ in sorted(sizes, key=lambda x: (-x[1], x[0])):
        held, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (held + size, shard))
    return out


def grown(slot_map: list[int], sizes: list[tuple[int, int, int]], shards: int) -> list[int]:
    """The map edited for one more shard, which only takes: from the heaviest shard that has one, its largest slot that still fits."""
    out, load, own, size = list(slot_map), [0] * (shards + 1), {}, dict.fromkeys(range(len(slot_map)), 0)
    for slot, n, _ in sizes:
        size[slot] = n
    for slot, shard in enumerate(out):
        load[shard] += size[slot]
        own.setdefault(shard, []).append((size[slot], slot))
    target = sum(load) / (shards + 1)
    able = set(range(shards))
    while load[shards] < target and able:
        donor = max(able, key=lambda s: (load[s], -s))
        fits = [x for x in own.get(donor, ()) if 0 < x[0] <= target - load[shards]]
        if not fits:
            able.discard(donor)
            continue
        n, slot = max(fits)
        own[donor].remove((n, slot))
        out[slot] = shards
        load[donor] -= n
        load[shards] += n
    return out


def grown_to(slot_map: list[int], sizes: list[tuple[int, int, int]], shards: int, more: int) -> list[int]:
    """The map edited for ``more`` shards on top of ``shards``, one after the other."""
    for k in range(more):
        slot_map = grown(slot_map, sizes, shards + k)
    return slot_map


def save_map(spark: SparkSession, path: str, version: int, slot_map: list[int]) -> None:
    """Add a version of the map; older ones stay readable, and none is written twice."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder) and spark.read.parquet(path).where(F.col("version") == version).limit(1).count():
        raise ValueError(f"version {version} of the map is there")
    values = ",".join(map(str, slot_map))
    spark.range(1).select(F.lit(version).alias("version"), F.posexplode(_array(values)).alias("slot", "shard")).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> list[int]:
    """A version of the map, or the newest."""
    stored = spark.read.parquet(path)
    at = version if version is not None else stored.agg(F.max("version")).first()[0]
    return [r["shard"] for r in stored.where(F.col("version") == at).orderBy("slot").collect()]


def _array(values: str) -> Column:
    return F.split(F.lit(values), ",").cast("array<bigint>")


def place(records: DataFrame, slot_map: list[int], sizes: list[tuple[int, int, int]]) -> DataFrame:
    """Each record's shard and its place there, counted slot by slot, so no shard is sorted as a whole."""
    filled, base, rows = {}, [0] * len(slot_map), {s: n for s, _, n in sizes}
    for slot, shard in enumerate(slot_map):
        base[slot] = filled.get(shard, 0)
        filled[shard] = base[slot] + rows.get(slot, 0)
    within = F.row_number().over(Window.partitionBy("v").orderBy("doc_id", "text_crc32", "size"))
    look = lambda xs: F.element_at(_array(",".join(map(str, xs))), F.col("v") + 1)
    return records.withColumn("shard", look(slot_map).cast("int")).withColumn("slot", look(base) + within - 1)


def sharded(docs: DataFrame, shards: int = 40, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: the ``bytes`` law over a fresh map."""
    records = sized(docs, slots)
    sizes = slot_sizes(records)
    path = f"{checkpoint_root(docs.sparkSession)}/slot-map-{uuid.uuid4().hex}"
    save_map(docs.sparkSession, path, 1, balanced(sizes, shards, slots))
    placed = place(records, load_map(docs.sparkSession, path), sizes)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
