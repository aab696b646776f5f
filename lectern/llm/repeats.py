"""Shared frame of the two exact repeat finders (bytes: suffix.py, words: superkmer.py).

A *window* is a fixed number of consecutive items (100 bytes, 20 words). Every window belongs to
exactly one anchor: the leftmost smallest k-gram hash inside it. Consecutive windows with the same
anchor form one *run* (a super-k-mer), described by the anchor's hash ``m`` and a packed position.
Equal windows have equal anchors at equal offsets, so only runs whose ``m`` occurs twice can hold a
repeat. All steps are keyed on hashes, pre-aggregate before the shuffle and never gather a hot group:

1. count the anchors by ``m``, keep the repeated ones (partial aggregates);
2. fetch the runs' content beside their own document, reduced to a 128-bit digest;
3. of runs with one digest only the first can be new; the later ones are repeats as a whole;
4. runs with the same ``m`` but different content (edges of repeats) travel as packed strings to
   their bucket, which the operator's own sorting resolves. Buckets of more than ``BLOCK`` strings are
   dealt into blocks, each sorted the same way; of each window only its first place in the block goes
   on, by a 128-bit digest, to one more aggregate. A window met by every document thus leaves a block once.

Copies are told by 128-bit BLAKE2b digests of whole runs (no comparison of bytes follows: two different
strings share one with probability 2^-128).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import byte_blocks, discard, free_shuffles, materialise, text_or_empty

#: Different strings of a bucket that are sorted together.
BLOCK = 2048
C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F], dtype=np.uint64)
POS = 20  # low bits that hold a position inside a block
ROUTE = "m long, part int, whole boolean, doc_id long, pos long, packed binary"
SORTED = "doc_id long, s long, e long, d1 long, d2 long"


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= C[4]
    h ^= h >> np.uint64(29)
    return h


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    reach = 1
    while reach * 2 <= width:
        v = np.minimum(v[:-reach], v[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(v[:-rest], v[rest:]) if rest else v


def runs(h: np.ndarray, lengths: list[int], window: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of windows over concatenated documents.

    h: hash of the k-gram at each position; lengths: items of each document. Returns document index,
    start inside it, number of windows, offset of the anchor from the start, anchor hash.
    """
    none = np.zeros(0, np.int64)
    total = sum(lengths)
    if total < window or not len(h):
        return none, none, none, none, none.view(np.uint64)
    low = np.uint64((1 << POS) - 1)
    best = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), window - k + 1)
    anchor = (best & low).astype(np.int64)
    ends = np.cumsum(np.asarray(lengths, np.int64))
    inside = np.ones(len(anchor), bool)
    for end, length in zip(ends, lengths):
        inside[max(end - min(window - 1, length), 0) : end] = False
    at = np.flatnonzero(inside)
    if not len(at):
        return none, none, none, none, none.view(np.uint64)
    own = anchor[at]
    cut = np.flatnonzero((own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(at)])) - 1
    start, a = at[first], own[first]
    doc = np.searchsorted(ends, start, "right")
    return doc, start - (ends[doc] - np.asarray(lengths, np.int64)[doc]), at[last] - start + 1, a - start, h[a]


class Kind:
    """What differs between bytes and words."""

    window: int
    k: int

    def anchors(self, block: list[tuple]) -> tuple[np.ndarray, ...]:
        """For (doc_id, bytes) rows: row index, start, windows, anchor offset, m."""
        raise NotImplementedError

    def slicer(self, text: bytes) -> Callable[[int, int], bytes]:
        """Gives the packed content of items start to end of one text."""
        raise NotImplementedError

    def cut(self, packed: bytes, number: int) -> bytes:
        """One window of a packed string."""
        raise NotImplementedError

    def bucket(self, info: list[tuple[int, int, int]], packed: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For strings with their (start, windows, anchor offset), by group and then place: each window's string,
        number in it, and the string whose equal window of the group comes first."""
        raise NotImplementedError


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), *(c.to_pylist() for c in batch.columns[2:]))


def unpack(pos: int) -> tuple[int, int, int]:
    """start, number of windows, anchor offset."""
    return pos >> 16, (pos >> 8) & 255, pos & 255


def _anchor_map(kind: Kind):
    def run(batches):
        for batch in batches:
            for block in byte_blocks(_rows(batch)):
                row, start, n, a, m = kind.anchors(block)
                if len(row):
                    ids = np.asarray([x[0] for x in block], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(ids[row]), pa.array(start << 16 | n << 8 | a)], ["m", "doc_id", "pos"])

    return run


def _digest_map(kind: Kind):
    def run(batches):
        for batch in batches:
            for doc_id, text, found in _rows(batch):
                cut = kind.slicer(text)
                digests, ms, ps = [], [], []
                for x in found:
                    start, n, _ = unpack(x["pos"])
                    digests.append(blake2b(cut(start, start + n - 1 + kind.window), digest_size=16).digest())
                    ms.append(x["m"])
                    ps.append(x["pos"])
                d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ms, pa.int64()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array([doc_id] * len(ms), pa.int64()), pa.array(ps, pa.int64())], ["m", "d1", "d2", "doc_id", "pos"])

    return run


def digest(x: bytes) -> tuple[int, int]:
    d = blake2b(x, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _route_map(kind: Kind, most: int):
    """Packed strings with their bucket's block."""

    def run(batches):
        for batch in batches:
            for doc_id, text, found in _rows(batch):
                cut, out = kind.slicer(text), []
                for x in found:
                    start, n, _ = unpack(x["pos"])
                    blocks = -(-x["c"] // most)
                    part = ((doc_id * 0x9E3779B97F4A7C15 + x["pos"] * 0xC2B2AE3D27D4EB4F) >> 23 & 0xFFFFFFFF) % blocks
                    out.append((x["m"], part, blocks == 1, doc_id, x["pos"], cut(start, start + n - 1 + kind.window)))
                for i in range(0, len(out), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 20_000]), [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()])], [f.split()[0] for f in ROUTE.split(", ")])

    return run


def _resolved(kind: Kind, rows: list[tuple]) -> pa.RecordBatch:
    """Of whole blocks: repeated spans, and the digests of the first windows of blocks that aren't a whole bucket."""
    info, doc = [unpack(r[4]) for r in rows], np.array([r[3] for r in rows], np.int64)
    group = np.cumsum(np.array([False] + [a[:2] != b[:2] for a, b in zip(rows[1:], rows)], bool)).astype(np.int64)
    row, j, first = kind.bucket(info, [r[5] for r in rows], group)
    start = np.array([i[0] for i in info], np.int64)
    whole = np.array([r[2] for r in rows], bool)
    anchor = start + np.array([i[2] for i in info], np.int64)
    again = (first != row) & ((doc[first] != doc[row]) | (anchor[first] != anchor[row]))  # equal places are one document's versions
    r, k = row[again], j[again]
    order = np.lexsort((k, r))
    r, k = r[order], k[order]
    cut = np.concatenate(([True], (r[1:] != r[:-1]) | (k[1:] != k[:-1] + 1))) if len(r) else np.zeros(0, bool)
    at = np.flatnonzero(cut)
    last = np.concatenate((at[1:], [len(r)])) - 1 if len(at) else at
    alone = np.flatnonzero((first == row) & ~whole[row])
    named = [digest(kind.cut(rows[i][5], x)) for i, x in zip(row[alone].tolist(), j[alone].tolist())]
    s = np.concatenate((start[r[at]] + k[at], start[row[alone]] + j[alone]))
    e = np.concatenate((start[r[at]] + k[last], start[row[alone]] + j[alone])) + kind.window
    none = [None] * len(at)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate((doc[r[at]], doc[row[alone]]))), pa.array(s), pa.array(e), pa.array(none + [x for x, _ in named], pa.int64()), pa.array(none + [x for _, x in named], pa.int64())],
        [f.split()[0] for f in SORTED.split(", ")],
    )


def _bucket_map(kind: Kind):
    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            if len(held) > 4000:
                last = held[-1][:2]
                edge = next((i for i in range(len(held) - 1, -1, -1) if held[i][:2] != last), -1) + 1
                if edge:
                    yield _resolved(kind, held[:edge])
                    held = held[edge:]
        if held:
            yield _resolved(kind, held)

    return run


def repeated_spans(docs: DataFrame, kind: Kind) -> tuple[DataFrame, DataFrame]:
    """(texts, spans) of all items that a window covers which also starts earlier.

    docs: doc_id, text. spans: doc_id and a list of (s, e) item intervals, one row per document with any.
    """
    spark, left = docs.sparkSession, []
    listed = F.collect_list(F.struct("s", "e"))

    def keep(df: DataFrame, label: str, *done: DataFrame) -> DataFrame:
        """Written apart: joins against it can be split where a key is hot; ``done`` and the shuffle files can go."""
        left.append(materialise(df, label))
        for x in done:
            discard(x)
        free_shuffles(spark)
        return left[-1]

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    known = texts.where("doc_id IS NOT NULL")
    anchored = known.mapInArrow(_anchor_map(kind), "m long, doc_id long, pos long")
    repeated = keep(anchored.groupBy("m").count().where("count > 1").select("m"), "repeated")
    flagged = keep(anchored.join(repeated, "m", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("m", "pos")).alias("found")), "flagged", repeated)
    digested = keep(known.join(flagged, "doc_id").select("doc_id", "text", "found").mapInArrow(_digest_map(kind), "m long, d1 long, d2 long, doc_id long, pos long"), "runs", flagged)
    first = keep(digested.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "pos")).alias("f"), F.count("*").alias("n"), F.min("m").alias("m")), "first")
    start = F.shiftright("pos", 16)
    count = F.shiftright("pos", 8).bitwiseAND(F.lit(255).cast("long"))
    copies = _later(digested.drop("m"), first).select("doc_id", start.alias("s"), (start + count - 1 + kind.window).alias("e"))
    copies = keep(copies.groupBy("doc_id").agg(listed.alias("spans")), "copies", digested)
    single = first.select("m", F.col("f.doc_id").alias("doc_id"), F.col("f.pos").alias("pos"))
    crowd = keep(single.groupBy("m").agg(F.count("*").alias("c")).where("c > 1"), "crowd")
    mixed = keep(single.join(crowd, "m").groupBy("doc_id").agg(F.collect_list(F.struct("m", "c", "pos")).alias("found")), "mixed", first, crowd)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    routed = known.join(mixed, "doc_id").select("doc_id", "text", "found").mapInArrow(_route_map(kind, BLOCK), ROUTE)
    resolved = keep(routed.repartition(n, "m", "part").sortWithinPartitions("m", "part", "doc_id", "pos").mapInArrow(_bucket_map(kind), SORTED), "resolved", mixed)
    edges = keep(resolved.where("d1 IS NULL").groupBy("doc_id").agg(listed.alias("spans")), "edges")
    window = resolved.where("d1 IS NOT NULL").select("d1", "d2", "doc_id", F.col("s").alias("pos"))
    origin = keep(window.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "pos")).alias("f"), F.count("*").alias("n")).where("n > 1"), "origin")
    crowded = _later(window, origin).select("doc_id", F.col("pos").alias("s"), (F.col("pos") + kind.window).alias("e"))
    crowded = keep(crowded.groupBy("doc_id").agg(listed.alias("spans")), "crowded", resolved, origin)
    spans = materialise(copies.unionByName(edges).unionByName(crowded).groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    for df in left:
        discard(df)
    free_shuffles(spark)
    return texts, spans


def _later(df: DataFrame, first: DataFrame) -> DataFrame:
    """The rows of a digest but the first one; digests that occur once have none."""
    return df.join(first.where("n > 1").select("d1", "d2", "f"), ["d1", "d2"]).where("doc_id != f.doc_id OR pos != f.pos")


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Union of the intervals, as maximal runs."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]
