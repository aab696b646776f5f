"""Operator 1: near-duplicate documents by b-bit MinHash.

A document's set holds its distinct shingles of two words (general: ``words``). Documents with equal
sets collapse first; the rest get ``BANDS * ROWS`` minima, whose bands (of ``ROWS`` whole minima) give
candidates and whose low ``BITS`` bits, packed, give a collision-corrected estimate of similarity
from bit counts. Candidates that the estimate doesn't rule out (five standard deviations) are
confirmed on the full sets. Candidates form in two rounds, so that no group is expanded into pairs:

1. each member of a band's bucket with the bucket's least document;
2. in buckets that then still span several components, the members outside the bucket's largest component
   with all others, in blocks that compare signatures and full sets in place and give away a spanning forest only.
   A text goes to one block for each block of such outsiders, an outsider to every block.

A pair at the threshold shares no band with probability (1 - .8^5)^40 = 1e-7.

Cases: null or empty texts and texts without words have an empty set and link with nothing; rows
without an id are dropped, for a component has no name there; rows that share an id are one
document, for which the least set digest stands; empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import byte_blocks, columns, discard, free_shuffles, materialise, small, text_or_empty
from lectern.llm.components import components
from lectern.llm.repeats import C, _rows, mix
from lectern.llm.superkmer import word_hashes

BANDS, ROWS, BITS = 40, 5, 2
HASHES = BANDS * ROWS
#: Five standard deviations of the estimate at the threshold.
MARGIN = 5
#: Members of a bucket that one task compares with as many others.
BLOCK = 512
_seeds = np.random.default_rng(20).integers(1, 1 << 63, size=(2, HASHES), dtype=np.uint64)
MULTIPLY, ADD = (_seeds[0] | np.uint64(1)).astype(np.uint64), _seeds[1]
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, signature binary"


def shingle_sets(texts: list[bytes], words: int = 2) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; a shorter text is one shingle."""
    split = [t.translate(LOWER).split() for t in texts]
    h = word_hashes([w for x in split for w in x])
    out, at = [], 0
    for x in split:
        own = h[at : at + len(x)]
        at += len(x)
        if not len(x):
            out.append(own)
            continue
        k = min(words, len(x))
        s = own[: len(x) - k + 1] * C[0]
        for i in range(1, k):
            s = (s ^ (s >> np.uint64(31))) * C[i % 6] + own[i : len(x) - k + 1 + i]
        out.append(np.unique(mix(s + np.uint64(k))))
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    best = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        x = shingles[at : at + 2048]
        for lo in range(0, HASHES, 50):
            hi = lo + 50
            h = x[:, None] * MULTIPLY[None, lo:hi]
            h += ADD[lo:hi]
            h ^= h >> np.uint64(33)
            h *= C[4]
            np.minimum(best[lo:hi], h.min(axis=0), out=best[lo:hi])
    return best


def pack(best: np.ndarray) -> bytes:
    """The low BITS bits of each minimum."""
    low = (mix(best.copy())[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(low.astype(np.uint8).reshape(-1)).tobytes()


def band_keys(best: np.ndarray) -> np.ndarray:
    m = best.reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * C[1]
    for i in range(ROWS):
        h = mix((h ^ m[:, i]) * C[i])
    return h.view(np.int64)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Corrected estimate of similarity of packed signatures (rows of bytes), by bit counts."""
    x = np.bitwise_xor(a, b)
    differ = x | (x >> 1) if BITS == 2 else x
    equal = HASHES - np.bitwise_count(differ & (0x55 if BITS == 2 else 0xFF)).sum(axis=-1, dtype=np.int64)
    chance = 0.5**BITS
    return (equal / HASHES - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    chance = 0.5**BITS
    p = threshold + (1 - threshold) * chance
    return threshold - MARGIN * (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)


def _sign(words: int):
    def run(batches):
        for batch in small(batches):
            for block in byte_blocks(_rows(batch)):
                out = []
                for (doc_id, _), s in zip(block, shingle_sets([x[1] for x in block], words)):
                    if not len(s):
                        out.append((doc_id, 0, None, None, None, None))
                        continue
                    d = blake2b(s.tobytes(), digest_size=16).digest()
                    best = minima(s)
                    out.append((doc_id, len(s), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), band_keys(best), pack(best)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.binary()])], ["doc_id", "n_shingles", "d1", "d2", "bands", "signature"])

    return run


def _estimate(threshold: float):
    low = least_estimate(threshold)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sx", "sy"))
                yield batch.filter(pa.array(agreement(x, y) >= low)).select(["x", "y"])

    return run


def _confirm(percent: int, words: int):
    def run(batches):
        for batch in batches:
            out = []
            for y, text, others in _rows(batch):
                own = shingle_sets([text], words)[0]
                for o in others:
                    s = shingle_sets([(o["text"] or "").encode()], words)[0]
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        out.append((o["x"], y))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["u", "v"])

    return run


def _settle(percent: int, words: int):
    """Links between different components within the rows of one block pair, on full sets, as a forest.

    A pair meets in the first band that it shares only, and a bucket's least document has been tried before.
    """
    low = least_estimate(percent / 100)

    def run(key, table):
        doc, comp = table.column("doc_id").to_numpy(), table.column("c").to_numpy()
        side, least = table.column("side").to_numpy(), table.column("least").to_numpy()
        sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(len(doc), -1)
        bands = np.array(table.column("bands").to_pylist(), np.int64)
        texts, sets = table.column("text"), {}
        at = int(np.flatnonzero(bands[0] == key[0].as_py())[0])
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                x = up
            return x

        def own(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_sets([(texts[i].as_py() or "").encode()], words)[0]
            return sets[i]

        p = np.flatnonzero((side == key[1].as_py()) & (doc != least))
        q = np.flatnonzero((side == key[2].as_py()) & (doc != least))
        out = []
        for i in p:
            rest = q[comp[q] != comp[i]]
            if key[1] == key[2]:
                rest = rest[doc[rest] > doc[i]]
            if at and len(rest):
                rest = rest[~(bands[rest, :at] == bands[i, :at]).any(axis=1)]
            if len(rest):
                rest = rest[agreement(sig[i][None], sig[rest]) >= low]
            for j in rest:
                x, y = root(int(comp[i])), root(int(comp[j]))
                if x == y:
                    continue
                a, b = own(i), own(j)
                both = len(np.intersect1d(a, b, assume_unique=True)) if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) else 0
                if 100 * both >= percent * (len(a) + len(b) - both):
                    parent[max(x, y)] = min(x, y)
                    out.append((int(doc[i]), int(doc[j])))
        return pa.table({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([y for _, y in out], pa.int64())})

    return run


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs (x < y) whose full sets are similar enough. A y has few partners of its own here (its buckets' least documents)."""
    lesser = pairs.withColumnRenamed("x", "doc_id").join(texts, "doc_id").select("y", F.struct(F.col("doc_id").alias("x"), "text").alias("o"))
    parts = lesser.groupBy(F.col("y").alias("doc_id"), F.pmod(F.xxhash64("o.x"), F.lit(8)).alias("part")).agg(F.collect_list("o").alias("others")).drop("part")
    return texts.join(parts, "doc_id").select("doc_id", "text", "others").mapInArrow(_confirm(percent, words), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row per document.

    Rows that share an id: the first by set digest stands for the document.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).where("doc_id IS NOT NULL")
    signed = materialise(texts.mapInArrow(_sign(words), SIGNED), "signed")
    known = signed.where("d1 IS NOT NULL")
    classes = known.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"))
    heads = materialise(known.join(classes, ["d1", "d2", "doc_id"]).dropDuplicates(["doc_id"]).select("doc_id", "bands", "signature"), "heads")
    signatures = heads.select("doc_id", "signature")
    banded = heads.select("doc_id", F.explode("bands").alias("band"))
    bucket = banded.groupBy("band").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    member = materialise(banded.join(bucket, "band"), "member")
    star = member.where("doc_id != least").select(F.col("least").alias("x"), F.col("doc_id").alias("y")).distinct()
    side = lambda k: signatures.select(F.col("doc_id").alias(k), F.col("signature").alias(f"s{k}"))
    likely = star.join(side("x"), "x").join(side("y"), "y").mapInArrow(_estimate(percent / 100), "x long, y long")
    links = materialise(_verified(likely, texts, percent, words), "links")
    free_shuffles(spark)
    stars = components(links)
    crowd = member.where("n > 2").join(stars.select(F.col("u").alias("doc_id"), "v"), "doc_id", "left").select("band", "doc_id", "least", "n", F.coalesce("v", "doc_id").alias("c"))
    shares = crowd.groupBy("band", "c").agg(F.count("*").alias("own"))
    split = shares.groupBy("band").agg(F.max_by("c", F.struct("own", "c")).alias("top"), F.max("own").alias("inside"), F.sum("own").alias("all")).where("inside < all")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sized = crowd.join(split, "band").withColumns({"ours": blocks(F.col("inside")), "others": blocks(F.col("all") - F.col("inside")), "main": F.col("c") == F.col("top")})
    place = F.xxhash64("doc_id")
    placed = sized.withColumn("side", F.when(F.col("main"), F.pmod(place, F.col("ours"))).otherwise(F.col("ours") + F.pmod(place, F.col("others"))).cast("int"))
    met = F.explode(F.sequence(F.when(F.col("main"), F.col("ours")).otherwise(F.lit(0)), F.col("ours") + F.col("others") - 1))
    told = placed.join(heads, "doc_id").join(texts, "doc_id").withColumn("other", met)
    paired = told.select("band", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"), "side", "doc_id", "least", "c", "signature", "bands", "text")
    more = materialise(paired.groupBy("band", "p", "q").applyInArrow(_settle(percent, words), "u long, v long").distinct(), "links")
    free_shuffles(spark)
    joined = components(links.unionByName(more)) if more.limit(1).count() else stars
    for done in (heads, member, links, more, *([stars] if joined is not stars else [])):
        discard(done)
    of_class = classes.join(joined.select(F.col("u").alias("doc_id"), "v"), "doc_id", "left").select("d1", "d2", F.coalesce("v", "doc_id").alias("component_id"))
    single = signed.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min(F.struct("d1", "d2")).alias("d"))
    out = single.select("doc_id", "n_shingles", "d.d1", "d.d2").join(of_class, ["d1", "d2"], "left")
    cid = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", cid.alias("component_id"), (F.col("doc_id") == cid).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that are linked to one of a smaller id; of rows that share an id, the least by its
    other columns stays; rows without an id stay all."""
    gone = near_duplicates(docs, words, percent).where("NOT kept").select("doc_id")
    order = columns(docs)
    shared = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    left = docs.join(gone, "doc_id", "left_anti").select(order)
    first = left.join(shared, "doc_id", "left_semi").select("doc_id", F.struct(*order).alias("row")).groupBy("doc_id").agg(F.min("row").alias("row"))
    return left.join(shared, "doc_id", "left_anti").select(order).unionByName(first.select("row.*"))
