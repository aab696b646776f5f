"""Operator 13: periodic runs of words by heavy/light lag counting.

A run of period q is a stretch of words in which words q apart are equal, q being its smallest period, that
no neighbouring word extends, of at least ``max(SHORTEST, TIMES * q)`` words. Each text is searched for itself:

1. for every lag p up to a quarter of the text, the pairs of equal words p apart are counted exactly. A word
   is *heavy* if it occurs more than max(64, root of the number of words) times: the power spectra of all heavy
   words' places are added, and one inverse transform gives their autocorrelation, rounded to whole counts.
   For *light* words the differences of their places are counted;
2. a run of period p holds at least 3p such pairs, so only lags with enough of them are scanned for islands of
   consecutive matches, shorter lags first. Matches at a multiple of the period of a run that is known belong to
   that run, never to a longer period's (two runs that shared them would have a common period), so they are
   taken off first: one word repeated n times costs one scan, not n. Before a scan of a long lag sixteen places of
   every stretch of p words are looked at: an island of 3p matches holds two whole stretches;
3. an island whose words have a smaller period has the extent of that period's run and isn't a run of its own.

Texts are mapped in blocks; nothing is shuffled, and a task holds one block or one longer text with arrays in
proportion to its words.

Cases: null and empty texts have no words and no runs; words are compared byte for byte; repeated rows give
repeated rows; rows without an id are searched (and never edited); ties of the longest run go to the smallest
start, then period; very long texts are searched whole; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import byte_blocks, text_or_empty

#: A run has at least so many words, and at least so many times its period.
SHORTEST, TIMES = 6, 4
#: A word that occurs more often, and more often than the root of the text's words, is heavy.
HEAVY = 64
#: Lags from here on are probed at so many places of each stretch before they are scanned.
PROBED, PROBES = 32, 16
REPORT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def autocorrelation(places: list[np.ndarray], n: int, most: int) -> np.ndarray:
    """For lags 0 to ``most``: pairs of places of one word that far apart, over all words; exact."""
    size = 1 << (n + most - 1).bit_length()
    power = np.zeros(size // 2 + 1)
    for at in places:
        x = np.zeros(size)
        x[at] = 1.0
        f = np.fft.rfft(x)
        power += f.real * f.real + f.imag * f.imag
    return np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)


def lag_counts(word: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, base) of a block of texts: counts[base[d] + p] pairs of equal words of text d are p apart.

    word: numbers of the words of all texts, one after the other; lengths: words of each. Lags go up to a quarter.
    """
    most = lengths // TIMES
    base = np.concatenate(([0], np.cumsum(most + 1)))
    counts = np.zeros(base[-1], np.int64)
    if not len(word):
        return counts, base
    first = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(lengths)), lengths)
    key = doc * (int(word.max()) + 1) + word
    order = np.argsort(key, kind="stable")
    k, d, at = key[order], doc[order], order - first[doc[order]]
    cut = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]))
    times = np.diff(cut)
    limit = np.maximum(HEAVY, np.sqrt(lengths).astype(np.int64))[d[cut[:-1]]]
    heavy = np.flatnonzero(times > limit)
    i = np.flatnonzero(np.repeat(times <= limit, times))
    end, step = np.repeat(cut[1:], times), 1
    while len(i):  # each light place and its step-th follower
        i = i[i + step < end[i]]
        gap = at[i + step] - at[i]
        near = gap <= most[d[i]]
        i = i[near]
        np.add.at(counts, base[d[i]] + gap[near], 1)
        step += 1
    own = d[cut[heavy]]
    for t in np.unique(own):
        places = [at[cut[g] : cut[g + 1]] for g in heavy[own == t]]
        counts[base[t] : base[t + 1]] += autocorrelation(places, int(lengths[t]), int(most[t]))
    return counts, base


def _possible(w: np.ndarray, p: int) -> bool:
    """Whether two neighbouring stretches of p words can match the words p further on, by some of their places."""
    rows = (len(w) - p) // p
    at = np.arange(rows)[:, None] * p + np.arange(PROBES) * p // PROBES
    same = (w[at] == w[at + p]).all(1)
    return bool((same[1:] & same[:-1]).any())


def runs_of(w: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one text, by start, then period; counts: pairs by lag."""
    lags = np.arange(len(counts))
    need = np.maximum((TIMES - 1) * lags, SHORTEST - lags)
    found: dict[tuple[int, int], int] = {}
    left = counts.copy()
    for p in np.flatnonzero(left >= need).tolist():
        if not p or left[p] < need[p] or p >= PROBED and not _possible(w, p):
            continue
        same = np.zeros(len(w) - p + 2, np.int8)
        same[1:-1] = w[p:] == w[:-p]
        step = np.diff(same)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        long = ends - starts >= need[p]
        for s, e in zip(starts[long].tolist(), ends[long].tolist()):
            length = e - s + p
            if (s, length) in found:  # its period is smaller
                continue
            found[s, length] = p
            multiple = np.arange(2 * p, min(length, len(left)), p)
            left[multiple] -= length - multiple
    return sorted((s, n, p) for (s, n), p in found.items())


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when of each run only its first period does."""
    edge = np.zeros(n + 1, np.int64)
    for s, length, p in runs:
        edge[s + p] += 1
        edge[s + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's edit: in a tenth of the texts, told by the id, the words from some place on repeat with a period."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


Edit = Callable[[int | None, list[bytes]], list[bytes]]


def searched(batches: Iterator[pa.RecordBatch], edit: Edit | None = None) -> Iterator[tuple[int | None, list[bytes], list[tuple[int, int, int]]]]:
    """(doc_id, words, runs) of each text of batches of doc_id and text."""
    for batch in batches:
        rows = zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()))
        for block in byte_blocks((i, t.as_py()) for i, t in rows):
            texts = [edit(i, t.split()) if edit else t.split() for i, t in block]
            numbers: dict[bytes, int] = {}
            word = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int64)
            lengths = np.array([len(t) for t in texts], np.int64)
            counts, base = lag_counts(word, lengths)
            end = np.cumsum(lengths)
            for d, (i, _) in enumerate(block):
                yield i, texts[d], runs_of(word[end[d] - lengths[d] : end[d]], counts[base[d] : base[d + 1]])


def _arrow(rows: Iterator[tuple], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, period: one row a run."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "period")])

    def run(batches):
        return _arrow(((i, *r) for i, _, runs in searched(batches) for r in runs), schema)

    return _texts(docs).mapInArrow(run, "doc_id long, start long, length long, period long")


def collapsed(docs: DataFrame) -> DataFrame:
    """doc_id, text of the words that stay when each run keeps its first period only, joined by single spaces."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        return _arrow(((i, _joined(words, runs).decode()) for i, words, runs in searched(batches)), schema, 32)

    return _texts(docs).mapInArrow(run, "doc_id long, text string")


def _joined(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    return b" ".join(w for w, k in zip(words, kept(len(words), runs).tolist()) if k)


def report(docs: DataFrame, edit: Edit | None = None) -> DataFrame:
    """One row per text: its runs, the longest of them, and digests of all runs and of the collapsed words."""
    schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in REPORT.split(", ")])

    def row(i, words, runs):
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        longest = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        listed = "".join("%d,%d,%d\n" % r for r in runs)
        return i, len(runs), *longest, sha256(listed.encode()).hexdigest(), sha256(_joined(words, runs)).hexdigest()

    def run(batches):
        return _arrow((row(*x) for x in searched(batches, edit)), schema)

    return _texts(docs).mapInArrow(run, REPORT)
