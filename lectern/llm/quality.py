"""Operator 10: quality by a regularised quadratic discriminant over document statistics.

Each text becomes a fixed list of transformed statistics (lengths, character classes, repetition,
word shapes). Over all labelled rows that may teach, one aggregate gives each class's counts, sums and
products. The class covariances shrink towards the pooled one and towards a multiple of the identity;
their Cholesky factors are kept, so a score is the difference of two Mahalanobis log-densities. A
logistic curve, fitted on at most ``CURVE`` labelled rows, makes it a probability.

Cases: null counts as the empty text, whose statistics are all defined; unlabelled and null labels
teach nothing; a document labelled twice is good if any label says so; with fewer than two rows of a
class every score is the share of good labels (0.5 without labels); rows without an id are scored and
not held out; repeated rows give repeated rows; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import materialise
from lectern.llm.toxicity import by_hash, held_out, labelled, platt

#: Shares of the pooled covariance and of the identity, rows for the curve, and the threshold.
POOLED, IDENTITY, CURVE, THRESHOLD = 0.1, 0.02, 20_000, 0.7
FEATURES = (
    "bytes", "words", "word_length", "word_spread", "long_words", "letters", "upper", "digits", "spaces", "points", "symbols", "other_bytes",
    "distinct_words", "top_word", "line_length", "repeated_lines", "symbol_words", "bare_symbols", "runs", "ended_lines",
)
_CLASS = np.full(256, 6, np.uint8)  # letters 0, upper case 1, digits 2, spaces 3, points 4, symbols 5, beyond ASCII 6
for _c in range(128):
    _CLASS[_c] = 1 if 65 <= _c <= 90 else 0 if 97 <= _c <= 122 else 2 if 48 <= _c <= 57 else 3 if _c in b" \t\n\r\x0b\x0c" else 4 if _c in b".,;:!?'\"()-" else 5


def statistics(text: bytes) -> np.ndarray:
    """The transformed statistics of one text."""
    n = len(text)
    data = np.frombuffer(text, np.uint8)
    kind = _CLASS[data]
    share = np.bincount(kind, minlength=7) / max(n, 1)
    words = text.split()
    k = len(words)
    size = np.fromiter(map(len, words), np.float64, k)
    counted = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    odd = kind == 5
    bare = sum(c for w, c in counted.items() if not w.isalnum() and len(w) <= 4 and w.isascii() and not any(48 <= x <= 57 or 65 <= x <= 90 or 97 <= x <= 122 for x in w)) if k else 0
    touched = 0
    if odd.any():
        at = np.flatnonzero(odd)
        word_of = np.cumsum(np.concatenate(([False], (kind[1:] != 3) & (kind[:-1] == 3))))
        touched = len(np.unique(word_of[at]))
    runs = float((data[1:] == data[:-1]).sum()) if n > 1 else 0.0
    root = np.sqrt
    return np.array([
        np.log1p(n), np.log1p(k), np.log1p(size.mean()) if k else 0.0, np.log1p(size.std()) if k else 0.0, root((size > 20).mean()) if k else 0.0,
        share[0], root(share[1]), root(share[2]), share[3], root(share[4]), root(share[5]), root(share[6]),
        len(counted) / k if k else 0.0, root(max(counted.values()) / k) if k else 0.0, np.log1p(n / max(len(lines), 1)), root(1 - len(set(lines)) / max(len(lines), 1)) if lines else 0.0,
        root(min(touched / k, 1.0)) if k else 0.0, root(bare / k) if k else 0.0, root(runs / max(n, 1)), root(sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / max(len(lines), 1)),
    ])


def _measure(batches):
    for batch in batches:
        ids = batch.column(0)
        x = [statistics(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        flat = np.concatenate(x) if x else np.zeros(0)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([ids, lists], ["doc_id", "x"])


def _moments(batches):
    """Of a partition: for each class its count, sums and products, one value a row."""
    d = len(FEATURES)
    total = np.zeros((2, d + 1, d + 1))
    for batch in batches:
        if batch.num_rows:
            x = np.concatenate([np.ones((batch.num_rows, 1)), np.asarray(batch.column(0).flatten()).reshape(-1, d)], 1)
            y = batch.column(1).to_numpy()
            for c in (0, 1):
                total[c] += x[y == c].T @ x[y == c]
    at = np.flatnonzero(total.reshape(-1))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1)[at])], ["place", "value"])


class Discriminant:
    """Two Gaussian classes with regularised covariances, and the curve over their log-density difference."""

    def __init__(self, moments: np.ndarray, pooled: float = POOLED, identity: float = IDENTITY):
        n, sums, products = moments[:, 0, 0], moments[:, 0, 1:], moments[:, 1:, 1:]
        self.share = float(n[1] / n.sum()) if n.sum() else 0.5
        self.usable = bool((n >= 2).all())
        self.curve = (1.0, 0.0)
        if not self.usable:
            return
        self.centre = sums.sum(0) / n.sum()
        self.spread = np.sqrt(np.maximum(np.diagonal(products.sum(0)) / n.sum() - self.centre**2, 1e-12))
        self.spread[self.spread < 1e-5] = 1.0
        scale = np.outer(self.spread, self.spread)
        means = sums / n[:, None]
        covariance = [(products[c] / n[c] - np.outer(means[c], means[c])) / scale for c in (0, 1)]
        both = (n[0] * covariance[0] + n[1] * covariance[1]) / n.sum()
        self.means = (means - self.centre) / self.spread
        self.factors, self.constants = [], []
        for c in (0, 1):
            s = (1 - pooled) * covariance[c] + pooled * both
            s = (1 - identity) * s + identity * max(np.trace(s) / len(s), 1e-3) * np.eye(len(s))
            factor = np.linalg.cholesky(s)
            self.factors.append(np.linalg.inv(factor))
            self.constants.append(-np.log(np.diagonal(factor)).sum() + np.log(n[c] / n.sum()))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0, with the classes' shares, for rows of statistics."""
        z = (x - self.centre) / self.spread
        log = [k - 0.5 * (((z - m) @ f.T) ** 2).sum(1) for m, f, k in zip(self.means, self.factors, self.constants)]
        return squeeze(log[1] - log[0])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.usable:
            return np.full(len(x), self.share)
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * self.difference(x) + b, -60, 60)))


def squeeze(d: np.ndarray) -> np.ndarray:
    """Keeps signs and order, and tames what far tails would make of a Gaussian."""
    return np.sign(d) * np.log1p(np.abs(d))


def fit(measured: DataFrame, labels: DataFrame) -> Discriminant:
    """From doc_id, x of all documents and the labels."""
    d = len(FEATURES)
    teach = measured.where("doc_id IS NOT NULL").join(labelled(labels, "quality"), "doc_id").select("x", "y", "doc_id")
    total = np.zeros(2 * (d + 1) ** 2)
    for r in teach.select("x", "y").mapInArrow(_moments, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
        total[r["place"]] = r["value"]
    model = Discriminant(total.reshape(2, d + 1, d + 1))
    if model.usable:
        rows = by_hash(teach, int(total.reshape(2, d + 1, d + 1)[:, 0, 0].sum()), CURVE).select("x", "y").collect()
        x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float)
        model.curve = platt(model.difference(x), y, np.ones(len(y)))
    return model


def _score(model: Discriminant):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(np.array(batch.column(1).to_pylist())))], ["doc_id", "score"])

    return run


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    measured = materialise(texts.mapInArrow(_measure, "doc_id long, x array<double>"), "statistics")
    out = measured.mapInArrow(_score(fit(measured, labels)), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
