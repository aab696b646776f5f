"""Operator 5: toxicity from the nearest labelled examples, by exact TF-IDF cosine.

Examples: of each class at most ``EXAMPLES`` labelled rows, by hash of the id. All their words are the
vocabulary; document frequencies are counted over all documents. A term's weight is its TF-IDF times a
relevance that is never zero: ``FLOOR`` plus the lower confidence bound (``SPREAD`` standard errors) of the
log odds ratio between toxic and other examples, where that is positive. Plain TF-IDF finds texts of
like subject, not of like tone (README has the figures).

The examples' unit vectors form a block-max inverted index: postings by term and block of examples, and the
largest weight of each frequent term in each block. A query scores the rare terms, adds the frequent ones' block maxima as
bounds, and opens blocks by falling bound until none left can enter the nearest ``NEAREST``: exact. The neighbours vote with their cosine, each class
scaled to its share of all labels; a logistic curve turns votes into probabilities. It is fitted on votes
of examples whose weights were learned from the other half of the examples.

Cases: null or empty texts, and texts without a word of any example, get the score of texts
without evidence; unlabelled and null labels teach nothing; a document labelled twice is toxic if any
label says so; without labels of both classes every score is the share of toxic labels (0.5 without
labels); rows without an id are scored and not held out; repeated rows give repeated rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_rows, small

EXAMPLES, NEAREST, BLOCK, COMMON = 2500, 15, 64, 8
#: Weight that every term keeps, standard errors under the log odds ratio, and weight of the prior in a vote.
FLOOR, SPREAD, PRIOR = 0.01, 1.0, 0.5
THRESHOLD = 0.3
OUT = "doc_id long, score double, evidence array<long>"
#: ASCII but letters becomes a space; letters lose their case.
_TABLE = bytes(32 if c < 128 and not chr(c).isalpha() else ord(chr(c).lower()) if c < 128 else c for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """doc_id, y of the labels that may teach."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).where(~held_out())
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("y"))


def by_hash(df: DataFrame, rows: int, most: int) -> DataFrame:
    """At most ``most`` of ``rows`` rows, by hash of the id. Only little more than these reach the last sort."""
    cut = min(1.0, (1.1 * most + 50) / max(rows, 1))
    near = df.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(cut * (1 << 30)) + 1) if cut < 1 else df
    return near.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id").limit(most)


def spread_out(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each interval, one interval behind the other."""
    return np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())


class BlockMaxIndex:
    """Unit vectors by term, then example: postings, and for frequent terms a table by block with its largest weights.

    doc, term, weight: one posting each, no (doc, term) twice. Terms in more than one of ``common`` examples are the
    frequent ones. Examples are placed so that those with the same most frequent terms share blocks, which keeps the
    blocks' maxima tight.
    """

    def __init__(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, docs: int, terms: int, block: int = BLOCK, common: int = COMMON):
        self.n, self.block, self.blocks = docs, block, -(-docs // block)
        n = np.bincount(term, minlength=terms)
        self.row = np.where(n * common > docs, np.cumsum(n * common > docs) - 1, -1)
        lead = np.argsort(-n, kind="stable")[:16]
        has = np.zeros((len(lead), docs), bool)
        for r, t in enumerate(lead):
            has[r, doc[term == t]] = True
        self.number = np.lexsort(has[::-1])  # the example at each place
        place = np.empty(docs, np.int64)
        place[self.number] = np.arange(docs)
        order = np.lexsort((place[doc], term))
        self.place, self.weight, term = place[doc[order]].astype(np.int32), weight[order], term[order]
        self.cells = np.searchsorted(term, np.arange(terms + 1))  # a term's postings
        self.table = None

    def __getstate__(self):
        return {**self.__dict__, "table": None, "top": None}

    def _open(self) -> None:
        """The frequent terms' weights by block, and the largest of each block."""
        held = np.flatnonzero(self.row >= 0)
        table = np.zeros((len(held), self.blocks * self.block))
        for r, t in enumerate(held):
            at = slice(self.cells[t], self.cells[t + 1])
            table[r, self.place[at]] = self.weight[at]
        self.table = np.ascontiguousarray(table.reshape(len(held), self.blocks, self.block).transpose(1, 0, 2))
        self.top = self.table.max(2).T.copy()

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and numbers of the k examples of largest positive cosine, ties to the smaller number."""
        if self.table is None:
            self._open()
        row = self.row[terms]
        often = row >= 0
        rows, held, rest = row[often], weights[often], terms[~often]
        size = self.cells[rest + 1] - self.cells[rest]
        at = spread_out(self.cells[rest], size) if len(rest) else np.zeros(0, np.int64)
        score = np.bincount(self.place[at], np.repeat(weights[~often], size) * self.weight[at], self.blocks * self.block).reshape(self.blocks, self.block)
        bound = score.max(1) + held @ self.top[rows]
        order = np.argsort(-bound, kind="stable")
        best, number = np.zeros(0), np.zeros(0, np.int64)
        for opened in range(0, self.blocks, 8):
            some = order[opened : opened + 8]
            some = some[bound[some] >= (best[-1] if len(best) == k else 0) - 1e-12]
            if not len(some):
                break
            exact = np.concatenate([score[b] + held @ self.table[b][rows] for b in some])
            near = np.flatnonzero(exact > max(best[-1] - 1e-12 if len(best) == k else 0, 1e-12))
            own = self.number[(some[:, None] * self.block + np.arange(self.block)).reshape(-1)[near]]
            near, own = near[own != without], own[own != without]
            best, number = np.concatenate((best, exact[near])), np.concatenate((number, own))
            keep = np.lexsort((number, -best.round(12)))[:k]
            best, number = best[keep], number[keep]
        return best, number


class Model:
    """Vocabulary, weights, index, votes and the curve from votes to probabilities.

    terms: sorted; frequency: documents that hold each, of ``total``; ids, y: the examples; doc, term, count: their postings.
    """

    def __init__(self, terms: list[bytes], frequency: np.ndarray, total: int, ids: np.ndarray, y: np.ndarray, doc: np.ndarray, term: np.ndarray, count: np.ndarray, shares: tuple[float, float]):
        self.spelt, self.number = b"\n".join(terms), None
        self.idf = np.log((1 + total) / (1 + frequency)) + 1
        self.share = shares[1] / max(sum(shares), 1e-9) if sum(shares) else 0.5
        self.ids, self.y = ids, y
        n = np.bincount(y, minlength=2)
        self.scale = np.array([shares[c] / n[c] if n[c] else 0.0 for c in (0, 1)])
        self.scale = self.scale / max(self.scale.max(), 1e-9)
        self.curve, self.usable = (1.0, 0.0), bool(n.all())
        if not self.usable:
            return
        part = np.fromiter((zlib.crc32(str(i).encode()) // 4 % 2 for i in ids.tolist()), np.int64, len(ids))  # halves, for votes that the curve learns from
        own = np.split(np.arange(len(doc)), np.searchsorted(doc, np.arange(1, len(ids))))
        votes = np.zeros(len(ids))
        for h in (0, 1):
            self._learn(doc, term, count, part != h)
            for i in np.flatnonzero(part == h):
                votes[i] = self.vote(term[own[i]], count[own[i]], int(i))[0]
        self._learn(doc, term, count, np.ones(len(ids), bool))
        self.curve = platt(logit(votes), y, self.scale[y])

    def _learn(self, doc: np.ndarray, term: np.ndarray, count: np.ndarray, taught: np.ndarray) -> None:
        """The terms' weights from the taught examples, and the index of all examples under them."""
        use = taught[doc]
        p, q = (np.bincount(term[use & (self.y[doc] == c)], minlength=len(self.idf)) for c in (1, 0))
        a, b = (int((taught & (self.y == c)).sum()) for c in (1, 0))
        odds = np.log((p + 0.5) / (a - p + 0.5)) - np.log((q + 0.5) / (b - q + 0.5))
        error = np.sqrt(1 / (p + 0.5) + 1 / (a - p + 0.5) + 1 / (q + 0.5) + 1 / (b - q + 0.5))
        self.weights = self.idf * (FLOOR + np.maximum(odds - SPREAD * error, 0))
        w = (1 + np.log(count)) * self.weights[term]
        norm = np.sqrt(np.bincount(doc, w * w, len(self.ids)))
        self.index = BlockMaxIndex(doc, term, w / norm[doc], len(self.ids), len(self.idf))

    def vote(self, terms: np.ndarray, counts: np.ndarray, without: int = -1) -> tuple[float, list[int]]:
        if not len(terms):
            return self.share, []
        w = (1 + np.log(counts)) * self.weights[terms]
        cosine, near = self.index.nearest(terms, w / np.sqrt((w * w).sum()), NEAREST, without)
        weight = cosine * self.scale[self.y[near]]
        prior = PRIOR * float(self.scale.mean())
        return float((weight @ self.y[near] + prior * self.share) / (weight.sum() + prior)), self.ids[near[:3]].tolist()

    def score(self, text: bytes) -> tuple[float, list[int]]:
        if not self.usable:
            return self.share, []
        if self.number is None:
            self.number = {t: i for i, t in enumerate(self.spelt.split(b"\n"))}
        found = Counter(words(text))
        own = [(self.number[t], found[t]) for t in self.number.keys() & found.keys()] if len(found) > len(self.number) else [(i, c) for t, c in found.items() if (i := self.number.get(t)) is not None]
        terms, counts = (np.array(x, np.int64) for x in (zip(*sorted(own)) if own else ((), ())))
        vote, evidence = self.vote(terms, counts)
        a, b = self.curve
        return float(1 / (1 + np.exp(-(a * logit(np.array(vote)) + b)))), evidence


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a weighted logistic curve, slightly regularised, by Newton steps."""
    w, ridge = np.array([1.0, 0.0]), np.diag([1e-2, 1e-4]) * max(weight.sum(), 1)
    z = np.stack([x, np.ones_like(x)], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - y)) + ridge @ (w - [1.0, 0.0])
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _texts(batches, with_label: bool = False):
    for batch in small(batches):
        ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
        yield from zip(ids, texts, batch.column(2).to_pylist() if with_label else ids)


def _frequencies(terms: list[bytes]):
    """Of a partition: how many texts hold each term; under the empty term, how many texts there are."""
    spelt = b"\n".join(terms)

    def run(batches):
        names = spelt.split(b"\n")
        number, n, rows = {t: i for i, t in enumerate(names)}, np.zeros(len(names), np.int64), 0
        for _, text, _ in _texts(batches):
            n[[i for t in set(words(text)) if (i := number.get(t)) is not None]] += 1
            rows += 1
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([b""] + [names[i] for i in held], pa.binary()), pa.array(np.concatenate(([rows], n[held]))), pa.array(np.arange(len(held) + 1) == 0)], ["term", "n", "whole"])

    return run


def _example_terms(batches):
    for batch in batches:
        for doc_id, text, y in _texts([batch], with_label=True):
            own = Counter(words(text))
            yield pa.RecordBatch.from_arrays([pa.array([doc_id]), pa.array([y], pa.int64()), pa.array([list(own)], pa.list_(pa.binary())), pa.array([list(own.values())], pa.list_(pa.int64()))], ["doc_id", "y", "t", "c"])


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> Model:
    """A model from documents and labels; what reaches the driver is bounded by the words of EXAMPLES texts a class and their counts."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    teach = labelled(labels, column).join(texts.where("doc_id IS NOT NULL").select("doc_id").distinct(), "doc_id")
    shares = {r["y"]: r["count"] for r in teach.groupBy("y").count().collect()}
    share = (shares.get(0, 0), shares.get(1, 0))
    none = np.zeros(0, np.int64)
    if not all(share):
        return Model([], none, 0, none, none, none, none, none, share)
    chosen = None
    for y in (0, 1):
        own = by_hash(teach.where(F.col("y") == y), shares[y], EXAMPLES)
        chosen = own if chosen is None else chosen.unionByName(own)
    ids = chosen.select("doc_id", F.col("y").cast("long").alias("y")).collect()
    picked = docs.sparkSession.createDataFrame(ids, "doc_id long, y long")
    sample = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y")
    alike = sample.groupBy(F.sha2("text", 256).alias("d"), "y").agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("doc_id"))
    found = alike.select("doc_id", "text", "y").mapInArrow(_example_terms, "doc_id long, y long, t array<binary>, c array<long>").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")]).combine_chunks()
    ids, ys = found.column("doc_id").to_numpy(), found.column("y").to_numpy()
    doc = np.repeat(np.arange(len(ids)), pc.list_value_length(found.column("t")).to_numpy())
    coded = pc.dictionary_encode(found.column("t").combine_chunks().flatten())
    count = found.column("c").combine_chunks().flatten().to_numpy()
    spelt, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    order = sorted(range(len(spelt)), key=spelt.__getitem__)
    terms = [spelt[i] for i in order]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    counts = texts.mapInArrow(_frequencies(terms), "term binary, n long, whole boolean").groupBy("term", "whole").agg(F.sum("n").alias("n")).toArrow()
    held = dict(zip(counts.column("term").to_pylist(), counts.column("n").to_pylist()))
    frequency = np.array([held.get(t, 0) for t in terms], np.int64)
    return Model(terms, frequency, held.get(b"", 0), ids, ys, doc, rank[code], count, share)


def _score(model: Model):
    def run(batches):
        for batch in small(batches):
            out = [(i, *model.score(t)) for i, t, _ in _texts([batch])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.float64(), pa.list_(pa.int64())))], ["doc_id", "score", "evidence"])

    return run


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (nearest examples) of every document."""
    model = fit(docs, labels)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = texts.mapInArrow(_score(model), OUT)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score under the threshold, with all their columns."""
    model, at = fit(docs, labels), docs.columns.index("text")

    def run(batches):
        for batch in small(batches):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([model.score(t or b"")[0] < THRESHOLD for t in texts], pa.bool_()))

    return map_rows(docs, run)
