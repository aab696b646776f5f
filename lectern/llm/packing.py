"""Operator 4: token sequences by hierarchical residual packing.

Every document becomes token ids with an end id behind; longer ones than a sequence are cut. Leaves
of a tree pack their pieces best-fit, longest first, and emit their bins; as items for the next round
go only those that a later round can use: bins at most half full (best-fit leaves one a leaf) and, for
each node that meets them, as many hosts with the most room. That bounds what moves up, at any size,
and loses nothing, for more than FAN_IN half-empty bins never meet in a node.

Token ids come from the given tokenizer. With a lower-casing word tokenizer, as probes at loading tell, texts
of ASCII and Latin-1 letters take a shortcut with the same result: they are cut where the tokenizer would cut them and each distinct word is encoded once.

Cases: null or empty text is the end id alone; rows without an id or with the same id are packed like
any other, each row by itself; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import materialise, small

LENGTH, END, FAN_IN, LEAF = 2048, 0, 8, 50_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
FLAT = "node int, up boolean, sequence_id long, fill int, " + PIECE + ", offset long"
_FIELDS = [f.split()[0] for f in FLAT.split(", ")]
_TYPES = [pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

_EASY = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
#: Texts whose ids say whether a tokenizer cuts as the shortcut does.
_PROBES = ("Hello World, it's 12ab", "É ÀÉ ß", "plain words here", "x_y ''s DON'T 3.14\n\tq-r  (s)", "naïve'd über # a@b.co")
#: Distinct words whose ids a worker keeps.
WORDS = 400_000


class Encoder:
    """Token ids of a text, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.words: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.short = True
        self.short = bool(self.last.any()) and all(self.encode(t) == self.whole(t) for t in _PROBES)  # only for tokenizers of its kind
        self.words.clear()

    def learn(self, words: list[str]) -> None:
        """Encode words together and take their ids apart at the word ends."""
        ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = (np.flatnonzero(self.last[ids]) + 1) * 4
        if len(cuts) == len(words):
            held, at = ids.tobytes(), 0
            for w, cut in zip(words, cuts.tolist()):
                self.words[w] = held[at:cut]
                at = cut
        else:
            self.words.update((w, self.whole(w)) for w in words)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not self.short or not _EASY.fullmatch(text):
            return self.whole(text)
        cut, words = _CUT.findall(text.lower()), self.words
        try:
            return b"".join([words[w] for w in cut])
        except KeyError:
            if len(words) > WORDS:
                words.clear()
            self.learn(list(set(cut).difference(words)))
            return b"".join([words[w] for w in cut])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _pieces(path: str, length: int):
    end = np.asarray([END], "<u4").tobytes()

    def run(batches):
        e = encoder(path)
        for batch in small(batches):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = e.encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [_TYPES[4], _TYPES[5], *[pa.int64()] * 3])], [f.split()[0] for f in PIECE.split(", ")])

    return run


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Bins of item numbers: longest item first, each to the fullest bin that still takes it."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(length + 1)]  # bins by the room they have
    mask = 0  # bit r: a bin with room r is there
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fit = mask >> sizes[i]
        if fit:
            r = sizes[i] + (fit & -fit).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
            bins[b].append(i)
            r -= sizes[i]
        else:
            b, r = len(bins), length - sizes[i]
            bins.append([i])
        room[r].append(b)
        mask |= 1 << r
    return bins


def _flat(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(_TYPES), _TYPES)], _FIELDS)


def _going_up(fills: list[int], length: int) -> set[int]:
    """Numbers of the bins that a later round can use."""
    order = sorted(range(len(fills)), key=lambda i: fills[i])
    small = [i for i in order if 2 * fills[i] <= length]
    return set(small) | {i for i in order[len(small) : len(small) + FAN_IN] if fills[i] < length}


def _leaf(length: int):
    def run(batches):
        from pyspark import TaskContext

        node = TaskContext.get().partitionId()
        items = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))]
        bins = best_fit([x[3] for x in items], length)
        fills = [sum(items[i][3] for i in b) for b in bins]
        up, out = _going_up(fills, length), []
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                out.append((node, k in up, node << 33 | k, fills[k], *items[i], at))
                at += items[i][3]
            if len(out) > 20_000:
                yield _flat(out)
                out = []
        if out:
            yield _flat(out)

    return run


def _merge(length: int):
    def run(key, table):
        held: dict[int, list[tuple]] = {}
        for row in zip(*(table.column(f).to_pylist() for f in _FIELDS)):
            held.setdefault(row[2], []).append(row)
        names = sorted(held)
        fills = [held[b][0][3] for b in names]
        merged = best_fit(fills, length)
        total = [sum(fills[i] for i in m) for m in merged]
        up, out = _going_up(total, length), []
        for k, m in enumerate(merged):
            at = 0
            for i in m:
                out += [(key[0].as_py(), k in up, names[m[0]], total[k], *row[4:9], row[9] + at) for row in held[names[i]]]
                at += fills[i]
        return pa.Table.from_batches([_flat(out)])

    return run


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: all documents' ids, cut to ``length``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_pieces(tokenizer, length), PIECE)


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """The pieces with their sequence and their place in it."""
    cut = materialise(pieces(docs, tokenizer, length), "pieces")
    leaves = max(1, -(-cut.count() // LEAF))
    level = materialise(cut.repartition(leaves).mapInArrow(_leaf(length), FLAT), "packed")
    done = []
    while leaves > 1:
        done.append(level.where("NOT up"))
        leaves = -(-leaves // FAN_IN)
        level = materialise(level.where("up").withColumn("parent", F.expr(f"node div {FAN_IN}").cast("int")).groupBy("parent").applyInArrow(_merge(length), FLAT), "packed")
    done.append(level)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
