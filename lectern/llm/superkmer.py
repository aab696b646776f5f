"""Operator 8: exact repeats of 20 words by super-k-mer partitioning.

Consecutive windows that share a minimiser (the smallest hash of 5 consecutive words) travel as one
packed string, words joined by a space, to the bucket of that minimiser; there they are unpacked,
sorted and counted exactly. See repeats.py for the frame, which also handles hot buckets.

Cases: null text has no words; rows without an id are returned whole and never count as earlier;
rows that share an id are one document's versions, every span found in any of them goes from each;
fewer than 20 words keep everything; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.repeats import C, Kind, _rows, merged, mix, repeated_spans, runs

WINDOW, GRAM = 20, 5
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
R = np.uint64(0x5851F42D4C957F2D)
R_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * C[5])
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("r", ())) < n:
        size = max(n, 1 << 17)
        for name, base in (("r", R), ("i", R_INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["r"][:n], _powers["i"]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A hash of each word, from prefix sums over the packed words."""
    if not words:
        return np.zeros(0, np.uint64)
    packed = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    r, inverse = _power(len(packed) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE[packed] * r[: len(packed)], dtype=np.uint64)))
    return mix((total[ends] - total[starts]) * inverse[starts])


class Words(Kind):
    window, k = WINDOW, GRAM

    def anchors(self, block):
        split = [x[1].split() for x in block]
        step = 1 << 16
        if len(split) == 1 and len(split[0]) > step:  # a very long text, in overlapping pieces
            words, out = split[0], []
            for at in range(0, len(words) - self.window + 1, step):
                piece = words[at : at + step + self.window - 1]
                row, start, n, a, m = self._anchors([piece])
                out.append((row, start + at, n, a, m))
            return tuple(np.concatenate(c) for c in zip(*out))
        return self._anchors(split)

    def _anchors(self, split):
        lengths = [len(x) for x in split]
        w = word_hashes([x for words in split for x in words])
        n = len(w) - self.k + 1
        if n < 1:
            return runs(np.zeros(0, np.uint64), lengths, self.window, self.k)
        h = w[:n] * C[0]
        for i in range(1, self.k):
            h = (h ^ (h >> np.uint64(31))) * C[i % 6] + w[i : i + n]
        return runs(mix(h), lengths, self.window, self.k)

    def slicer(self, text):
        words = text.split()
        return lambda s, e: b" ".join(words[s:e])

    def cut(self, packed, number):
        return b" ".join(packed.split(b" ", number + self.window)[number : number + self.window])

    def bucket(self, info, packed, group):
        """Unpack the windows and sort them: equal ones stand together, the first place of each first."""
        windows = []
        for i, ((_, n, _), string, g) in enumerate(zip(info, packed, group.tolist())):
            words = string.split(b" ")
            windows += [(g, b" ".join(words[j : j + self.window]), i, j) for j in range(n)]
        windows.sort()
        first, out = None, []
        for x in windows:
            if first is None or x[1] != first[1] or x[0] != first[0]:
                first = x
            out.append((x[2], x[3], first[2]))
        return tuple(np.array(c, np.int64) for c in zip(*out))


def _removal(batches):
    for batch in batches:
        out = []
        for doc_id, text, spans in _rows(batch):
            words, gone = text.split(), merged(spans)
            kept, at = [], 0
            for s, e in gone:
                kept += words[at:s]
                at = e
            kept += words[at:]
            out.append((doc_id, len(words), sum(e - s for s, e in gone), sha256(b" ".join(kept)).hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 3 + [pa.string()])], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def remove_repeated_words(docs: DataFrame) -> DataFrame:
    """One row per document: words removed and the digest of those that stay."""
    texts, spans = repeated_spans(docs, Words())
    return texts.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_removal, OUT)
