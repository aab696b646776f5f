"""Operator 7: exact repeats of 100 bytes by a sparse suffix array, ordered by deep-shallow sorting.

The suffixes that are sorted start at the anchors of repeats.py (a synchronising set: equal 100-byte
strings hold an anchor at the same place). Within a bucket of equal anchors a multikey quicksort on
8-byte characters orders them to ``SHALLOW`` bytes; blind tries order the remaining groups with long
common prefixes. The reversed prefixes to the left of the anchors are ordered in the same way. Prefix lengths
between neighbours of the two orders give, for each offset of the anchor, the classes of equal windows: n log n
steps for a bucket of n strings, with no comparison of pairs.

Cases: null text counts as empty; rows without an id are returned whole and never count as earlier;
rows that share an id are one document's versions, every span found in any of them goes from each;
texts under 100 bytes keep everything; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.repeats import C, Kind, _rows, merged, mix, repeated_spans, runs

WINDOW, GRAM, SHALLOW = 100, 40, 64
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class BlindTrie:
    """Patricia tree that stores branching depths only; strings are compared once per insertion."""

    def __init__(self):
        self.root = None

    def insert(self, key: bytes, tag: int) -> None:
        leaf = [None, [tag], key]
        if self.root is None:
            self.root = leaf
            return
        node = self.root
        while node[0] is not None:  # blind descent to any leaf below the matching branches
            depth, kids = node[0], node[1]
            c = key[depth] if depth < len(key) else -1
            node = kids[c] if c in kids else next(iter(kids.values()))
        depth = common_prefix(key, node[2])
        if depth == len(key) == len(node[2]):
            node[1].append(tag)
            return
        c, parent, node = (key[depth] if depth < len(key) else -1), None, self.root
        while node[0] is not None and node[0] < depth:
            parent, node = (node, key[node[0]] if node[0] < len(key) else -1), node[1][key[node[0]] if node[0] < len(key) else -1]
        if node[0] == depth:
            node[1][c] = leaf
            return
        below = node
        while below[0] is not None:
            below = next(iter(below[1].values()))
        fresh = [depth, {(below[2][depth] if depth < len(below[2]) else -1): node, c: leaf}, None]
        if parent is None:
            self.root = fresh
        else:
            parent[0][1][parent[1]] = fresh

    def ordered(self) -> list[tuple[int, int]]:
        """(tag, prefix shared with the one before) in order; the first has 0."""
        out: list[tuple[int, int]] = []
        stack = [(self.root, 0)] if self.root else []
        while stack:
            node, shared = stack.pop()
            if node[0] is None:
                out += [(tag, shared if i == 0 else len(node[2])) for i, tag in enumerate(node[1])]
            else:
                kids = [node[1][c] for c in sorted(node[1])]
                stack += [(kid, node[0]) for kid in kids[:0:-1]] + [(kids[0], shared)]
        return out


def deep_shallow(keys: list[bytes], group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order ``keys`` within their groups (numbers that ascend): positions in order, prefix shared with the one before in the group."""
    n = len(keys)
    width = shallow // 8
    lens = np.fromiter(map(len, keys), np.int64, n)
    words = np.frombuffer(b"".join(k[:shallow].ljust(shallow, b"\0") for k in keys), ">u8").reshape(n, width).astype(np.uint64) if n else np.zeros((0, width), np.uint64)
    order, lcp = np.arange(n), np.zeros(n, np.int64)
    part = group.copy()  # class of each place of the order: equal in all characters so far
    live = np.arange(n)
    for d in range(width):  # multikey quicksort, one 8-byte character a round, only where classes still hold several
        if not len(live):
            break
        key = words[order[live], d]
        inner = np.lexsort((key, part[live]))
        order[live], key, cls = order[live][inner], key[inner], part[live][inner]
        same = cls[1:] == cls[:-1]
        differ = key[1:] ^ key[:-1]
        split = same & (differ != 0)
        if split.any():
            x = differ[split].astype(">u8").view(np.uint8).reshape(-1, 8) != 0
            lcp[live[1:][split]] = 8 * d + x.argmax(1)
        fresh = np.concatenate(([True], ~same | (differ != 0)))
        part[live] = live[np.maximum.accumulate(np.where(fresh, np.arange(len(live)), 0))]
        alone = fresh & np.concatenate((fresh[1:], [True]))
        live = live[~alone]
    start = 0
    while start < len(live):  # blind tries for groups that share the shallow prefix
        end = start + 1
        while end < len(live) and part[live[end]] == part[live[start]]:
            end += 1
        at = live[start:end]
        trie = BlindTrie()
        for i in order[at]:
            trie.insert(keys[i], int(i))
        held = lcp[at[0]]
        for place, (tag, shared) in zip(at, trie.ordered()):
            order[place], lcp[place] = tag, shared
        lcp[at[0]] = held
        start = end
    if n:
        lcp[1:] = np.where(group[1:] == group[:-1], np.minimum(lcp[1:], np.minimum(lens[order[1:]], lens[order[:-1]])), 0)
        lcp[0] = 0
    return order, lcp


def suffix_array(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of a small text and the prefixes shared between neighbours."""
    keys = [text[i:] for i in range(len(text))]
    return deep_shallow(keys, np.zeros(len(keys), np.int64))


class Bytes(Kind):
    window, k = WINDOW, GRAM

    def anchors(self, block):
        out = []
        step = (1 << 20) - self.window
        if len(block) == 1 and len(block[0][1]) > step:  # a very long text, in overlapping pieces
            text = block[0][1]
            for at in range(0, len(text) - self.window + 1, step):
                piece = text[at : at + step + self.window - 1]
                row, start, n, a, m = self._anchors(piece, [len(piece)])
                out.append((row, start + at, n, a, m))
            return tuple(np.concatenate(c) for c in zip(*out))
        return self._anchors(b"".join(x[1] for x in block), [len(x[1]) for x in block])

    def _anchors(self, text, lengths):
        n = len(text) - self.k + 1
        if n < 1:
            return runs(np.zeros(0, np.uint64), lengths, self.window, self.k)
        word = np.ndarray(shape=(len(text) - 7,), dtype="<u8", buffer=text, strides=(1,)).copy()
        h = word[:n] * C[0]
        for i, at in enumerate([*range(8, self.k - 8, 8), self.k - 8]):  # 8 bytes a read
            h += word[at : at + n] * C[(i + 1) % len(C)]
            h ^= h >> np.uint64(31)
        return runs(mix(h), lengths, self.window, self.k)

    def slicer(self, text):
        return lambda s, e: text[s:e]

    def cut(self, packed, number):
        return packed[number : number + self.window]

    def bucket(self, info, packed, group):
        """Sort the suffixes right of the anchors and the reversed prefixes left of them: windows with the anchor at
        offset t are equal where the ones share window - t bytes and the others t bytes."""
        n, a = (np.array([x[i] for x in info], np.int64) for i in (1, 2))
        sides = []
        for keys in ([p[i[2] :] for p, i in zip(packed, info)], [p[: i[2]][::-1] for p, i in zip(packed, info)]):
            order, shared = deep_shallow(keys, group)
            fresh = np.concatenate(([True], group[order][1:] != group[order][:-1]))
            sides.append((order, shared, fresh))
        out = []
        for t in range(int((a - n + 1).min()), int(a.max()) + 1):
            rows = np.flatnonzero((a - n < t) & (t <= a))
            if not len(rows):
                continue
            key = np.zeros(len(a), np.int64)
            for (order, shared, fresh), depth in zip(sides, (self.window - t, t)):
                label = np.empty(len(a), np.int64)
                label[order] = np.cumsum(fresh | (shared < depth))
                key = key * (len(a) + 1) + label
            order = np.argsort(key[rows], kind="stable")
            rows, key = rows[order], key[rows[order]]
            head = np.concatenate(([True], key[1:] != key[:-1]))
            out.append((rows, a[rows] - t, rows[np.maximum.accumulate(np.where(head, np.arange(len(rows)), 0))]))
        return tuple(np.concatenate(x) for x in zip(*out))


def _removal(batches):
    for batch in batches:
        out = []
        for doc_id, text, spans in _rows(batch):
            gone = merged(spans)
            kept, at = sha256(), 0
            for s, e in gone:
                kept.update(text[at:s])
                at = e
            kept.update(text[at:])
            out.append((doc_id, len(text), sum(e - s for s, e in gone), len(gone), kept.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.string()])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def duplicate_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, spans: maximal byte runs that 100-byte strings cover which also start earlier."""
    return repeated_spans(docs, Bytes())[1]


def remove_repeated_bytes(docs: DataFrame) -> DataFrame:
    """One row per document: what is removed and the digest of what stays."""
    texts, spans = repeated_spans(docs, Bytes())
    return texts.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_removal, OUT)
