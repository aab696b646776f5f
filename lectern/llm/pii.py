"""Operator 3: personal data, also behind disguises, with spans in the source text.

Base detectors find e-mail addresses, IPv4 addresses, payment cards and phone numbers in the text as it
is. Then transducers rewrite it while carrying each output character's source interval: look-alike
and compatibility characters and the digits of any script become ASCII, invisible ones vanish, spelled digits
(also tens and "double five") become digits, and
"at" / "dot" disguises become their signs: dots beside any "@", plain or disguised, and between digits. The same detectors run on the result, and what they find
through at least one rewritten character maps back to source characters as an additional span.

Counts and the base digest are of base spans only; ``spans`` holds all; ``n_added`` counts the rest.
Cases: null or empty text has no spans; rows without an id pass through; repeated rows give repeated
rows; added spans that overlap a base span of their kind are left out; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_rows, small

KINDS = ("email", "ip", "card", "phone")
OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Cyrillic and Greek letters that look like Latin ones, and the Latin ones.
_LOOKS = "аеорсухіјѕԁһӏԛԝвмтнкАВЕКМНОРСТУХІЈЅԌ" + "αορνικτυχεΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
_LATIN = "aeopcyxijsdhlqwbmthkABEKMHOPCTYXIJSG" + "aopvikTuxeABEZHIKMNOPTYX"
#: Invisible characters, other spaces, dots and dashes.
_HIDDEN = "­​‌‍‎‏⁠﻿"
_SPACES = "             　"
_DOTS, _DASHES = "․。｡·‧", "‐‑‒–—−"
CHARS = dict(zip(_LOOKS, _LATIN)) | dict.fromkeys(_HIDDEN, "") | dict.fromkeys(_SPACES, " ") | dict.fromkeys(_DOTS, ".") | dict.fromkeys(_DASHES, "-")
#: The digits' names, zero to nine, in English, German, Spanish and French.
_NAMES = (
    ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"),
    ("null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"),
    ("cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"),
    ("zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"),
)
DIGITS = {name: str(i) for names in _NAMES for i, name in enumerate(names)} | {"oh": "0"}
#: English numbers of two digits, and words that repeat the digit behind them.
TEENS = {name: str(i) for i, name in enumerate(("ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"), 10)}
TENS = {name: str(i) for i, name in enumerate(("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"), 2)}
TIMES = {"double": 2, "triple": 3}
_any = lambda names: "(?:" + "|".join(sorted(names, key=len, reverse=True)) + ")"
_NAME, _TENS, _TEENS = _any(DIGITS), _any(TENS), _any(TEENS)
_UNIT = _any(n for n in _NAMES[0] if n != "zero")
_SIGN = r"(?:dot|punkt|punto|point)"
_ONE = rf"(?:(?:double|triple)\s{{1,3}}(?:{_NAME}|[0-9])|{_TENS}(?:[\s-]{{1,2}}{_UNIT}(?![^\W_]))?|{_TEENS}|{_NAME}|[0-9])"
#: Four digits and more of which at least one is spelled; a spelled dot, dash or plus may stand between.
_SPELLED = re.compile(rf"(?<![^\W_])(?:plus[\s,-]{{0,4}})?{_ONE}(?:[\s,.()-]{{0,4}}(?:(?:{_SIGN}|dash|minus|hyphen)[\s,.()-]{{0,4}})?{_ONE}){{3,}}(?![^\W_])", re.I)
_PART = re.compile(rf"(plus)|(double|triple)\s{{1,3}}({_NAME}|[0-9])|({_TENS})(?:[\s-]{{1,2}}({_UNIT})(?![^\W_]))?|({_TEENS})|({_NAME})|([0-9])|({_SIGN})|(dash|minus|hyphen)|(\.)|([\s,()-]+)", re.I)
#: Names that start the search; "un" alone is too common a word, so a sequence needs another name.
_NAMED = frozenset(n.encode() for n in [*DIGITS, *TENS, *TEENS] if n != "un")
_HAS_NAME = re.compile(rf"(?<![^\W_])(?!un\b)(?:{_NAME}|{_TENS}|{_TEENS})(?![^\W_])", re.I)

_OPEN, _CLOSE = r"[\s\[\(\{<_]", r"[\s\]\)\}>_]"
_AT = re.compile(rf"{_OPEN}{{1,8}}(?:(?:at|arroba|ät){_CLOSE}{{1,8}}|@{_CLOSE}{{0,8}})(?=[A-Za-z0-9])|@\s{{1,8}}(?=[A-Za-z0-9])", re.I)
_DOT = re.compile(rf"{_OPEN}{{1,8}}(?:{_SIGN}|\.){_CLOSE}{{1,8}}(?=[A-Za-z0-9])", re.I)
_AT_WORDS = frozenset((b"at", b"arroba", "ät".encode()))
#: What a text with a disguised dot holds.
_DOT_WORDS = (b"dot", b"punkt", b"punto", b"point")
_BOXED = re.compile(r"[\[({<][\s\[({<_]*\.")
_TO_SPACE = bytes.maketrans(bytes(range(0x21, 0x61)) + bytes(range(0x7B, 0x80)), b" " * 69)
_WORD = re.compile(r"[A-Za-z0-9-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of all base spans, in order."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


class Mapped:
    """A text with the source interval of each character and whether it was rewritten."""

    def __init__(self, text: str):
        self.text, self.start, self.end, self.new = text, list(range(len(text))), list(range(1, len(text) + 1)), bytearray(len(text))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace intervals (in order, apart from each other) by strings."""
        if not edits:
            return
        text, start, end, new, at = [], [], [], bytearray(), 0
        for s, e, out in edits:
            text += (self.text[at:s], out)
            start += self.start[at:s] + [self.start[s]] * len(out)
            end += self.end[at:s] + [self.end[e - 1]] * len(out)
            new += self.new[at:s] + b"\1" * len(out)
            at = e
        text.append(self.text[at:])
        start += self.start[at:]
        end += self.end[at:]
        new += self.new[at:]
        self.text, self.start, self.end, self.new = "".join(text), start, end, new


@lru_cache(maxsize=1 << 16)
def plain(c: str) -> str:
    """The ASCII reading of a look-alike, compatibility or foreign digit character."""
    if c in CHARS:
        return CHARS[c]
    out = unicodedata.normalize("NFKC", c)
    if len(out) == 1 and out.isdigit():
        out = str(unicodedata.digit(out))
    return out if out.isascii() else CHARS.get(out, c)


def _spelled(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _SPELLED.finditer(text):
        if not _HAS_NAME.search(m[0]):
            continue
        for p in _PART.finditer(text, m.start(), m.end()):
            plus, times, repeated, tens, unit, teens, name, digit, dot, dash, _, gap = p.groups()
            if times:
                edits.append((p.start(), p.end(), DIGITS.get(repeated.lower(), repeated) * TIMES[times.lower()]))
            elif tens:
                edits.append((p.start(), p.end(), TENS[tens.lower()] + (DIGITS[unit.lower()] if unit else "0")))
            elif teens:
                edits.append((p.start(), p.end(), TEENS[teens.lower()]))
            elif name:
                edits.append((p.start(), p.end(), DIGITS[name.lower()]))
            elif plus or dot or dash:
                edits.append((p.start(), p.end(), "+" if plus else "." if dot else "-"))
            elif gap and not digit:
                edits.append((p.start(), p.end(), ""))
    return edits


def _disguised(text: str, dotted: bool) -> list[tuple[int, int, str]]:
    """Edits that put back "@" and "." where an address hides them."""
    dots = [(d.start(), d.end(), ".") for d in _DOT.finditer(text) if d.start() and text[d.start() - 1].isalnum() and ("." not in d[0] or any(c in "[({<" for c in d[0]))] if dotted else []
    ats, spelt = [], {s for s, _, _ in dots}
    for m in _AT.finditer(text):
        if not m.start() or text[m.start() - 1] not in _LOCAL:
            continue
        if _WORD.match(text, m.end()).end() in spelt:
            ats.append((m.start(), m.end(), "@"))
        elif _DOMAIN.match(text, m.end()):  # a bare "at" counts only after what can't be a plain word
            start = m.start()
            while start > 0 and text[start - 1] in _LOCAL:
                start -= 1
            if "@" in m[0] or any(c in "[({<" for c in m[0]) or any(c in "0123456789_.+" for c in text[start : m.start()].strip(".")):
                ats.append((m.start(), m.end(), "@"))
    if not ats and "@" not in text:  # without an address, only an IPv4 address can hold them
        dots = [d for d in dots if text[d[0] - 1].isdigit() and text[d[1]].isdigit()]
    edits, at = [], 0
    for s, e, c in sorted(dots + ats):
        if s >= at:
            edits.append((s, e, c))
            at = e
    return edits


def normalised(text: str) -> Mapped | None:
    """All transducers in turn; None where nothing is rewritten."""
    out = None
    if not text.isascii():
        odd = "".join(sorted(c for c in set(text) if c > "\x7f" and plain(c) != c))
        if odd:
            out = Mapped(text)
            out.rewrite([(m.start(), m.end(), plain(m[0])) for m in re.finditer(f"[{re.escape(odd)}]", text)])
    low = (out.text if out else text).lower().encode("utf-8", "surrogatepass")
    words, dotted = set(low.translate(_TO_SPACE).split()), any(w in low for w in _DOT_WORDS) or bool(_BOXED.search(out.text if out else text))
    if not words.isdisjoint(_NAMED):
        edits = _spelled(out.text if out else text)
        if edits:
            out = out or Mapped(text)
            out.rewrite(edits)
    if dotted or "@" in (out.text if out else text) or not words.isdisjoint(_AT_WORDS):
        edits = _disguised(out.text if out else text, dotted)
        if edits:
            out = out or Mapped(text)
            out.rewrite(edits)
    return out


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, added spans), each in order."""
    base = detect(text)
    other = normalised(text)
    added = []
    if other is not None:
        for kind, s, e in detect(other.text):
            a, b = other.start[s], other.end[e - 1]
            if (any(other.new[s:e]) or b - a != e - s) and not any(k == kind and x < b and a < y for k, x, y in base):
                added.append((kind, a, b))
    return base, added


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _find(batches):
    for batch in small(batches):
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            base, added = all_spans(text)
            n = [0] * 4
            for k, _, _ in base:
                n[k] += 1
            out.append((doc_id, *n, sha256(spelled(base).encode()).hexdigest(), spelled(sorted(base + added)), len(added)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()])], [f.split()[0] for f in OUT.split(", ")])


def find(docs: DataFrame) -> DataFrame:
    """One row per document: counts, digest of the base spans, all spans."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_find, OUT)


def masked(text: str | None) -> str | None:
    """The text with each found span replaced by its kind in angle brackets; of overlapping spans the first and longest."""
    if not text:
        return text
    out, at = [], 0
    for k, s, e in sorted((x for found in all_spans(text) for x in found), key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += (text[at:s], f"<{KINDS[k].upper()}>")
            at = e
        elif e > at:
            at = e
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data masked; all other columns, and nulls, as they were."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in small(batches):
            columns = list(batch.columns)
            columns[at] = pa.array([masked(t) for t in columns[at].to_pylist()], batch.schema.types[at])
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return map_rows(docs, run)
