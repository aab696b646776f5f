"""Passage keys: book * 10^6 + chapter * 10^3 + verse, closed intervals of them, and their text forms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 66 book codes in key order.
BOOKS = (
    "GEN EXO LEV NUM DEU JOS JDG RUT 1SA 2SA 1KI 2KI 1CH 2CH EZR NEH EST JOB PSA PRO ECC SNG ISA JER LAM EZK DAN HOS JOL AMO OBA JON MIC NAM HAB ZEP HAG ZEC MAL "
    "MAT MRK LUK JHN ACT ROM 1CO 2CO GAL EPH PHP COL 1TH 2TH 1TI 2TI TIT PHM HEB JAS 1PE 2PE 1JN 2JN 3JN JUD REV"
).split()

#: The English names of the 66 books in key order.
NAMES = (
    "Genesis, Exodus, Leviticus, Numbers, Deuteronomy, Joshua, Judges, Ruth, 1 Samuel, 2 Samuel, 1 Kings, 2 Kings, 1 Chronicles, 2 Chronicles, Ezra, Nehemiah, Esther, Job, Psalms, Proverbs, Ecclesiastes, Song of Songs, "
    "Isaiah, Jeremiah, Lamentations, Ezekiel, Daniel, Hosea, Joel, Amos, Obadiah, Jonah, Micah, Nahum, Habakkuk, Zephaniah, Haggai, Zechariah, Malachi, Matthew, Mark, Luke, John, Acts, Romans, 1 Corinthians, 2 Corinthians, "
    "Galatians, Ephesians, Philippians, Colossians, 1 Thessalonians, 2 Thessalonians, 1 Timothy, 2 Timothy, Titus, Philemon, Hebrews, James, 1 Peter, 2 Peter, 1 John, 2 John, 3 John, Jude, Revelation"
).split(", ")
#: Names and codes in lower case, a leading number without space, by book number.
ALIASES = {re.sub(r"^(\d) ", r"\1", name.lower()): i + 1 for i, name in enumerate(NAMES)} | {code.lower(): i + 1 for i, code in enumerate(BOOKS)}


def encode(book: Column, chapter: Column, verse: Column) -> Column:
    """The key; null where a part is out of 1..66 or 1..999."""
    ok = book.between(1, 66) & chapter.between(1, 999) & verse.between(1, 999)
    return F.when(ok, (book * 1000000 + chapter * 1000 + verse).cast("long"))


def book_of(key: Column) -> Column:
    return F.floor(key / 1000000).cast("long")


def chapter_of(key: Column) -> Column:
    return F.floor(F.pmod(key, F.lit(1000000)) / 1000).cast("long")


def verse_of(key: Column) -> Column:
    return F.pmod(key, F.lit(1000)).cast("long")


def code_of(book: Column) -> Column:
    """Three-letter code of a book number."""
    return F.get(F.array(*map(F.lit, BOOKS)), book.cast("int") - 1)


def book_number(code: Column) -> Column:
    """Number of a book code, null if unknown."""
    return F.nullif(F.array_position(F.array(*map(F.lit, BOOKS)), F.upper(code)), F.lit(0)).cast("long")


def testament(book: Column) -> Column:
    return F.when(book <= 39, "ot").otherwise("nt")


def human(s: Column, e: Column) -> Column:
    """An interval as text: one verse, within a chapter, across chapters, across books."""
    place = lambda k: F.concat_ws(":", chapter_of(k).cast("string"), verse_of(k).cast("string"))
    start = F.concat_ws(" ", code_of(book_of(s)), place(s))
    return (
        F.when(s == e, start)
        .when(F.floor(s / 1000) == F.floor(e / 1000), F.concat_ws("-", start, verse_of(e).cast("string")))
        .when(book_of(s) == book_of(e), F.concat_ws("-", start, place(e)))
        .otherwise(F.concat(start, F.lit(" - "), code_of(book_of(e)), F.lit(" "), place(e)))
    )


def url(s: Column) -> Column:
    return F.concat_ws("/", F.lit("/scripture"), testament(book_of(s)), F.lower(code_of(book_of(s))), chapter_of(s).cast("string"), verse_of(s).cast("string"))


def width(s: Column, e: Column) -> Column:
    return (e - s).cast("long")


def specificity(s: Column, e: Column) -> Column:
    """1 for a verse, falling to 0.5 at a width of 500."""
    return F.lit(1.0) - F.lit(0.5) * F.least(width(s, e), F.lit(500)) / 500.0


def parse_osis(ref: Column) -> tuple[Column, Column]:
    """(s, e) of ``BOOK.chapter.verse`` with an optional ``-BOOK.chapter.verse`` or ``-verse``; null if malformed."""
    pattern = r"^([1-3A-Za-z]{3})\.(\d+)\.(\d+)(?:-(?:([1-3A-Za-z]{3})\.(\d+)\.)?(\d+))?$"
    part = lambda i: F.nullif(F.regexp_extract(ref, pattern, i), F.lit(""))
    number = lambda i: part(i).cast("long")
    s = encode(book_number(part(1)), number(2), number(3))
    e = encode(F.coalesce(book_number(part(4)), book_number(part(1))), F.coalesce(number(5), number(2)), F.coalesce(number(6), number(3)))
    return F.least(s, e), F.greatest(s, e)


def coerced(pair: Column) -> Column:
    """An array of two keys as an ordered interval; null if malformed."""
    return F.when(F.size(pair) == 2, F.struct(F.least(pair[0], pair[1]).alias("s"), F.greatest(pair[0], pair[1]).alias("e")))


def clock_seconds(text: Column) -> Column:
    """Seconds of ``m:ss`` or ``h:mm:ss``."""
    parts = F.split(text, ":")
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 60 + x.cast("long"))
