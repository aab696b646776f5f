"""References and time ranges in transcripts, with their places in the text, in expressions only.

Spark gives the matches of a pattern but not where they are; :func:`located` puts them back: the text is split by the same
pattern, and a match lies after the pieces and matches before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The names of books as patterns, those of several words first.
BOOKS = (
    r"1\s*Chronicles?", r"2\s*Chronicles?", r"1\s*Corinthians?", r"2\s*Corinthians?", r"1\s*Kings?", r"2\s*Kings?", r"1\s*Peter", r"2\s*Peter", r"1\s*Samuel", r"2\s*Samuel",
    r"1\s*Thessalonians?", r"2\s*Thessalonians?", r"1\s*Timothy", r"2\s*Timothy", r"1\s*John", r"2\s*John", r"3\s*John", r"Song\s+of\s+Songs?", r"Song\s+of\s+Solomon",
    r"Genesis", r"Exodus", r"Leviticus", r"Numbers", r"Deuteronomy", r"Joshua", r"Judges", r"Ruth", r"Ezra", r"Nehemiah", r"Esther", r"Job", r"Psalms?", r"Proverbs?", r"Ecclesiastes",
    r"Isaiah", r"Jeremiah", r"Lamentations", r"Ezekiel", r"Daniel", r"Hosea", r"Joel", r"Amos", r"Obadiah", r"Jonah", r"Micah", r"Nahum", r"Habakkuk", r"Zephaniah", r"Haggai", r"Zechariah", r"Malachi",
    r"Matthew", r"Mark", r"Luke", r"John", r"Acts", r"Romans?", r"Galatians?", r"Ephesians?", r"Philippians?", r"Colossians?", r"Titus", r"Philemon", r"Hebrews?", r"James", r"Jude", r"Revelation",
)
BOOK = "(?:" + "|".join(BOOKS) + ")"
#: Verse range, verse, chapter, chapter range; the second number of a chapter range stands where a verse would.
REFERENCES = (rf"({BOOK})\s+(\d+):(\d+)[-–](\d+)", rf"({BOOK})\s+(\d+):(\d+)", rf"({BOOK})\s+(\d+)", rf"({BOOK})\s+(\d+)[-–](\d+)")
#: Hours, minutes and seconds; minutes and seconds.
TIMES = (r"(\d{1,2}:\d{2}:\d{2})[-–](\d{1,2}:\d{2}:\d{2})", r"(\d{1,2}:\d{2})[-–](\d{1,2}:\d{2})")
#: Verses named without a book, which take the one before them.
BARE = r"\b(?:verses?|vv?\.)\s*(\d+)(?:[-–](\d+))?"


def located(text: Column | str, pattern: str) -> Column:
    """All matches as (position from 0, text), in order."""
    pieces, found = F.transform(F.split(text, pattern, -1), F.length), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<position:int,text:string>>").alias("out"))
    steps = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("gap"), found.alias("hit"))

    def step(s: Column, x: Column) -> Column:
        at = s["at"] + x["gap"]
        return F.struct((at + F.length(x["hit"])).alias("at"), F.concat(s["out"], F.array(F.struct(at.alias("position"), x["hit"].alias("text")))).alias("out"))

    return F.aggregate(steps, start, step, lambda s: s["out"])


def references(texts: DataFrame, keys: list[str], text: str, around: int = 50) -> DataFrame:
    """keys, position, text, book, chapter, verse_start, verse_end, context: the references of each text.

    Each wording counts once in a text, where it first stands; a longer reference doesn't hide the shorter one inside it.
    ``context`` has so many characters on both sides. Null and empty texts have none.
    """
    out = None
    for i, pattern in enumerate(REFERENCES):
        p = "(?i)" + pattern
        own = texts.select(*keys, F.col(text).alias("_t"), F.explode(located(F.col(text), p)).alias("x"))
        part = lambda k: F.nullif(F.regexp_extract("x.text", p, k), F.lit(""))  # noqa: B023, E731
        none = F.lit(None).cast("long")
        number = lambda k: part(k).cast("long")  # noqa: B023, E731
        row = own.select(*keys, "_t", "x.position", "x.text", F.lit(i).alias("_i"), part(1).alias("book"), number(2).alias("chapter"), (number(3) if i != 2 else none).alias("verse_start"), (number(4) if i == 0 else none).alias("verse_end"))
        out = row if out is None else out.unionByName(row)
    names = ["_t", "position", "_i", "book", "chapter", "verse_start", "verse_end"]
    first = out.groupBy(*keys, "text").agg(F.min_by(F.struct(*names), F.struct("_i", "position")).alias("f")).select(*keys, "text", "f.*")
    begin = F.greatest(F.col("position") - around, F.lit(0))
    context = F.substring("_t", begin + 1, F.col("position") + F.length("text") + around - begin)
    return first.select(*keys, F.col("position").cast("long").alias("position"), "text", "book", "chapter", "verse_start", "verse_end", F.regexp_replace(context, r"^\s+|\s+$", "").alias("context"))


def seconds(clock: Column) -> Column:
    """H:MM:SS or MM:SS as seconds."""
    p = F.split(clock, ":")
    n = lambda i: F.get(p, F.lit(i)).cast("long")
    return F.when(F.size(p) == 3, n(0) * 3600 + n(1) * 60 + n(2)).when(F.size(p) == 2, n(0) * 60 + n(1)).otherwise(0)


def times(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, position, start, end, start_s, end_s: the time ranges of each text; both patterns count for themselves."""
    out = None
    for pattern in TIMES:
        own = texts.select(*keys, F.explode(located(F.col(text), pattern)).alias("x")).select(*keys, F.col("x.position").cast("long").alias("position"), F.regexp_extract("x.text", pattern, 1).alias("start"), F.regexp_extract("x.text", pattern, 2).alias("end"))
        out = own if out is None else out.unionByName(own)
    return out.withColumn("start_s", seconds(F.col("start"))).withColumn("end_s", seconds(F.col("end")))


def carried(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, position, book, chapter, verse_start, verse_end: verses named without a book, with that of the reference before.

    The matches of full references and of bare verses are merged by place, and one pass over them carries the book and chapter.
    """
    full = F.transform(located(F.col(text), "(?i)" + rf"({BOOK})\s+(\d+)(?::(\d+))?"), lambda x: F.struct(x["position"], F.lit(0).alias("bare"), x["text"]))
    bare = F.transform(located(F.col(text), "(?i)" + BARE), lambda x: F.struct(x["position"], F.lit(1).alias("bare"), x["text"]))
    nothing = F.lit(None).cast("string")
    start = F.struct(nothing.alias("last"), F.array().cast("array<struct<position:int,text:string,last:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        met = F.struct(x["position"].alias("position"), x["text"].alias("text"), s["last"].alias("last"))
        return F.when(x["bare"] == 0, F.struct(x["text"].alias("last"), s["out"].alias("out"))).otherwise(F.struct(s["last"].alias("last"), F.concat(s["out"], F.array(met)).alias("out")))

    found = F.aggregate(F.array_sort(F.concat(full, bare)), start, step, lambda s: s["out"])
    own = texts.select(*keys, F.explode(found).alias("x")).where("x.last IS NOT NULL")
    of = lambda k: F.nullif(F.regexp_extract("x.last", "(?i)" + rf"({BOOK})\s+(\d+)", k), F.lit(""))
    verse = lambda k: F.nullif(F.regexp_extract("x.text", "(?i)" + BARE, k), F.lit("")).cast("long")
    return own.select(*keys, F.col("x.position").cast("long").alias("position"), of(1).alias("book"), of(2).cast("long").alias("chapter"), verse(1).alias("verse_start"), verse(2).alias("verse_end"))
