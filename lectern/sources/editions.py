"""Readers of editions in three formats, all to (path, ref, text): markdown by verse, USFM and USFX.

Each takes files as rows (path, raw) and stays in expressions: a text is cut before its markers, chapters first, then verses,
so a verse's chapter is that of the piece it lies in. Notes and cross-references go with their content, other markup goes
without; white space is collapsed. Verses of unknown books, without a chapter, beyond the key's range or without text are
left out; null and empty files give none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.refs import book_number, book_of, encode


def read_files(spark: SparkSession, root: str, extension: str) -> DataFrame:
    """path, raw of the files below a folder, each as one row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension}").load(root)
    return files.select("path", F.decode("content", "UTF-8").alias("raw"))


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _cut(text: Column, before: str) -> Column:
    """Pieces of a text that begin at each match."""
    return F.split(text, f"(?={before})")


def _verses(files: DataFrame, chapter: tuple[str, str], verse: tuple[str, str], text: Callable[[Column], Column]) -> DataFrame:
    """path, ref, text of files (path, book, text), cut before each chapter and then each verse, given by where they begin and their number.

    What holds for a whole file or chapter is a column before its pieces become rows; with them it would be found again for
    each, in time that grows with the square of the verses.
    """
    number = lambda x, pattern: F.nullif(F.regexp_extract(x, pattern, 1), F.lit("")).cast("long")
    chapters = files.select("path", "book", _cut(F.col("text"), chapter[0]).alias("pieces")).select("path", "book", F.explode("pieces").alias("piece"))
    found = F.transform(_cut(F.col("piece"), verse[0]), lambda x: F.struct(number(x, verse[1]).alias("verse"), text(x).alias("text")))
    rows = chapters.select("path", "book", number(F.col("piece"), chapter[1]).alias("chapter"), found.alias("found")).select("path", "book", "chapter", F.explode("found").alias("x"))
    return rows.select("path", encode(F.col("book"), F.col("chapter"), F.col("x.verse")).alias("ref"), "x.text")


def _kept(verses: DataFrame, books: tuple[int, int]) -> DataFrame:
    own = verses.where(F.col("ref").isNotNull() & (F.col("text") != ""))
    return own.where(book_of(F.col("ref")).between(*books)).select("path", "ref", "text")


def markdown_verses(files: DataFrame, books: tuple[int, int] = (1, 66)) -> DataFrame:
    """One verse a file: the first passage of the front matter, and the body without its leading verse number."""
    ref = F.nullif(F.regexp_extract("raw", r"passages:\s*\n\s*-\s*\[(\d+)\s*,", 1), F.lit("")).cast("long")
    parts = F.split("raw", "---", 3)
    body = F.regexp_replace(F.regexp_replace(F.element_at(parts, -1), r"^\s+|\s+$", ""), r"^\d+\s+", "")
    return _kept(files.select("path", ref.alias("ref"), body.alias("text")), books)


def usfm_verses(files: DataFrame, books: tuple[int, int] = (1, 66)) -> DataFrame:
    r"""Verses of USFM: ``\id`` names the book; notes, alignment milestones and word attributes go, word texts stay."""
    bare = F.regexp_replace("raw", r"(?is)\\(f|x|fe)\b.*?\\\1\*", "")
    bare = F.regexp_replace(bare, r"\\zaln-[se]\b[^\n\\]*(?:\\\*)?", "")
    bare = F.regexp_replace(bare, r"(?s)\\w\s+([^\\|]*?)(?:\|[^\\]*?)?\\w\*", "$1")
    book = book_number(F.substring(F.regexp_extract("raw", r"\\id\s+(\w+)", 1), 1, 3))
    text = lambda x: _flat(F.regexp_replace(F.regexp_replace(x, r"^\\v\s+\d+", ""), r"\\[a-z0-9]+\*?", " "))
    return _kept(_verses(files.select("path", book.alias("book"), bare.alias("text")), (r"\\c\s+\d", r"^\\c\s+(\d+)"), (r"\\v\s+\d", r"^\\v\s+(\d+)"), text), books)


def usfx_verses(files: DataFrame, books: tuple[int, int] = (1, 66)) -> DataFrame:
    """Verses of USFX, whose chapters and verses are empty elements between texts; ``<v id="3-4"/>`` counts as verse 3."""
    found = F.regexp_extract_all("raw", F.lit(r'(?s)<book\s+id="[A-Za-z0-9]{3}"\s*>.*?</book>'), F.lit(0))
    body = files.select("path", found.alias("found")).select("path", F.explode("found").alias("book"))
    code = F.regexp_extract("book", r'id="([A-Za-z0-9]{3})"', 1)
    bare = F.regexp_replace(F.regexp_replace("book", r"(?s)<f\b.*?</f>", ""), r"(?s)<x\b.*?</x>", "")

    def text(x: Column) -> Column:
        for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            x = F.replace(x, F.lit(entity), F.lit(sign))
        return x

    own = body.select("path", book_number(code).alias("book"), bare.alias("text"))
    return _kept(_verses(own, (r"<c\s+id=", r'^<c\s+id="(\d+)"\s*/?>'), (r"<v\s+id=", r'^<v\s+id="(\d+)[\d-]*"'), lambda x: text(_flat(F.regexp_replace(x, r"<[^>]+>", " ")))), books)


READERS = {"markdown": markdown_verses, "usfm": usfm_verses, "usfx": usfx_verses}
EXTENSIONS = {"markdown": "md", "usfm": "usfm", "usfx": "xml"}


def read_edition(spark: SparkSession, root: str, form: str, edition: str, books: tuple[int, int] = (1, 66)) -> DataFrame:
    """edition, ref, text of a folder of files of one form; of a verse that is there twice the first path counts."""
    verses = READERS[form](read_files(spark, root, EXTENSIONS[form]), books)
    return verses.groupBy("ref").agg(F.min_by("text", F.struct("path", "text")).alias("text")).select(F.lit(edition).alias("edition"), "ref", "text")
