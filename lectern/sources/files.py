"""File sources: markdown with front matter, word-level markup, tagged text, tab-separated and JSON-line tables.

Readers use Spark's own sources, so paths may be in any store; per-file parsing is Arrow-batched.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MARKDOWN = ("md", "markdown", "mdx")
DOCUMENT = "id string, path string, title string, body string, tags array<string>, s array<long>, e array<long>, metadata string"


def scalar(value: str):
    """A YAML scalar or inline list."""
    value = value.strip()
    if value.startswith("[") and value.endswith("]"):
        return [scalar(x) for x in re.split(r",(?![^\[]*\])", value[1:-1]) if x.strip()]
    if value[:1] in "\"'" and value[-1:] == value[:1]:
        return value[1:-1]
    return int(value) if re.fullmatch(r"-?\d+", value) else value


def front_matter(text: str) -> tuple[dict, str]:
    """(keys, body) of a text with a ``---`` block of ``key: value`` lines and ``- item`` lists in front."""
    m = re.match(r"---\s*\n(.*?)\n---\s*(?:\n|$)", text, re.S)
    if not m:
        return {}, text
    out: dict = {}
    key = None
    for line in m[1].split("\n"):
        if re.match(r"\s*-\s+", line) and key:
            if not isinstance(out[key], list):
                out[key] = []
            out[key].append(scalar(re.sub(r"^\s*-\s+", "", line)))
        elif ":" in line:
            key, _, value = line.partition(":")
            key = key.strip()
            out[key] = scalar(value)
    return out, text[m.end() :]


def coerce_tags(value) -> list[str]:
    """A scalar or list as a list of non-empty strings."""
    return [str(x) for x in (value if isinstance(value, list) else [value]) if x not in (None, "", [])]


def coerce_passages(value) -> list[tuple[int, int]]:
    """Pairs of keys in order; malformed ones are left out."""
    pairs = value if isinstance(value, list) else []
    if len(pairs) == 2 and all(isinstance(x, int) for x in pairs):
        pairs = [pairs]
    return [(min(p), max(p)) for p in pairs if isinstance(p, list) and len(p) == 2 and all(isinstance(x, int) for x in p)]


def parse_markdown(path: str, text: str) -> tuple:
    keys, body = front_matter(text)
    spans = coerce_passages(keys.get("passages"))
    rest = {k: v for k, v in keys.items() if k not in ("title", "tags", "passages")}
    title = str(keys.get("title") or path.rsplit("/", 1)[-1].rsplit(".", 1)[0])
    return sha256(path.encode()).hexdigest()[:16], path, title, body.strip() or None, coerce_tags(keys.get("tags")), [a for a, _ in spans], [b for _, b in spans], json.dumps(rest, sort_keys=True)


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """One row a file; its id comes from the path below ``root``; an empty body is null and gives no chunk."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{md,markdown,mdx}").select(F.col("_metadata.file_path").alias("p"), "value")
    below = F.regexp_replace("p", "^.*?" + re.escape(root.split("://", 1)[-1].rstrip("/")) + "/", "")
    return markdown_documents(raw.select(below.alias("path"), F.col("value").alias("raw")))


#: Texts that are Python's at a time: of a batch of Arrow some thousand long texts, only so many are copied.
FEW = 256
_DOCUMENT = pa.schema([(n, {"string": pa.string(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}[k]) for n, k in (c.split() for c in DOCUMENT.split(", "))])


def markdown_documents(raw: DataFrame) -> DataFrame:
    """The documents of markdown texts (path, raw), in Arrow batches of ``FEW`` texts."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, FEW):
                some = batch.slice(at, FEW)
                rows = [parse_markdown(p, v or "") for p, v in zip(*(some.column(c).to_pylist() for c in ("path", "raw")))]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _DOCUMENT)], schema=_DOCUMENT)

    return raw.select("path", "raw").mapInArrow(run, DOCUMENT)


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = dict.fromkeys(MARKDOWN, read_markdown)


def reader(extension: str) -> Callable[[SparkSession, str], DataFrame]:
    """The reader of an extension; unknown ones are an error."""
    try:
        return READERS[extension.lower().lstrip(".")]
    except KeyError:
        raise ValueError(f"no reader for {extension!r}") from None


def routed(paths: DataFrame) -> DataFrame:
    """path, extension, reader of files (path): the registered reader's name, null for unknown extensions."""
    extension = F.regexp_extract("path", r"\.([^./]+)$", 1)
    known = F.create_map(*[F.lit(x) for e, f in sorted(READERS.items()) for x in (e, f.__name__.removeprefix("read_"))])
    return paths.select("path", extension.alias("extension"), F.try_element_at(known, F.lower(extension)).alias("reader"))


def file_digests(spark: SparkSession, root: str) -> DataFrame:
    """path, digest: the first 16 hex digits of each file's SHA-256."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.substring(F.sha2("content", 256), 1, 16).alias("digest"))


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A tab-separated table with ``#`` comments and a header; numbers that don't parse become null."""
    r = spark.read.option("sep", "\t").option("header", True).option("comment", "#").option("mode", "PERMISSIVE")
    return (r.schema(schema) if schema else r).csv(path)


def write_table(df: DataFrame, path: str, *order: str, notes: tuple[str, ...] = ()) -> None:
    """A sorted tab-separated table; ranges of the order go to files in turn, so no task holds everything.

    ``notes`` (where the data come from) stand as ``#`` lines in a file of their own that sorts first; readers skip them.
    """
    df.orderBy(*order).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
    if notes:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/00-notes.csv")
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
        out.write(bytearray("".join(f"# {n}\n" for n in notes).encode()))
        out.close()


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; bad ones are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def usfm_verses(text: Column | str) -> Column:
    """chapter, verse, text of marked-up text: headers, notes and word attributes go, a bridge counts as its first verse."""
    plain = F.regexp_replace(text, r"\\f .*?\\f\*|\\x .*?\\x\*|\\(?:id|h|toc\d|mt\d?|s\d?) [^\n]*|\|[^\\\n]*(?=\\w\*)", "")
    plain = F.regexp_replace(plain, r"\\\+?(?:w|nd|add|wj)\*?\s?", "")
    chapters = F.split(plain, r"\\c\s+")
    per = F.transform(F.slice(chapters, 2, 1 << 20), lambda c: F.transform(F.slice(F.split(c, r"\\v\s+"), 2, 1 << 20), lambda v: F.struct(
        F.regexp_extract(c, r"^(\d+)", 1).cast("int").alias("chapter"), F.regexp_extract(v, r"^(\d+)", 1).cast("int").alias("verse"),
        F.trim(F.regexp_replace(F.regexp_replace(v, r"^\d+(?:-\d+)?\s*", ""), r"\\\w+\*?|\s+", " ")).alias("text"))))
    return F.flatten(per)


def usfm_words(text: str) -> list[tuple[int, int, int, str, str | None]]:
    """(chapter, verse, idx from 0, surface, code) in document order; a new chapter starts at verse 0."""
    chapter = verse = idx = 0
    out = []
    for m in re.finditer(r"\\c\s+(\d+)|\\v\s+(\d+)|\\w\s+([^|\\]*)(?:\|([^\\]*))?\\w\*", text):
        if m[1]:
            chapter, verse, idx = int(m[1]), 0, 0
        elif m[2]:
            verse, idx = int(m[2]), 0
        else:
            code = re.search(r'strong="([^"]+)"', m[4] or "")
            out.append((chapter, verse, idx, m[3].strip(), code[1] if code else None))
            idx += 1
    return out


def usfm_word_rows(text: Column) -> Column:
    """The same as an array of (chapter, verse, idx, surface, strong), in expressions: chapters are cut first, then verses, then words."""
    number = lambda x, p: F.coalesce(F.nullif(F.regexp_extract(x, p, 1), F.lit("")).cast("int"), F.lit(0))
    word = r"\\w\s+([^|\\]*)(?:\|([^\\]*))?\\w\*"

    def words(chapter: Column, piece: Column) -> Column:
        found = F.regexp_extract_all(piece, F.lit(word), F.lit(0))
        strong = lambda w: F.nullif(F.regexp_extract(F.regexp_extract(w, word, 2), 'strong="([^"]+)"', 1), F.lit(""))
        return F.transform(found, lambda w, i: F.struct(chapter.alias("chapter"), number(piece, r"^\\v\s+(\d+)").alias("verse"), i.alias("idx"), F.trim(F.regexp_extract(w, word, 1)).alias("surface"), strong(w).alias("strong")))

    chapters = F.split(text, r"(?=\\c\s+\d)")
    return F.flatten(F.transform(chapters, lambda c: F.flatten(F.transform(F.split(c, r"(?=\\v\s+\d)"), lambda v: words(number(c, r"^\\c\s+(\d+)"), v)))))


def inline_tagged(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, idx from 1, surface, strong, morph of ``word<S>123</S><m>N</m>`` text."""
    word = df.select(*keys, F.posexplode(F.split(F.trim(text), r"\s+")).alias("i", "w"))
    part = lambda p: F.nullif(F.regexp_extract("w", p, 1), F.lit(""))
    return word.select(*keys, (F.col("i") + 1).cast("long").alias("idx"), F.regexp_extract("w", r"^([^<]+)", 1).alias("surface"), part(r"<S>(\d+)</S>").alias("strong"), part(r"<m>([^<]+)</m>").alias("morph"))


def frames(df: DataFrame, key: str, frame: str) -> DataFrame:
    """key, role, arg of ``A0:id;id A1:id`` strings, each once."""
    group = df.select(key, F.explode(F.split(F.trim(frame), r"\s+")).alias("g")).where("g <> ''")
    role, args = F.split_part("g", F.lit(":"), F.lit(1)), F.split(F.split_part("g", F.lit(":"), F.lit(2)), ";")
    return group.select(key, role.alias("role"), F.explode(args).alias("arg")).where("arg <> ''").dropDuplicates()


def consecutive(df: DataFrame, order: str, key: str, value: str, within: list[str]) -> DataFrame:
    """Groups of consecutive rows with one key: within, key, values in order."""
    w = Window.partitionBy(*within).orderBy(order)
    new = F.when(F.col(key).eqNullSafe(F.lag(key).over(w)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    g = df.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.array_sort(F.collect_list(F.struct(order, value)))
    return g.groupBy(*within, "_g", key).agg(F.transform(ordered, lambda x: x[value]).alias("values")).withColumn("g", F.col("_g").cast("long")).drop("_g")


def html_text(html: Column | str) -> Column:
    """The text of HTML: scripts, styles and tags go, common entities are read, white space collapses."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(c))
    return F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " "))
