"""Scans that turn source tables into documents with tags, passages and bodies, and into graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.refs import book_number, code_of, book_of
from lectern.functions.text import fold

NONE = "array<string>"


def _prefixed(prefix: str, values: Column) -> Column:
    return F.transform(F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))), lambda v: F.concat(F.lit(prefix), v))


def lemma_slug(word: Column) -> Column:
    """A transliteration as a tag: without accents, lower case, letters, digits and hyphens."""
    return F.regexp_replace(F.regexp_replace(fold(word), r"[^a-z0-9]+", "-"), "^-+|-+$", "")


def strongs_code(code: Column) -> Column:
    """G26a as G0026a; null for what isn't a code."""
    p = r"^([GH])(\d+)([a-zA-Z]?)$"
    trimmed = F.trim(code)
    return F.when(trimmed.rlike(p), F.concat(F.regexp_extract(trimmed, p, 1), F.lpad(F.regexp_extract(trimmed, p, 2).cast("int").cast("string"), 4, "0"), F.regexp_extract(trimmed, p, 3)))


def morphology_documents(words: DataFrame) -> DataFrame:
    """ref, title, tags, body: one document a verse, its words as numbered lines.

    words: ref, idx, original, translit, strongs (array), morph, gloss; what is null or empty is left out of its line. The Old Testament is
    ``hbo``, the New ``grc``. Tags are sorted, each once.
    """
    some = lambda c: c.isNotNull() & (c != "")
    codes = F.array_join(F.filter("strongs", lambda s: s.isNotNull() & (s != "")), ", ")
    meta = F.concat_ws(" / ", F.when(codes != "", codes), F.when(some(F.col("morph")), F.col("morph")))
    line = F.concat_ws(" ", F.when(some(F.col("original")), F.concat(F.lit("**"), "original", F.lit("**"))).otherwise("—"), F.when(some(F.col("translit")), F.concat(F.lit("*"), "translit", F.lit("*"))), F.when(meta != "", F.concat(F.lit("["), meta, F.lit("]"))), F.when(some(F.col("gloss")), F.concat(F.lit('= "'), "gloss", F.lit('"'))))
    own = words.select("ref", "idx", line.alias("line"), "strongs", F.when(some(F.col("translit")), lemma_slug(F.col("translit"))).alias("lemma"), "morph")
    verse = own.groupBy("ref").agg(F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("l"), F.flatten(F.collect_list("strongs")).alias("s"), F.collect_set("lemma").alias("m"), F.collect_set("morph").alias("p"))
    code = code_of(book_of(F.col("ref")))
    hebrew = book_of(F.col("ref")) <= 39
    tags = F.concat(F.array(F.lit("kind:morphology"), F.concat(F.lit("book:"), code), F.concat(F.lit("lang:"), F.when(hebrew, "hbo").otherwise("grc"))), _prefixed("strongs:", F.col("s")), _prefixed("lemma:", F.col("m")), _prefixed("morph:", F.col("p")))
    body = F.array_join(F.transform("l", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["line"])), "\n")
    place = F.concat_ws(":", (F.floor(F.col("ref") / 1000) % 1000).cast("string"), (F.col("ref") % 1000).cast("string"))
    title = F.concat(F.when(hebrew, "TAHOT").otherwise("TAGNT"), F.lit(" — "), code, F.lit(" "), place)
    return verse.select("ref", title.alias("title"), F.array_sort(tags).alias("tags"), body.alias("body"))


def verse_documents(verses: DataFrame, resource: str) -> DataFrame:
    """ref, kind, title, tags, body of verses (ref, text, codes): codes are padded, malformed ones go; verses without text give none."""
    code = code_of(book_of(F.col("ref")))
    padded = F.transform("codes", strongs_code)
    tags = F.concat(F.array(F.lit("kind:bible"), F.concat(F.lit("book:"), code), F.lit("lang:en"), F.lit(f"resource:{resource}")), _prefixed("strongs:", padded))
    place = F.concat_ws(":", (F.floor(F.col("ref") / 1000) % 1000).cast("string"), (F.col("ref") % 1000).cast("string"))
    own = verses.where(F.trim("text") != "")
    return own.select("ref", F.lit("bible").alias("kind"), F.concat(F.lit(f"{resource.upper()} — "), code, F.lit(" "), place).alias("title"), F.array_sort(F.array_distinct(tags)).alias("tags"), F.trim("text").alias("body"))


def heading_documents(headings: DataFrame, resource: str, levels: tuple[str, ...] = ("s1", "s2")) -> DataFrame:
    """The same for section headings (ref of the verse before which they stand, level, text); other levels give none."""
    code = code_of(book_of(F.col("ref")))
    own = headings.where(F.col("level").isin(*levels) & F.col("ref").isNotNull() & (F.trim("text") != ""))
    tags = F.array(F.lit("kind:section-heading"), F.concat(F.lit("book:"), code), F.lit("lang:en"), F.lit(f"resource:{resource}"), F.concat(F.lit("heading-level:"), "level"))
    return own.select("ref", F.lit("section-heading").alias("kind"), F.concat(F.lit("Heading: "), F.trim("text")).alias("title"), F.array_sort(tags).alias("tags"), F.trim("text").alias("body"))


def listed(field: Column) -> Column:
    """The non-empty parts of a comma list."""
    return F.filter(F.transform(F.split(F.coalesce(field, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def graph(people: DataFrame, places: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, edges, mentions) of tables whose lists are comma lists.

    people: id, name, father, mother, partners, siblings, verses; places: id, name, verses; events: id, title, participants, locations, verses. Rows
    without an id go; a name that is missing is the id. Siblings are stored once, from the lesser key. Verses are ``GEN.1.1``; others go.
    """
    tables = (("person", people, "name"), ("place", places, "name"), ("event", events, "title"))
    vertices = edges = mentions = None
    union = lambda a, b: b if a is None else a.unionByName(b)

    def link(df: DataFrame, kind: str, field: str, other: str, relation: str, outward: bool) -> DataFrame:
        met = df.select(F.concat(F.lit(f"{kind}:"), F.trim("id")).alias("x"), F.explode(F.transform(listed(F.col(field)), lambda o: F.concat(F.lit(f"{other}:"), o))).alias("y"))
        a, b = ("x", "y") if outward else ("y", "x")
        return met.select(F.col(a).alias("source_id"), F.col(b).alias("target_id"), F.lit(relation).alias("relation"))

    for kind, df, name in tables:
        own = df.where(F.trim("id") != "")
        key = F.concat(F.lit(f"{kind}:"), F.trim("id"))
        vertices = union(vertices, own.select(key.alias("id"), F.lit(kind).alias("type"), F.coalesce(F.nullif(F.trim(name), F.lit("")), F.trim("id")).alias("name")))
        parts = F.split("v", r"\.")
        at = lambda i: F.get(parts, F.lit(i))  # noqa: B023, E731
        ref = F.when(F.size(parts) == 3, book_number(at(0)) * 1000000 + at(1).try_cast("long") * 1000 + at(2).try_cast("long"))
        mentions = union(mentions, own.select(key.alias("id"), F.explode(listed(F.col("verses"))).alias("v")).select("id", ref.alias("ref")).where("ref IS NOT NULL"))
    people, events = people.where(F.trim("id") != ""), events.where(F.trim("id") != "")
    edges = link(people, "person", "father", "person", "father-of", False).unionByName(link(people, "person", "mother", "person", "mother-of", False)).unionByName(link(people, "person", "partners", "person", "partner-of", True))
    edges = edges.unionByName(link(people, "person", "siblings", "person", "sibling-of", True).where("source_id < target_id"))
    edges = edges.unionByName(link(events, "event", "participants", "person", "participates-in", False)).unionByName(link(events, "event", "locations", "place", "occurred-at", True))
    return vertices, edges, mentions


def chunk_passages(chunks: DataFrame, key: str) -> DataFrame:
    """key, passages, tags of transcript chunks: their references in order, each interval once, the primary one last if it is new.

    chunks: key, found (array of book code, chapter, verse), primary (the same, one). A reference without a verse is its chapter; one of an
    unknown book or without a chapter has no interval, but an unknown chapter keeps its book's tag.
    """

    def span(r: Column) -> Column:
        base = book_number(r["book"]) * 1000000 + r["chapter"] * 1000
        s = base + F.coalesce(r["verse"], F.lit(1))
        e = base + F.coalesce(r["verse"], F.lit(999))
        return F.when(base.isNotNull(), F.struct(s.cast("long").alias("s"), e.cast("long").alias("e")))

    every = F.concat(F.coalesce("found", F.array().cast(chunks.schema["found"].dataType)), F.when(F.col("primary").isNotNull(), F.array("primary")).otherwise(F.array().cast(chunks.schema["found"].dataType)))
    spans = F.array_distinct(F.filter(F.transform(every, span), lambda x: x.isNotNull()))
    books = F.transform(F.filter(every, lambda r: book_number(r["book"]).isNotNull()), lambda r: F.upper(r["book"]))
    return chunks.select(key, spans.alias("passages"), _prefixed("book:", books).alias("tags"))


def markdown(html: Column) -> Column:
    """Lexicon HTML as minimal markdown: bold, italic and breaks stay, other tags go, entities are read, white space collapses."""
    out = F.regexp_replace(html, r"(?i)</?(?:b|strong)(?:\s[^>]*)?>", "**")
    out = F.regexp_replace(out, r"(?i)</?(?:i|em)(?:\s[^>]*)?>", "*")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?i)</p>", "\n\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"\n[ \t]+", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def lexicon_documents(entries: DataFrame, source: str) -> DataFrame:
    """code, title, tags, body: one document a headword. entries: code, headword, translit, short, html; malformed codes give none."""
    own = entries.withColumn("code", strongs_code(F.col("code"))).where("code IS NOT NULL AND trim(headword) != ''")
    slug = lemma_slug(F.coalesce("translit", F.lit("")))
    tags = F.concat(F.array(F.lit("kind:lexicon"), F.lit(f"resource:{source}"), F.concat(F.lit("strongs:"), "code"), F.concat(F.lit("lang:"), F.when(F.col("code").startswith("H"), "hbo").otherwise("grc"))), F.when(slug != "", F.array(F.concat(F.lit("lemma:"), slug))).otherwise(F.array().cast(NONE)))
    title = F.concat(F.lit(f"{source.upper()} — "), F.trim("headword"), F.lit(" ("), "code", F.lit(")"))
    body = F.concat_ws("\n\n", F.when(F.length(F.trim("short")) > 0, F.trim("short")), F.nullif(markdown(F.coalesce("html", F.lit(""))), F.lit("")))
    return own.select("code", title.alias("title"), F.array_sort(tags).alias("tags"), body.alias("body"))


def inherited(articles: DataFrame, links: DataFrame, codes: DataFrame) -> DataFrame:
    """path, title, tags, passages, body: each linked article with the passages of all links to it.

    articles: path (``…/category/term``), text. links: path, s, e. codes: term (spaces), code. Articles that no link names, and null
    texts, give none; tags hold the category, the term, the term's codes and the books of the passages.
    """
    spans = links.where("s IS NOT NULL AND e IS NOT NULL").groupBy("path").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("passages"))
    own = articles.where("text IS NOT NULL").join(spans, "path")
    category, term = F.element_at(F.split("path", "/"), -2), F.element_at(F.split("path", "/"), -1)
    named = own.withColumn("category", category).withColumn("slug", term).withColumn("term", F.lower(F.replace(term, F.lit("-"), F.lit(" "))))
    anchors = codes.groupBy(F.lower("term").alias("term")).agg(F.collect_set("code").alias("codes"))
    met = named.join(anchors, "term", "left")
    books = F.transform("passages", lambda p: code_of(book_of(p["s"])))
    tags = F.concat(F.array(F.lit("kind:term"), F.lit("lang:en"), F.concat(F.lit("category:"), "category"), F.concat(F.lit("term:"), "slug")), _prefixed("strongs:", F.coalesce("codes", F.array().cast(NONE))), _prefixed("book:", books))
    title = F.concat(F.lit("TW — "), F.initcap("term"), F.lit(" ("), "category", F.lit(")"))
    return met.select("path", title.alias("title"), F.array_sort(tags).alias("tags"), "passages", F.trim("text").alias("body"))
