"""Places out of JSON lines of deep and uneven shape, read as VARIANT: what isn't of the expected type counts as absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.refs import book_number, encode

#: The OSIS names of the 66 books in key order.
OSIS = (
    "Gen Exod Lev Num Deut Josh Judg Ruth 1Sam 2Sam 1Kgs 2Kgs 1Chr 2Chr Ezra Neh Esth Job Ps Prov Eccl Song Isa Jer Lam Ezek Dan Hos Joel Amos Obad Jonah Mic Nah Hab Zeph Hag Zech Mal "
    "Matt Mark Luke John Acts Rom 1Cor 2Cor Gal Eph Phil Col 1Thess 2Thess 1Tim 2Tim Titus Phlm Heb Jas 1Pet 2Pet 1John 2John 3John Jude Rev"
).split()
#: Fixed value: the key that holds Wikidata ids.
WIKIDATA = "s7cc8b2"


def verse_key(osis: Column) -> Column:
    """The passage key of ``Gen.1.1``; three-letter codes are known too; null for all else."""
    parts = F.split(osis, r"\.")
    name = F.get(parts, F.lit(0))
    book = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, OSIS)), name), F.lit(0)).cast("long"), book_number(name))
    return F.when(F.size(parts) == 3, encode(book, F.get(parts, F.lit(1)).try_cast("long"), F.get(parts, F.lit(2)).try_cast("long")))


def parsed(lines: DataFrame, line: str = "value") -> DataFrame:
    """The lines with ``entry``, a VARIANT: null where a line isn't JSON."""
    return lines.where(F.length(F.trim(line)) > 0).withColumn("entry", F.try_parse_json(line))


def malformed(lines: DataFrame, line: str = "value") -> DataFrame:
    """lines, malformed, nameless: one row of counts."""
    own = parsed(lines, line)
    return own.agg(F.count("*").alias("lines"), F.count_if(F.col("entry").isNull()).alias("malformed"), F.count_if(F.col("entry").isNotNull() & ~_named()).alias("nameless"))


def _text(path: str) -> Column:
    return F.try_variant_get(F.col("entry"), path, "string")


def _named() -> Column:
    return F.length(F.trim(F.coalesce(_text("$.friendly_id"), F.lit("")))) > 0


def places(lines: DataFrame, line: str = "value") -> DataFrame:
    """id, name, types, verses, lon, lat, wikidata, modern, variants of each well-formed line with a name.

    The coordinate is the first usable one of all resolutions of all identifications, in their order: a text of two numbers
    with a comma. Verses that name no known place are left out.
    """
    get = lambda path, kind: F.try_variant_get(F.col("entry"), path, kind)
    own = parsed(lines, line).where(F.col("entry").isNotNull() & _named())
    # identifications are read one by one, so that one of another shape doesn't hide the rest
    idents = F.coalesce(get("$.identifications", "array<variant>"), F.array().cast("array<variant>"))
    resolutions = F.flatten(F.transform(idents, lambda i: F.coalesce(F.try_variant_get(i, "$.resolutions", "array<variant>"), F.array().cast("array<variant>"))))
    pairs = F.transform(resolutions, lambda r: F.split(F.try_variant_get(r, "$.lonlat", "string"), ",", 2))
    number = lambda p, i: F.trim(F.get(p, F.lit(i))).try_cast("double")
    usable = F.get(F.filter(F.transform(pairs, lambda p: F.struct(number(p, 0).alias("lon"), number(p, 1).alias("lat"))), lambda x: x["lon"].isNotNull() & x["lat"].isNotNull()), F.lit(0))
    verses = F.transform(F.coalesce(get("$.verses", "array<variant>"), F.array().cast("array<variant>")), lambda v: verse_key(F.try_variant_get(v, "$.osis", "string")))
    wikidata = _text(f"$.linked_data.{WIKIDATA}.id")
    modern = F.transform(F.map_entries(get("$.modern_associations", "map<string,variant>")), lambda e: F.struct(
        e["key"].alias("id"), F.try_variant_get(e["value"], "$.name", "string").alias("name"), F.try_variant_get(e["value"], "$.score", "double").alias("score"), F.try_variant_get(e["value"], "$.url_slug", "string").alias("url_slug")))
    variants = F.transform(F.map_entries(get("$.translation_name_counts", "map<string,bigint>")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("count")))
    wide = own.withColumn("at", usable)
    return wide.select(
        F.coalesce(_text("$.id"), F.lit("")).alias("id"), F.trim(_text("$.friendly_id")).alias("name"), F.coalesce(get("$.types", "array<string>"), F.array().cast("array<string>")).alias("types"),
        F.filter(verses, lambda v: v.isNotNull()).alias("verses"), F.col("at.lon").alias("lon"), F.col("at.lat").alias("lat"), F.when(wikidata.startswith("Q"), wikidata).alias("wikidata"),
        F.array_sort(modern).alias("modern"), F.array_sort(variants).alias("variants"),
    )
