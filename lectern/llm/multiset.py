"""Operator 12: homomorphic multiset fingerprints of documents, DataFrame functions only.

A document is the multiset of its paragraphs (lines). Each paragraph hashes to a wide vector, and the
fingerprint is the sum of its paragraphs' vectors, lane by lane, modulo powers of two:

* 16 identity lanes modulo 2^32, from two SHA-256 digests of the paragraph;
* 128 likeness lanes modulo 2^24: the sum of the sign vectors (+1 or -1 by the bits of an MD5 digest) of the
  paragraph's pieces, which are up to four words between punctuation.

So equal multisets have equal fingerprints in whatever order, and paragraphs can be inserted and deleted by adding
and subtracting their vectors (:func:`inserted`, :func:`deleted`). The scalar product of two likeness blocks
estimates how many pieces two documents share, with an error of a root of 128th of their norms; its cosine, from 0
to 1, is the likeness. Lanes are summed two to a long, 32 bits each, inside the row.

:func:`edited` fingerprints each document with half of it replaced by its successor's beginning, incrementally:
paragraphs before the cut are hashed once, and only the rest is subtracted and added. The successor comes by one
shuffle of the texts into ranges of ids, bounded by percentiles; the first row of each range also goes to the range
before it. An id that fills several ranges is spread over them by a hash of the text.

Cases: null text counts as empty, one empty paragraph; texts without words have likeness 0 to others and 1 to
an equal fingerprint; one document is its own successor; rows that share an id follow one another by their texts'
hash, and rows equal in both are alike (they share one range); rows without an id have no successor: half of them
goes and nothing comes, and ``near_next`` is 0; very long texts are hashed whole; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Identity lanes and their bits; likeness lanes and their bits.
IDENTITY, IDENTITY_BITS, LIKENESS, LIKENESS_BITS = 16, 32, 128, 24
#: Up to four words divided by single spaces, without punctuation.
PIECE = r"[^\x00-\x20.,;:!?]+(?: [^\x00-\x20.,;:!?]+){0,3}"
#: Ranges of ids for each shuffle partition, so that ranges of several partitions even out.
RANGES = 4
_LOW = (1 << 32) - 1
_PAIR = (1 << 32) + 1


def _total(values: str, term) -> Column:
    return F.aggregate(F.col(values), F.lit(0).cast("long"), lambda s, x: s + term(x))


def with_sums(df: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """``df`` with a column of sums for each named text (null: no paragraph at all).

    Sums are an array of longs: identity lanes (not yet reduced), pairs of counts of set bits, number of pieces.
    """
    names, own = list(texts), df.columns
    out = df.select("*", *[F.coalesce(F.split(t, "\n"), F.array().cast("array<string>")).alias(f"_l_{n}") for n, t in texts.items()], *[F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(PIECE), F.lit(0)).alias(f"_p_{n}") for n, t in texts.items()])
    sha = lambda k: (lambda p: F.sha2(F.concat(F.lit(f"{k}:"), p).cast("binary"), 256))
    out = out.select(*own, *[F.transform(f"_l_{n}", sha(k)).alias(f"_s{k}_{n}") for n in names for k in range(2)], *[F.transform(f"_p_{n}", lambda p: F.md5(p.cast("binary"))).alias(f"_m_{n}") for n in names])
    half = lambda at: (lambda m: F.conv(F.substring(m, at, 16), 16, -10).cast("long"))
    out = out.select(*own, *[f"_s{k}_{n}" for n in names for k in range(2)], *[F.transform(f"_m_{n}", half(16 * t + 1)).alias(f"_b{t}_{n}") for n in names for t in range(2)])
    lane = lambda i: (lambda h: F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long"))
    bits = lambda j: (lambda b: F.shiftrightunsigned(b, j).bitwiseAND(F.lit(_PAIR)))

    def sums(n: str) -> Column:
        identity = [_total(f"_s{k}_{n}", lane(i)) for k in range(2) for i in range(8)]
        return F.array(*identity, *[_total(f"_b{t}_{n}", bits(j)) for t in range(2) for j in range(32)], F.size(f"_b0_{n}").cast("long"))

    return out.select(*own, *[sums(n).alias(n) for n in names])


def added(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def lanes_of(sums: str) -> Column:
    """Sums as lanes: identity lanes modulo 2^32, then signed likeness lanes."""
    s, pieces = F.col(sums), F.element_at(F.col(sums), -1)
    identity = F.transform(F.slice(s, 1, IDENTITY), lambda x: x.bitwiseAND(F.lit(_LOW)))
    signed = lambda x: F.array(2 * x.bitwiseAND(F.lit(_LOW)) - pieces, 2 * F.shiftrightunsigned(x, 32) - pieces)
    return F.concat(identity, F.flatten(F.transform(F.slice(s, IDENTITY + 1, LIKENESS // 2), signed)))


def _hex(digits: int):
    return lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit((1 << 4 * digits) - 1)))), digits, "0")


def encoded(lanes: Column) -> Column:
    """Lanes as the hexadecimal fingerprint."""
    parts = F.transform(F.slice(lanes, 1, IDENTITY), _hex(IDENTITY_BITS // 4)), F.transform(F.slice(lanes, IDENTITY + 1, LIKENESS), _hex(LIKENESS_BITS // 4))
    return F.array_join(F.concat(*parts), "")


def decoded(fingerprint: Column) -> Column:
    """The lanes of a fingerprint; likeness lanes are signed."""
    w, v, start = IDENTITY_BITS // 4, LIKENESS_BITS // 4, IDENTITY * IDENTITY_BITS // 4
    number = lambda at, digits: F.conv(F.substring(fingerprint, at, digits), 16, 10).cast("long")
    identity = F.transform(F.sequence(F.lit(0), F.lit(IDENTITY - 1)), lambda i: number(i * w + 1, F.lit(w)))
    top = 1 << LIKENESS_BITS
    signed = lambda x: F.when(x >= top // 2, x - top).otherwise(x)
    return F.concat(identity, F.transform(F.sequence(F.lit(0), F.lit(LIKENESS - 1)), lambda i: signed(number(i * v + 1 + start, F.lit(v)))))


def inserted(a: Column, b: Column) -> Column:
    """The fingerprint of the paragraphs of both."""
    return encoded(F.zip_with(decoded(a), decoded(b), lambda x, y: x + y))


def deleted(a: Column, b: Column) -> Column:
    """The fingerprint of the paragraphs of ``a`` without those of ``b``."""
    return encoded(F.zip_with(decoded(a), decoded(b), lambda x, y: x - y))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two arrays of lanes: the cosine of their likeness blocks, 1 for equal lanes."""
    x, y = (F.slice(v, IDENTITY + 1, LIKENESS) for v in (a, b))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0).cast("long"), lambda s, v: s + v).cast("double")
    norm = F.sqrt(dot(x, x) * dot(y, y))
    cosine = F.when(norm > 0, F.greatest(dot(x, y) / norm, F.lit(0.0))).otherwise(0.0)
    return F.when(a == b, F.lit(1.0)).otherwise(F.round(F.least(cosine, F.lit(1.0)), 6))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return with_sums(own, {"sums": F.col("text")}).select("doc_id", lanes_of("sums").alias("lanes")).select("doc_id", encoded(F.col("lanes")).alias("fingerprint"))


def _below(bounds: list[int], value: Column, strictly: bool) -> Column:
    """How many of the sorted bounds are smaller than the value, or not greater; by a coarse and a fine look."""
    fits = (lambda b: b < value) if strictly else (lambda b: b <= value)
    coarse = F.size(F.filter(F.lit(bounds[::64]), fits))
    fine = F.size(F.filter(F.slice(F.lit(bounds), (F.greatest(coarse, F.lit(1)) - 1) * 64 + 1, F.lit(64)), fits))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * 64 + fine)


def _ranged(known: DataFrame, ranges: int) -> DataFrame:
    """known (doc_id, text, h) with its range: ranges follow the order of (doc_id, h)."""
    shares = [i / ranges for i in range(1, ranges)]
    bounds = known.agg(F.percentile_approx("doc_id", shares, 20 * ranges)).first()[0] if shares else None
    if not bounds:
        return known.withColumn("range", F.lit(0))
    low, many = _below(bounds, F.col("doc_id"), True), _below(bounds, F.col("doc_id"), False)
    out = known.withColumn("low", low).withColumn("many", many - F.col("low"))
    place = F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * F.col("many")).cast("int")
    spread = F.when(F.col("many") > 1, F.least(place, F.col("many") - 1)).otherwise(0)
    return out.withColumn("range", F.col("low") + spread).drop("low", "many")


def with_successor(docs: DataFrame, shown: list[str], carried) -> DataFrame:
    """doc_id, text, what ``carried`` adds, and ``next``: text and the ``shown`` columns of the next row by descending id.

    The driver holds one id for each range, a number fixed by the session's partitions.
    """
    spark = docs.sparkSession
    known = docs.where("doc_id IS NOT NULL").withColumn("h", F.xxhash64("text"))
    ranged = _ranged(known, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    heads = sorted(ranged.groupBy("range").agg(F.max(F.struct("doc_id", "h")).alias("head")).collect(), key=lambda r: -r["range"])
    before = [(heads[i]["head"]["doc_id"], heads[i]["head"]["h"], heads[i - 1]["range"]) for i in range(len(heads))]  # the first head also ends the last range
    ends = spark.createDataFrame(before, "doc_id long, h long, range int")
    guests = known.join(F.broadcast(ends), ["doc_id", "h"]).dropDuplicates(["range"]).withColumn("guest", F.lit(1))
    both = carried(ranged.withColumn("guest", F.lit(0)).unionByName(guests))
    order = Window.partitionBy("range").orderBy("guest", F.desc("doc_id"), F.desc("h"))
    own = [c for c in both.columns if c not in ("doc_id", "h", "range", "guest")]
    following = both.withColumn("next", F.lead(F.struct("text", *shown)).over(order)).where("guest = 0")
    return following.select("doc_id", *own, "next")


def edited(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and the likenesses."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def carried(df: DataFrame) -> DataFrame:
        """The sums of the paragraphs before the cut's, and of all."""
        n = F.length("text")
        cut = df.withColumn("half", F.floor(n / 2).cast("int")).withColumn("kept", F.substring("text", F.lit(1), n - F.col("half")))
        cut = cut.withColumn("before", F.length("kept") - F.length(F.substring_index("kept", "\n", -1))).drop("kept")
        head = F.when(F.col("before") > 0, F.substring("text", F.lit(1), F.col("before") - 1))
        summed = with_sums(cut, {"head": head, "rest": F.substring("text", F.col("before") + 1, F.lit(2**31 - 1))})
        return summed.withColumn("sums", added("head", "rest")).drop("rest")

    followed = with_successor(plain, ["sums"], carried)
    alone = carried(plain.where("doc_id IS NULL"))
    alone = alone.withColumn("next", F.lit(None).cast(followed.schema["next"].dataType)).select(followed.columns)
    n = F.length("text")
    whole = followed.unionByName(alone).withColumn("edit", F.concat(F.substring("text", F.lit(1), n - F.col("half")), F.coalesce(F.substring("next.text", F.lit(1), F.col("half")), F.lit(""))))
    short = whole.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"), "head", "sums", F.col("next.sums").alias("next"),
        F.substring("edit", F.col("before") + 1, F.lit(2**31 - 1)).alias("fresh"),
    )
    summed = with_sums(short, {"new": F.col("fresh")}).withColumn("edit", added("head", "new"))
    lanes = summed.select("doc_id", "n_chars", "edited_sha256", lanes_of("sums").alias("a"), lanes_of("edit").alias("b"), F.when(F.col("next").isNotNull(), lanes_of("next")).alias("c"))
    return lanes.select(
        "doc_id", "n_chars", "edited_sha256", encoded(F.col("a")).alias("fingerprint"), encoded(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), F.coalesce(likeness(F.col("a"), F.col("c")), F.lit(0.0)).alias("near_next"),
    )
