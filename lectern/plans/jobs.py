"""Queries of jobs that keep state: sense merges, refreshes, caches, readers of other formats, acceptance checks, alignments."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.refs import code_of
from lectern.operators import checks, coreference, senses
from lectern.plans.registry import query
from lectern.sources import aligned, editions, places, sinks, store, transcripts
from lectern.streaming import lookups, refresh

_OCC = "o AS (SELECT label AS lex, vec_id % 2 AS stem, CASE WHEN vec_id % 3 = 0 THEN 'G' ELSE 'g' END || (vec_id // 8) || CASE WHEN vec_id // 8 % 3 = 0 THEN '.x' ELSE '' END AS gloss, embedding::DOUBLE[] AS x FROM embeddings)"


@query("", f"""WITH RECURSIVE {_OCC}, m AS (SELECT lex, stem, k, list(m ORDER BY i) AS c FROM (SELECT lex, stem, k, i, avg(x[i]) AS m FROM (SELECT *, lower(gloss) AS k FROM o), unnest(range(1, 65)) AS t(i) GROUP BY ALL) GROUP BY ALL),
e AS (SELECT a.lex, a.stem, a.k AS u, b.k AS v FROM m a JOIN m b ON a.lex = b.lex AND a.stem = b.stem AND a.k <> b.k AND list_cosine_similarity(a.c, b.c) >= 0.35),
r AS (SELECT lex, stem, k AS u, k AS v FROM m UNION SELECT r.lex, r.stem, r.u, e.v FROM r JOIN e ON e.lex = r.lex AND e.stem = r.stem AND e.u = r.v),
c AS (SELECT lex, stem, u AS k, min(v) AS cluster FROM r GROUP BY ALL),
f AS (SELECT o.lex, o.stem, cluster, gloss, count(*) AS m FROM o JOIN c ON c.lex = o.lex AND c.stem = o.stem AND c.k = lower(gloss) GROUP BY ALL),
s AS (SELECT lex, stem, cluster, sum(m)::BIGINT AS n, arg_min(gloss, (length(gloss) - length(replace(gloss, '.', '')), -m, gloss)) AS canonical FROM f GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY lex, stem ORDER BY n DESC, cluster) AS sense, round(n / sum(n) OVER (PARTITION BY lex, stem), 3) AS share FROM s)
SELECT lex, stem, sense, CASE WHEN sense = 1 AND stem = 0 THEN coalesce(n_name, canonical) ELSE canonical END AS gloss, n, share FROM n LEFT JOIN nation ON n_nationkey = lex""")
def seq_05_context_senses(t):
    v = F.col("vec_id")
    run = F.floor(v / 8).cast("long")
    gloss = F.concat(F.when(v % 3 == 0, "G").otherwise("g"), run.cast("string"), F.when(run % 3 == 0, ".x").otherwise(""))
    occurrences = t.table("embeddings").select(F.col("label").alias("lex"), (v % 2).alias("stem"), gloss.alias("gloss"), F.col("embedding").alias("vector"))
    curated = t.table("nation").select(F.col("n_nationkey").alias("lex"), F.lit(0).cast("long").alias("stem"), F.col("n_name").alias("label"))
    return senses.by_context(occurrences, curated, 0.35)


@query("chunks", "SELECT doc_id, count(c.chunk_id) AS chunks, count(c.chunk_id) AS embedded FROM documents LEFT JOIN chunks c USING (doc_id) GROUP BY doc_id")
def str_06_refresh(t):
    """The documents as a stream of files, ingested, cut and embedded; what a former call took isn't taken again."""
    root = f"{store.shared_root(t.spark)}/refresh/{store.snapshot(t.spark, t.path('documents'))}"
    own = refresh.Refresh(t.spark, root, sinks.hashed, "hashed-64")
    own.run(store.as_pattern(t.path("documents")), t.table("documents").schema, files=4)
    chunks = own.chunks().join(own.vectors().select("digest", F.lit(1).alias("hit")), "digest", "left")
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count("hit").alias("embedded"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return own.documents().select("doc_id").join(counts, "doc_id", "left").select("doc_id", zero("chunks"), zero("embedded"))


_REQUESTS = "q AS (SELECT user_id || ':' || event_type AS key, ts, event_id AS id, json_extract(props, '$.k')::BIGINT % 3 > 0 AS ok, value FROM events)"


def _requests(df):
    ok = F.get_json_object("props", "$.k").cast("long") % 3 > 0
    return df.select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), "ts", F.col("event_id").alias("id"), ok.alias("ok"), "value")


def _cache_sql(period: str) -> str:
    return f"WITH {_REQUESTS}, p AS (SELECT *, {period} AS period FROM q), f AS (SELECT key, period, min({{'ts': ts, 'id': id, 'value': value}}) AS f FROM p WHERE ok GROUP BY ALL), j AS (SELECT p.*, f, CASE WHEN (ts, id) > (f.ts, f.id) THEN 'cache' WHEN ok THEN 'fetched' ELSE 'failed' END AS source FROM p LEFT JOIN f USING (key, period)) SELECT key, ts, id, source, CASE source WHEN 'cache' THEN f.value WHEN 'fetched' THEN value END AS value FROM j"


@query("", _cache_sql("0"))
def str_07_lookup_cache(t):
    return lookups.cached(_requests(t.table("events")))


@query("", _cache_sql("epoch_us(ts) // 86400000000"))
def str_07b_expiring_stream(t):
    """The same as a stream with keyed state; answers expire at the end of the day."""
    spark, events = t.spark, t.table("events")
    root = f"{store.shared_root(spark)}/lookups-2/{store.snapshot(spark, t.path('events'))}"
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(events.schema).parquet(store.as_pattern(t.path("events")))
        answers = lookups.cached_stream(_requests(stream), 86400)
        answers.writeStream.option("checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/answers").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(conf, before)
    return spark.read.schema(lookups.ANSWER).parquet(f"{root}/answers")


@query("", "WITH c AS (SELECT text FROM conversations WHERE trim(text) <> '') SELECT (SELECT count(*) FROM conversations) AS contexts, count(*) AS joined, count(DISTINCT text) AS encoded, 64 AS dimensions FROM c")
def vec_10_contexts(t):
    """Each distinct turn encoded once and written by digest, then joined back."""
    turns = t.table("conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")

    def build(path):
        sinks.embed_contexts(turns, "id", "text", sinks.hashed, "hashed-64")[0].write.parquet(f"{path}/vectors")
        return {"model": "hashed-64"}

    path, manifest = store.derived(t.spark, "contexts", [t.path("conversations")], build)
    stored = t.spark.read.parquet(f"{path}/vectors")
    joined = sinks.embed_contexts(turns, "id", "text", sinks.hashed, "hashed-64", stored, manifest["model"])[1]
    own = joined.agg(F.count("*").alias("joined"), F.countDistinct("digest").alias("encoded"), F.max(F.size("embedding")).alias("dimensions"))
    return turns.agg(F.count("*").alias("contexts")).crossJoin(own)  # one row each


_LINE = "trim(regexp_replace(regexp_replace(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1], '[\\\\<>|{}]', '', 'g'), '\\s+', ' ', 'g'))"
_VERSES = f"v AS (SELECT doc_id % 66 + 1 AS book, doc_id // 66 % 150 + 1 AS chapter, doc_id // 66 // 150 + 1 AS verse, {_LINE} AS text FROM documents)"


@query("", f"WITH {_VERSES} SELECT unnest(['markdown', 'usfm', 'usfx']) AS edition, book * 1000000 + chapter * 1000 + verse AS ref, text FROM v WHERE text <> '' AND verse <= 999")
def src_22_editions(t):
    """A verse out of each document, written in three formats with notes and markup, and read back."""
    d = F.col("doc_id")
    line = F.get(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), F.lit(0))
    text = F.trim(F.regexp_replace(F.regexp_replace(line, r"[\\<>|{}]", ""), r"\s+", " "))
    rest = F.floor(d / 66).cast("long")
    v = t.dealt("documents", "doc_id", "text").select((d % 66 + 1).alias("book"), (rest % 150 + 1).alias("chapter"), (F.floor(rest / 150).cast("long") + 1).alias("verse"), text.alias("text")).where("text != '' AND verse <= 999")
    ref = F.format_string("%d", F.col("book") * 1000000 + F.col("chapter") * 1000 + F.col("verse"))
    one = v.select(ref.alias("path"), F.format_string("---\npassages:\n  - [%s, %s]\n---\n%d %s\n", ref, ref, "verse", "text").alias("raw"))
    ordered = lambda e: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("verse", "text"))), e), "")
    escaped = lambda x: F.replace(x, F.lit("&"), F.lit("&amp;"))
    usfm = ordered(lambda x: F.format_string('\\v %d \\zaln-s |x-strong="G1"\\*\\w %s|strong="G1"\\w*\\zaln-e\\*\\f + \\ft note\\f*\n', x["verse"], x["text"]))
    usfx = ordered(lambda x: F.format_string('<v id="%d-%d" bcv="x"/>%s<f caller="+">note</f><ve/>\n', x["verse"], x["verse"], escaped(x["text"])))
    files = v.groupBy("book", "chapter").agg(usfm.alias("usfm"), usfx.alias("usfx"))  # a chapter has 999 verses at most
    code = code_of(F.col("book"))
    path = F.format_string("%s-%d", code, "chapter")
    u = files.select(path.alias("path"), F.format_string("\\id %s edition\n\\c %d\n\\p\n%s", code, "chapter", "usfm").alias("raw"))
    x = files.select(path.alias("path"), F.format_string('<usfx><book id="%s">\n<c id="%d"/>\n%s</book></usfx>', code, "chapter", "usfx").alias("raw"))
    out = None
    for form, given in (("markdown", one), ("usfm", u), ("usfx", x)):
        own = editions.READERS[form](given).select(F.lit(form).alias("edition"), "ref", "text")
        out = own if out is None else out.unionByName(own)
    return out


def _entries(t):
    """JSON lines of places from the customers, some cut short, some without a name."""
    k, own = F.col("c_custkey"), t.table("customer").join(t.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    s = lambda c: c.cast("string")
    at = lambda x: F.struct(x.alias("lonlat"))
    good = F.concat(s(k % 360 - 180), F.lit(", "), s(k % 180 - 90))
    idents = F.when(k % 5 != 0, F.array(F.struct(F.array(at(F.lit("n/a")), at(F.lit("far,away"))).alias("resolutions")), F.struct(F.array(at(good), at(F.lit("0,0"))).alias("resolutions"))))
    osis = lambda x: F.struct(x.alias("osis"))
    entry = F.to_json(F.struct(
        F.concat(F.lit("a"), s(k)).alias("id"), F.when(k % 11 == 0, "  ").otherwise(F.col("c_name")).alias("friendly_id"), F.array("c_mktsegment").alias("types"),
        F.array(osis(F.concat(F.lit("1Kgs."), s(k % 22 + 1), F.lit("."), s(k % 30 + 1))), osis(F.lit("Nowhere.1.1"))).alias("verses"), idents.alias("identifications"),
        F.struct(F.struct(F.concat(F.when(k % 2 == 0, "Q").otherwise("X"), s(k)).alias("id")).alias("s7cc8b2")).alias("linked_data"),
        F.create_map(F.concat(F.lit("m"), s(F.col("n_nationkey"))), F.struct(F.col("n_name").alias("name"), (k % 100).alias("score"), F.lower("n_name").alias("url_slug"))).alias("modern_associations"),
        F.create_map(F.col("n_name"), k).alias("translation_name_counts"),
    ))
    return own.select(F.when(k % 7 == 0, F.left(entry, F.floor(F.length(entry) / 2).cast("int"))).otherwise(entry).alias("value"))


@query("", "SELECT 'a' || c_custkey AS id, c_name AS name, c_mktsegment AS types, (11000000 + (c_custkey % 22 + 1) * 1000 + c_custkey % 30 + 1)::VARCHAR AS verses, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 360 - 180)::DOUBLE END AS lon, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 180 - 90)::DOUBLE END AS lat, CASE WHEN c_custkey % 2 = 0 THEN 'Q' || c_custkey END AS wikidata, 'm' || n_nationkey || ':' || n_name || ':' || lower(n_name) AS modern, (c_custkey % 100)::DOUBLE AS score, n_name || ':' || c_custkey AS variants FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0")
def src_23_places(t):
    own = places.places(_entries(t))
    first = lambda c: F.get(c, F.lit(0))
    modern, variant = first(F.col("modern")), first(F.col("variants"))
    return own.select("id", "name", F.array_join("types", ",").alias("types"), F.array_join(F.transform("verses", lambda v: v.cast("string")), ",").alias("verses"), "lon", "lat", "wikidata",
        F.concat_ws(":", modern["id"], modern["name"], modern["url_slug"]).alias("modern"), modern["score"].alias("score"), F.concat_ws(":", variant["name"], variant["count"].cast("string")).alias("variants"))


@query("", "SELECT count(*) AS lines, count(*) FILTER (c_custkey % 7 = 0) AS malformed, count(*) FILTER (c_custkey % 7 <> 0 AND c_custkey % 11 = 0) AS nameless FROM customer")
def src_23_malformed(t):
    return places.malformed(_entries(t))


def _spoken(t):
    """The turns with references, bare verses and time ranges spoken in them."""
    c, n, s = F.col("conv_id"), F.col("turn"), lambda x: x.cast("string")
    gen = F.concat(F.lit("Genesis "), s(c % 50 + 1), F.lit(":"), s(n + 1))
    said = F.concat(F.when(c % 2 == 0, "Romans 3-5, ").otherwise(""), F.coalesce("text", F.lit("")), F.lit(" See "), gen, F.lit("-"), s(n + 4), F.lit(" and 1 kings "), s(n + 1), F.lit(", verse "), s(n + 2), F.lit(" at 0:0"), s(n % 10), F.lit(":05-0:1"), s(n % 10), F.lit(":30; again "), gen, F.lit(". v. 7-9"))
    return t.dealt("conversations", "conv_id", "turn", "text").select(c.cast("long").alias("conv_id"), n.cast("long").alias("turn"), said.alias("text"))


_SPOKEN = "x AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, CASE WHEN conv_id % 2 = 0 THEN 'Romans 3-5, ' ELSE '' END || coalesce(text, '') || ' See Genesis ' || (conv_id % 50 + 1) || ':' || (turn + 1) || '-' || (turn + 4) || ' and 1 kings ' || (turn + 1) || ', verse ' || (turn + 2) || ' at 0:0' || (turn % 10) || ':05-0:1' || (turn % 10) || ':30; again Genesis ' || (conv_id % 50 + 1) || ':' || (turn + 1) || '. v. 7-9' AS text FROM conversations)"


def _located(name: str, pattern: str) -> str:
    """DuckDB: the matches of a pattern with their positions, from the lengths of what lies before."""
    return f"{name} AS (SELECT conv_id, turn, whole, f[k] AS text, (list_sum(list_transform(p[1:k], lambda y: length(y))) + coalesce(list_sum(list_transform(f[1:k - 1], lambda y: length(y))), 0))::BIGINT AS position FROM (SELECT conv_id, turn, text AS whole, string_split_regex(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS f FROM x), unnest(range(1, len(f) + 1)) AS t(k))"


_REFS = [f"(?i){p}" for p in transcripts.REFERENCES]


@query("", f"WITH {_SPOKEN}, {', '.join(_located(f'm{i}', p) for i, p in enumerate(_REFS))}, a AS ("
    + " UNION ALL ".join(f"SELECT *, {i} AS i, regexp_extract(text, '{p}', 1) AS book, regexp_extract(text, '{p}', 2)::BIGINT AS chapter, {f'''regexp_extract(text, '{p}', 3)::BIGINT''' if i != 2 else 'NULL::BIGINT'} AS verse_start, {f'''regexp_extract(text, '{p}', 4)::BIGINT''' if i == 0 else 'NULL::BIGINT'} AS verse_end FROM m{i}" for i, p in enumerate(_REFS))
    + "), f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, text ORDER BY i, position) AS n FROM a) SELECT conv_id, turn, position, text, book, chapter, verse_start, verse_end, regexp_replace(substr(whole, greatest(position - 50, 0) + 1, position + length(text) + 50 - greatest(position - 50, 0)), '^\\s+|\\s+$', '', 'g') AS context FROM f WHERE n = 1")
def src_24_references(t):
    return transcripts.references(_spoken(t), ["conv_id", "turn"], "text")


_CLOCK = "(CASE WHEN len(string_split({0}, ':')) = 3 THEN string_split({0}, ':')[1]::BIGINT * 3600 + string_split({0}, ':')[2]::BIGINT * 60 + string_split({0}, ':')[3]::BIGINT ELSE string_split({0}, ':')[1]::BIGINT * 60 + string_split({0}, ':')[2]::BIGINT END)"


@query("", f"WITH {_SPOKEN}, {', '.join(_located(f'm{i}', p) for i, p in enumerate(transcripts.TIMES))}, a AS (" + " UNION ALL ".join(f"SELECT conv_id, turn, position, regexp_extract(text, '{p}', 1) AS s, regexp_extract(text, '{p}', 2) AS e FROM m{i}" for i, p in enumerate(transcripts.TIMES)) + f") SELECT conv_id, turn, position, s AS start, e AS \"end\", {_CLOCK.format('s')} AS start_s, {_CLOCK.format('e')} AS end_s FROM a")
def src_24b_times(t):
    return transcripts.times(_spoken(t), ["conv_id", "turn"], "text")


_FULL, _BARE = rf"(?i)({transcripts.BOOK})\s+(\d+)(?::(\d+))?", "(?i)" + transcripts.BARE


@query("", f"WITH {_SPOKEN}, {_located('f', _FULL)}, {_located('b', _BARE)}, a AS (SELECT conv_id, turn, position, text, 0 AS bare FROM f UNION ALL SELECT conv_id, turn, position, text, 1 FROM b), l AS (SELECT *, last_value(CASE WHEN bare = 0 THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY position, bare ROWS UNBOUNDED PRECEDING) AS last FROM a) SELECT conv_id, turn, position, regexp_extract(last, '{_FULL}', 1) AS book, regexp_extract(last, '{_FULL}', 2)::BIGINT AS chapter, regexp_extract(text, '{_BARE}', 1)::BIGINT AS verse_start, nullif(regexp_extract(text, '{_BARE}', 2), '')::BIGINT AS verse_end FROM l WHERE bare = 1 AND last IS NOT NULL")
def src_24c_carried(t):
    return transcripts.carried(_spoken(t), ["conv_id", "turn"], "text")


@query("words refs tags", """SELECT * FROM (SELECT 'words' AS subject, unnest(['rows', 'padded codes', 'places in the verse', 'content words']) AS "constraint", unnest([count(*), count(*) FILTER (NOT regexp_matches(strong, '^[HG][0-9]{4}$')), count(*) FILTER (idx NOT BETWEEN 0 AND 11), sum(is_content)]::DOUBLE[]) AS value FROM words)
UNION ALL SELECT 'words', 'unique book, chapter, verse, idx', count(*)::DOUBLE FROM (SELECT 1 FROM words GROUP BY book, chapter, verse, idx HAVING count(*) > 1)
UNION ALL SELECT 'refs', unnest(['rows', 'ordered', 'greatest width']), unnest([count(*), count(*) FILTER (s > e), max(e - s)]::DOUBLE[]) FROM refs
UNION ALL SELECT 'tags', unnest(['rows', 'spaced names']), unnest([count(*), count(*) FILTER (NOT contains(tag, ':'))]::DOUBLE[]) FROM tags
UNION ALL SELECT 'tags', 'known doc_id', count(*)::DOUBLE FROM (SELECT DISTINCT doc_id FROM tags WHERE doc_id NOT IN (SELECT doc_id FROM documents))""".join(("SELECT *, CASE \"constraint\" WHEN 'rows' THEN value >= 1 WHEN 'content words' THEN value >= 1 WHEN 'greatest width' THEN value <= 3000 ELSE value = 0 END AS passed FROM (", ")")))
def etl_10_checks(t):
    words, refs, own = t.words(), t.refs(), t.tags()
    out = checks.measured(words, "words", [checks.rows(), checks.always("padded codes", F.col("strong").rlike("^[HG][0-9]{4}$")), checks.always("places in the verse", F.col("idx").between(0, 11)), checks.Constraint("content words", F.sum("is_content"), 1)])
    out = out.unionByName(checks.repeated(words, "words", ["book", "chapter", "verse", "idx"]))
    out = out.unionByName(checks.measured(refs, "refs", [checks.rows(), checks.never("ordered", F.col("s") > F.col("e")), checks.Constraint("greatest width", F.max(F.col("e") - F.col("s")), None, 3000)]))
    out = out.unionByName(checks.measured(own, "tags", [checks.rows(), checks.always("spaced names", F.contains("tag", F.lit(":")))]))
    return out.unionByName(checks.missing(own, "tags", "doc_id", t.table("documents")))


_TOKENS = "k AS (SELECT book, book * 1000000 + chapter * 1000 + verse AS ref, idx, min({'a': surface, 'b': strong, 'c': lemma, 'd': morph}) AS x FROM words GROUP BY ALL), tok AS (SELECT book, ref, idx, x.a AS surface, x.b AS strong, x.c AS lemma, x.d AS morph, lpad(ref::VARCHAR, 8, '0') || lpad(idx::VARCHAR, 3, '0') AS id FROM k)"


def _tokens(t):
    """One token a place of the word store, with its id."""
    ref = F.col("book") * 1000000 + F.col("chapter") * 1000 + F.col("verse")
    one = t.words().groupBy("book", ref.alias("ref"), "idx").agg(F.min(F.struct("surface", "strong", "lemma", "morph")).alias("x"))
    return one.select("book", "ref", "idx", "x.*", F.concat(F.lpad(F.col("ref").cast("string"), 8, "0"), F.lpad(F.col("idx").cast("string"), 3, "0")).alias("id"))


def _aligned(t):
    """Alignment tables of two source corpora: both are transferred, one is aligned by hand too."""
    k = _tokens(t)
    corpus = F.when(F.col("book") % 2 == 0, "SBL").otherwise("WLC")
    head = F.lpad(F.col("ref").cast("string"), 8, "0")
    sources = k.select(corpus.alias("source_corpus"), F.concat(F.lit("n"), "id").alias("id"), F.when(F.col("idx") % 4 == 3, "").otherwise(F.col("strong")).alias("strong"), "lemma")
    near = F.concat(F.lit("o"), head, F.lpad(((F.col("idx") + 1) % 12).cast("string"), 3, "0"))
    record = k.select(corpus.alias("source_corpus"), F.lit("V1").alias("version"), F.lit("transfer").alias("method"), (F.col("ref") * 100 + F.col("idx")).alias("place"), F.array(F.col("id"), near).alias("source"), F.array("id").alias("target"), "idx")
    manual = record.where("source_corpus = 'SBL' AND idx % 3 != 0").withColumn("method", F.lit("manual")).withColumn("source", F.reverse("source"))
    targets = k.select(F.lit("V1").alias("version"), "id", F.col("surface").alias("text"), (F.col("idx") % 5 == 0).alias("skip"))
    return record.unionByName(manual).drop("idx"), sources, targets


_ALIGNED = f"{_TOKENS}, src AS (SELECT CASE WHEN book % 2 = 0 THEN 'SBL' ELSE 'WLC' END AS corpus, id, CASE WHEN idx % 4 = 3 THEN '' ELSE strong END AS strong, lemma FROM tok), rec AS (SELECT CASE WHEN book % 2 = 0 THEN 'SBL' ELSE 'WLC' END AS corpus, 'transfer' AS method, ref, idx, id, id AS s1, lpad(ref::VARCHAR, 8, '0') || lpad(((idx + 1) % 12)::VARCHAR, 3, '0') AS s2 FROM tok UNION ALL SELECT 'SBL', 'manual', ref, idx, id, lpad(ref::VARCHAR, 8, '0') || lpad(((idx + 1) % 12)::VARCHAR, 3, '0'), id FROM tok WHERE book % 2 = 0 AND idx % 3 <> 0), pick AS (SELECT rec.corpus, method, ref, idx, rec.id, CASE WHEN a.id IS NOT NULL THEN a.id ELSE b.id END AS sid, CASE WHEN a.id IS NOT NULL THEN a.strong ELSE b.strong END AS strong, CASE WHEN a.id IS NOT NULL THEN a.lemma ELSE b.lemma END AS lemma FROM rec LEFT JOIN src a ON a.corpus = rec.corpus AND a.id = s1 AND a.strong <> '' LEFT JOIN src b ON b.corpus = rec.corpus AND b.id = s2 AND b.strong <> '')"


@query("words", f"WITH {_ALIGNED} SELECT p.ref, p.id AS target_id, 'n' || sid AS source_id, surface, p.strong, p.lemma, method, corpus AS source_corpus, 'V1' AS version FROM pick p JOIN tok ON tok.id = p.id WHERE sid IS NOT NULL")
def src_21_occurrences(t):
    return aligned.attestations(*_aligned(t))


@query("words", f"WITH {_ALIGNED}, c AS (SELECT id, strong FROM pick WHERE sid IS NOT NULL AND (corpus = 'WLC' OR method = 'manual')), j AS (SELECT tok.ref, tok.id, surface, c.strong, idx % 5 = 0 AS skip FROM tok LEFT JOIN c ON c.id = tok.id) SELECT 'V1' AS version, ref, trim(string_agg(surface || CASE WHEN skip THEN '' ELSE ' ' END, '' ORDER BY id)) AS text, coalesce(array_to_string(list_sort(list_distinct(list(strong) FILTER (strong IS NOT NULL))), ','), '') AS strongs, string_agg(surface || '=' || coalesce(strong, ''), ' ' ORDER BY id) AS tokens FROM j GROUP BY ref")
def src_20_verses(t):
    own = aligned.aligned_verses(*_aligned(t))
    shown = F.array_join(F.transform("tokens", lambda x: F.concat(x["surface"], F.lit("="), F.coalesce(x["strong"], F.lit("")))), " ")
    return own.select("version", "ref", "text", F.array_join("strongs", ",").alias("strongs"), shown.alias("tokens"))


@query("words", f"WITH RECURSIVE {_TOKENS}, n AS (SELECT ref * 100 + idx AS node, * FROM tok), w AS (SELECT node, morph, lag(node) OVER v AS p, lag(morph) OVER v AS pm FROM n WINDOW v AS (PARTITION BY ref ORDER BY node)), l AS (SELECT node, p AS tgt FROM w WHERE morph = 'P' AND pm IN ('P', 'N-msa')), r AS (SELECT node, tgt, 1 AS hops FROM l UNION ALL SELECT r.node, l.tgt, hops + 1 FROM r JOIN l ON l.node = r.tgt WHERE hops < 8), e AS (SELECT node, tgt FROM r WHERE tgt NOT IN (SELECT node FROM l)), q AS (SELECT conv_id::BIGINT AS question, turn::BIGINT AS place, (conv_id % 66 + 1) * 1000000 + (turn + 1) * 1000 + conv_id // 66 * 20 + 1 + turn % 3 AS ref FROM conversations), q8 AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY question ORDER BY place, ref) <= 8) SELECT question, place, q8.ref, row_number() OVER (PARTITION BY question, place, q8.ref ORDER BY n.node) AS \"at\", n.surface AS word, n.lemma, a.lemma AS refers_to, a.ref AS there FROM q8 JOIN n ON n.ref = q8.ref JOIN e ON e.node = n.node JOIN n a ON a.node = e.tgt QUALIFY row_number() OVER (PARTITION BY question, place, q8.ref ORDER BY n.node) <= 12")
def api_13_participants(t):
    tokens = _tokens(t).withColumn("node", F.col("ref") * 100 + F.col("idx"))
    w = Window.partitionBy("ref").orderBy("node")  # at most twelve tokens
    before = tokens.select("node", "morph", F.lag("node").over(w).alias("refers_to"), F.lag("morph").over(w).alias("kind"))
    links = before.where("morph = 'P' AND kind IN ('P', 'N-msa')").select("node", "refers_to")
    c, n = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    ref = (c % 66 + 1) * 1000000 + (n + 1) * 1000 + F.floor(c / 66) * 20 + 1 + n % 3
    cited = t.table("conversations").select(c.alias("question"), n.alias("place"), ref.cast("long").alias("ref"))
    return coreference.participants(cited, tokens, links)
