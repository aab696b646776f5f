"""Queries of aggregations, window-like operators and derived tables (AGG, WIN, ETL)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import initial
from lectern.operators import ranking, tags
from lectern.operators.intervals import within
from lectern.plans.registry import query


@query("tags", "SELECT tag[6:] AS value, count(DISTINCT doc_id) AS n FROM tags WHERE tag LIKE 'kind:%' GROUP BY 1")
def agg_01_facets(t):
    return tags.facets(t.tags(), "kind:")


@query("titles", "SELECT CASE WHEN upper(title[1]) BETWEEN 'A' AND 'Z' THEN upper(title[1]) ELSE '#' END AS letter, count(*) AS n FROM titles GROUP BY 1")
def agg_02_letters(t):
    c = initial(F.col("title"))
    return t.titles().groupBy(F.when(c.between("A", "Z"), c).otherwise("#").alias("letter")).agg(F.count("*").alias("n"))


@query("", "SELECT greatest(p_partkey // 100 * 100, 1) AS bucket, count(*) AS n FROM part GROUP BY 1")
def agg_03_buckets(t):
    b = (F.floor(F.col("p_partkey") / 100) * 100).cast("long")
    return t.table("part").groupBy(F.greatest(b, F.lit(1)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


@query("tags", "SELECT split_part(tag, ':', 1) AS ns, split_part(tag, ':', 2) AS value, count(*) AS n FROM tags GROUP BY 1, 2")
def agg_04_tag_types(t):
    part = lambda i: F.split_part("tag", F.lit(":"), F.lit(i))
    return t.tags().groupBy(part(1).alias("ns"), part(2).alias("value")).agg(F.count("*").alias("n"))


@query("topics", "SELECT name, min(s) AS s, max(e) AS e FROM topics GROUP BY name")
def agg_05_envelope(t):
    return t.topics().groupBy("name").agg(F.min("s").alias("s"), F.max("e").alias("e"))


@query("words", "SELECT strong, count(*) AS total, count(*) FILTER (book <= 39) AS ot, count(*) FILTER (book > 39) AS nt, sum(is_content)::BIGINT AS content, sum(is_content) < count(*) / 2.0 AS is_function FROM words GROUP BY strong")
def agg_06_frequency(t):
    n = F.count("*")
    return t.words().groupBy("strong").agg(n.alias("total"), F.count_if(F.col("book") <= 39).alias("ot"), F.count_if(F.col("book") > 39).alias("nt"), F.sum("is_content").alias("content"), (F.sum("is_content") < n / 2).alias("is_function"))


@query("words", "WITH c AS (SELECT strong, lemma, count(*) AS n FROM words GROUP BY 1, 2) SELECT strong, arg_min(lemma, (-n, lemma)) AS lemma, string_agg(lemma, '|' ORDER BY lemma) AS variants, sum(n)::BIGINT AS total FROM c GROUP BY strong")
def agg_07_primary_lemma(t):
    c = t.words().groupBy("strong", "lemma").agg(F.count("*").alias("n"))
    return c.groupBy("strong").agg(F.min_by("lemma", F.struct(-F.col("n"), "lemma")).alias("lemma"), F.array_join(F.array_sort(F.collect_list("lemma")), "|").alias("variants"), F.sum("n").alias("total"))


@query("words", "SELECT surface, count(*) AS n, min(book * 1000000 + chapter * 1000 + verse) AS first_ref, mode(lemma) AS lemma FROM words GROUP BY surface")
def agg_08_surfaces(t):
    ref = F.col("book") * 1000000 + F.col("chapter") * 1000 + F.col("verse")
    return t.words().groupBy("surface").agg(F.count("*").alias("n"), F.min(ref).alias("first_ref"), F.mode("lemma").alias("lemma"))


@query("words", "SELECT surface, strong, n, round(n / sum(n) OVER (PARTITION BY strong), 4) AS share FROM (SELECT surface, strong, count(*) AS n FROM words GROUP BY 1, 2)")
def agg_09_surface_codes(t):
    return ranking.share(t.words().groupBy("surface", "strong").agg(F.count("*").alias("n")), "n", ["strong"], digits=4)


@query("words", "SELECT strong, string_agg(surface, ',' ORDER BY n DESC, surface) AS surfaces FROM (SELECT strong, surface, count(*) AS n FROM words GROUP BY 1, 2) GROUP BY strong")
def agg_10_inversion(t):
    c = t.words().groupBy("strong", "surface").agg((-F.count("*")).alias("m"))
    return c.groupBy("strong").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("m", "surface"))), lambda x: x["surface"]), ",").alias("surfaces"))


_SURF = "c AS (SELECT surface, strong, count(*) AS n FROM words GROUP BY 1, 2), f AS (SELECT strong, sum(is_content) < count(*) / 2.0 AS fn FROM words GROUP BY strong), p AS (SELECT surface, strong, n, n / sum(n) OVER (PARTITION BY surface) AS share FROM c)"


@query("words", f"WITH {_SURF} SELECT surface, sum(n)::BIGINT AS n, string_agg(strong, ',' ORDER BY strong) AS codes, round(max(share), 3) AS share FROM p JOIN f USING (strong) WHERE share >= 0.10 GROUP BY surface HAVING bool_and(fn) AND sum(n) >= 3")
def agg_11_function_words(t):
    w = t.words()
    p = ranking.share(w.groupBy("surface", "strong").agg(F.count("*").alias("n")), "n", ["surface"], digits=12)
    f = w.groupBy("strong").agg((F.sum("is_content") < F.count("*") / 2).alias("fn"))
    own = p.where("share >= 0.10").join(f, "strong").groupBy("surface").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list("strong")), ",").alias("codes"), F.round(F.max("share"), 3).alias("share"), F.bool_and("fn").alias("ok"))
    return own.where("ok AND n >= 3").drop("ok")


@query("", "SELECT source, lang, n, share FROM (SELECT source, lang, n, round(n / sum(n) OVER (PARTITION BY source), 3) AS share, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS rn FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)) WHERE rn = 1 OR n >= 2")
def agg_12_domains(t):
    from lectern.operators.derive import top_or_frequent

    return top_or_frequent(t.table("documents").groupBy("source", "lang").agg(F.count("*").alias("n")), "source", "lang")


@query("", "WITH b AS (SELECT l_suppkey AS h, l_partkey % 50 AS g, count(*) AS n FROM lineitem GROUP BY 1, 2), d AS (SELECT p_partkey % 50 AS g, p_brand AS domain, count(*) AS c FROM part GROUP BY 1, 2), s AS (SELECT g, domain, c / sum(c) OVER (PARTITION BY g) AS share FROM d), w AS (SELECT h, domain, sum(n * share) AS weight FROM b JOIN s USING (g) GROUP BY 1, 2), r AS (SELECT h, domain, weight, weight / sum(weight) OVER (PARTITION BY h) AS share, row_number() OVER (PARTITION BY h ORDER BY round(weight, 6) DESC, domain) AS rn FROM w) SELECT h, domain, greatest(1, round(weight, 6)::BIGINT) AS n FROM r WHERE rn = 1 OR share >= 0.15")
def agg_13_bridge_projection(t):
    b = t.table("lineitem").groupBy(F.col("l_suppkey").alias("h"), (F.col("l_partkey") % 50).alias("g")).agg(F.count("*").alias("n"))
    d = t.table("part").groupBy((F.col("p_partkey") % 50).alias("g"), F.col("p_brand").alias("domain")).agg(F.count("*").alias("c"))
    s = d.withColumn("share", F.col("c") / F.sum("c").over(Window.partitionBy("g")))
    w = b.join(s, "g").groupBy("h", "domain").agg(F.sum(F.col("n") * F.col("share")).alias("weight"))
    r = w.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("h"))).withColumn("rn", F.row_number().over(Window.partitionBy("h").orderBy(F.desc(F.round("weight", 6)), "domain")))
    return r.where("rn = 1 OR share >= 0.15").select("h", "domain", F.greatest(F.lit(1), F.rint(F.round("weight", 6)).cast("long")).cast("long").alias("n"))


_SENSE = "c AS (SELECT lex, stem, sense, count(*) AS n, min(surface) AS label FROM occurrences GROUP BY 1, 2, 3)"


@query("occurrences", f"WITH {_SENSE} SELECT lex, stem, sense, n, label, rank, share FROM (SELECT *, row_number() OVER (PARTITION BY lex, stem ORDER BY n DESC, sense) AS rank, round(n / sum(n) OVER (PARTITION BY lex, stem), 3) AS share FROM c) WHERE rank = 1 OR n >= 2")
def agg_14_sense_inventory(t):
    from lectern.operators.derive import sense_inventory

    return sense_inventory(t.occurrences())


@query("", "SELECT s, p, n FROM (SELECT l_suppkey AS s, l_partkey AS p, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_partkey) AS rn FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 2) WHERE rn <= 4")
def agg_15_bridge_top(t):
    c = t.table("lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).agg(F.count("*").alias("n")).where("n >= 2")
    return ranking.per_key(c, ["s"], 4, F.desc("n"), F.col("p")).select("s", "p", "n")


def topic_lexemes(t):
    """name, lex, n: the words within a topic's passages; topics of one passage meet its words once, summed up by lexeme."""
    counted = t.occurrences().groupBy("ref", "lex").agg(F.count("*").alias("c"))
    topics = t.topics().groupBy("name", "s", "e").agg(F.count("*").alias("m"))
    passages = within(counted, topics.select("s", "e").distinct(), "ref").groupBy("s", "e", "lex").agg(F.sum("c").alias("c"))
    return topics.join(passages, ["s", "e"]).groupBy("name", "lex").agg(F.sum(F.col("m") * F.col("c")).alias("n"))


@query("topics occurrences", "SELECT name, lex, count(*) AS n FROM topics JOIN occurrences ON ref BETWEEN s AND e GROUP BY 1, 2")
def agg_16_topic_codes(t):
    return topic_lexemes(t)


@query("occurrences", "SELECT lex, stem, count(*) AS n, arg_max(sense, node) AS last_sense, arg_min(surface, node) AS first_surface FROM occurrences GROUP BY 1, 2")
def agg_17_first_last(t):
    return t.occurrences().groupBy("lex", "stem").agg(F.count("*").alias("n"), F.max_by("sense", "node").alias("last_sense"), F.min_by("surface", "node").alias("first_surface"))


_REG = "g AS (SELECT DISTINCT strong, surface, is_content FROM words), e AS (SELECT surface, count(DISTINCT strong) FILTER (is_content = 1) AS k FROM g GROUP BY surface), n AS (SELECT strong, count(*) AS n FROM words GROUP BY strong)"


@query("words", "SELECT strong, surface, CASE WHEN grouping(morph) = 1 THEN 'all' ELSE morph END AS method, count(*) AS n, count(DISTINCT book * 1000000 + chapter * 1000 + verse) AS verses FROM words GROUP BY GROUPING SETS ((strong, surface, morph), (strong, surface))")
def agg_19_attestation(t):
    from lectern.operators.derive import attestation

    return attestation(t.words())


@query("words", "SELECT lemma, string_agg(DISTINCT morph, ',' ORDER BY morph) AS methods, string_agg(DISTINCT strong, ',' ORDER BY strong) AS sources FROM words GROUP BY lemma")
def agg_20_gloss_family(t):
    s = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return t.words().groupBy("lemma").agg(s("morph").alias("methods"), s("strong").alias("sources"))


@query("words", "SELECT lemma, n, row_number() OVER (ORDER BY n DESC, lemma) - 1 AS rank FROM (SELECT lemma, count(*) AS n FROM words GROUP BY lemma)")
def agg_21_lexeme_rank(t):
    n = t.words().groupBy("lemma").agg(F.count("*").alias("n"))
    return n.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("n"), "lemma")) - 1).cast("long"))


@query("words", "SELECT lemma, strong FROM (SELECT lemma, strong, row_number() OVER (PARTITION BY lemma ORDER BY count(*) DESC, strong) AS rn FROM words GROUP BY 1, 2) WHERE rn = 1")
def agg_22_dominant_code(t):
    c = t.words().groupBy("lemma", "strong").agg(F.count("*").alias("n"))
    return ranking.first_wins(c, ["lemma"], F.desc("n"), F.col("strong")).select("lemma", "strong")


@query("words", "WITH ex AS (SELECT surface, min(strong) AS s FROM words GROUP BY surface HAVING count(*) >= 20), v AS (SELECT lemma, strong, n / sum(n) OVER (PARTITION BY lemma) AS share FROM (SELECT lemma, strong, count(*) AS n FROM words GROUP BY 1, 2)), vote AS (SELECT lemma, min(strong) AS s FROM v WHERE share >= 0.7 GROUP BY lemma), sk AS (SELECT lemma[1:3] AS k, min(strong) AS s FROM words GROUP BY 1 HAVING count(DISTINCT strong) = 1) SELECT DISTINCT w.surface, coalesce(ex.s, vote.s, sk.s) AS strong FROM words w LEFT JOIN ex USING (surface) LEFT JOIN vote USING (lemma) LEFT JOIN sk ON sk.k = w.lemma[1:3]")
def agg_23_resolver(t):
    from lectern.operators.derive import three_tiers

    return three_tiers(t.words())


@query("occurrences", "SELECT lex, stem, sense, count(*) AS n, list_slice(list(ref ORDER BY node), 1, 6) AS sample FROM occurrences GROUP BY 1, 2, 3")
def agg_24_occurrence_groups(t):
    first = F.slice(F.array_sort(F.collect_list(F.struct("node", "ref"))), 1, 6)
    return t.occurrences().groupBy("lex", "stem", "sense").agg(F.count("*").alias("n"), F.transform(first, lambda x: x["ref"]).alias("sample"))


@query("titles tokens", "WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(title), '[a-zà-öø-ÿß]{3,}')) AS word FROM titles), c AS (SELECT term AS word, count(*) AS n FROM tokens GROUP BY term) SELECT word, doc_id, coalesce(n, 0) AS n FROM w LEFT JOIN c USING (word)")
def agg_25_reverse_gloss(t):
    from lectern.functions.text import terms

    w = t.titles().select("doc_id", F.explode(F.array_distinct(terms(F.col("title")))).alias("word"))
    c = t.tokens().groupBy(F.col("term").alias("word")).agg(F.count("*").alias("n"))
    return w.join(c, "word", "left").select("word", "doc_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("words", "WITH c AS (SELECT strong, lemma, count(*) AS n FROM words GROUP BY 1, 2), s AS (SELECT strong, lemma, n, n / sum(n) OVER (PARTITION BY strong) AS share FROM c), p AS (SELECT strong, lemma[1:3] AS parent, sum(share) AS share, arg_min(lemma, (-n, lemma)) AS child FROM s GROUP BY 1, 2) SELECT strong, parent, child FROM p WHERE share >= 0.6")
def agg_26_rollup(t):
    s = ranking.share(t.words().groupBy("strong", "lemma").agg(F.count("*").alias("n")), "n", ["strong"], digits=12)
    p = s.groupBy("strong", F.substring("lemma", 1, 3).alias("parent")).agg(F.sum("share").alias("share"), F.min_by("lemma", F.struct(-F.col("n"), "lemma")).alias("child"))
    return p.where("share >= 0.6").select("strong", "parent", "child")


@query("speakers", "SELECT speaker, count(*) AS n, bool_or(divine) AS divine FROM speakers GROUP BY speaker")
def agg_27_speakers(t):
    return t.speakers().groupBy("speaker").agg(F.count("*").alias("n"), F.bool_or("divine").alias("divine"))


@query("words", "WITH f AS (SELECT lemma, count(*) AS corpus FROM words GROUP BY lemma) SELECT book, chapter, lemma, count(*) AS n, any_value(corpus) AS corpus FROM words JOIN f USING (lemma) GROUP BY 1, 2, 3")
def agg_28_vocabulary(t):
    w = t.words()
    f = w.groupBy("lemma").agg(F.count("*").alias("corpus"))
    return w.groupBy("book", "chapter", "lemma").agg(F.count("*").alias("n")).join(f, "lemma").select("book", "chapter", "lemma", "n", "corpus")


@query("", "SELECT event_type, count(*) AS n, count(props) > 0 AS has_props, max(value) > 0 AS has_value FROM events GROUP BY 1")
def agg_29_object_types(t):
    return t.table("events").groupBy("event_type").agg(F.count("*").alias("n"), (F.count("props") > 0).alias("has_props"), (F.max("value") > 0).alias("has_value"))


@query("tokens", "WITH m AS (SELECT term FROM tokens GROUP BY term ORDER BY count(*) DESC, term LIMIT 60) SELECT chunk_id, count(DISTINCT term) AS score FROM tokens JOIN m USING (term) GROUP BY chunk_id")
def agg_30_domain_overlap(t):
    m = t.tokens().groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(60).select("term")
    return t.tokens().join(F.broadcast(m), "term").groupBy("chunk_id").agg(F.countDistinct("term").alias("score"))


@query("tokens titles", "SELECT chunk_id, count(*) AS n FROM tokens JOIN titles USING (doc_id) WHERE contains(lower(title), term) GROUP BY chunk_id")
def agg_31_anchor_matches(t):
    met = t.bags().join(t.titles().withColumn("title", F.lower("title")), "doc_id")  # a chunk travels as one row, not one for each word
    n = F.size(F.filter("words", lambda w: F.contains("title", w)))
    return met.select("chunk_id", n.alias("n")).where("n > 0").groupBy("chunk_id").agg(F.sum("n").alias("n"))


@query("chunks refs tags", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'chunks', count(*) FROM chunks UNION ALL SELECT 'refs', count(*) FROM refs UNION ALL SELECT 'tags', count(*) FROM tags")
def agg_33_index_stats(t):
    n = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return n("documents", t.table("documents")).unionByName(n("chunks", t.chunks())).unionByName(n("refs", t.refs())).unionByName(n("tags", t.tags()))


@query("", "SELECT source, max(n) FILTER (lang = 'de') AS de, max(n) FILTER (lang = 'en') AS en, max(n) FILTER (lang = 'es') AS es, max(n) FILTER (lang = 'fr') AS fr FROM (SELECT source, lang, count(*) || CASE WHEN count(*) < 10 THEN ' *' ELSE '' END AS n FROM documents GROUP BY 1, 2) GROUP BY source")
def agg_34_wide(t):
    c = F.count("*")
    n = t.table("documents").groupBy("source", "lang").agg(F.concat(c.cast("string"), F.when(c < 10, " *").otherwise("")).alias("n"))
    return n.groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).agg(F.first("n"))


@query("words", "SELECT book, avg((morph = 'P')::INT) > 0.01 AS triangulation, avg(is_content) < 0.99 AS coverage FROM words GROUP BY book")
def agg_36_fidelity(t):
    return t.words().groupBy("book").agg((F.avg((F.col("morph") == "P").cast("int")) > 0.01).alias("triangulation"), (F.avg("is_content") < 0.99).alias("coverage"))


@query("", "SELECT o_orderkey, round(1.0 - 1.0 * (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) - 1) / count(*) OVER (PARTITION BY o_orderpriority), 6) AS score FROM orders")
def win_01_decay(t):
    return ranking.decayed(t.table("orders"), 1.0, 1.0, F.desc("o_totalprice"), F.col("o_orderkey"), keys=["o_orderpriority"]).select("o_orderkey", "score")


@query("", "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2")
def win_02_top_per_key(t):
    return ranking.per_key(t.table("orders"), ["o_custkey"], 2, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "rn")


@query("", "SELECT l_orderkey, l_linenumber, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey), 3) AS share FROM lineitem")
def win_03_share(t):
    return ranking.share(t.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", ["l_orderkey"]).drop("l_quantity")


@query("occurrences", f"WITH {_SENSE} SELECT lex, stem, sense, row_number() OVER (PARTITION BY lex, stem ORDER BY n DESC, sense) AS number FROM c")
def win_04_sense_numbers(t):
    c = t.occurrences().groupBy("lex", "stem", "sense").agg(F.count("*").alias("n"))
    return c.withColumn("number", F.row_number().over(Window.partitionBy("lex", "stem").orderBy(F.desc("n"), "sense")).cast("long")).drop("n")


@query("refs", "WITH d AS (SELECT s, min(doc_id) AS doc_id FROM refs GROUP BY s), f AS (SELECT s, doc_id, CASE WHEN s - lag(s) OVER (ORDER BY s) <= 2 THEN 0 ELSE 1 END AS new FROM d), i AS (SELECT s, doc_id, sum(new) OVER (ORDER BY s) AS island FROM f) SELECT min(s) AS s, max(s) AS e, count(*) AS n, min(doc_id) AS best FROM i GROUP BY island")
def win_05_consolidation(t):
    from lectern.operators.derive import consolidated

    return consolidated(t.refs().groupBy("s").agg(F.min("doc_id").alias("doc_id")), 2)


@query("", "SELECT event_id, lag(ts) OVER w AS since, lead(ts) OVER w AS until FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def win_07_segments(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.table("events").select("event_id", F.lag("ts").over(w).alias("since"), F.lead("ts").over(w).alias("until"))


@query("", "WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w), 1), 650)) AS start FROM w) SELECT doc_id, start // 650 AS chunk, start, len(list_slice(w, start + 1, start + 800)) AS n FROM s")
def win_08_sliding(t):
    w = t.table("documents").select("doc_id", F.split("text", " ").alias("w"))
    return ranking.sliding(w, "w").select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("start").cast("long").alias("start"), F.size("slice").cast("long").alias("n"))


@query("xref", "SELECT source, arg_min(ts, (rank, ts)) AS first FROM xref WHERE rank IS NOT NULL GROUP BY source")
def win_09_first_wins(t):
    return t.xref().where("rank IS NOT NULL").groupBy("source").agg(F.min_by("ts", F.struct("rank", "ts")).alias("first"))


@query("", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS marker FROM events")
def win_10_carried(t):
    e = t.table("events").withColumn("m", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return ranking.carried(e, ["user_id"], "event_id", "m", "marker").select("event_id", "marker")


@query("", "WITH n AS (SELECT p_partkey, lower(replace(p_name, ' ', '-')) AS slug, CASE WHEN row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) > 1 THEN 1 ELSE 0 END AS again FROM part) SELECT p_partkey, CASE WHEN again = 1 THEN slug || '-' || sum(again) OVER (ORDER BY p_partkey) ELSE slug END AS id FROM n")
def win_11_collisions(t):
    p = t.table("part").select("p_partkey", F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("slug"))
    return ranking.suffixed(p, "slug", "p_partkey", "id").select("p_partkey", "id")


@query("", "SELECT event_type, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1")
def win_12_latency(t):
    return t.table("events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


@query("words occurrences", "WITH v AS (SELECT book * 1000000 + chapter * 1000 + verse AS ref, string_agg(surface, ' ' ORDER BY idx, surface) AS context FROM words GROUP BY 1) SELECT node, ref, lex, context FROM occurrences JOIN v USING (ref)")
def etl_01_sidecar(t):
    o = t.occurrences()
    ordered = F.array_sort(F.collect_list(F.struct("node", "surface")))  # by reference: long verses of one chapter share those of the next
    context = o.groupBy("ref").agg(F.array_join(F.transform(ordered, lambda x: x["surface"]), " ").alias("context"))
    return o.join(context, "ref").select("node", "ref", "lex", "context")


@query("words", "SELECT strong, surface, n FROM (SELECT strong, surface, count(*) AS n, row_number() OVER (PARTITION BY strong ORDER BY sum(is_content) DESC, count(*) DESC, surface) AS rn FROM words GROUP BY 1, 2) WHERE rn = 1")
def etl_03_heads(t):
    c = t.words().groupBy("strong", "surface").agg(F.count("*").alias("n"), F.sum("is_content").alias("c"))
    return ranking.first_wins(c, ["strong"], F.desc("c"), F.desc("n"), F.col("surface")).select("strong", "surface", "n")


@query("", "WITH n AS (SELECT p_brand AS code, p_name AS name FROM part GROUP BY ALL), d AS (SELECT code, name, row_number() OVER (PARTITION BY code ORDER BY len(string_split(name, ' ')), len(name), name) AS rn FROM n), o AS (SELECT name FROM n GROUP BY name HAVING count(DISTINCT code) = 1) SELECT d.code, d.name AS display, (SELECT count(*) FROM n JOIN o USING (name) WHERE n.code = d.code) AS aliases FROM d WHERE rn = 1")
def etl_07_names(t):
    n = t.table("part").select(F.col("p_brand").alias("code"), F.col("p_name").alias("name")).distinct()
    d = ranking.first_wins(n, ["code"], F.size(F.split("name", " ")), F.length("name"), F.col("name"))
    o = n.groupBy("name").agg(F.count("*").alias("k")).where("k = 1")
    a = n.join(o, "name").groupBy("code").agg(F.count("*").alias("aliases"))
    return d.join(a, "code", "left").select("code", F.col("name").alias("display"), F.coalesce("aliases", F.lit(0)).alias("aliases"))


@query("words", "SELECT DISTINCT lemma FROM words WHERE lemma NOT IN (SELECT lemma FROM words WHERE is_content = 1 GROUP BY lemma)")
def etl_08_worklist(t):
    return t.words().select("lemma").distinct().join(t.words().where("is_content = 1").select("lemma"), "lemma", "left_anti")
