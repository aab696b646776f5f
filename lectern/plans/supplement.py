"""Queries of sources, sinks, evaluation and the remaining views (SRC, SNK, SUP, API)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import refs
from lectern.operators import corpus, derive, evaluate, intervals, ranking, tags
from lectern.plans.registry import query
from lectern.sources import files


@query("refs", "SELECT doc_id, least(s, e) AS s, greatest(s, e) AS e FROM refs WHERE doc_id % 3 <> 0")
def src_02_coercion(t):
    pair = F.when(F.col("doc_id") % 3 == 0, F.array("s")).otherwise(F.array("e", "s"))
    return t.refs().select("doc_id", refs.coerced(pair).alias("p")).where("p is not null").select("doc_id", "p.s", "p.e")


@query("", "SELECT doc_id, sha256(text)[1:16] AS digest FROM documents")
def src_04_digest(t):
    return t.table("documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("digest"))


@query("", "SELECT doc_id, 1 AS chapter, i::INT AS verse, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS text FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE NOT contains(s, chr(92))")
def src_06_usfm(t):
    lines = F.filter(F.transform(F.split("text", "\n"), lambda s, i: F.concat(F.lit("\\v "), (i + 1).cast("string"), F.lit(" @"), s)), lambda s: ~F.contains(F.substring(s, 4, 1 << 20), F.lit("\\")))
    marked = t.table("documents").select("doc_id", F.concat(F.lit("\\id GEN\n\\c 1\n"), F.array_join(lines, "\n")).alias("u"))
    v = marked.select("doc_id", F.explode(files.usfm_verses("u")).alias("v")).select("doc_id", "v.*")
    return v.withColumn("text", F.trim(F.regexp_replace("text", "^@", "")))


@query("words", "SELECT book, chapter, verse, idx + 1 AS idx, surface, strong[2:]::BIGINT::VARCHAR AS strong, morph FROM words")
def src_08_inline_tagged(t):
    w = t.words().withColumn("key", corpus.node())
    marked = w.select("book", "chapter", "verse", (F.col("idx") + 1).alias("at"), F.concat("surface", F.lit("<S>"), F.substring("strong", 2, 10).cast("long").cast("string"), F.lit("</S><m>"), "morph", F.lit("</m>")).alias("x"))
    return files.inline_tagged(marked, ["book", "chapter", "verse", "at"], "x").drop("idx").withColumnRenamed("at", "idx")


@query("", "SELECT DISTINCT l_orderkey AS verb, 'A' || (l_linenumber % 3) AS role, l_partkey::VARCHAR AS arg FROM lineitem")
def src_09_frames(t):
    one = F.concat(F.lit("A"), (F.col("l_linenumber") % 3).cast("string"), F.lit(":"), F.col("l_partkey").cast("string"), F.lit(";"))
    own = t.table("lineitem").groupBy(F.col("l_orderkey").alias("verb")).agg(F.array_join(F.collect_list(one), " ").alias("frame"))
    return files.frames(own, "verb", "frame")


@query("", "WITH f AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS g FROM f) SELECT user_id, g, event_type, list(event_id ORDER BY event_id) AS values FROM g GROUP BY 1, 2, 3")
def src_10_consecutive(t):
    e = t.table("events").select("user_id", "event_id", "event_type").withColumn("v", F.col("event_id"))
    return files.consecutive(e, "event_id", "event_type", "v", ["user_id"])


@query("xref", "SELECT source, ts, te, row_number() OVER (PARTITION BY source ORDER BY ts, te) AS place FROM (SELECT DISTINCT source, ts, te FROM xref)")
def src_12_json_rank(t):
    x = t.xref().select("source", "ts", "te").distinct()
    own = x.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("ts", "te"))).alias("l"))
    return own.select("source", F.posexplode("l").alias("i", "x")).select("source", "x.ts", "x.te", (F.col("i") + 1).cast("long").alias("place"))


@query("", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS topic FROM events")
def src_15_current_topic(t):
    e = t.table("events").withColumn("m", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return ranking.carried(e, ["user_id"], "event_id", "m", "topic").select("event_id", "topic")


@query()
def src_16_html(t):
    return t.table("pages").select("page_id", files.html_text("html").alias("text"))


@query("", "SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, coalesce(nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), ''), '0')::BIGINT AS page FROM pages")
def src_17_urls(t):
    page = F.nullif(F.regexp_extract("url", r"[?&]page=([0-9]+)", 1), F.lit(""))
    return t.table("pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), F.coalesce(page, F.lit("0")).cast("long").alias("page"))


@query("", "SELECT page_id, len(regexp_extract_all(html, 'href=\"[^\"]*\"')) AS links FROM pages")
def src_18_links(t):
    return t.table("pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit('href="[^"]*"'), F.lit(0))).cast("long").alias("links"))


@query("", "SELECT event_id, try_cast(props->>'k' AS BIGINT) AS k FROM events WHERE try_cast(props->>'k' AS BIGINT) IS NOT NULL")
def src_27_bad_numbers(t):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return t.table("events").select("event_id", k.alias("k")).where("k is not null")


@query("refs", "SELECT doc_id, s, e FROM refs WHERE s <= 20999999 AND e >= 10000000 ORDER BY s, doc_id LIMIT 50")
def sup_01_passage_lookup(t):
    return intervals.overlapping(t.refs(), [(10000000, 20999999)]).orderBy("s", "doc_id").limit(50)


@query("tags", "SELECT doc_id FROM tags WHERE tag = 'source:src3' ORDER BY doc_id LIMIT 50")
def sup_02_tag_lookup(t):
    return t.tags().where("tag = 'source:src3'").select("doc_id").orderBy("doc_id").limit(50)


@query("refs", "SELECT doc_id, s <= 30999999 AND 20000000 <= e AS met FROM refs")
def sup_03_overlap(t):
    return t.refs().select("doc_id", evaluate.overlaps(F.col("s"), F.col("e"), F.lit(20000000), F.lit(30999999)).alias("met"))


@query("refs topics", "WITH e AS (SELECT doc_id % 20 AS case_id, s, e FROM refs), f AS (SELECT topic_id % 20 AS case_id, s, e FROM topics) SELECT case_id, round(avg(hit), 4) AS recall FROM (SELECT e.case_id, (EXISTS (SELECT 1 FROM f WHERE f.case_id = e.case_id AND f.s <= e.e AND e.s <= f.e))::INT AS hit FROM e) GROUP BY case_id")
def sup_04_passage_recall(t):
    expected = t.refs().select((F.col("doc_id") % 20).alias("case_id"), "s", "e")
    found = t.topics().select((F.col("topic_id") % 20).alias("case_id"), F.col("s").alias("ts"), F.col("e").alias("te"))
    return evaluate.passage_recall(expected, found)


@query("tags", "SELECT doc_id, round(len(list_intersect(['lang:en', 'quality:1', 'toxic:0'], list(tag))) / 3, 4) AS recall FROM tags GROUP BY doc_id")
def sup_05_tag_recall(t):
    own = t.tags().groupBy("doc_id").agg(F.collect_list("tag").alias("l"))
    return own.select("doc_id", evaluate.tag_recall(F.array(*map(F.lit, ("lang:en", "quality:1", "toxic:0"))), F.col("l")).alias("recall"))


@query("", "SELECT conv_id, turn, regexp_matches(lower(text), '(cannot|can''t|unable to|don''t have)\\b.{0,40}\\b(answer|help|information|find)') AS refusal FROM conversations")
def sup_06_refusal(t):
    return t.table("conversations").select("conv_id", "turn", evaluate.is_refusal(F.col("text")).alias("refusal"))


@query("words", "WITH v AS (SELECT book, chapter, verse, min(lemma) AS lemma FROM words GROUP BY 1, 2, 3 HAVING count(DISTINCT lemma) = 1) SELECT book, chapter, verse, lemma FROM (SELECT *, row_number() OVER (PARTITION BY lemma ORDER BY book, chapter, verse) AS rn FROM v) WHERE rn <= 3")
def sup_10_unambiguous(t):
    v = t.words().groupBy("book", "chapter", "verse").agg(F.min("lemma").alias("lemma"), F.countDistinct("lemma").alias("k")).where("k = 1").drop("k")
    return ranking.per_key(v, ["lemma"], 3, F.col("book"), F.col("chapter"), F.col("verse")).drop("rn")


@query("tokens", "SELECT term, count(*) AS n FROM tokens WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'en') GROUP BY term")
def sup_11_other_corpus(t):
    own = t.table("documents").where("lang <> 'en'").select("doc_id")
    return t.tokens().join(own, "doc_id", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


@query("words", "SELECT lemma, morph FROM (SELECT lemma, morph, row_number() OVER (PARTITION BY lemma ORDER BY count(*) DESC, morph) AS rn FROM words GROUP BY 1, 2) WHERE rn = 1 AND morph <> 'P'")
def sup_12_dominant_pos(t):
    c = t.words().groupBy("lemma", "morph").agg(F.count("*").alias("n"))
    return ranking.first_wins(c, ["lemma"], F.desc("n"), F.col("morph")).where("morph <> 'P'").select("lemma", "morph")


@query("words", "WITH l AS (SELECT lemma[1:3] AS k, min(surface) AS label FROM words WHERE morph = 'N-msa' GROUP BY 1), e AS (SELECT lemma, min(surface) AS label FROM words WHERE morph = 'V-qal' GROUP BY 1) SELECT w.lemma, coalesce(e.label, l.label) AS label FROM (SELECT DISTINCT lemma FROM words) w LEFT JOIN e USING (lemma) LEFT JOIN l ON l.k = w.lemma[1:3]")
def sup_13_label_fallback(t):
    w = t.words()
    e = w.where("morph = 'V-qal'").groupBy("lemma").agg(F.min("surface").alias("a"))
    l = w.where("morph = 'N-msa'").groupBy(F.substring("lemma", 1, 3).alias("k")).agg(F.min("surface").alias("b"))
    return w.select("lemma").distinct().join(e, "lemma", "left").join(l, F.substring("lemma", 1, 3) == F.col("k"), "left").select("lemma", F.coalesce("a", "b").alias("label"))


@query("", "SELECT p_partkey, 'type' AS axis, p_type AS value FROM part UNION ALL SELECT p_partkey, 'brand', p_brand FROM part UNION ALL SELECT p_partkey, 'name', p_name FROM part")
def sup_14_unpivot(t):
    p = t.table("part").select("p_partkey", F.col("p_type").alias("type"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"))
    return p.unpivot("p_partkey", ["type", "brand", "name"], "axis", "value")


@query("occurrences", "WITH c AS (SELECT lex, stem, sense, count(*) AS n, min(surface) AS label FROM occurrences GROUP BY 1, 2, 3) SELECT lex, stem, sense, n, label, rank, share FROM (SELECT *, row_number() OVER (PARTITION BY lex, stem ORDER BY n DESC, sense) AS rank, round(n / sum(n) OVER (PARTITION BY lex, stem), 3) AS share FROM c) WHERE rank = 1 OR n >= 2")
def sup_15_senses(t):
    return derive.sense_inventory(t.occurrences())


@query("speakers", "SELECT speaker, bool_or(divine OR s % 7 = 0) AS divine FROM speakers GROUP BY speaker")
def sup_16_divinity(t):
    return t.speakers().groupBy("speaker").agg(F.bool_or(F.col("divine") | (F.col("s") % 7 == 0)).alias("divine"))


@query("", "SELECT p_partkey, trim(regexp_replace(p_name, '\\s*\\([^)]*\\)', '', 'g')) AS base FROM part")
def sup_17_base_names(t):
    return t.table("part").select("p_partkey", F.trim(F.regexp_replace("p_name", r"\s*\([^)]*\)", "")).alias("base"))


@query("words", "WITH v AS (SELECT DISTINCT surface FROM words), k AS (SELECT surface FROM words GROUP BY surface HAVING count(*) >= 5) SELECT surface, surface IN (SELECT surface FROM k) OR (surface LIKE '%s' AND surface[1:len(surface) - 1] IN (SELECT surface FROM k)) AS known FROM v")
def sup_19_membership(t):
    k = t.words().groupBy("surface").agg(F.count("*").alias("n")).where("n >= 5").select("surface")
    v = t.words().select("surface").distinct()
    cut = F.when(F.col("surface").endswith("s"), F.expr("substring(surface, 1, length(surface) - 1)"))
    own = v.withColumn("cut", cut).join(k.withColumn("a", F.lit(True)), "surface", "left").join(k.toDF("cut").withColumn("b", F.lit(True)), "cut", "left")
    return own.select("surface", (F.coalesce("a", F.lit(False)) | F.coalesce("b", F.lit(False))).alias("known"))


@query("words", "WITH c AS (SELECT strong, lemma[1:3] AS domain, count(*) AS n FROM words GROUP BY 1, 2), p AS (SELECT strong, arg_min(domain, (-n, domain)) AS domain FROM c GROUP BY strong) SELECT domain, list_sort(list(strong)) AS members FROM p GROUP BY domain")
def sup_20_primary_domain(t):
    c = t.words().groupBy("strong", F.substring("lemma", 1, 3).alias("domain")).agg(F.count("*").alias("n"))
    p = c.groupBy("strong").agg(F.min_by("domain", F.struct(-F.col("n"), "domain")).alias("domain"))
    return p.groupBy("domain").agg(F.array_sort(F.collect_list("strong")).alias("members"))


@query("refs", "SELECT s // 1000000 AS book, count(DISTINCT s // 1000 % 1000) AS chapters, count(*) AS docs FROM refs GROUP BY 1")
def sup_32_books(t):
    return t.refs().groupBy(refs.book_of(F.col("s")).alias("book")).agg(F.countDistinct(refs.chapter_of(F.col("s"))).alias("chapters"), F.count("*").alias("docs"))


@query("occurrences", "SELECT lex, stem, list_sort(list_distinct(list(sense))) AS senses FROM occurrences GROUP BY 1, 2")
def sup_34_inventory(t):
    return t.occurrences().groupBy("lex", "stem").agg(F.array_sort(F.collect_set("sense")).alias("senses"))


@query("refs", "SELECT DISTINCT doc_id, unnest(range(s // 1000000, e // 1000000 + 1)) AS book FROM refs")
def sup_37_book_span(t):
    return t.refs().select("doc_id", F.explode(F.sequence(refs.book_of(F.col("s")), refs.book_of(F.col("e")))).alias("book")).distinct()


@query("words", "SELECT lemma, count(DISTINCT morph) AS stems FROM words GROUP BY lemma HAVING count(DISTINCT morph) >= 2")
def sup_43_multi_stem(t):
    return t.words().groupBy("lemma").agg(F.countDistinct("morph").alias("stems")).where("stems >= 2")


@query("words", "WITH m AS (SELECT strong, min(strong) OVER (PARTITION BY strong[2:4]) AS canonical FROM (SELECT DISTINCT strong FROM words)) SELECT m.canonical AS code, count(*) AS n FROM words JOIN m USING (strong) GROUP BY 1")
def sup_44_remap(t):
    from pyspark.sql.window import Window

    m = t.words().select("strong").distinct().withColumn("canonical", F.min("strong").over(Window.partitionBy(F.substring("strong", 2, 3))))
    return t.words().join(m, "strong").groupBy(F.col("canonical").alias("code")).agg(F.count("*").alias("n"))


@query("", "SELECT lang, lang <> 'en' AS later FROM (SELECT DISTINCT lang FROM documents) ORDER BY lang <> 'en', lang")
def sup_45_languages(t):
    return t.table("documents").select("lang").distinct().withColumn("later", F.col("lang") != "en").orderBy("later", "lang")


@query("refs", "SELECT s // 1000000 AS book, s // 1000 % 1000 AS chapter, count(*) AS docs, min(s % 1000) AS first FROM refs GROUP BY 1, 2")
def api_08_tree(t):
    s = F.col("s")
    return t.refs().groupBy(refs.book_of(s).alias("book"), refs.chapter_of(s).alias("chapter")).agg(F.count("*").alias("docs"), F.min(refs.verse_of(s)).alias("first"))


@query("refs titles", "SELECT doc_id, title, s, e FROM titles JOIN refs USING (doc_id) WHERE s <= 40999999 AND e >= 40000000")
def api_09_pericope(t):
    return t.titles().join(intervals.overlapping(t.refs(), [(40000000, 40999999)]), "doc_id").select("doc_id", "title", "s", "e")


@query("tags titles", "SELECT tag, doc_id, title FROM (SELECT tag, doc_id, title, row_number() OVER (PARTITION BY tag ORDER BY title, doc_id) AS rn FROM tags JOIN titles USING (doc_id) WHERE tag LIKE 'kind:%') WHERE rn <= 300")
def api_10_leaves(t):
    own = t.tags().where(F.col("tag").startswith("kind:")).join(t.titles(), "doc_id")
    return ranking.per_key(own, ["tag"], 300, F.asc_nulls_last("title"), F.col("doc_id")).select("tag", "doc_id", "title")


@query("refs tags", "WITH p AS (SELECT a.doc_id, b.doc_id AS other FROM refs a JOIN refs b ON a.s <= b.e AND b.s <= a.e WHERE a.doc_id <> b.doc_id AND a.e - a.s < 100) SELECT doc_id, other FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY other) AS rn FROM p) WHERE rn <= 10")
def api_12_cross_refs(t):
    b = t.refs().select(F.col("doc_id").alias("other"), F.col("s").alias("ts"), F.col("e").alias("te"))
    p = intervals.overlap_join(t.refs().where("e - s < 100"), b).where("doc_id <> other").select("doc_id", "other")
    return ranking.per_key(p, ["doc_id"], 10, F.col("other")).drop("rn")
