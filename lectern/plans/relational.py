"""Queries of filters, projections, joins, sorts and sets (FLT, PRJ, JN, SRT, SET)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text
from lectern.operators import intervals, ranking, tags
from lectern.plans.registry import query

_SPANS = [(1001001, 1020999), (40001001, 45050999), (66001001, 66999999)]
_ANY = " OR ".join(f"(s <= {b} AND e >= {a})" for a, b in _SPANS)


@query("refs", f"SELECT DISTINCT doc_id FROM refs WHERE {_ANY}")
def flt_01_overlap_any(t):
    return intervals.overlapping(t.refs(), _SPANS).select("doc_id").distinct()


@query("tags refs", "SELECT doc_id, s FROM refs WHERE EXISTS (SELECT 1 FROM tags WHERE tags.doc_id = refs.doc_id AND tag = 'resource:aquifer')")
def flt_02_source(t):
    return tags.from_source(t.refs(), t.tags(), "aquifer").select("doc_id", "s")


@query("tags refs", "SELECT doc_id FROM refs WHERE doc_id IN (SELECT doc_id FROM tags WHERE tag IN ('kind:article', 'kind:note')) AND doc_id NOT IN (SELECT doc_id FROM tags WHERE tag = 'resource:aquifer')")
def flt_03_kind(t):
    return tags.untagged(tags.tagged(t.refs(), t.tags(), "kind:article", "kind:note"), t.tags(), "resource:aquifer").select("doc_id")


@query("tags refs", "SELECT doc_id FROM refs WHERE NOT EXISTS (SELECT 1 FROM tags WHERE tags.doc_id = refs.doc_id AND tag IN ('kind:bible', 'kind:morphology'))")
def flt_04_not_exists(t):
    return tags.untagged(t.refs(), t.tags(), "kind:bible", "kind:morphology").select("doc_id")


@query("tags refs", "SELECT doc_id FROM refs WHERE doc_id IN (SELECT doc_id FROM tags WHERE tag = 'lang:en') AND doc_id IN (SELECT doc_id FROM tags WHERE tag = 'quality:1')")
def flt_05_optional(t):
    of = lambda x: t.tags().where(F.col("tag") == x)
    return tags.intersected(t.refs(), of("lang:en"), None, of("quality:1")).select("doc_id")


@query("refs", "SELECT doc_id, e - s AS width, e - s < 999 AS narrow FROM refs WHERE e - s <= 3000")
def flt_06_width(t):
    w = F.col("e") - F.col("s")
    return t.refs().where(w <= 3000).select("doc_id", w.alias("width"), (w < 999).alias("narrow"))


_NEAR = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), near AS (SELECT q, vec_id, sim, rn FROM (SELECT q.vec_id AS q, v.vec_id, round(list_dot_product(q.x, v.x), 6) AS sim, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.x, v.x), 6) DESC, v.vec_id) AS rn FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0) WHERE rn <= 80)"


@query("tags", f"WITH {_NEAR} SELECT q, vec_id, sim FROM near WHERE vec_id IN (SELECT doc_id FROM tags WHERE tag = 'lang:en')")
def flt_07_post_filter(t):
    from lectern.operators.vectors import ranked_neighbours

    v = t.table("embeddings")
    near = ranked_neighbours(v.where("vec_id % 50 = 0"), v, 80)
    return near.join(t.tags().where("tag = 'lang:en'").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").select("q", "vec_id", "sim")


@query("tags refs", "WITH l AS (SELECT doc_id, list(tag) AS tags FROM tags GROUP BY doc_id) SELECT refs.doc_id FROM refs LEFT JOIN l USING (doc_id) WHERE CASE WHEN list_contains(tags, 'kind:bible') THEN list_contains(tags, 'lang:de') ELSE list_contains(tags, 'lang:de') OR list_contains(tags, 'lang:en') END")
def flt_08_language_gate(t):
    return tags.language_gate(t.refs(), t.tags(), "de").select("doc_id")


@query("words", "SELECT book, chapter, verse, idx FROM words WHERE morph ILIKE '%v%' AND chapter = 2")
def flt_10_morph_pattern(t):
    return t.words().where(F.col("morph").ilike("%v%") & (F.col("chapter") == 2)).select("book", "chapter", "verse", "idx")


@query("words", "SELECT book, chapter, verse, idx, surface FROM words WHERE morph[1] IN ('N', 'V') AND is_content = 1 AND len(surface) BETWEEN 5 AND 9")
def flt_11_features(t):
    return t.words().where(F.substring("morph", 1, 1).isin("N", "V") & (F.col("is_content") == 1) & F.length("surface").between(5, 9)).select("book", "chapter", "verse", "idx", "surface")


@query("words", "SELECT a.book, a.chapter, a.verse, a.idx AS noun, min(b.idx) AS verb FROM words a JOIN words b USING (book, chapter, verse) WHERE a.morph = 'N-msa' AND b.morph = 'V-qal' AND b.idx > a.idx GROUP BY ALL")
def flt_12_template(t):
    from lectern.operators.corpus import construction

    return construction(t.words(), "N-msa", "V-qal").select("book", "chapter", "verse", F.col("first").alias("noun"), F.col("second").alias("verb"))


@query("", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 45")
def flt_13_dynamic_where(t):
    from lectern.operators.corpus import frame_filter

    return frame_filter(t.table("lineitem"), l_returnflag="R", l_linestatus="F", l_shipmode=None).where("l_quantity > 45").select("l_orderkey", "l_linenumber")


@query("entities", "SELECT id, name FROM entities WHERE starts_with(lower(name), 'customer#0000') AND type = 'customer'")
def flt_14_prefix(t):
    return t.entities().where(F.lower("name").startswith("customer#0000") & (F.col("type") == "customer")).select("id", "name")


@query("titles", "SELECT doc_id FROM titles WHERE NOT upper(title[1]) BETWEEN 'A' AND 'Z'")
def flt_15_other_letters(t):
    return t.titles().where(~text.initial(F.col("title")).between("A", "Z")).select("doc_id")


@query("", f"WITH {_NEAR} SELECT q, vec_id, sim FROM near WHERE sim >= 0.5")
def flt_16_min_score(t):
    from lectern.operators.vectors import ranked_neighbours

    v = t.table("embeddings")
    return ranked_neighbours(v.where("vec_id % 50 = 0"), v, 80).where("sim >= 0.5").select("q", "vec_id", "sim")


@query("", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def flt_17_orphans(t):
    return t.table("embeddings").join(t.table("labels").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti").select("vec_id")


@query("", "SELECT page_id FROM pages WHERE NOT regexp_matches(url, '/(fr|de)/')")
def flt_18_stale(t):
    return t.table("pages").where(~F.col("url").rlike("/(fr|de)/")).select("page_id")


@query("titles chunks refs", "SELECT c.chunk_id, t.title, rtrim(c.body[1:80]) AS preview, '/' || r.s || '/' || r.e AS permalink FROM chunks c JOIN titles t USING (doc_id) JOIN refs r USING (doc_id)")
def prj_02_preview(t):
    link = F.concat(F.lit("/"), F.col("s").cast("string"), F.lit("/"), F.col("e").cast("string"))
    return t.chunks().join(t.titles(), "doc_id").join(t.refs(), "doc_id").select("chunk_id", "title", F.rtrim(F.substring("body", 1, 80)).alias("preview"), link.alias("permalink"))


@query("tags", "SELECT doc_id, list(tag ORDER BY p, tag) AS paths FROM (SELECT DISTINCT doc_id, tag, CASE WHEN tag LIKE 'kind:%' THEN 0 ELSE 1 END AS p FROM tags) GROUP BY doc_id")
def prj_03_tree_paths(t):
    own = t.tags().distinct().withColumn("x", F.struct(F.when(F.col("tag").startswith("kind:"), 0).otherwise(1).alias("p"), "tag"))
    return own.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["tag"]).alias("paths"))


@query("", "SELECT doc_id, text[1:CASE doc_id % 3 WHEN 0 THEN 100 WHEN 1 THEN 300 ELSE 50 END] AS body FROM documents")
def prj_04_body_caps(t):
    cap = F.when(F.col("doc_id") % 3 == 0, 100).when(F.col("doc_id") % 3 == 1, 300).otherwise(50)
    return t.table("documents").select("doc_id", F.substring("text", F.lit(1), cap).alias("body"))


@query("words", "SELECT surface AS g_word, strong AS sn, coalesce(morph, '') AS parsing, count(*) AS n FROM words GROUP BY ALL")
def prj_05_feature_map(t):
    return t.words().groupBy(F.col("surface").alias("g_word"), F.col("strong").alias("sn"), F.coalesce("morph", F.lit("")).alias("parsing")).agg(F.count("*").alias("n"))


@query("tokens", "WITH hit AS (SELECT chunk_id, min(pos) AS p FROM tokens WHERE term = 'the' GROUP BY chunk_id) SELECT chunk_id, string_agg(CASE WHEN term = 'the' THEN '<<the>>' ELSE term END, ' ' ORDER BY pos) AS snippet FROM tokens JOIN hit USING (chunk_id) WHERE pos BETWEEN p - 7 AND p + 8 GROUP BY chunk_id")
def prj_06_snippet(t):
    from lectern.operators.fts import snippets

    return snippets(t.tokens(), "the")


@query("chunks titles tags", "SELECT c.chunk_id, t.title, g.tag FROM chunks c JOIN titles t USING (doc_id) JOIN tags g USING (doc_id) WHERE g.tag LIKE 'kind:%'")
def jn_01_equi(t):
    return t.chunks().join(t.titles(), "doc_id").join(t.tags().where(F.col("tag").startswith("kind:")), "doc_id").select("chunk_id", "title", "tag")


@query("chunks titles", "SELECT t.doc_id, c.chunk_id FROM titles t JOIN chunks c USING (doc_id) WHERE chunk_index = 0")
def jn_02_canonical(t):
    return t.titles().join(t.chunks().where("chunk_index = 0"), "doc_id").select("doc_id", "chunk_id")


@query("tags titles", "SELECT doc_id, title FROM titles WHERE doc_id IN (SELECT doc_id FROM tags WHERE tag = 'toxic:1')")
def jn_03_semi(t):
    return tags.tagged(t.titles(), t.tags(), "toxic:1").select("doc_id", "title")


@query("tags titles", "SELECT doc_id, title FROM titles WHERE doc_id NOT IN (SELECT doc_id FROM tags WHERE tag LIKE 'quality:%')")
def jn_04_anti(t):
    return t.titles().join(t.tags().where(F.col("tag").startswith("quality:")).select("doc_id"), "doc_id", "left_anti").select("doc_id", "title")


@query("refs speakers", "SELECT doc_id, speaker, x.s AS ts, x.e AS te FROM refs r JOIN speakers x ON r.s <= x.e AND x.s <= r.e")
def jn_05_entity_overlap(t):
    x = t.speakers().select("speaker", F.col("s").alias("ts"), F.col("e").alias("te"))
    return intervals.overlap_join(t.refs(), x).select("doc_id", "speaker", "ts", "te")


@query("refs topics", "SELECT doc_id, topic_id FROM refs r JOIN topics x ON r.s <= x.e AND x.s <= r.e")
def jn_06_topic_overlap(t):
    x = t.topics().select("topic_id", F.col("s").alias("ts"), F.col("e").alias("te"))
    return intervals.overlap_join(t.refs(), x).select("doc_id", "topic_id")


@query("refs xref", "SELECT doc_id, count(*) AS n, min(rank) AS best FROM refs r JOIN xref x ON r.s <= x.te AND x.ts <= r.e GROUP BY doc_id")
def jn_07_xref_overlap(t):
    x = t.xref().groupBy("ts", "te").agg(F.count("*").alias("c"), F.min("rank").alias("rank"))
    return intervals.overlap_join(t.refs(), x).groupBy("doc_id").agg(F.sum("c").alias("n"), F.min("rank").alias("best"))


@query("refs speakers", "SELECT doc_id, speaker, count(*) AS n FROM refs r JOIN speakers x ON r.s BETWEEN x.s AND x.e GROUP BY ALL")
def jn_08_point_in_interval(t):
    p = t.refs().select("doc_id", F.col("s").alias("ref"))
    return intervals.within(p, t.speakers(), "ref").groupBy("doc_id", "speaker").agg(F.count("*").alias("n"))


@query("refs topics", "WITH p AS (SELECT topic_id, s + k AS ref FROM topics, unnest(range(0, e - s + 1)) AS u(k)) SELECT topic_id, doc_id FROM p JOIN refs ON refs.s = p.ref")
def jn_09_points(t):
    return intervals.points(t.topics()).select("topic_id", "ref").join(t.refs().select("doc_id", F.col("s").alias("ref")), "ref").select("topic_id", "doc_id")


@query("tags", "SELECT a.doc_id FROM tags a JOIN tags b USING (doc_id) WHERE a.tag = 'lang:fr' AND b.tag = 'quality:1'")
def jn_10_all_facets(t):
    ids = t.table("documents").select("doc_id")
    return tags.with_all(ids, t.tags(), "lang:fr", "quality:1")


@query("tags", "SELECT tag[8:] AS source, count(DISTINCT doc_id) AS n FROM tags WHERE tag LIKE 'source:%' GROUP BY 1")
def jn_11_prefix(t):
    return tags.facets(t.tags(), "source:").withColumnRenamed("value", "source")


@query("", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def jn_12_left(t):
    return t.table("documents").select("doc_id").join(t.table("labels").select("doc_id", "quality"), "doc_id", "left")


@query("", "SELECT d.doc_id FROM documents d LEFT JOIN embeddings v ON v.vec_id = d.doc_id WHERE v.vec_id IS NULL")
def jn_13_missing(t):
    return t.table("documents").select("doc_id").join(t.table("embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("tokens", "WITH v AS (SELECT DISTINCT term FROM tokens), g AS (SELECT term, min(term) OVER (PARTITION BY term[1:6]) AS stem FROM v WHERE len(term) <= 8) SELECT v.term, coalesce(a.stem, b.stem) AS gloss FROM v LEFT JOIN g a ON a.term = v.term LEFT JOIN (SELECT term[1:6] AS k, min(stem) AS stem FROM g GROUP BY 1) b ON b.k = v.term[1:6]")
def jn_14_fallback_key(t):
    v = t.tokens().select("term").distinct()
    key = F.substring("term", 1, 6)
    g = v.where(F.length("term") <= 8).withColumn("stem", F.min("term").over(Window.partitionBy(key)))
    back = g.groupBy(key.alias("k")).agg(F.min("stem").alias("other"))
    return v.join(g, "term", "left").join(back, F.substring(v["term"], 1, 6) == F.col("k"), "left").select(v["term"], F.coalesce("stem", "other").alias("gloss"))


@query("words", "WITH c AS (SELECT surface, strong, count(*) AS n FROM words GROUP BY 1, 2), s AS (SELECT strong, surface, round(n / sum(n) OVER (PARTITION BY strong), 4) AS share, row_number() OVER (PARTITION BY strong ORDER BY n DESC, surface) AS rn FROM c) SELECT strong, surface, share FROM s WHERE rn = 1")
def jn_15_name_bridge(t):
    c = t.words().groupBy("surface", "strong").agg(F.count("*").alias("n"))
    s = c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("strong")), 4))
    return ranking.first_wins(s, ["strong"], F.desc("n"), F.col("surface")).select("strong", "surface", "share")


@query("words", "WITH n AS (SELECT book, chapter, verse, count(*) AS n FROM words GROUP BY 1, 2, 3), b AS (SELECT book, chapter, verse, max(idx) AS last FROM words WHERE morph <> 'P' GROUP BY 1, 2, 3) SELECT w.book, w.chapter, w.verse, w.idx, least((w.idx * (b.last + 1)) // n.n, b.last) AS target FROM words w JOIN n USING (book, chapter, verse) JOIN b USING (book, chapter, verse) WHERE w.morph = 'P'")
def jn_17_positional(t):
    from lectern.operators.corpus import positional

    return positional(t.words())


@query("words", "SELECT a.surface AS a, b.surface AS b, count(*) AS votes FROM words a JOIN words b USING (book, chapter, verse) WHERE a.idx < b.idx AND a.surface <> b.surface AND (contains(b.surface, a.surface) OR contains(a.surface, b.surface)) GROUP BY 1, 2")
def jn_18_contained(t):
    w = t.words().select("book", "chapter", "verse", "idx", "surface")
    both = w.withColumnRenamed("surface", "a").join(w.select("book", "chapter", "verse", F.col("idx").alias("j"), F.col("surface").alias("b")), ["book", "chapter", "verse"])
    return both.where((F.col("idx") < F.col("j")) & (F.col("a") != F.col("b")) & (F.contains("b", "a") | F.contains("a", "b"))).groupBy("a", "b").agg(F.count("*").alias("votes"))


@query("occurrences", "WITH i AS (SELECT lex, stem, sense, min(surface) AS label FROM occurrences GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY node) AS rn FROM occurrences) SELECT f.ref, f.lex, i.label FROM f JOIN i USING (lex, stem, sense) WHERE rn = 1")
def jn_19_senses(t):
    o = t.occurrences("c", "t", "i")  # words that share a node: the first in reading order
    i = o.groupBy("lex", "stem", "sense").agg(F.min("surface").alias("label"))
    return ranking.first_wins(o, ["ref"], F.col("node"), *map(F.col, "cti")).join(i, ["lex", "stem", "sense"]).select("ref", "lex", "label")


@query("occurrences refs", "SELECT DISTINCT r.doc_id, 'lex:' || o.lex AS tag FROM refs r JOIN occurrences o ON o.ref = r.s WHERE r.s = r.e")
def jn_20_occurrence_tags(t):
    return t.refs().where("s = e").join(t.occurrences().withColumnRenamed("ref", "s"), "s").select("doc_id", F.concat(F.lit("lex:"), "lex").alias("tag")).distinct()


@query("tokens", "WITH b AS (SELECT chunk_id, pos, term || ' ' || lead(term) OVER (PARTITION BY chunk_id ORDER BY pos) AS pair FROM tokens), top AS (SELECT pair FROM b WHERE pair IS NOT NULL GROUP BY pair ORDER BY count(*) DESC, pair LIMIT 50) SELECT chunk_id, pair, pos, row_number() OVER (PARTITION BY chunk_id, pair ORDER BY pos) AS occurrence FROM b JOIN top USING (pair)")
def jn_21_spans(t):
    from lectern.operators.fts import ngrams

    b = ngrams(t.tokens(), 2)
    top = b.groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gram").limit(50)
    return b.join(top, "gram").withColumn("occurrence", F.row_number().over(Window.partitionBy("chunk_id", "gram").orderBy("pos")).cast("long")).select("chunk_id", F.col("gram").alias("pair"), "pos", "occurrence")


@query("", f"WITH {_NEAR} SELECT q, vec_id, sim FROM near WHERE rn <= 10")
def jn_22_cosine_pairs(t):
    from lectern.operators.vectors import ranked_neighbours

    v = t.table("embeddings")
    return ranked_neighbours(v.where("vec_id % 50 = 0"), v, 10).select("q", "vec_id", "sim")


@query("words", "WITH v AS (SELECT book, chapter, verse, min(idx) AS lo, max(idx) AS hi FROM words GROUP BY 1, 2, 3) SELECT w.book, w.chapter, w.verse, w.idx, hi - lo + 1 AS size FROM words w JOIN v USING (book, chapter, verse) WHERE w.idx BETWEEN lo AND hi AND w.is_content = 1")
def jn_23_containment(t):
    w = t.words()
    v = w.groupBy("book", "chapter", "verse").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    return w.where("is_content = 1").join(v, ["book", "chapter", "verse"]).where(F.col("idx").between(F.col("lo"), F.col("hi"))).select("book", "chapter", "verse", "idx", (F.col("hi") - F.col("lo") + 1).alias("size"))


@query("edges entities", "SELECT a.name AS source, relation, b.name AS target FROM edges JOIN entities a ON a.id = source_id JOIN entities b ON b.id = target_id")
def jn_24_pointers(t):
    e = t.entities().select("id", "name")
    a, b = e.toDF("source_id", "source"), e.toDF("target_id", "target")
    return t.edges().join(a, "source_id").join(b, "target_id").select("source", "relation", "target")


@query("refs", "SELECT doc_id, s, row_number() OVER (ORDER BY s // 1000000, s // 1000 % 1000, s % 1000, doc_id) AS place FROM refs ORDER BY place LIMIT 500")
def srt_01_canonical(t):
    top = ranking.top_k(t.refs(), 500, F.col("s"), F.col("doc_id"))  # the key's order is the canonical order
    return top.withColumn("place", F.row_number().over(Window.orderBy("s", "doc_id")).cast("long")).select("doc_id", "s", "place")


@query("xref", "SELECT source, ts, te, attribution, rank FROM xref ORDER BY CASE attribution WHEN 'F' THEN 0 ELSE 1 END, rank NULLS LAST, source, ts, te LIMIT 300")
def srt_02_nulls_last(t):
    return t.xref().orderBy(F.when(F.col("attribution") == "F", 0).otherwise(1), F.asc_nulls_last("rank"), "source", "ts", "te").limit(300)


@query("titles", "SELECT doc_id, title, (SELECT count(*) FROM titles) AS total FROM titles ORDER BY title, doc_id LIMIT 20 OFFSET 40")
def srt_03_page(t):
    total = t.titles().agg(F.count("*").alias("total"))
    return ranking.page(t.titles(), 40, 20, F.asc_nulls_last("title"), F.asc_nulls_last("doc_id")).crossJoin(F.broadcast(total))


@query("", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def srt_04_top_k(t):
    return ranking.top_k(t.table("orders").select("o_orderkey", "o_totalprice"), 25, F.desc("o_totalprice"), F.col("o_orderkey"))


@query("", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 30")
def srt_05_dense_top(t):
    return ranking.top_k(t.table("events").select("event_id", "value"), 30, F.desc("value"), F.col("event_id"))


@query("words", "WITH n AS (SELECT lemma, count(*) AS n, min(book * 100000000 + chapter * 100000 + verse * 100 + idx) AS node FROM words GROUP BY lemma) SELECT lemma, n, node FROM n ORDER BY n, lemma LIMIT 100")
def srt_06_rare_first(t):
    from lectern.operators.corpus import lexeme_feed

    return lexeme_feed(t.words(), "rare", 100)


@query("titles", "SELECT doc_id, doc_id % 17 = 0 AS featured FROM titles ORDER BY doc_id % 17 = 0 DESC, title, doc_id LIMIT 50")
def srt_07_featured(t):
    f = t.titles().withColumn("featured", F.col("doc_id") % 17 == 0)
    return f.orderBy(F.desc("featured"), F.asc_nulls_last("title"), "doc_id").limit(50).select("doc_id", "featured")


@query("entities", "SELECT type, id FROM (SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY length(metadata) DESC, id) AS rn FROM entities) WHERE rn = 1")
def srt_08_richest(t):
    return ranking.first_wins(t.entities(), ["type"], F.desc(F.length("metadata")), F.col("id")).select("type", "id")


@query("tags refs", "SELECT doc_id FROM tags WHERE tag = 'toxic:1' UNION SELECT doc_id FROM refs WHERE e - s > 900")
def set_01_union(t):
    return t.tags().where("tag = 'toxic:1'").select("doc_id").union(t.refs().where("e - s > 900").select("doc_id")).distinct()


@query("titles", "SELECT doc_id, title, NULL::BIGINT AS n FROM titles UNION ALL SELECT item_id, NULL, length(text) FROM benchmark")
def set_02_union_all(t):
    b = t.table("benchmark").select(F.col("item_id").alias("doc_id"), F.length("text").cast("long").alias("n"))
    return t.titles().unionByName(b, allowMissingColumns=True)


@query("tags", "SELECT doc_id FROM tags WHERE tag = 'lang:en' INTERSECT SELECT doc_id FROM tags WHERE tag = 'quality:1'")
def set_03_intersection(t):
    return t.tags().where("tag = 'lang:en'").select("doc_id").intersect(t.tags().where("tag = 'quality:1'").select("doc_id"))


@query("tags", "SELECT doc_id FROM tags WHERE tag LIKE 'kind:%' EXCEPT SELECT doc_id FROM tags WHERE tag = 'resource:aquifer'")
def set_04_difference(t):
    return t.tags().where("tag like 'kind:%'").select("doc_id").subtract(t.tags().where("tag = 'resource:aquifer'").select("doc_id"))


_STOP = ", ".join(f"('{w}')" for w in text.STOPWORDS)


@query("tokens", f"SELECT w FROM (VALUES {_STOP}) AS s(w) UNION SELECT term FROM tokens GROUP BY term HAVING count(DISTINCT chunk_id) > 0.2 * (SELECT count(DISTINCT chunk_id) FROM tokens)")
def set_05_stopwords(t):
    hand = t.spark.createDataFrame([(w,) for w in text.STOPWORDS], "w string")
    total = t.tokens().agg(F.countDistinct("chunk_id").alias("total"))
    often = t.tokens().groupBy(F.col("term").alias("w")).agg(F.countDistinct("chunk_id").alias("n")).crossJoin(F.broadcast(total)).where("n > 0.2 * total").select("w")
    return hand.union(often).distinct()


@query("tokens", "SELECT DISTINCT chunk_id FROM tokens WHERE term IN ('the', 'die', 'les', 'los')")
def set_06_distinct(t):
    return t.tokens().where(F.col("term").isin("the", "die", "les", "los")).select("chunk_id").distinct()
