"""Queries of scans: documents, graphs and inherited passages out of tables shaped like the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.plans.registry import query
from lectern.plans.surface import _BOOK
from lectern.sources import scans

_FOLD = "translate(lower(lemma), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
_SLUG = f"regexp_replace(regexp_replace({_FOLD}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_REF = "book * 1000000 + chapter * 1000 + verse AS ref"
_PLACE = "(ref // 1000 % 1000) || ':' || (ref % 1000)"


@query("words", f"""WITH w AS (SELECT DISTINCT {_REF}, idx, surface, lemma, strong, morph, is_content FROM words), l AS (SELECT ref, idx, strong, {_SLUG} AS slug, morph, '**' || surface || '** *' || lemma || '* [' || strong || CASE WHEN is_content = 1 THEN ' / ' || morph ELSE '' END || ']' || CASE WHEN is_content = 1 THEN ' = "' || substr(surface, 1, 3) || '"' ELSE '' END AS line, is_content FROM w),
v AS (SELECT ref, list(line ORDER BY idx, line) AS l, list_distinct(list('strongs:' || strong)) AS s, list_distinct(list('lemma:' || slug) FILTER (slug <> '')) AS m, list_distinct(coalesce(list('morph:' || morph) FILTER (is_content = 1), [])) AS p FROM l GROUP BY ref)
SELECT ref, CASE WHEN ref < 40000000 THEN 'TAHOT' ELSE 'TAGNT' END || ' — ' || {_BOOK}[ref // 1000000] || ' ' || {_PLACE} AS title, array_to_string(list_sort(list_concat(list_concat(['kind:morphology', 'book:' || {_BOOK}[ref // 1000000], 'lang:' || CASE WHEN ref < 40000000 THEN 'hbo' ELSE 'grc' END], s), list_concat(coalesce(m, []), p))), ' ') AS tags, array_to_string(list_transform(range(1, len(l) + 1), lambda i: i || '. ' || l[i]), '|') AS body FROM v""")
def src_11_morph_docs(t):
    content = F.col("is_content") == 1
    w = t.words().select((F.col("book") * 1000000 + F.col("chapter") * 1000 + F.col("verse")).alias("ref"), "idx", F.col("surface").alias("original"), F.col("lemma").alias("translit"), "strong", F.when(content, F.col("morph")).alias("morph"), F.when(content, F.substring("surface", 1, 3)).alias("gloss")).distinct()
    own = scans.morphology_documents(w.withColumn("strongs", F.array("strong")).drop("strong"))
    return own.select("ref", "title", F.array_join("tags", " ").alias("tags"), F.replace("body", F.lit("\n"), F.lit("|")).alias("body"))


@query("words", f"""WITH v AS (SELECT {_REF}, string_agg(surface, ' ' ORDER BY idx, surface) AS text, list_distinct(list('G' || (substr(strong, 2)::INT % 50) || CASE WHEN idx = 0 THEN 'x!' WHEN idx = 1 THEN 'a' ELSE '' END)) AS codes FROM words GROUP BY ALL), c AS (SELECT ref, text, list_distinct(list_transform(list_filter(codes, lambda c: NOT contains(c, '!')), lambda c: 'strongs:G' || lpad(regexp_extract(c, '[0-9]+'), 4, '0') || CASE WHEN suffix(c, 'a') THEN 'a' ELSE '' END)) AS s FROM v)
SELECT ref, 'bible' AS kind, 'BSB — ' || {_BOOK}[ref // 1000000] || ' ' || {_PLACE} AS title, array_to_string(list_sort(list_concat(['kind:bible', 'book:' || {_BOOK}[ref // 1000000], 'lang:en', 'resource:bsb'], s)), ' ') AS tags, text AS body FROM c
UNION ALL SELECT ref, 'section-heading', 'Heading: ' || text, array_to_string(list_sort(['kind:section-heading', 'book:' || {_BOOK}[ref // 1000000], 'lang:en', 'resource:bsb', 'heading-level:' || level]), ' '), text FROM (SELECT (conv_id % 66 + 1) * 1000000 + (turn + 1) * 1000 + 1 AS ref, ['s1', 's2', 's3', 'd'][turn % 4 + 1] AS level, role || ' ' || conv_id AS text FROM conversations) WHERE level IN ('s1', 's2')""")
def src_13_verse_docs(t):
    ref = (F.col("book") * 1000000 + F.col("chapter") * 1000 + F.col("verse")).alias("ref")
    code = F.concat(F.lit("G"), (F.substring("strong", 2, 8).cast("int") % 50).cast("string"), F.when(F.col("idx") == 0, "x!").when(F.col("idx") == 1, "a").otherwise(""))
    v = t.words().select(ref, "idx", "surface", code.alias("code")).groupBy("ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "surface"))), lambda x: x["surface"]), " ").alias("text"), F.collect_set("code").alias("codes"))
    c, n = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    level = F.element_at(F.array(*map(F.lit, ("s1", "s2", "s3", "d"))), (n % 4 + 1).cast("int"))
    h = t.table("conversations").select(((c % 66 + 1) * 1000000 + (n + 1) * 1000 + 1).alias("ref"), level.alias("level"), F.concat("role", F.lit(" "), c.cast("string")).alias("text"))
    both = scans.verse_documents(v, "bsb").unionByName(scans.heading_documents(h, "bsb"))
    return both.withColumn("tags", F.array_join("tags", " "))


@query("", """WITH p AS (SELECT c_custkey AS k, c_name, c_nationkey FROM customer), n AS (SELECT n_nationkey, n_name FROM nation), v AS (
SELECT 'vertex' AS part, 'person:' || k AS a, CASE WHEN k % 6 = 0 THEN k::VARCHAR ELSE c_name END AS b, 'person' AS c FROM p UNION ALL SELECT 'vertex', 'place:' || n_nationkey, n_name, 'place' FROM n UNION ALL SELECT 'vertex', 'event:' || o_orderkey, 'E' || o_orderkey, 'event' FROM orders),
e AS (SELECT 'edge', 'person:' || (k // 2), 'person:' || k, 'father-of' FROM p WHERE k % 3 = 0 UNION ALL SELECT 'edge', 'person:' || k, 'person:' || (k + 1), 'partner-of' FROM p WHERE k % 4 = 0 UNION ALL SELECT 'edge', 'person:' || k, 'person:' || o, 'sibling-of' FROM (SELECT k, k + 2 AS o FROM p UNION ALL SELECT k, k + 7 FROM p) WHERE 'person:' || k < 'person:' || o UNION ALL SELECT 'edge', 'person:' || o_custkey, 'event:' || o_orderkey, 'participates-in' FROM orders UNION ALL SELECT 'edge', 'event:' || o_orderkey, 'place:' || (o_custkey % 25), 'occurred-at' FROM orders),
m AS (SELECT 'mention', 'person:' || k, (1000000 + (k % 50 + 1) * 1000 + 1)::VARCHAR, 'ref' FROM p UNION ALL SELECT 'mention', 'place:' || n_nationkey, '2003004', 'ref' FROM n)
SELECT * FROM v UNION ALL SELECT * FROM e UNION ALL SELECT * FROM m""")
def src_14_lists(t):
    """Vertices, edges and mentions of people, places and events whose lists are comma lists."""
    k, s = F.col("c_custkey"), lambda x: x.cast("string")
    none = F.lit(None).cast("string")
    people = t.table("customer").select(
        s(k).alias("id"), F.when(k % 6 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.when(k % 3 == 0, s(F.floor(k / 2).cast("long"))).alias("father"), none.alias("mother"), F.when(k % 4 == 0, F.concat(s(k + 1), F.lit(", "))).alias("partners"),
        F.concat(s(k + 2), F.lit(" ,,"), s(k + 7)).alias("siblings"), F.concat(F.lit("GEN."), s(k % 50 + 1), F.lit(".1, XXX.1.1, GEN")).alias("verses"),
    )
    places = t.table("nation").select(s(F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name"), F.lit("EXO.3.4").alias("verses"))
    o = F.col("o_orderkey")
    events = t.table("orders").select(s(o).alias("id"), F.concat(F.lit("E"), s(o)).alias("title"), s(F.col("o_custkey")).alias("participants"), s(F.col("o_custkey") % 25).alias("locations"), none.alias("verses"))
    vertices, edges, mentions = scans.graph(people, places, events)
    out = vertices.select(F.lit("vertex").alias("part"), F.col("id").alias("a"), F.col("name").alias("b"), F.col("type").alias("c"))
    out = out.unionByName(edges.select(F.lit("edge").alias("part"), F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("relation").alias("c")))
    return out.unionByName(mentions.select(F.lit("mention").alias("part"), F.col("id").alias("a"), s(F.col("ref")).alias("b"), F.lit("ref").alias("c")))


@query("", "WITH c AS (SELECT conv_id::BIGINT AS c, turn::BIGINT AS t FROM conversations), x AS (SELECT c, t, (c % 66 + 1) * 1000000 + (t + 1) * 1000 AS a, (c * 3 % 66 + 1) * 1000000 + (t + 1) * 1000 + t + 2 AS b FROM c) SELECT c AS conv_id, t AS turn, CASE WHEN t % 2 = 0 THEN (a + 1) || '-' || (a + 999) || CASE WHEN t % 3 = 0 THEN ' ' || b || '-' || b ELSE '' END ELSE (a + 5) || '-' || (a + 5) || CASE WHEN t % 3 = 0 AND b <> a + 5 THEN ' ' || b || '-' || b ELSE '' END END AS passages, array_to_string(list_sort(list_distinct(['book:' || " + _BOOK + "[c % 66 + 1]] || CASE WHEN t % 3 = 0 THEN ['book:' || " + _BOOK + "[c * 3 % 66 + 1]] ELSE [] END)), ' ') AS tags FROM x")
def src_25_chunk_passages(t):
    c, n = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    from lectern.functions.refs import code_of

    ref = lambda book, chapter, verse: F.struct(book.alias("book"), chapter.cast("long").alias("chapter"), verse.cast("long").alias("verse"))
    first = ref(F.lower(code_of(c % 66 + 1)), n + 1, F.when(n % 2 == 1, 5))
    lost, odd = ref(F.lit("???"), n, F.lit(1)), ref(code_of(c % 66 + 1), F.lit(None), F.lit(3))
    primary = F.when(n % 3 == 0, ref(code_of(c * 3 % 66 + 1), n + 1, n + 2))
    own = scans.chunk_passages(t.table("conversations").select(c.alias("conv_id"), n.alias("turn"), F.array(first, lost, first, odd).alias("found"), primary.alias("primary")).withColumn("key", F.struct("conv_id", "turn")), "key")
    spans = F.array_join(F.transform("passages", lambda p: F.concat_ws("-", p["s"].cast("string"), p["e"].cast("string"))), " ")
    return own.select("key.conv_id", "key.turn", spans.alias("passages"), F.array_join("tags", " ").alias("tags"))


@query("", "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'H' ELSE 'G' END || lpad((p_partkey % 9000)::VARCHAR, 4, '0') AS code, 'LSJ — ' || p_brand || ' (' || CASE WHEN p_partkey % 2 = 0 THEN 'H' ELSE 'G' END || lpad((p_partkey % 9000)::VARCHAR, 4, '0') || ')' AS title, array_to_string(list_sort(['kind:lexicon', 'resource:lsj', 'strongs:' || CASE WHEN p_partkey % 2 = 0 THEN 'H' ELSE 'G' END || lpad((p_partkey % 9000)::VARCHAR, 4, '0'), 'lang:' || CASE WHEN p_partkey % 2 = 0 THEN 'hbo' ELSE 'grc' END, 'lemma:' || regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')]), ' ') AS tags, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type || '||' END || '**' || p_name || '** & *' || p_type || '*|size ' || p_size AS body FROM part WHERE p_partkey % 10 <> 0")
def src_16_lexicons(t):
    k, s = F.col("p_partkey"), lambda x: x.cast("string")
    code = F.when(k % 10 == 0, F.concat(F.lit("X"), s(k))).otherwise(F.concat(F.when(k % 2 == 0, "H").otherwise("G"), s(k % 9000)))
    html = F.concat(F.lit('<p class="x"><b>'), "p_name", F.lit("</b>  &amp; <i>"), "p_type", F.lit("</i><br/> <font size=1>size "), s(F.col("p_size")), F.lit("</font></p>"))
    entries = t.table("part").select(code.alias("code"), F.col("p_brand").alias("headword"), F.col("p_brand").alias("translit"), F.when(k % 3 == 0, " ").otherwise(F.col("p_type")).alias("short"), html.alias("html"))
    return scans.lexicon_documents(entries, "lsj").withColumn("tags", F.array_join("tags", " ")).withColumn("body", F.replace("body", F.lit("\n"), F.lit("|")))


@query("", "WITH a AS (SELECT p_partkey AS k, 'bible/' || CASE WHEN p_size > 25 THEN 'kt' ELSE 'other' END || '/term-' || p_partkey AS path, p_name AS text, CASE WHEN p_size > 25 THEN 'kt' ELSE 'other' END AS category FROM part WHERE p_partkey % 13 <> 0), l AS (SELECT DISTINCT l_partkey AS k, 1000000 * (l_suppkey % 66 + 1) + 1001 AS s, 1000000 * (l_suppkey % 66 + 1) + 1005 AS e FROM lineitem), g AS (SELECT k, string_agg(s || '-' || e, ' ' ORDER BY s, e) AS passages, list_distinct(list('book:' || " + _BOOK + "[s // 1000000])) AS books FROM l GROUP BY k) SELECT path, 'TW — Term ' || k || ' (' || category || ')' AS title, array_to_string(list_sort(list_concat(list_concat(['kind:term', 'lang:en', 'category:' || category, 'term:term-' || k], books), CASE WHEN k % 2 = 0 THEN ['strongs:H' || lpad((k % 997)::VARCHAR, 4, '0')] ELSE [] END)), ' ') AS tags, passages, trim(text) AS body FROM a JOIN g USING (k)")
def src_19_inheritance(t):
    """Articles with the passages of all links to them, and their terms' codes."""
    k = F.col("p_partkey")
    path = F.concat(F.lit("bible/"), F.when(F.col("p_size") > 25, "kt").otherwise("other"), F.lit("/term-"), k.cast("string"))
    part = t.table("part").select(k.alias("l_partkey"), path.alias("path"), F.when(k % 13 != 0, F.col("p_name")).alias("text"))
    s = (F.lit(1000000) * (F.col("l_suppkey") % 66 + 1) + 1001).cast("long")
    links = t.table("lineitem").select("l_partkey", s.alias("s"), (s + 4).alias("e")).join(part.select("l_partkey", "path"), "l_partkey").drop("l_partkey")
    codes = t.table("part").where("p_partkey % 2 = 0").select(F.concat(F.lit("Term "), k.cast("string")).alias("term"), F.concat(F.lit("H"), F.lpad((k % 997).cast("string"), 4, "0")).alias("code"))
    own = scans.inherited(part.drop("l_partkey"), links, codes)
    spans = F.array_join(F.transform("passages", lambda p: F.concat_ws("-", p["s"].cast("string"), p["e"].cast("string"))), " ")
    return own.select("path", "title", F.array_join("tags", " ").alias("tags"), spans.alias("passages"), "body")
