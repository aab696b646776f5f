"""Queries of gates, composites, context lines, cards, editions and the build steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import context, ranking, study
from lectern.operators.analyze import detect_language
from lectern.operators.graph import cut
from lectern.plans.registry import query

#: Code-keyed dimensions out of the driver tables, as SQL; the functions below are the same in Spark.
_CODES = "codes AS (SELECT strong AS code, max(is_content) = 0 AS idle, count(*) AS n FROM words GROUP BY 1)"
_KEY = "keyness AS (SELECT code, (n % 7) / 7.0::DOUBLE AS score FROM codes WHERE n % 5 <> 0)"
_GLOSS = "glosses AS (SELECT DISTINCT lemma AS word, strong AS code, CASE WHEN surface = lemma THEN 2 ELSE 1 END AS quality FROM words)"
_ART = "articles AS (SELECT 'H' || lpad((p_partkey % 997)::VARCHAR, 4, '0') AS code, p_brand AS slug, p_name AS title, p_size > 25 AS head, p_size > 40 AS key, p_size::BIGINT AS n FROM part)"


def codes(t):
    return t.words().groupBy(F.col("strong").alias("code")).agg((F.max("is_content") == 0).alias("idle"), F.count("*").alias("n"))


def keyness(t):
    return codes(t).where("n % 5 != 0").select("code", ((F.col("n") % 7) / F.lit(7.0)).alias("score"))


def glosses(t):
    return t.words().select(F.col("lemma").alias("word"), F.col("strong").alias("code"), F.when(F.col("surface") == F.col("lemma"), 2).otherwise(1).alias("quality")).distinct()


def articles(t):
    code = F.concat(F.lit("H"), F.lpad((F.col("p_partkey") % 997).cast("string"), 4, "0"))
    return t.table("part").select(code.alias("code"), F.col("p_brand").alias("slug"), F.col("p_name").alias("title"), (F.col("p_size") > 25).alias("head"), (F.col("p_size") > 40).alias("key"), F.col("p_size").cast("long").alias("n"))


_GATES = f"{_CODES}, {_KEY}, {_GLOSS}, w AS (SELECT DISTINCT book AS q, lemma AS word FROM words WHERE lemma NOT IN ('the', 'und', 'les') AND lemma NOT IN ('que', 'with')), m AS (SELECT g.*, coalesce(c.idle, false) AS idle, k.score FROM glosses g LEFT JOIN codes c USING (code) LEFT JOIN keyness k USING (code)), r AS (SELECT word, max(quality) AS best FROM m GROUP BY 1), v AS (SELECT m.word, max(best) AS best, bool_and(idle) AS idle, bool_and(coalesce(score <= 0.2, false)) AS low FROM m JOIN r ON r.word = m.word AND m.quality = r.best GROUP BY 1), kept AS (SELECT q, w.word FROM w LEFT JOIN v USING (word) WHERE CASE WHEN best IS NULL THEN length(w.word) > 3 ELSE NOT (length(w.word) <= 3 AND best < 2) AND NOT idle AND NOT low END)"


@query("words", f"WITH {_GATES} SELECT * FROM kept")
def flt_09_word_gates(t):
    named = lambda *xs: t.spark.createDataFrame([(x,) for x in xs], "word string")
    own = t.words().select(F.col("book").alias("q"), F.col("lemma").alias("word"))
    return study.word_gates(own, glosses(t), named("the", "und", "les"), named("que", "with"), codes(t).where("idle"), keyness(t), 0.2)


@query("words", f"WITH {_GATES} SELECT q, string_agg(word, ' OR ' ORDER BY word) AS match FROM kept GROUP BY 1")
def exp_03_bible_words(t):
    kept = flt_09_word_gates(t).groupBy("q").agg(F.array_sort(F.collect_list("word")).alias("w"))
    return kept.select("q", F.array_join("w", " OR ").alias("match"))


@query("words", f"WITH {_CODES}, {_KEY}, {_ART}, l AS (SELECT strong AS code, lemma, count(*) AS m FROM words GROUP BY 1, 2), b AS (SELECT code, arg_min(lemma, (-m, lemma)) AS lemma, sum(m)::BIGINT AS n FROM l GROUP BY 1), a AS (SELECT code, array_to_string(list_sort(list_distinct(list(slug) FILTER (head))), ' ') AS articles, bool_or(key) AS key_term FROM articles GROUP BY 1), g AS (SELECT DISTINCT strong AS code, lemma AS word FROM words), s AS (SELECT word, count(*) AS shared FROM g JOIN codes USING (code) WHERE NOT idle GROUP BY 1), e AS (SELECT code, max(shared) AS elaboration FROM g JOIN s USING (word) GROUP BY 1), f AS (SELECT code, min(word) AS gloss FROM g GROUP BY 1) SELECT b.code, b.lemma, b.n, c.idle AS function, k.score AS keyness, coalesce(a.articles, '') AS articles, coalesce(a.key_term, false) AS key_term, f.gloss, coalesce(e.elaboration, 0)::BIGINT AS elaboration FROM b JOIN codes c USING (code) LEFT JOIN keyness k USING (code) LEFT JOIN a USING (code) LEFT JOIN f USING (code) LEFT JOIN e USING (code)")
def agg_18_concept_registry(t):
    w = cut(t.words().groupBy(F.col("strong").alias("code"), "lemma").agg(F.count("*").alias("n"), F.max("is_content").alias("is_content")))  # read once, used four times
    score = w.groupBy("code").agg(F.sum("n").alias("n")).where("n % 5 != 0").select("code", ((F.col("n") % 7) / F.lit(7.0)).alias("score"))
    return study.concept_table(w, w.select("code", F.col("lemma").alias("word")), articles(t), score)


@query("words", "WITH i AS (SELECT lemma AS word, strong AS code, count(*) AS n FROM words GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, code) AS place FROM i), o AS (SELECT DISTINCT strong AS code, book * 1000000 + chapter * 1000 + verse AS ref FROM words), s AS (SELECT code, list(ref ORDER BY ref) AS refs FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ref) AS rn FROM o) WHERE rn <= 3 GROUP BY 1) SELECT word, code, place, refs FROM p LEFT JOIN s USING (code) WHERE place <= 5")
def cor_17_concept(t):
    w = t.words()
    i = w.groupBy(F.col("lemma").alias("word"), F.col("strong").alias("code")).agg(F.count("*").alias("n"))
    return study.concept_samples(i, w.select(F.col("strong").alias("code"), (F.col("book") * 1000000 + F.col("chapter") * 1000 + F.col("verse")).alias("ref")))


_FILL = "o AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS v FROM customer WHERE c_custkey % 5 > 0), n AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS v FROM supplier)"


def _fill(t):
    o = t.table("customer").where("c_custkey % 5 > 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("v"))
    n = t.table("supplier").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("v"))
    return study.filled(o, n, "k", "v")


@query("", f"WITH {_FILL} SELECT coalesce(o.k, n.k) AS k, coalesce(o.v, n.v) AS v FROM o FULL JOIN n ON n.k = o.k")
def etl_05_fill(t):
    return _fill(t)[0]


@query("", f"WITH {_FILL} SELECT CASE WHEN n.v IS NULL THEN 'kept' WHEN o.k IS NULL THEN 'added' WHEN o.v IS NULL THEN 'filled' WHEN o.v = n.v THEN 'same' ELSE 'differs' END AS change, count(*) AS n FROM o FULL JOIN n ON n.k = o.k GROUP BY 1")
def etl_05_report(t):
    return _fill(t)[1]


@query("words", f"WITH {_CODES}, {_ART}, a AS (SELECT code, slug, title, n, n / sum(n) OVER (PARTITION BY code) AS share, row_number() OVER (PARTITION BY code ORDER BY n DESC, slug, title) AS rn FROM articles) SELECT code, slug, list_slice(list_filter(string_split_regex(lower(title), '[^a-z]+'), lambda x: x <> ''), 1, 4) AS seeds FROM a WHERE rn = 1 AND share >= 0.5 AND code NOT IN (SELECT code FROM codes WHERE idle)")
def sup_42_seeds(t):
    return study.seeds(articles(t), codes(t).where("idle"))


_QUESTIONS = "qs AS (SELECT n_nationkey AS q, CASE n_nationkey % 9 WHEN 0 THEN 'Who was ' || n_name || '?' WHEN 1 THEN 'who is the father of ' || n_name WHEN 2 THEN n_name || '''s wife' WHEN 3 THEN 'What does it teach about the ' || n_name || '?' WHEN 4 THEN 'cross references for ' || n_name WHEN 5 THEN 'the Greek word G' || n_nationkey WHEN 6 THEN 'which verb stem is this' WHEN 7 THEN 'kings throughout ' || n_name ELSE 'How should we translate ' || n_name END AS text FROM nation)"
_PARTS = r"""parts AS (SELECT q, CASE WHEN len(string_split_regex(text, '\s+')) <= 10 THEN nullif(regexp_extract(lower(text), '^(?:who|what) (?:is|are|was|were) (?:the |a |an )?([a-z][a-z-]+)\??$', 1), '') END AS term,
  coalesce(nullif(regexp_extract(lower(text), '(father|mother|son|daughter|brother|wife) of [a-z]+', 1), ''), nullif(regexp_extract(lower(text), '[a-z]+''s (father|mother|son|daughter|brother|wife)', 1), '')) AS relation,
  coalesce(nullif(regexp_extract(lower(text), '(?:father|mother|son|daughter|brother|wife) of ([a-z]+)', 1), ''), nullif(regexp_extract(lower(text), '([a-z]+)''s (?:father|mother|son|daughter|brother|wife)', 1), '')) AS name,
  regexp_replace(nullif(regexp_extract(lower(text), '(?:teach|say)s? about ([a-z ]+?)\??$', 1), ''), '^(the|a|an) ', '') AS topic,
  upper(nullif(regexp_extract(lower(text), '(?:greek|hebrew) word ([gh][0-9]+)', 1), '')) AS code, regexp_matches(lower(text), 'cross.?references?|parallel (verses|passages)') AS xref,
  regexp_matches(lower(text), 'verb stem|participle|part of speech|tense') AS morphology, regexp_matches(lower(text), '^how (do|should) (i|we) translate') AS methodology,
  nullif(regexp_extract(lower(text), '\b(?:in|throughout|the book of) ([a-z]+)\b', 1), '') AS book FROM qs)"""
_INTENT = "CASE WHEN code IS NOT NULL THEN 'word_study' WHEN morphology THEN 'morphology' WHEN relation IS NOT NULL AND name IS NOT NULL THEN 'genealogy' WHEN xref THEN 'xref' WHEN topic IS NOT NULL THEN 'topic' WHEN methodology THEN 'methodology' WHEN term IS NOT NULL THEN 'entity_lookup' WHEN book IS NOT NULL THEN 'passage_book' ELSE 'thematic' END"


def questions(t):
    n, name = F.col("n_nationkey"), F.col("n_name")
    shapes = (("Who was ", name, "?"), ("who is the father of ", name), (name, "'s wife"), ("What does it teach about the ", name, "?"), ("cross references for ", name), ("the Greek word G", n.cast("string")), ("which verb stem is this",), ("kings throughout ", name))
    text = F.concat(F.lit("How should we translate "), name)
    for i, shape in enumerate(shapes):
        text = F.when(n % 9 == i, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in shape])).otherwise(text)
    return t.table("nation").select(n.alias("q"), text.alias("text"))


@query("", f"WITH {_QUESTIONS}, {_PARTS}, i AS (SELECT *, {_INTENT} AS intent FROM parts) SELECT q, CASE WHEN intent = 'topic' THEN 'Verses that the topical index groups under ''' || topic || '''' WHEN intent = 'xref' THEN 'Cross-references for GEN 1:' || (q + 1) WHEN intent = 'genealogy' THEN 'Entity graph: ' || relation || '-of of ' || name WHEN intent = 'word_study' THEN 'Lexicon entries for the queried word' END AS line FROM i")
def sup_24_intent_line(t):
    p = study.sub_intents(F.col("text"))
    source = (F.lit(1001001) + F.col("q")).cast("long")
    return questions(t).select("q", context.intent_line(study.intent_of(p), p["topic"], source, F.concat(p["relation"], F.lit("-of-rev")), p["name"]).alias("line"))


_FRAMES = "ph AS (SELECT book, chapter, verse, idx, idx // 6 AS clause, lemma, substr(morph, 1, 1) AS sp, CASE WHEN morph LIKE 'V%' THEN 'Pred' WHEN morph LIKE 'N%' AND idx % 6 < 3 THEN 'Subj' WHEN morph LIKE 'N%' THEN 'Objc' ELSE 'Adju' END AS fn FROM words), mc AS (SELECT book, chapter, verse, min(clause) AS clause FROM ph WHERE fn = 'Pred' GROUP BY 1, 2, 3), fr AS (SELECT book, chapter, verse, 'frame: ' || string_agg(fn || ' ' || lemma, ' · ' ORDER BY idx, lemma) AS line FROM ph JOIN mc USING (book, chapter, verse, clause) WHERE sp IN ('N', 'V') GROUP BY 1, 2, 3)"


def verse_clauses(t):
    """book, chapter, verse, clauses: two clauses of up to six words a verse, each word a phrase."""
    key = ["book", "chapter", "verse"]
    sp = F.substring("morph", 1, 1)
    fn = F.when(sp == "V", "Pred").when((sp == "N") & (F.col("idx") % 6 < 3), "Subj").when(sp == "N", "Objc").otherwise("Adju")
    word = F.struct("idx", "lemma", fn.alias("function"), F.array(F.struct(F.col("lemma").alias("gloss"), sp.alias("sp"))).alias("words"))
    clause = t.words().groupBy(*key, (F.col("idx") / 6).cast("int").alias("clause")).agg(F.array_sort(F.collect_list(word)).alias("phrases"))
    return clause.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("clause", "phrases"))), lambda c: F.struct(c["phrases"].alias("phrases"))).alias("clauses"))


@query("words", f"WITH {_FRAMES} SELECT DISTINCT w.book, w.chapter, w.verse, fr.line FROM words w LEFT JOIN fr USING (book, chapter, verse)")
def sup_25_clause_frame(t):
    return verse_clauses(t).select("book", "chapter", "verse", context.clause_frame(F.col("clauses")).alias("line"))


@query("", "WITH r AS (SELECT n_regionkey, list(n_name ORDER BY n_name) AS related FROM nation GROUP BY 1) SELECT r_regionkey AS id, CASE r_regionkey % 4 WHEN 0 THEN 'ENTITY: ' || r_name || ' (region): ' || lower(r_name) WHEN 1 THEN 'ENTITY: father of ' || r_name || ' → ' || array_to_string(related, ', ') WHEN 2 THEN 'ENTITY: children of ' || r_name || ' → ' || array_to_string(related, ', ') ELSE 'ENTITY: siblings of ' || r_name || ' → —' END AS line FROM region JOIN r ON n_regionkey = r_regionkey")
def sup_26_entity_line(t):
    r = t.table("nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_name")).alias("related"))
    kind = F.col("r_regionkey") % 4
    rel = F.when(kind == 1, "father-of-rev").when(kind == 2, "father-of").when(kind == 3, "sibling-of")
    own = F.when(kind == 3, F.array().cast("array<string>")).otherwise(F.col("related"))
    return t.table("region").join(r, "r_regionkey").select(F.col("r_regionkey").alias("id"), context.entity_line(F.col("r_name"), F.lit("region"), F.lower("r_name"), rel, own).alias("line"))


@query("words", f"WITH {_CODES}, g AS (SELECT strong AS code, min(lemma) AS gloss, list_slice(list_sort(list_distinct(list(surface))), 1, 4) AS senses FROM words GROUP BY 1) SELECT code, 'CONCEPT: ' || code || ' = ' || gloss || ' | sense: ' || array_to_string(senses, '; ') || CASE WHEN n % 7 > 0 THEN ' | keyness ' || (n % 7) ELSE '' END || ' | domain: ' || substr(gloss, 1, 1) AS line FROM g JOIN codes USING (code)")
def sup_27_concept_line(t):
    g = t.words().groupBy(F.col("strong").alias("code")).agg(F.min("lemma").alias("gloss"), F.array_sort(F.collect_set("surface")).alias("senses"), F.count("*").alias("n"))
    return g.select("code", context.concept_line(F.col("code"), F.col("gloss"), F.col("senses"), F.array().cast("array<string>"), F.col("n") % 7, F.substring("gloss", 1, 1)).alias("line"))


@query("", "SELECT doc_id, CASE lang WHEN 'de' THEN 'Deutsch (OT)' WHEN 'fr' THEN 'Français (NT)' WHEN 'es' THEN 'Español' ELSE lang END AS label FROM documents")
def sup_28_edition(t):
    e = t.spark.createDataFrame([("de", "Deutsch", "ot"), ("fr", "Français", "nt"), ("es", "Español", "all")], "lang string, name string, books string")
    return t.table("documents").select("doc_id", "lang").join(F.broadcast(e), "lang", "left").select("doc_id", context.edition_label(F.col("lang"), F.col("name"), F.col("books")).alias("label"))


@query("words speakers", f"WITH {_FRAMES}, v AS (SELECT book, chapter, verse, string_agg(surface || '/' || strong, ' ' ORDER BY idx, surface) AS interlinear FROM words GROUP BY 1, 2, 3), sp AS (SELECT s AS ref, min(speaker) AS speaker FROM speakers GROUP BY 1) SELECT v.*, fr.line AS syntax, sp.speaker FROM v LEFT JOIN fr USING (book, chapter, verse) LEFT JOIN sp ON sp.ref = v.book * 1000000 + v.chapter * 1000 + v.verse")
def sup_29_verse_facets(t):
    key = ["book", "chapter", "verse"]
    pair = F.struct("idx", "surface", F.concat_ws("/", "surface", "strong").alias("x"))
    line = t.words().groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["x"]), " ").alias("interlinear"))
    syntax = verse_clauses(t).select(*key, context.clause_frame(F.col("clauses")).alias("syntax"))
    said = t.speakers().groupBy(F.col("s").alias("ref")).agg(F.min("speaker").alias("speaker"))
    ref = F.col("book") * 1000000 + F.col("chapter") * 1000 + F.col("verse")
    return line.join(syntax, key, "left").withColumn("ref", ref).join(said, "ref", "left").drop("ref")


@query("tags titles", "SELECT kind, doc_id, title, place FROM (SELECT tag[6:] AS kind, doc_id, title, row_number() OVER (PARTITION BY tag ORDER BY title, doc_id) AS place FROM tags JOIN titles USING (doc_id) WHERE tag LIKE 'kind:%') WHERE place <= 300")
def sup_31_leaves(t):
    own = t.tags().where("tag LIKE 'kind:%'").join(t.titles(), "doc_id").withColumn("kind", F.substring("tag", 6, 64))
    return ranking.per_key(own, ["kind"], 300, F.asc_nulls_last("title"), F.col("doc_id"), name="place").select("kind", "doc_id", "title", "place")


@query("", "SELECT page_id, regexp_extract(url, '([^/]+)/?$', 1) AS module FROM pages WHERE page_id IN (SELECT l_partkey FROM lineitem)")
def sup_38_referenced(t):
    used = t.table("lineitem").select(F.col("l_partkey").alias("page_id")).distinct()
    return t.table("pages").join(used, "page_id", "left_semi").select("page_id", F.regexp_extract("url", "([^/]+)/?$", 1).alias("module"))


@query("", "SELECT o_custkey AS place, arg_min(o_totalprice, (o_orderdate, o_orderkey)) FILTER (o_orderstatus <> 'P') AS lon, list_sort(list_distinct(list(regexp_replace(o_orderpriority, '^[0-9]-', '')))) AS kinds FROM orders GROUP BY 1")
def sup_39_first_coordinate(t):
    held = t.table("orders").groupBy(F.col("o_custkey").alias("place")).agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_totalprice", "o_orderstatus"))).alias("x"), F.array_sort(F.collect_set(F.regexp_replace("o_orderpriority", "^[0-9]-", ""))).alias("kinds"))
    usable = F.get(F.filter("x", lambda o: o["o_orderstatus"] != "P"), F.lit(0))["o_totalprice"]
    return held.select("place", usable.alias("lon"), "kinds")


@query("xref", "SELECT source, list_sort(list_distinct(list_concat([source], list(ts)))) AS refs FROM xref GROUP BY 1")
def sup_40_all_refs(t):
    return t.xref().groupBy("source").agg(F.collect_set("ts").alias("own")).select("source", F.array_sort(F.array_distinct(F.concat(F.array("source"), "own"))).alias("refs"))


@query("", "SELECT n_regionkey AS key, coalesce(max(CASE WHEN n_nationkey % 3 = 0 THEN n_name END), max(CASE WHEN n_nationkey % 3 = 1 THEN n_name END)) AS label FROM nation WHERE n_regionkey <> 1 OR n_nationkey % 3 <> 0 GROUP BY 1")
def sup_46_localised(t):
    lang = F.when(F.col("n_nationkey") % 3 == 0, "Spanish").when(F.col("n_nationkey") % 3 == 1, "English").otherwise("French")
    n = t.table("nation").where("n_regionkey != 1 OR n_nationkey % 3 != 0").select(F.col("n_regionkey").alias("key"), lang.alias("language"), F.col("n_name").alias("label"))
    return study.localised(n, "key", "Spanish")


@query("words", f"WITH {_CODES}, {_ART}, a AS (SELECT code, slug, sum(n)::BIGINT AS n FROM articles GROUP BY 1, 2) SELECT codes.code, list(slug ORDER BY a.n DESC, slug) FILTER (slug IS NOT NULL) AS slugs FROM codes LEFT JOIN a USING (code) GROUP BY 1")
def sup_47_articles(t):
    a = articles(t).groupBy("code", "slug").agg(F.sum("n").alias("n")).groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "slug"))), lambda x: x["slug"]).alias("slugs"))
    return codes(t).select("code").join(a, "code", "left")


@query("", "SELECT p_brand AS key, arg_min(p_name, ((p_size <> 7)::INT, p_partkey)) AS gloss FROM part WHERE length(trim(p_name)) > 0 GROUP BY 1")
def sup_49_representative(t):
    return study.representative(t.table("part").select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("place"), (F.col("p_size") == 7).alias("is_default"), F.col("p_name").alias("gloss")), "key")


@query("words", "SELECT surface, arg_min(strong, (-n, strong)) AS code, round(max(n) / sum(n), 3) AS share FROM (SELECT surface, strong, count(*) AS n FROM words GROUP BY 1, 2) GROUP BY 1")
def sup_21_dominant_code(t):
    n = t.words().groupBy("surface", "strong").agg(F.count("*").alias("n"))
    return n.groupBy("surface").agg(F.min_by("strong", F.struct(-F.col("n"), "strong")).alias("code"), F.round(F.max("n") / F.sum("n"), 3).alias("share"))


@query("words", f"WITH {_CODES}, {_KEY} SELECT code, n, idle AS function, score AS keyness, coalesce(score, 0) > 0.5 AS distinctive FROM codes LEFT JOIN keyness USING (code)")
def sup_18_dimensions(t):
    return codes(t).join(keyness(t), "code", "left").select("code", "n", F.col("idle").alias("function"), F.col("score").alias("keyness"), (F.coalesce("score", F.lit(0)) > 0.5).alias("distinctive"))


@query("words", f"WITH {_CODES}, b AS (SELECT strong AS code, arg_min(lemma, (-n, lemma)) AS bridge FROM (SELECT strong, lemma, count(*) AS n FROM words WHERE is_content = 1 GROUP BY 1, 2) GROUP BY 1) SELECT code, n, coalesce(bridge, 'none') AS bridge FROM codes LEFT JOIN b USING (code)")
def sup_22_bridge_lookup(t):
    n = t.words().where("is_content = 1").groupBy(F.col("strong").alias("code"), "lemma").agg(F.count("*").alias("m"))
    b = n.groupBy("code").agg(F.min_by("lemma", F.struct(-F.col("m"), "lemma")).alias("bridge"))
    return codes(t).join(b, "code", "left").select("code", "n", F.coalesce("bridge", F.lit("none")).alias("bridge"))


@query("tokens", "WITH s(l, term) AS (VALUES ('en','the'),('en','and'),('de','der'),('de','die'),('es','que'),('es','los'),('fr','les'),('fr','des')), h AS (SELECT doc_id, l, count(*) AS hits FROM tokens JOIN s USING (term) GROUP BY 1, 2), n AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY 1), r AS (SELECT doc_id, l, hits, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, l) AS rn FROM h), g AS (SELECT n.doc_id, CASE WHEN r.hits / n.n >= 0.02 THEN r.l ELSE 'en' END AS got FROM n LEFT JOIN r ON r.doc_id = n.doc_id AND r.rn = 1) SELECT lang, count(*) AS n, round(avg((got = lang)::INT), 4) AS accuracy FROM g JOIN documents USING (doc_id) GROUP BY 1")
def sup_08_language_accuracy(t):
    got = detect_language(t.tokens(), t.spark, floor=0.02).join(t.table("documents").select("doc_id", "lang"), "doc_id")
    return got.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg((F.col("detected") == F.col("lang")).cast("int")), 4).alias("accuracy"))


@query("titles refs tags chunks", "WITH k AS (SELECT doc_id, list(tag ORDER BY tag) AS tags, min(CASE WHEN tag LIKE 'source:%' THEN tag[8:] END) AS source FROM tags GROUP BY 1), f AS (SELECT doc_id, arg_min(body, chunk_index) AS body, min(chunk_id) AS provenance FROM chunks GROUP BY 1) SELECT t.doc_id, title, s, e, tags, source, rtrim(f.body[1:80]) AS excerpt, provenance FROM titles t JOIN refs USING (doc_id) JOIN k USING (doc_id) LEFT JOIN f USING (doc_id)")
def prj_01_card(t):
    k = t.tags().groupBy("doc_id").agg(F.array_sort(F.collect_list("tag")).alias("tags"), F.min(F.when(F.col("tag").startswith("source:"), F.substring("tag", 8, 64))).alias("source"))
    f = t.chunks().groupBy("doc_id").agg(F.min_by("body", "chunk_index").alias("body"), F.min("chunk_id").alias("provenance"))
    return t.titles().join(t.refs(), "doc_id").join(k, "doc_id").join(f, "doc_id", "left").select("doc_id", "title", "s", "e", "tags", "source", F.rtrim(F.substring("body", 1, 80)).alias("excerpt"), "provenance")


_RESULTS = "res AS (SELECT conv_id, bool_or(role = 'assistant') AND count(*) % 3 > 0 AS passed, count(*) FILTER (role = 'user') / count(*) AS passage_recall, CASE WHEN count(*) > 2 THEN count(DISTINCT role) / 3 END AS tag_recall, bool_or(length(text) < 40) AS refusal_correct FROM conversations GROUP BY 1)"


@query("", f"WITH {_RESULTS} SELECT count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, round(avg(passed::INT), 3) AS pass_rate, round(avg(passage_recall), 3) AS passage_recall_mean, round(avg(tag_recall), 3) AS tag_recall_mean, count(*) FILTER (refusal_correct) AS refusal_correct_count FROM res")
def agg_32_eval(t):
    n = F.count("*")
    is_ = lambda r: F.col("role") == r
    res = t.table("conversations").groupBy("conv_id").agg((F.bool_or(is_("assistant")) & (n % 3 > 0)).alias("passed"), (F.count_if(is_("user")) / n).alias("passage_recall"), F.when(n > 2, F.countDistinct("role") / 3).alias("tag_recall"), F.bool_or(F.length("text") < 40).alias("refusal_correct"))
    return study.aggregate_results(res)


_MORPH = "pts AS (SELECT b, node FROM (SELECT book AS b, (book * 1000000 + chapter * 1000 + verse) AS node, row_number() OVER (PARTITION BY book ORDER BY chapter, verse, idx, surface, lemma) AS rn FROM words WHERE morph LIKE 'V%') WHERE rn <= 200)"


@query("words", f"WITH {_MORPH} SELECT DISTINCT b AS book, node AS s, node AS e FROM pts")
def exp_08_morph_points(t):
    hits = t.words().where("morph LIKE 'V%'")
    few = ranking.per_key(hits, ["book"], 200, F.col("chapter"), F.col("verse"), F.col("idx"), F.col("surface"), F.col("lemma"))
    ref = F.col("book") * 1000000 + F.col("chapter") * 1000 + F.col("verse")
    return few.select("book", ref.alias("s"), ref.alias("e")).distinct()


@query("titles refs tags words", "WITH k AS (SELECT doc_id, min(tag[6:]) AS kind FROM tags WHERE tag LIKE 'kind:%' GROUP BY 1), c AS (SELECT t.doc_id, kind, title AS headline, CASE WHEN e - s < 10 THEN 0.9 WHEN e - s < 100 THEN 0.7 ELSE 0.4 END AS c FROM titles t JOIN refs USING (doc_id) JOIN k USING (doc_id)) SELECT doc_id, kind, headline, round(c, 2)::DOUBLE AS confidence, c >= 0.7 AS featured FROM c")
def crd_03_leads(t):
    k = t.tags().where("tag LIKE 'kind:%'").groupBy("doc_id").agg(F.min(F.substring("tag", 6, 64)).alias("kind"))
    w = F.col("e") - F.col("s")
    cards = t.titles().join(t.refs(), "doc_id").join(k, "doc_id").select("doc_id", "kind", F.col("title").alias("headline"), F.when(w < 10, 0.9).when(w < 100, 0.7).otherwise(0.4).alias("confidence"))
    return context.leads(cards)


@query("xref", "WITH r AS (SELECT source, ts, te, row_number() OVER (PARTITION BY source ORDER BY ts, te) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM (SELECT DISTINCT source, ts, te FROM xref)) SELECT source, ts, te, floor((121 * n - 60 * i) / (2 * n)) / 100 AS confidence, false AS featured FROM r")
def crd_03_source_leads(t):
    x = t.xref().select("source", "ts", "te").distinct().withColumn("at", F.struct("ts", "te"))
    return context.source_leads(x, ["source"], "at").drop("at")


_CAND = "cand AS (SELECT DISTINCT w.book AS q, w.strong AS code, w.strong = 'H0007' AS anchored, coalesce(k.score, 0) AS keyness, m.g <= 'm' AS matches, (c.n % 3)::BIGINT AS siblings FROM words w JOIN codes c ON c.code = w.strong JOIN (SELECT strong, min(lemma) AS g FROM words GROUP BY 1) m ON m.strong = w.strong LEFT JOIN keyness k ON k.code = w.strong)"


@query("words", f"WITH {_CODES}, {_KEY}, {_CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY q, anchored ORDER BY code = 'H0011', keyness DESC, code) AS place FROM cand WHERE keyness > 0 OR anchored), o AS (SELECT *, CASE WHEN anchored THEN 0 WHEN matches AND siblings > 0 THEN 1 WHEN matches THEN 2 ELSE 3 END AS tier FROM r WHERE anchored OR place <= 4) SELECT q, code, tier::BIGINT AS tier FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY tier, place) AS rn FROM o) WHERE rn = 1")
def crd_05_concept_choice(t):
    w = t.words()
    g = w.groupBy("strong").agg((F.min("lemma") <= "m").alias("matches"), (F.count("*") % 3).alias("siblings"))
    c = w.select(F.col("book").alias("q"), "strong").distinct().join(g, "strong").withColumnRenamed("strong", "code").join(keyness(t), "code", "left")
    return context.concept_choice(c.select("q", "code", (F.col("code") == "H0007").alias("anchored"), F.coalesce("score", F.lit(0.0)).alias("keyness"), "matches", "siblings"), ["q"], ("H0011",))


@query("xref titles refs", "WITH h AS (SELECT source AS q, row_number() OVER (PARTITION BY source ORDER BY ts, te) AS rank, ts::VARCHAR AS chunk_id FROM (SELECT DISTINCT source, ts, te FROM xref)), c AS (SELECT s AS q, title, 0.9 - (doc_id % 5) / 10.0 AS conf FROM refs JOIN titles USING (doc_id)), a AS (SELECT q, list(chunk_id ORDER BY rank) AS citations FROM h GROUP BY 1), b AS (SELECT q, list('passage: ' || title ORDER BY conf DESC, title) AS cards FROM c GROUP BY 1) SELECT coalesce(a.q, b.q) AS q, coalesce(citations, []) AS citations, coalesce(cards, []) AS cards FROM a FULL JOIN b ON a.q = b.q")
def api_04_study_packet(t):
    x = t.xref().select(F.col("source").alias("q"), "ts", "te").distinct()
    hits = ranking.per_key(x, ["q"], 1 << 30, F.col("ts"), F.col("te"), name="rank").select("q", "rank", F.col("ts").cast("string").alias("chunk_id"))
    cards = t.refs().join(t.titles(), "doc_id").select(F.col("s").alias("q"), F.lit("passage").alias("kind"), F.col("title").alias("headline"), (0.9 - (F.col("doc_id") % 5) / 10.0).alias("confidence"))
    return context.packet(hits, cards, ["q"])


@query("words xref", "WITH c AS (SELECT DISTINCT ts FROM xref), v AS (SELECT book * 1000000 + chapter * 1000 + verse AS ref, list(strong ORDER BY idx, surface) AS words FROM words GROUP BY 1) SELECT ts, coalesce(words, []) AS words FROM c LEFT JOIN v ON v.ref = c.ts")
def api_13_citation_words(t):
    ref = F.col("book") * 1000000 + F.col("chapter") * 1000 + F.col("verse")
    v = t.words().groupBy(ref.alias("ts")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "surface", "strong"))), lambda x: x["strong"]).alias("words"))
    return t.xref().select("ts").distinct().join(v, "ts", "left").select("ts", F.coalesce("words", F.array().cast("array<string>")).alias("words"))


@query("chunks tokens topics xref entities", "SELECT 'chunk' AS call, chunk_id AS key, doc_id::VARCHAR AS value FROM chunks UNION ALL SELECT 'cross_reference', source::VARCHAR, ts::VARCHAR FROM (SELECT source, ts, row_number() OVER (PARTITION BY source ORDER BY rank NULLS LAST, ts, te) AS rn FROM (SELECT DISTINCT source, ts, te, rank FROM xref)) WHERE rn <= 100 UNION ALL SELECT 'concordance', term, min(chunk_id) FROM tokens GROUP BY 2 UNION ALL SELECT 'entity', lower(name), min(id) FROM entities GROUP BY 2 UNION ALL SELECT 'topic', lower(name), min(topic_id)::VARCHAR FROM topics GROUP BY 2")
def api_05_lookup(t):
    row = lambda call, df, key, value: df.select(F.lit(call).alias("call"), key.cast("string").alias("key"), value.cast("string").alias("value"))
    x = t.xref().select("source", "ts", "te", "rank").distinct()
    x = ranking.per_key(x, ["source"], 100, F.asc_nulls_last("rank"), F.col("ts"), F.col("te"))
    least = lambda df, key, value: df.groupBy(key.alias("k")).agg(F.min(value).alias("v"))
    parts = (row("chunk", t.chunks(), F.col("chunk_id"), F.col("doc_id")), row("cross_reference", x, F.col("source"), F.col("ts")), *(row(c, least(df, k, v), F.col("k"), F.col("v")) for c, df, k, v in (("concordance", t.tokens(), F.col("term"), F.col("chunk_id")), ("entity", t.entities(), F.lower("name"), F.col("id")), ("topic", t.topics(), F.lower("name"), F.col("topic_id")))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
