"""Queries of question analysis at table scale, source trees, sense derivation, dictionaries and guarded deltas."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.refs import BOOKS
from lectern.operators import analyze, derive, incremental, senses, tags
from lectern.plans.registry import query

_ASKED = "lower(CASE s_suppkey % 4 WHEN 0 THEN 'What did ' || n_name || ' say?' WHEN 1 THEN 'the words of ' || n_name WHEN 2 THEN n_name || '''s answer' ELSE 'the land of ' || n_name END)"
_SAID = r"'\b' || lower(n_name) || '(''s\b|\s+(said|says|say|spoke|speak|told|answered)\b)|\bwords of ' || lower(n_name) || '\b'"


@query("refs", "SELECT doc_id, 0::BIGINT AS place, s, e FROM refs")
def fn_04_references(t):
    """Each document's passage asked for in words, half of them last verse first, and read back."""
    code = F.get(F.array(*map(F.lit, BOOKS)), F.floor(F.col("s") / 1000000).cast("int") - 1)
    verse = lambda k: F.concat_ws(":", (F.floor(F.col(k) / 1000) % 1000).cast("string"), (F.col(k) % 1000).cast("string"))
    there, back = F.concat_ws("-", verse("s"), verse("e")), F.concat_ws("-", verse("e"), verse("s"))
    asked = F.concat(F.lit("what happens in "), code, F.lit(" "), F.when(F.col("doc_id") % 2 == 0, there).otherwise(back), F.lit("?"))
    return analyze.references(t.refs().select("doc_id", asked.alias("question")), "doc_id", "question")


@query("", f"WITH q AS (SELECT s_suppkey, {_ASKED} AS q FROM supplier JOIN nation ON s_nationkey = n_nationkey), h AS (SELECT s_suppkey, arg_min(n_name, (-length(n_name), n_name)) AS speaker FROM q JOIN nation ON regexp_matches(q, {_SAID}) GROUP BY 1) SELECT s_suppkey, speaker FROM q LEFT JOIN h USING (s_suppkey)")
def fn_25_speakers(t):
    nation, key, name = t.table("nation"), F.col("s_suppkey") % 4, F.col("n_name")
    asked = F.when(key == 0, F.concat(F.lit("What did "), name, F.lit(" say?"))).when(key == 1, F.concat(F.lit("the words of "), name)).when(key == 2, F.concat(name, F.lit("'s answer"))).otherwise(F.concat(F.lit("the land of "), name))
    own = t.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", asked.alias("question"))
    return analyze.spoken_by(own, nation.select(F.col("n_name").alias("name")), "s_suppkey", "question")


@query("tags refs", "SELECT substr(tag, 8) AS source, s // 1000000 AS book, count(DISTINCT doc_id) AS documents, count(*) AS passages FROM (SELECT DISTINCT * FROM tags WHERE tag LIKE 'source:%') JOIN refs USING (doc_id) GROUP BY 1, 2")
def api_07_source_tree(t):
    return tags.source_tree(t.tags(), t.refs())


@query("occurrences", "WITH c AS (SELECT lex, stem, left(surface, 6) || CASE WHEN length(surface) > 6 THEN '.' || right(surface, 1) ELSE '' END AS gloss FROM occurrences), k AS (SELECT lex, stem, lower(gloss) AS k, gloss, count(*) AS m FROM c GROUP BY ALL), s AS (SELECT lex, stem, k, arg_min(gloss, (length(gloss) - length(replace(gloss, '.', '')), -m, gloss)) AS label, sum(m)::BIGINT AS n FROM k GROUP BY 1, 2, 3) SELECT lex, stem, label, n, row_number() OVER (PARTITION BY lex, stem ORDER BY n DESC, k) AS number FROM s")
def seq_06_anchored_senses(t):
    n = F.length("surface")
    gloss = F.concat(F.left("surface", F.lit(6)), F.when(n > 6, F.concat(F.lit("."), F.right("surface", F.lit(1)))).otherwise(""))
    return senses.anchored(t.occurrences().select("lex", "stem", gloss.alias("gloss")))


@query("tags", "SELECT doc_id, regexp_replace(text, '(?m)^#+ *', '', 'g') AS text FROM documents WHERE doc_id IN (SELECT doc_id FROM tags WHERE tag = 'resource:aquifer')")
def etl_04_article_text(t):
    return derive.article_text(t.table("documents"), t.tags().where("tag = 'resource:aquifer'"))


@query("", "SELECT p_type AS lang, p_brand || '-' || p_partkey AS code, p_name AS gloss FROM part")
def etl_09_multilingual_glosses(t):
    """Dictionaries written as one JSON list a language and size, among malformed ones, and flattened."""
    entry = F.struct(F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")).alias("code"), F.col("p_name").alias("gloss"))
    files = t.table("part").groupBy(F.col("p_type").alias("lang"), "p_size").agg(F.to_json(F.collect_list(entry)).alias("body")).drop("p_size")
    return derive.flat_dictionary(files.unionByName(files.select("lang", F.lit("[{").alias("body"))))


@query("", "SELECT c_custkey AS id, c_name AS body FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) AND c_custkey NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT s_suppkey, s_name FROM supplier")
def str_02_import_delta(t):
    rows = lambda name, key, body: t.table(name).select(F.col(key).alias("id"), F.col(body).alias("body"))
    return incremental.import_delta(rows("customer", "c_custkey", "c_name"), rows("supplier", "s_suppkey", "s_name"), rows("nation", "n_nationkey", "n_name"), "id")
