"""Queries of the smaller jobs, with all the parts that their operators have."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import fusion, tidying, trees
from lectern.plans.registry import query
from lectern.plans.retrieval import _THREE, _WEIGHTS, _three
from lectern.plans.surface import _BOOK
from lectern.sources import sinks


@query("tokens titles chunks tags", f"WITH {_THREE}, m AS (SELECT string_split(line, ' ') AS x FROM (SELECT unnest(string_split('" + _WEIGHTS.strip().replace("\n", "|") + "', '|')) AS line)), w AS (SELECT x[1] AS intent, ['fts', 'title', 'passage', 'scripture', 'tag', 'vector', 'lexicon', 'morphology', 'entity', 'bible', 'topic', 'xref', 'cfabric', 'aquifer', 'speaker', 'semdomain'][i] AS retriever, x[i + 1]::DOUBLE AS weight FROM m, unnest(range(1, 17)) AS t(i)) SELECT intent, chunk_id, round(sum(weight / (60 + rank)), 8) AS score FROM hits JOIN w USING (retriever) WHERE weight > 0 GROUP BY ALL")
def fus_02_weights(t):
    """The same hits fused once by each intent's weights."""
    weighted = fusion.weights(t.spark).where("weight > 0").join(_three(t), "retriever")
    return weighted.groupBy("intent", "chunk_id").agg(F.round(F.sum(F.col("weight") / (F.lit(fusion.K) + F.col("rank"))), 8).alias("score"))


@query("", "SELECT d.doc_id::VARCHAR AS id, 64 AS dimensions FROM documents d WHERE d.doc_id NOT IN (SELECT vec_id FROM embeddings) AND trim(d.text) <> ''")
def vec_04_missing(t):
    """The documents without a vector, encoded; blank ones stay without, and another model's store would be refused."""
    chunks = t.table("documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("body"))
    known = t.table("embeddings").select(F.col("vec_id").cast("string").alias("id"))
    return sinks.embed_missing(chunks, known, sinks.hashed, "hashed-64", "hashed-64").select("id", F.size("embedding").alias("dimensions"))


@query("words", "WITH n AS (SELECT book AS q, strong AS code, count(*) AS m FROM words GROUP BY ALL), r AS (SELECT q, code, row_number() OVER (PARTITION BY q ORDER BY m DESC, code) AS rank FROM n), s AS (SELECT *, substr(code, 2)::INT % 9 = q % 9 AS subject, substr(code, 2)::INT % 5 = 0 AS bad FROM r WHERE rank <= 10) SELECT q, count(*) FILTER (bad) AS noise, arg_min(subject, rank) AS subject_first, bool_or(subject) AS subject_present FROM s GROUP BY q")
def sup_07_denoise(t):
    n = t.words().groupBy(F.col("book").alias("q"), F.col("strong").alias("code")).agg(F.count("*").alias("m"))
    from lectern.operators.ranking import per_key

    ranked = per_key(n, ["q"], 10, F.desc("m"), F.col("code"), name="rank").select("q", "rank", "code")
    number = F.substring("code", 2, 8).cast("int")
    return tidying.denoised(ranked, ranked.where(number % 9 == F.col("q") % 9), ranked.where(number % 5 == 0))


@query("topics", "WITH a AS (SELECT DISTINCT name AS w FROM topics UNION SELECT DISTINCT split_part(name, ' ', 1) FROM topics), e AS (SELECT w, topic_id FROM a JOIN (SELECT DISTINCT topic_id, name FROM topics) ON lower(name) = lower(w)), p AS (SELECT w, topic_id FROM a JOIN (SELECT DISTINCT topic_id, name FROM topics) ON starts_with(lower(name), lower(w)) WHERE w NOT IN (SELECT w FROM e)), m AS (SELECT * FROM (SELECT * FROM e UNION ALL SELECT * FROM p) QUALIFY row_number() OVER (PARTITION BY w ORDER BY topic_id) <= 3), r AS (SELECT w, s, topic_id FROM m JOIN topics USING (topic_id) QUALIFY row_number() OVER (PARTITION BY w ORDER BY s, topic_id) <= 10) SELECT w AS q, list(s ORDER BY s, topic_id) AS refs FROM r GROUP BY w")
def sup_23_topic_verses(t):
    """Every topic's name, which meets it, and every first word, which begins some."""
    names = t.topics().select("name").distinct()
    asked = names.union(names.select(F.split_part("name", F.lit(" "), F.lit(1)))).distinct().select(F.col("name").alias("q"), "name")
    return tidying.topic_verses(t.topics(), asked)


@query("", "WITH d AS (SELECT s_nationkey AS series, 'Talks — Part ' || (s_suppkey % 6) || CASE s_suppkey % 3 WHEN 0 THEN ' (timestamp)' WHEN 1 THEN ' (semantic)' ELSE '' END AS title FROM supplier) SELECT series, regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g') AS slug, label, count(*) AS n FROM (SELECT series, regexp_replace(regexp_replace(title, '^Talks — ', ''), ' \\([a-z]+\\)$', '') AS label FROM d) GROUP BY ALL")
def sup_30_series(t):
    k = F.col("s_suppkey")
    title = F.concat(F.lit("Talks — Part "), (k % 6).cast("string"), F.when(k % 3 == 0, " (timestamp)").when(k % 3 == 1, " (semantic)").otherwise(""))
    return tidying.series(t.table("supplier").select(F.col("s_nationkey").alias("series"), title.alias("title")), "Talks")


@query("", "WITH l AS (SELECT doc_id, i - 1 AS i, body FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(body) <> ''), w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT 'line' AS strategy, doc_id, i, body FROM l UNION ALL SELECT 'document', doc_id, 0, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'window', doc_id, s // 650, array_to_string(list_slice(w, s + 1, s + 800), ' ') FROM w, unnest(range(0, greatest(len(w), 1), 650)) AS t(s)), n AS (SELECT strategy, strategy || ':' || doc_id || ':' || lpad(i::VARCHAR, 5, '0') AS id, len(regexp_extract_all(body, '\\S+')) AS n FROM c) SELECT strategy, count(*) AS chunks, min(id) AS first, max(id) AS last, sum(n)::BIGINT AS words, min(n) AS least, max(n) AS most, round(avg(n), 2) AS mean FROM n GROUP BY strategy")
def sup_36_chunk_strategies(t):
    return tidying.strategy_statistics(tidying.strategies(t.dealt("documents", "doc_id", "text")))


@query("words", "WITH f AS (SELECT DISTINCT strong || '/{' || 'G' || (substr(strong, 2)::INT % 90) || 'A}' || CASE WHEN morph = 'P' THEN '' ELSE '=' || morph || '=x' END AS field, strong, morph FROM words) SELECT field, array_to_string(list_sort(list_distinct([strong, 'G' || lpad((substr(strong, 2)::INT % 90)::VARCHAR, 4, '0') || 'A'])), ',') AS codes, CASE WHEN morph = 'P' THEN field ELSE morph || '=x' END AS m FROM f")
def sup_41_composite(t):
    field = F.concat("strong", F.lit("/{G"), (F.substring("strong", 2, 8).cast("int") % 90).cast("string"), F.lit("A}"), F.when(F.col("morph") == "P", "").otherwise(F.concat(F.lit("="), "morph", F.lit("=x"))))
    return t.words().select(field.alias("field")).distinct().select("field", F.array_join(tidying.codes_in(F.col("field")), ",").alias("codes"), tidying.morphology_in(F.col("field")).alias("m"))


@query("", "WITH n AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'К ' || c_name WHEN 1 THEN '1-е ' || c_name WHEN 2 THEN 'Послание к ' || c_name ELSE c_name END AS name FROM customer) SELECT k, name, CASE k % 4 WHEN 1 THEN '1 ' || substr(name, 5) WHEN 0 THEN substr(name, 3) WHEN 2 THEN substr(name, 12) ELSE '' END AS forms FROM n")
def sup_50_bare_names(t):
    k, c = F.col("c_custkey"), F.col("c_name")
    name = F.when(k % 4 == 0, F.concat(F.lit("К "), c)).when(k % 4 == 1, F.concat(F.lit("1-е "), c)).when(k % 4 == 2, F.concat(F.lit("Послание к "), c)).otherwise(c)
    own = t.table("customer").select(k.alias("k"), name.alias("name"))
    return own.select("k", "name", F.array_join(tidying.bare_forms(F.col("name"), ("К", "Ко", "От", r"Послание\s+к", "Послание")), "|").alias("forms"))


@query("", f"WITH p AS (SELECT DISTINCT o_custkey % 20 AS w, o_orderkey % 66 + 1 AS b, o_orderkey % 50 + 1 AS c, o_orderkey % 9 + 1 AS v, o_orderkey % 4 AS m FROM orders), r AS (SELECT 'S' || w AS speaker, CASE WHEN m = 1 THEN 'alt' ELSE '' END AS alt, b * 1000000 + c * 1000 + v AS s, b * 1000000 + c * 1000 + v + CASE WHEN m = 2 THEN 3 ELSE 1 END AS e, 'Normal' AS kind, '' AS delivery, CASE WHEN w % 7 = 0 THEN 'Y' ELSE '' END AS divine FROM p WHERE m <> 3 AND w <> 5) SELECT DISTINCT * FROM r WHERE {_BOOK}[s // 1000000] IS NOT NULL")
def etl_06_json_ranges(t):
    """Speaker ranges from projected verses, reversed and unusable ones among them, and which speakers are divine."""
    o, w, s = F.col("o_orderkey"), F.col("o_custkey") % 20, lambda x: x.cast("string")
    from lectern.functions.refs import code_of

    place = lambda v: F.concat_ws(".", code_of(o % 66 + 1), s(o % 50 + 1), s(v))
    near, far = place(o % 9 + 1), place(o % 9 + 1 + F.when(o % 4 == 2, 3).otherwise(1))
    rows = t.table("orders").select(
        F.when(o % 4 == 3, "XXX.1.1").when(o % 4 == 1, far).otherwise(near).alias("start"), F.when(o % 4 == 1, near).otherwise(far).alias("end"),
        F.when(w == 5, " ").otherwise(F.concat(F.lit("S"), s(w), F.lit(" "))).alias("speaker"), F.when(o % 4 == 1, "alt").alias("alt"), F.lit("Normal").alias("kind"), F.lit(None).cast("string").alias("delivery"),
    )
    names = t.table("orders").select(F.concat(F.lit("S"), s(w)).alias("name"), (w % 7 == 0).alias("divine"))
    return tidying.speaker_ranges(rows, names)[0]


_PATHS = {
    "source": "SELECT tag[8:], s // 1000000, doc_id FROM tags JOIN refs USING (doc_id) WHERE tag LIKE 'source:%'",
    "kind": "SELECT a.tag[6:], b.tag[6:], doc_id FROM tags a JOIN tags b USING (doc_id) WHERE a.tag LIKE 'kind:%' AND b.tag LIKE 'lang:%'",
    "term": "SELECT upper(trim(title)[1]), title, doc_id FROM titles WHERE doc_id IN (SELECT doc_id FROM tags WHERE tag = 'kind:term')",
    "methodology": "SELECT tag[8:], upper(trim(title)[1]), doc_id FROM titles JOIN tags USING (doc_id) WHERE tag LIKE 'source:%' AND doc_id IN (SELECT doc_id FROM tags WHERE tag = 'kind:methodology')",
    "aquifer": "SELECT tag[6:], s // 1000000, doc_id FROM tags JOIN refs USING (doc_id) WHERE tag LIKE 'kind:%' AND doc_id IN (SELECT doc_id FROM tags WHERE tag = 'resource:aquifer')",
    "topic": "SELECT upper(trim(name)[1]), name, topic_id FROM topics",
    "entity": "SELECT type, upper(trim(name)[1]), id FROM entities",
    "lexicon": "SELECT strong[1], strong[2], strong FROM words",
    "morphology": "SELECT book, chapter, morph FROM words",
    "transcript": "SELECT role, conv_id % 10, conv_id FROM conversations",
}


@query("tags refs titles topics entities words", "WITH " + ", ".join(f"p_{n} AS (SELECT DISTINCT a::VARCHAR AS a, b::VARCHAR AS b, c::VARCHAR AS c FROM ({q}) AS t(a, b, c) WHERE a IS NOT NULL)" for n, q in _PATHS.items()) + " " + " UNION ALL ".join(f"SELECT '{n}' AS tree, NULL::VARCHAR AS parent, a AS id, count(DISTINCT c) AS n FROM p_{n} GROUP BY a" + ("" if n in ("term", "topic") else f" UNION ALL SELECT '{n}', a, b, count(*) FROM p_{n} GROUP BY a, b") for n in _PATHS))
def api_06_overview(t):
    return trees.overview(t)


@query("words", "SELECT 'morphology' AS tree, chapter::VARCHAR AS id, count(DISTINCT morph) AS n FROM words WHERE book = 1 GROUP BY 2 UNION ALL SELECT 'leaves', morph, 1 FROM words WHERE book = 1 AND chapter = 1 GROUP BY morph")
def api_06_descend(t):
    one, two = trees.descend(t, "morphology", "1"), trees.descend(t, "morphology", "1", "1")
    return one.select(F.lit("morphology").alias("tree"), "id", "n").unionByName(two.select(F.lit("leaves").alias("tree"), "id", "n"))
