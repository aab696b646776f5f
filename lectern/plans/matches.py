"""Queries of matching: names, frames, blocks, citations, clusters of references, gloss cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import matching
from lectern.plans.jobs import _SPOKEN, _spoken
from lectern.plans.registry import query
from lectern.sources import transcripts


@query("", """WITH f AS (SELECT s_suppkey AS id, s_suppkey % 40 AS x, [s_suppkey % 7, s_suppkey % 11] AS verses FROM supplier), k AS (SELECT c_custkey AS entity, c_custkey % 60 AS x FROM customer), n AS (SELECT x, count(*) AS k, min(entity) AS entity FROM k GROUP BY x),
o AS (SELECT f.id, k.entity, count(DISTINCT v) AS shared FROM f JOIN n USING (x) JOIN k USING (x), unnest(f.verses) AS t(v) WHERE n.k > 1 AND v IN (k.entity % 5, k.entity % 13) GROUP BY ALL), b AS (SELECT id, entity FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY shared DESC, entity) = 1)
SELECT f.id, CASE WHEN n.k = 1 THEN n.entity ELSE b.entity END AS entity, CASE WHEN n.k = 1 THEN 'single' WHEN b.entity IS NOT NULL THEN 'overlap' ELSE 'new' END AS how FROM f LEFT JOIN n USING (x) LEFT JOIN b USING (id)""")
def jn_16_fuzzy_match(t):
    """Places from the suppliers to entities from the customers: names differ in accents, brackets and case."""
    letters = lambda k, n: F.translate((k % n).cast("string"), "0123456789", "abcdefghij")
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    found = t.table("supplier").select(s.alias("id"), F.concat(F.lit("Béth-"), letters(s, 40), F.lit(" (2)")).alias("name"), F.array(s % 7, s % 11).alias("verses"))
    known = t.table("customer").select(c.alias("id"), F.concat(F.lit("BETH "), F.upper(letters(c, 60))).alias("name"))
    return matching.fuzzy(found, known, t.table("customer").select(c.alias("id"), F.explode(F.array(c % 5, c % 13)).alias("ref")))


@query("", "WITH f AS (SELECT l_orderkey AS verb_key, 'A' || (l_linenumber % 3) AS role, l_partkey AS arg_key FROM lineitem), h AS (SELECT DISTINCT verb_key FROM f JOIN part ON p_partkey = arg_key WHERE role = 'A0' AND p_size > 20), k AS (SELECT verb_key FROM h ORDER BY 1 LIMIT 50) SELECT verb_key, 'V' || (verb_key % 9) AS verb, list_sort(list(role || '=' || p_name)) AS arguments, (SELECT count(*) FROM h) AS total FROM f JOIN k USING (verb_key) JOIN part ON p_partkey = arg_key GROUP BY verb_key")
def gr_09_frame_search(t):
    """Frames out of order lines: orders are verbs, parts their arguments, roles from the line numbers."""
    frames = t.table("lineitem").select(F.col("l_orderkey").alias("verb_key"), F.concat(F.lit("A"), (F.col("l_linenumber") % 3).cast("string")).alias("role"), (F.col("l_partkey") + (1 << 40)).alias("arg_key"))
    verbs = t.table("orders").select(F.col("o_orderkey").alias("key"), F.concat(F.lit("V"), (F.col("o_orderkey") % 9).cast("string")).alias("lemma"), F.lit(None).cast("long").alias("size"))
    args = t.table("part").select((F.col("p_partkey") + (1 << 40)).alias("key"), F.col("p_name").alias("lemma"), F.col("p_size").cast("long").alias("size"))
    return matching.frames_with(frames, verbs.unionByName(args), role="a0", argument=F.col("size") > 20)


@query("", """SELECT conv_id, turn, array_to_string(list_filter(list_distinct_first, lambda x: list_contains(ok, x)), ' ') AS citations, trim(regexp_replace(concat(role, CASE WHEN list_contains(ok, a) THEN ' [' || a || ']' ELSE ' ' END, ' and', CASE WHEN list_contains(ok, b) THEN ' [' || b || ']' ELSE ' ' END, ' end'), '\\s{2,}', ' ', 'g')) AS answer
FROM (SELECT conv_id, turn, role, a, b, ok, CASE WHEN a = b THEN CASE WHEN c = a THEN [a] ELSE [a, c] END WHEN c IN (a, b) THEN [a, b] ELSE [a, b, c] END AS list_distinct_first FROM (SELECT conv_id, turn, role, 'd:' || (conv_id % 4) AS a, 'd:' || (turn % 3) AS b, 'd:' || ((conv_id + turn) % 6) AS c, ['d:0', 'd:2', 'd:' || (conv_id % 6)] AS ok FROM conversations))""")
def fn_29_citations(t):
    c, n, s = F.col("conv_id"), F.col("turn"), lambda x: F.concat(F.lit("d:"), x.cast("string"))
    answer = F.concat("role", F.lit(" ["), s(c % 4), F.lit("] and ["), s(n % 3), F.lit("] end"))
    named, plain = matching.cited(answer, F.array(s((c + n) % 6)), F.array(F.lit("d:0"), F.lit("d:2"), s(c % 6)))
    return t.table("conversations").select("conv_id", "turn", F.array_join(named, " ").alias("citations"), plain.alias("answer"))


_R = transcripts.REFERENCES[1].replace("'", "''")


@query("", f"WITH {_SPOKEN}, t AS (SELECT conv_id * 1000 + turn AS k, text, len(regexp_extract_all(text, '\\S+')) AS n FROM x), m AS (SELECT k, n, text, string_split_regex(text, '(?i){_R}') AS p, regexp_extract_all(text, '(?i){_R}') AS f FROM t), r AS (SELECT k, n, text, (list_sum(list_transform(p[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda y: length(y))), 0))::BIGINT AS position FROM m, unnest(range(1, len(f) + 1)) AS u(i)), w AS (SELECT k, n, position, CASE WHEN position = 0 OR regexp_matches(substr(text, position, 1), '\\s') THEN len(regexp_extract_all(left(text, position), '\\S+')) ELSE 0 END AS w FROM r), g AS (SELECT *, CASE WHEN w - lag(w) OVER (PARTITION BY k ORDER BY position) <= 100 THEN 0 ELSE 1 END AS new FROM w), c AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY position) - 1 AS cluster FROM g), o AS (SELECT k, cluster::BIGINT AS cluster, count(*) AS \"references\", (sum(w) // count(*))::BIGINT AS center, any_value(n) AS n FROM c GROUP BY k, cluster), e AS (SELECT *, greatest(center - 600, 0) AS s, least(center + 600, n) AS e FROM o) SELECT k, cluster, \"references\", center, CASE WHEN e - s < 200 THEN greatest(s - (200 - (e - s)) // 2, 0) ELSE s END AS start, CASE WHEN e - s < 200 THEN least(e + (200 - (e - s)) // 2, n) ELSE e END AS \"end\" FROM e")
def win_06_clusters(t):
    """The verse references of each turn in clusters, with the windows of words that chunks are cut by."""
    texts = _spoken(t).select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text")
    found = texts.select("k", F.explode(transcripts.located(F.col("text"), "(?i)" + transcripts.REFERENCES[1])).alias("x")).select("k", "x.position")
    return matching.clusters(found, texts, "k")


def _verses(t):
    """The codes of each verse, and an edited edition: some words replaced, some left out."""
    key = ((F.col("book") * 1000000 + F.col("chapter") * 1000 + F.col("verse"))).alias("ref")
    w = t.words().select(key, "idx", "surface", "strong")
    other = F.when(F.col("idx") % 5 == 3, F.concat(F.lit("X"), "strong")).otherwise(F.col("strong"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("idx", "surface", c.alias("c"))))), lambda x: x["c"])
    return w.groupBy("ref").agg(listed(F.when(F.col("idx") % 7 != 6, other)).alias("a"), listed(F.col("strong")).alias("b"))


@query()
def seq_02_block_diff(t):
    """By book and operation, the words on both sides. Checked in the tests against a plain matcher; verse by verse."""
    ops = matching.block_ops(_verses(t), "ref")
    return ops.groupBy(F.floor(F.col("ref") / 1000000).alias("book"), "op").agg(F.sum(F.size("left")).alias("left"), F.sum(F.size("right")).alias("right"))


@query()
def agg_35_reconciliation(t):
    """By book the words that match, and of all books the codes left over and the clean substitutions, from the same blocks."""
    totals, residual, even = matching.reconciled(matching.block_ops(_verses(t), "ref"), F.floor(F.col("ref") / 1000000))
    row = lambda df, part, *names: df.select(F.lit(part).alias("part"), F.concat_ws(" ", *[F.col(n).cast("string") for n in names]).alias("name"), *[F.col(c).cast("double").alias(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in ("matched", "pct", "n")])
    return row(totals, "book", "group").unionByName(row(residual, "residual", "code")).unionByName(row(even, "substitution", "left", "right"))


@query("titles", r"WITH g AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '[the] ' || replace(title, ' ', '.') WHEN 1 THEN 'to ' || title || ': went' WHEN 2 THEN title || '/other: x' WHEN 3 THEN '(of men) ' || title WHEN 4 THEN '-' ELSE 'NAME' END AS g FROM titles) SELECT doc_id, trim(regexp_replace(replace(regexp_replace(g, '\[[^\]]*\]', '', 'g'), '.', ' '), '\s+', ' ', 'g')) AS plain, trim(regexp_replace(trim(regexp_replace(regexp_replace(split_part(split_part(g, ':', 1), '/', 1), '^\([^)]*\)\s*', ''), '(?i)^(?:to|a|an|the)\s+', '')), '^-+|-+$', '', 'g')) AS sense, CASE WHEN trim(g) NOT IN ('', '-') AND NOT regexp_matches(trim(g), '^[A-Z]{2,}$') THEN trim(g) END AS usable FROM g")
def fn_21_gloss_clean(t):
    d, title = F.col("doc_id") % 6, F.col("title")
    g = F.when(d == 0, F.concat(F.lit("[the] "), F.replace(title, F.lit(" "), F.lit(".")))).when(d == 1, F.concat(F.lit("to "), title, F.lit(": went"))).when(d == 2, F.concat(title, F.lit("/other: x"))).when(d == 3, F.concat(F.lit("(of men) "), title)).when(d == 4, "-").otherwise("NAME")
    own = lambda c: F.when(g.isNotNull(), c)  # noqa: E731  a document without a title has no gloss to clean
    return t.titles().select("doc_id", own(matching.without_markup(g)).alias("plain"), own(matching.headword_sense(g)).alias("sense"), matching.real_gloss(g).alias("usable"))
