"""Queries of the scalar functions (FN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import refs, text
from lectern.operators.ranking import decayed, share
from lectern.plans.registry import query

_BOOKS = "['" + "', '".join(refs.BOOKS) + "']"
_CODE = f"{_BOOKS}[(x // 1000000)::INT]"


@query("refs", "SELECT doc_id, s // 1000000 AS book, s // 1000 % 1000 AS chapter, s % 1000 AS verse, (s // 1000000) * 1000000 + (s // 1000 % 1000) * 1000 + s % 1000 AS key FROM refs")
def fn_01_encode(t):
    r = t.refs()
    parts = r.select("doc_id", refs.book_of(F.col("s")).alias("book"), refs.chapter_of(F.col("s")).alias("chapter"), refs.verse_of(F.col("s")).alias("verse"))
    return parts.withColumn("key", refs.encode(F.col("book"), F.col("chapter"), F.col("verse")))


@query("refs", f"SELECT doc_id, {_CODE.replace('x', 's')} AS code, s // 1000 % 1000 AS chapter, s % 1000 AS verse FROM refs")
def fn_02_decode(t):
    s = F.col("s")
    return t.refs().select("doc_id", refs.code_of(refs.book_of(s)).alias("code"), refs.chapter_of(s).alias("chapter"), refs.verse_of(s).alias("verse"))


@query("refs", f"SELECT doc_id, {_CODE.replace('x', 's')} || ' ' || (s // 1000 % 1000) || ':' || (s % 1000) || CASE WHEN s = e THEN '' WHEN s // 1000 = e // 1000 THEN '-' || (e % 1000) WHEN s // 1000000 = e // 1000000 THEN '-' || (e // 1000 % 1000) || ':' || (e % 1000) ELSE ' - ' || {_CODE.replace('x', 'e')} || ' ' || (e // 1000 % 1000) || ':' || (e % 1000) END AS label FROM refs")
def fn_03_human(t):
    return t.refs().select("doc_id", refs.human(F.col("s"), F.col("e")).alias("label"))


@query("refs", "SELECT doc_id, s, least(s + 3, s // 1000 * 1000 + 999) AS e FROM refs")
def fn_07_osis(t):
    s, last = F.col("s"), F.least(F.col("s") + 3, F.floor(F.col("s") / 1000) * 1000 + 999)
    osis = t.refs().select("doc_id", F.concat_ws(".", refs.code_of(refs.book_of(s)), refs.chapter_of(s).cast("string"), F.concat_ws("-", refs.verse_of(s).cast("string"), refs.verse_of(last).cast("string"))).alias("osis"))
    a, b = refs.parse_osis(F.col("osis"))
    return osis.select("doc_id", a.alias("s"), b.alias("e"))


@query("", "SELECT doc_id, lower(regexp_replace(lang || ' ' || source, '[\\s.]+', '', 'g')) AS alias FROM documents")
def fn_05_alias(t):
    return t.table("documents").select("doc_id", text.alias(F.concat_ws(" ", "lang", "source")).alias("alias"))


@query("", f"SELECT i AS book, lower({_BOOKS}[i]) AS alias FROM range(1, 67) AS r(i) UNION ALL SELECT n_nationkey + 1, lower(n_name) FROM nation")
def fn_06_alias_table(t):
    codes = t.spark.range(1, 67).select(F.col("id").alias("book"), F.lower(refs.code_of(F.col("id"))).alias("alias"))
    return codes.unionByName(t.table("nation").select((F.col("n_nationkey") + 1).cast("long").alias("book"), text.alias(F.col("n_name")).alias("alias")))


@query("refs", f"SELECT doc_id, CASE WHEN s // 1000000 <= 39 THEN 'ot' ELSE 'nt' END AS testament, '/scripture/' || CASE WHEN s // 1000000 <= 39 THEN 'ot' ELSE 'nt' END || '/' || lower({_CODE.replace('x', 's')}) || '/' || (s // 1000 % 1000) || '/' || (s % 1000) AS url FROM refs")
def fn_08_testament(t):
    return t.refs().select("doc_id", refs.testament(refs.book_of(F.col("s"))).alias("testament"), refs.url(F.col("s")).alias("url"))


_RAW = "CASE WHEN p_partkey % 3 = 0 THEN 'g' ELSE 'H' END || p_partkey * 7 || CASE WHEN p_partkey % 5 = 0 THEN 'a' ELSE '' END"


def _codes(t):
    k = F.col("p_partkey")
    return t.table("part").select("p_partkey", F.concat(F.when(k % 3 == 0, "g").otherwise("H"), (k * 7).cast("string"), F.when(k % 5 == 0, "a").otherwise("")).alias("raw"))


@query("", f"SELECT p_partkey, raw, upper(raw[1]) || lpad(n, greatest(4, len(n))::INT, '0') AS code FROM (SELECT p_partkey, {_RAW} AS raw, (p_partkey * 7)::VARCHAR AS n FROM part)")
def fn_10_lexical_code(t):
    return _codes(t).select("p_partkey", "raw", text.lexical_code(F.col("raw")).alias("code"))


@query("", f"SELECT p_partkey, upper(raw[1]) || p || CASE WHEN p_partkey % 5 = 0 THEN 'a' ELSE '' END AS suffixed, upper(raw[1]) || p AS bare, upper(raw[1]) || n AS unpadded, CASE WHEN raw[1] = 'g' AND len(n) >= 5 THEN 'G' || n[1:4] ELSE upper(raw[1]) || p END AS greek4 FROM (SELECT *, lpad(n, greatest(4, len(n))::INT, '0') AS p FROM (SELECT p_partkey, {_RAW} AS raw, (p_partkey * 7)::VARCHAR AS n FROM part))")
def fn_11_code_variants(t):
    return _codes(t).select("p_partkey", *[c.alias(n) for n, c in text.code_variants(F.col("raw")).items()])


@query("", "SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'es' THEN 'spa' WHEN 'fr' THEN 'fra' ELSE lang END AS language FROM documents")
def fn_12_language(t):
    return t.table("documents").select("doc_id", text.language(F.col("lang")).alias("language"))


_FOLD = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


@query("titles", f"SELECT doc_id, translate(lower(title), '{_FOLD[0]}', '{_FOLD[1]}') AS folded FROM titles")
def fn_14_fold(t):
    return t.titles().select("doc_id", text.fold(F.col("title")).alias("folded"))


@query("titles", "SELECT doc_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM titles")
def fn_15_slug(t):
    return t.titles().select("doc_id", text.slug(F.col("title")).alias("slug"))


_STOP = "'the','and','for','with','this','that','from','was','are','der','die','das','und','les','des','que','los','las','una','por'"


@query("tokens", f"SELECT chunk_id, list(term ORDER BY pos) AS words FROM (SELECT chunk_id, term, min(pos) AS pos FROM tokens GROUP BY 1, 2) WHERE term NOT IN ({_STOP}) GROUP BY chunk_id")
def fn_16_keywords(t):
    return t.chunks().select("chunk_id", text.keywords(F.col("body")).alias("words")).where(F.size("words") > 0)


@query("chunks", f"SELECT chunk_id, count(DISTINCT w) AS n FROM (SELECT chunk_id, unnest(list_transform(regexp_extract_all(body, '[A-Za-z]+(?:''[A-Za-z]+)?'), lambda x: lower(x))) AS w FROM chunks) WHERE len(w) >= 3 AND w NOT IN ({_STOP}) GROUP BY chunk_id")
def fn_17_concordance_words(t):
    return t.chunks().select("chunk_id", F.size(text.concordance_words(F.col("body"))).cast("long").alias("n")).where("n > 0")


@query()
def fn_18_porter(t):
    vocabulary = t.tokens().select("term").distinct()
    return vocabulary.select("term", text.porter_stem("term").alias("stem"))


_STRIP = "coalesce(" + ", ".join(f"CASE WHEN suffix(w, '{s}') AND len(w) > {len(s) + 2} THEN w[1:len(w) - {len(s)}] END" for s in ("d", "s", "es", "ed", "ing", "er", "est", "ly", "ness")) + ", w)"


@query("tokens", f"SELECT w, {_STRIP} AS stem FROM (SELECT DISTINCT term AS w FROM tokens)")
def fn_19_strip_suffix(t):
    return t.tokens().select(F.col("term").alias("w")).distinct().select("w", text.strip_suffix(F.col("w")).alias("stem"))


@query("titles", "SELECT doc_id, array_to_string(list_filter(string_split_regex(trim(regexp_replace(regexp_replace(lower(title), '\\([^)]*\\)|\\[[^\\]]*\\]', ' ', 'g'), '[^a-z ]+', ' ', 'g')), ' +'), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the', 'to', 'of', 'be')), ' ') AS gloss FROM titles")
def fn_20_gloss(t):
    return t.titles().select("doc_id", text.gloss(F.col("title")).alias("gloss"))


@query("", "SELECT doc_id, CASE WHEN len(f) > 240 THEN rtrim(f[1:239]) || '…' ELSE f END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents)")
def fn_22_excerpt(t):
    return t.table("documents").select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


@query("tags", "SELECT doc_id, max(CASE WHEN tag LIKE 'kind:%' THEN tag[6:] END) AS kind, count(*) FILTER (tag LIKE 'source:%') AS sources FROM tags GROUP BY doc_id")
def fn_23_tag_helpers(t):
    own = t.tags().groupBy("doc_id").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    return own.select("doc_id", text.first_tag(F.col("tags"), "kind:").alias("kind"), F.size(text.all_tags(F.col("tags"), "source:")).cast("long").alias("sources"))


@query("words", "SELECT morph, string_split(morph, '-')[1] AS head, string_split(morph, '-')[-1] AS body, morph[1] IN ('N', 'V', 'A') AS content, count(*) AS n FROM words GROUP BY ALL")
def fn_24_morphology(t):
    m = F.col("morph")
    return t.words().groupBy("morph").agg(F.count("*").alias("n")).select("morph", F.split(m, "-")[0].alias("head"), F.element_at(F.split(m, "-"), -1).alias("body"), F.substring(m, 1, 1).isin("N", "V", "A").alias("content"), "n")


_COUNTS = "n AS (SELECT term, count(*) AS n FROM tokens GROUP BY term), total AS (SELECT sum(n) AS total FROM n)"


@query("tokens", f"WITH {_COUNTS} SELECT term, round(log10(n / total * 1e9), 4) AS zipf FROM n, total")
def fn_30_zipf(t):
    n = t.tokens().groupBy("term").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("term", F.round(F.log10(F.col("n") / F.col("total") * 1e9), 4).alias("zipf"))


@query("tokens", "WITH w AS (SELECT t.term, d.lang = 'en' AS own FROM tokens t JOIN documents d USING (doc_id)), n AS (SELECT term, count(*) FILTER (own) AS a, count(*) FILTER (NOT own) AS b FROM w GROUP BY term), s AS (SELECT sum(a) AS sa, sum(b) AS sb FROM n) SELECT term, round(CASE WHEN a > 0 THEN log10(a / sa * 1e9) ELSE 0 END - CASE WHEN b > 0 THEN log10(b / sb * 1e9) ELSE 0 END, 2) AS keyness FROM n, s")
def fn_31_keyness(t):
    own = F.col("lang") == "en"
    n = t.tokens().join(t.table("documents").select("doc_id", "lang"), "doc_id").groupBy("term").agg(F.count_if(own).alias("a"), F.count_if(~own).alias("b"))
    s = n.agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    zipf = lambda c, total: F.when(F.col(c) > 0, F.log10(F.col(c) / F.col(total) * 1e9)).otherwise(0.0)
    return n.crossJoin(F.broadcast(s)).select("term", F.round(zipf("a", "sa") - zipf("b", "sb"), 2).alias("keyness"))


@query("", "SELECT p_partkey, round(least(100.0, 100.0 * greatest(0.0, 1 - log10(p_partkey + 1) / 4) + least(greatest(p_size % 9, 0), 6) / 6.0 * 15), 1) AS priority FROM part")
def fn_32_priority(t):
    score = F.least(F.greatest(F.col("p_size") % 9, F.lit(0)), F.lit(6)) / 6.0 * 15
    return t.table("part").select("p_partkey", F.round(F.least(F.lit(100.0), F.lit(100.0) * F.greatest(F.lit(0.0), 1 - F.log10(F.col("p_partkey") + 1) / 4) + score), 1).alias("priority"))


@query("refs", "SELECT doc_id, round(1 - 0.5 * least(e - s, 500) / 500.0, 6) AS score FROM refs")
def fn_33_specificity(t):
    return t.refs().select("doc_id", F.round(refs.specificity(F.col("s"), F.col("e")), 6).alias("score"))


@query("refs", "SELECT doc_id, round(0.95 - 0.1 * (row_number() OVER (PARTITION BY s // 1000000 ORDER BY e - s, doc_id) - 1) / count(*) OVER (PARTITION BY s // 1000000), 6) AS score FROM refs")
def fn_34_decay(t):
    r = t.refs().withColumn("book", refs.book_of(F.col("s"))).withColumn("width", F.col("e") - F.col("s"))
    return decayed(r, 0.95, 0.1, F.col("width"), F.col("doc_id"), keys=["book"]).select("doc_id", "score")


@query("", "SELECT lang, source, n, round(n / sum(n) OVER (PARTITION BY lang), 3) AS share FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2)")
def fn_35_share(t):
    return share(t.table("documents").groupBy("lang", "source").agg(F.count("*").alias("n")), "n", ["lang"])


@query("tokens", "SELECT term, round(log2(count(DISTINCT doc_id)) + CASE WHEN len(term) > 8 THEN 1 ELSE 0 END, 4) AS importance FROM tokens GROUP BY term")
def fn_36_importance(t):
    n = t.tokens().groupBy("term").agg(F.countDistinct("doc_id").alias("n"))
    return n.select("term", F.round(F.log2("n") + F.when(F.length("term") > 8, 1.0).otherwise(0.0), 4).alias("importance"))


@query("tokens", "SELECT term, round(ln(1 + count(*)) + len(term) / 10.0, 4) AS centrality FROM tokens GROUP BY term")
def fn_37_centrality(t):
    return t.tokens().groupBy("term").agg(F.round(F.log1p(F.count("*")) + F.length("term") / 10.0, 4).alias("centrality"))


@query("", "SELECT o_orderkey, round(o_totalprice / max(o_totalprice) OVER (PARTITION BY o_orderpriority), 4) AS relative, round(least(1.0, o_totalprice / 500000.0), 4) AS absolute FROM orders")
def fn_38_lead_scores(t):
    from pyspark.sql.window import Window

    top = F.max("o_totalprice").over(Window.partitionBy("o_orderpriority"))
    return t.table("orders").select("o_orderkey", F.round(F.col("o_totalprice") / top, 4).alias("relative"), F.round(F.least(F.lit(1.0), F.col("o_totalprice") / 500000.0), 4).alias("absolute"))


_SIM = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 50 = 0), p AS (SELECT q.vec_id AS q, q.label AS ql, v.label AS vl, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.x, v.x), 6) DESC, v.vec_id) AS rn FROM q JOIN v ON q.vec_id <> v.vec_id)"


@query("", f"WITH {_SIM} SELECT round(avg(1.0 / first), 4) AS mrr, round(avg((first <= 5)::INT), 4) AS r5, round(avg(p5), 4) AS p5 FROM (SELECT q, min(CASE WHEN ql = vl THEN rn END) AS first, sum(CASE WHEN ql = vl AND rn <= 5 THEN 1 ELSE 0 END) / 5.0 AS p5 FROM p GROUP BY q)")
def fn_39_retrieval_metrics(t):
    from lectern.operators.vectors import first_hits, ranked_neighbours

    v = t.table("embeddings")
    q = v.where("vec_id % 50 = 0")
    near = ranked_neighbours(q, v, 5).join(v.select(F.col("vec_id").alias("q"), F.col("label").alias("ql")), "q").join(v.select("vec_id", F.col("label").alias("vl")), "vec_id")
    five = near.groupBy("q").agg((F.count_if(F.col("ql") == F.col("vl")) / 5.0).alias("p5"))
    per = first_hits(q, v, "label").join(five, "q", "left")
    return per.agg(F.round(F.avg(1.0 / F.col("first")), 4).alias("mrr"), F.round(F.avg((F.col("first") <= 5).cast("int")), 4).alias("r5"), F.round(F.avg("p5"), 4).alias("p5"))


@query("", "SELECT conv_id, turn, (turn // 60) * 60 + turn % 60 + 3600 AS seconds FROM conversations")
def fn_41_clock(t):
    clock = F.format_string("1:%02d:%02d", F.floor(F.col("turn") / 60).cast("int"), (F.col("turn") % 60).cast("int"))
    return t.table("conversations").select("conv_id", "turn", refs.clock_seconds(clock).alias("seconds"))


@query("tags", "SELECT doc_id, len(list_intersect(l, ['lang:en', 'kind:note', 'toxic:1'])) AS common, len(list_distinct(list_concat(l, ['lang:en']))) AS united FROM (SELECT doc_id, list(tag) AS l FROM tags GROUP BY doc_id)")
def fn_42_arrays(t):
    own = t.tags().groupBy("doc_id").agg(F.collect_list("tag").alias("l"))
    return own.select("doc_id", F.size(F.array_intersect("l", F.array(*map(F.lit, ("lang:en", "kind:note", "toxic:1"))))).cast("long").alias("common"), F.size(F.array_union("l", F.array(F.lit("lang:en")))).cast("long").alias("united"))


@query("tags", "SELECT tag, list(doc_id ORDER BY doc_id) AS docs FROM (SELECT DISTINCT tag, doc_id FROM tags) GROUP BY tag")
def fn_43_inversion(t):
    return t.tags().groupBy("tag").agg(F.array_sort(F.collect_set("doc_id")).alias("docs"))


@query("", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def fn_44_json(t):
    return t.table("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("entities", "SELECT id, lower(metadata->>'description')[1:160] AS summary FROM entities")
def fn_45_json_summary(t):
    return t.entities().select("id", F.substring(F.lower(F.get_json_object("metadata", "$.description")), 1, 160).alias("summary"))
