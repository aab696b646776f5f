"""Queries of full text, retrievers, expansion, fusion, vectors, graph, corpora, alignment, cards, windows of events and views."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import concordance_words, terms
from lectern.operators import align, cards, corpus, expand, fts, fusion, graph, lists, ranking, retrieve, tags, vectors
from lectern.plans.registry import query
from lectern.plans.views import doc_of
from lectern.streaming import windows

_Q = "q AS (SELECT term FROM (SELECT term, count(DISTINCT chunk_id) AS df FROM tokens GROUP BY term) WHERE df < 0.2 * (SELECT count(DISTINCT chunk_id) FROM tokens) ORDER BY df DESC, term LIMIT 3)"
_BM = "dl AS (SELECT {u} AS u, count(*) AS dl FROM {t} GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), p AS (SELECT {u} AS u, term, count(*) AS tf FROM {t} WHERE term IN (SELECT term FROM q) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM p GROUP BY term), bm AS (SELECT p.u, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM p JOIN df USING (term) JOIN dl USING (u), st GROUP BY p.u)"
_FTS = f"{_Q}, {_BM.format(u='chunk_id', t='tokens')}"
_CAN = "can AS (SELECT doc_id, arg_min(chunk_id, chunk_index) AS chunk_id FROM chunks GROUP BY doc_id)"


def _hits(frm: str, name: str, order: str = "score DESC, chunk_id", limit: int = 50, by: str = "") -> str:
    return f"SELECT {by or '0::BIGINT'} AS query_id, chunk_id, rank, score::DOUBLE AS score, '{name}' AS retriever FROM (SELECT *, row_number() OVER ({f'PARTITION BY {by} ' if by else ''}ORDER BY {order}) AS rank FROM {frm}) WHERE rank <= {limit}"


def question(t):
    """The query terms: the most frequent words under a fifth of the chunks."""
    return fts.frequent_terms(t.bags(), 3)


@query("tokens", "SELECT term, chunk_id, count(*) AS tf FROM tokens GROUP BY 1, 2")
def fts_01_postings(t):
    return fts.postings(t.tokens())


_CORPUS = "corp AS (SELECT doc_id, CASE WHEN bool_or(tag = 'resource:aquifer') THEN 'aquifer' WHEN bool_or(tag = 'kind:bible') THEN 'bible' WHEN bool_or(tag = 'kind:lexicon') THEN 'lexicon' WHEN bool_or(tag = 'kind:morphology') THEN 'morphology' ELSE 'main' END AS corpus FROM tags GROUP BY doc_id)"


@query("tags", f"WITH {_CORPUS} SELECT * FROM corp")
def fts_02_routing(t):
    return fts.corpus_of(t.tags())


@query("tags tokens", f"WITH {_CORPUS} SELECT corpus, count(DISTINCT chunk_id) AS chunks, count(*) AS tokens FROM tokens JOIN corp USING (doc_id) GROUP BY corpus")
def fts_03_partitions(t):
    return t.tokens().join(fts.corpus_of(t.tags()), "doc_id").groupBy("corpus").agg(F.countDistinct("chunk_id").alias("chunks"), F.count("*").alias("tokens"))


@query("tokens", f"WITH {_FTS} SELECT u AS chunk_id, score FROM bm")
def fts_04_bm25(t):
    index = t.index()
    return index.bm25(index.frequent(3))


@query("tokens tags", f"WITH {_FTS}, f AS (SELECT DISTINCT chunk_id, doc_id FROM tokens), {_CORPUS} SELECT u AS chunk_id, score FROM bm JOIN f ON f.chunk_id = u WHERE doc_id IN (SELECT doc_id FROM tags WHERE tag = 'lang:en') ORDER BY score DESC, chunk_id LIMIT 50")
def fts_05_filtered(t):
    index = t.index()
    found = index.bm25(index.frequent(3)).withColumn("doc_id", doc_of(F.col("chunk_id")))
    return tags.tagged(found, t.tags(), "lang:en").select("chunk_id", "score").orderBy(F.desc("score"), "chunk_id").limit(50)


_TT = "tt AS (SELECT doc_id, unnest(regexp_extract_all(lower(title), '[a-zà-öø-ÿß]{3,}')) AS term FROM titles)"



@query("tokens titles chunks", f"WITH {_Q}, {_TT}, {_BM.format(u='doc_id', t='tt')}, {_CAN}, r AS (SELECT u AS doc_id, row_number() OVER (ORDER BY score DESC, u) AS rank FROM bm) SELECT 0::BIGINT AS query_id, chunk_id, rank, round(1 - (rank - 1) / (SELECT count(*) FROM r WHERE rank <= 20), 6) AS score, 'title' AS retriever FROM r JOIN can USING (doc_id) WHERE rank <= 20")
def ret_02_title(t):
    return retrieve.by_title_index(t.title_index(), t.index().frequent(3), t.heads())


@query("tokens titles", f"WITH {_Q}, {_TT}, {_BM.format(u='doc_id', t='tt')} SELECT u AS doc_id, score FROM bm")
def fts_06_titles(t):
    return t.title_index().bm25(t.index().frequent(3), "doc_id")


@query("tokens", "WITH hit AS (SELECT chunk_id, min(pos) AS p FROM tokens WHERE term = 'les' GROUP BY chunk_id) SELECT chunk_id, string_agg(CASE WHEN term = 'les' THEN '<<les>>' ELSE term END, ' ' ORDER BY pos) AS snippet FROM tokens JOIN hit USING (chunk_id) WHERE pos BETWEEN p - 7 AND p + 8 GROUP BY chunk_id")
def fts_08_snippets(t):
    return fts.snippets(t.tokens(), "les")


_CONC = "conc AS (SELECT DISTINCT w AS word, chunk_id FROM (SELECT chunk_id, unnest(list_transform(regexp_extract_all(body, '[A-Za-z]+(?:''[A-Za-z]+)?'), lambda x: lower(x))) AS w FROM chunks) WHERE len(w) >= 3 AND w NOT IN ('the','and','for','with','this','that','from','was','are','der','die','das','und','les','des','que','los','las','una','por'))"


@query("chunks", f"WITH {_CONC} SELECT * FROM conc")
def fts_09_concordance(t):
    return fts.concordance(t.chunks(), concordance_words(F.col("body")))


@query("chunks", f"WITH {_CONC} SELECT * FROM conc WHERE word = 'thth' ORDER BY chunk_id LIMIT 20 OFFSET 5")
def fts_10_lookup(t):
    own = t.chunks().where(F.lower("body").contains("thth"))  # no other chunk travels
    return ranking.page(fts.concordance(own, concordance_words(F.col("body"))).where("word = 'thth'"), 5, 20, F.col("chunk_id"))


@query("tokens", "WITH b AS (SELECT chunk_id, pos, term, lead(term) OVER (PARTITION BY chunk_id ORDER BY pos) AS nxt FROM tokens) SELECT chunk_id, count(*) AS n FROM b WHERE term = 'the' AND nxt = 'the' GROUP BY chunk_id")
def fts_04b_phrase(t):
    return fts.phrase(t.tokens(), ["the", "the"])


@query("tags tokens", f"WITH {_Q}, {_CORPUS}, t AS (SELECT corpus, chunk_id, term FROM tokens JOIN corp USING (doc_id)), dl AS (SELECT corpus, chunk_id, count(*) AS dl FROM t GROUP BY 1, 2), st AS (SELECT corpus, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY 1), p AS (SELECT corpus, chunk_id, term, count(*) AS tf FROM t JOIN q USING (term) GROUP BY 1, 2, 3), df AS (SELECT corpus, term, count(*) AS df FROM p GROUP BY 1, 2) SELECT corpus, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM p JOIN df USING (corpus, term) JOIN dl USING (corpus, chunk_id) JOIN st USING (corpus) GROUP BY 1, 2")
def fts_05b_isolated(t):
    return fts.bm25_by_corpus(t.bags(), fts.corpus_of(t.tags()), question(t))


@query("tokens", f"WITH {_FTS} " + _hits("(SELECT u AS chunk_id, score FROM bm)", "fts"))
def ret_01_fts(t):
    return retrieve.by_index(t.index(), t.index().frequent(3))


_PASS = "ps AS (SELECT doc_id AS query_id, s AS qs, e AS qe FROM refs WHERE doc_id % 50 = 0)"


@query("refs chunks tags", f"WITH {_PASS}, {_CAN}, m AS (SELECT query_id, doc_id, min(e - s) AS width FROM refs JOIN ps ON s <= qe AND qs <= e WHERE e - s <= 3000 AND doc_id NOT IN (SELECT doc_id FROM tags WHERE tag IN ('kind:bible', 'kind:morphology')) GROUP BY 1, 2) " + _hits("(SELECT query_id, chunk_id, width, round(1 - 0.5 * least(width, 500) / 500.0, 6) AS score FROM m JOIN can USING (doc_id))", "passage", "width, chunk_id", by="query_id"))
def ret_03_passage(t):
    p = t.refs().where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("s").alias("qs"), F.col("e").alias("qe"))
    return retrieve.by_passage(t.refs(), t.chunks(), t.tags(), p)


@query("tokens tags", f"WITH tk AS (SELECT * FROM tokens WHERE doc_id IN (SELECT doc_id FROM tags WHERE tag = 'kind:bible')), {_Q}, {_BM.format(u='chunk_id', t='tk')} " + _hits("(SELECT u AS chunk_id, score FROM bm)", "scripture"))
def ret_04_scripture(t):
    return retrieve.by_kind_text(t.bags(), t.tags(), "bible", question(t), "scripture")


@query("chunks tags", f"WITH {_CAN} " + _hits("(SELECT chunk_id, 1.0 AS score FROM can WHERE doc_id IN (SELECT doc_id FROM tags WHERE tag IN ('toxic:1', 'kind:term')) AND doc_id NOT IN (SELECT doc_id FROM tags WHERE tag = 'resource:aquifer'))", "tag", "chunk_id"))
def ret_05_tag(t):
    return retrieve.by_tags(t.tags(), t.chunks(), ["toxic:1", "kind:term"])


_NN = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), nn AS (SELECT q.vec_id AS q, v.vec_id, round(list_dot_product(q.x, v.x), 6) AS sim, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.x, v.x), 6) DESC, v.vec_id) AS rn FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)"


@query("", f"WITH {_NN} SELECT q AS query_id, 'vec:' || vec_id AS chunk_id, rn AS rank, sim AS score, 'vector' AS retriever FROM nn WHERE rn <= 50")
def ret_06_vector(t):
    v = t.table("embeddings")
    near = vectors.ranked_neighbours(v.where("vec_id % 50 = 0"), v, 50)
    return near.select(F.col("q").alias("query_id"), F.concat(F.lit("vec:"), F.col("vec_id").cast("string")).alias("chunk_id"), F.col("rn").alias("rank"), F.col("sim").alias("score"), F.lit("vector").alias("retriever"))


@query("tokens", "WITH u AS (SELECT chunk_id, 1.0 AS score FROM tokens WHERE term = 'the' UNION ALL SELECT chunk_id, 0.9 FROM tokens WHERE starts_with(term, 'thea') UNION ALL SELECT chunk_id, 0.5 FROM tokens WHERE contains(term, 'ing')), m AS (SELECT chunk_id, max(score) AS score FROM u GROUP BY 1) " + _hits("m", "lexicon", limit=200))
def ret_07_lexicon(t):
    k = t.tokens()
    return retrieve.tiered("lexicon", (k.where("term = 'the'"), 1.0), (k.where(F.col("term").startswith("thea")), 0.9), (k.where(F.contains("term", F.lit("ing"))), 0.5), limit=200)


@query("chunks tags refs", f"WITH {_CAN}, u AS (SELECT doc_id, 1.0 AS score FROM tags WHERE tag = 'kind:morphology' UNION ALL SELECT doc_id, 0.6 FROM refs WHERE s BETWEEN 1000000 AND 20999999), m AS (SELECT chunk_id, max(score) AS score FROM u JOIN can USING (doc_id) GROUP BY 1) " + _hits("m", "morphology", limit=100))
def ret_08_morphology(t):
    c = retrieve.canonical(t.chunks())
    return retrieve.tiered("morphology", (t.tags().where("tag = 'kind:morphology'").join(c, "doc_id"), 1.0), (t.refs().where("s between 1000000 and 20999999").join(c, "doc_id"), 0.6), limit=100)


@query("edges", "WITH k AS (SELECT source_id, row_number() OVER (PARTITION BY target_id ORDER BY source_id) AS k FROM edges WHERE relation = 'located-in') " + _hits("(SELECT source_id AS chunk_id, 1.0 - k / 10.0 AS score FROM k WHERE k <= 5)", "entity", limit=100))
def ret_09_entity(t):
    return retrieve.by_entity(t.edges(), t.entities(), "located-in")


@query("refs", "WITH d AS (SELECT s, doc_id FROM refs WHERE e - s < 30), f AS (SELECT *, CASE WHEN s // 1000 = lag(s) OVER (ORDER BY s, doc_id) // 1000 AND s - lag(s) OVER (ORDER BY s, doc_id) <= 2 THEN 0 ELSE 1 END AS new FROM d), i AS (SELECT *, sum(new) OVER (ORDER BY s, doc_id ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT min(s) AS s, max(s) AS e, min(doc_id) AS best FROM i GROUP BY k")
def ret_10_bible(t):
    from lectern.operators.derive import consolidated

    return consolidated(t.refs().where("e - s < 30").groupBy("s").agg(F.min("doc_id").alias("doc_id"))).drop("n")


@query("topics refs chunks", f"WITH {_CAN}, m AS (SELECT doc_id, min(x.s) AS at_ FROM refs r JOIN topics x ON r.s <= x.e AND x.s <= r.e WHERE lower(name) = 'economy brand#1' OR (starts_with(lower(name), 'economy brand#1') AND NOT EXISTS (SELECT 1 FROM topics WHERE lower(name) = 'economy brand#1')) GROUP BY 1) " + _hits("(SELECT chunk_id, 1.0 AS score, at_ FROM m JOIN can USING (doc_id))", "topic", "at_, chunk_id"))
def ret_11_topic(t):
    return retrieve.by_topic(t.topics(), "economy brand#1", t.refs(), t.chunks())


@query("xref refs chunks", f"WITH {_CAN}, src AS (SELECT DISTINCT s AS source FROM refs WHERE doc_id % 50 = 0), m AS (SELECT doc_id, min((CASE attribution WHEN 'F' THEN 0 ELSE 1 END, coalesce(rank, 1099511627776), ts)) AS best FROM xref JOIN src USING (source) JOIN refs ON refs.s <= te AND ts <= refs.e GROUP BY 1) " + _hits("(SELECT chunk_id, 1.0 AS score, best FROM m JOIN can USING (doc_id))", "xref", "best, chunk_id"))
def ret_12_xref(t):
    return retrieve.by_cross_reference(t.xref(), t.refs().where("doc_id % 50 = 0").select(F.col("s").alias("source")).distinct(), t.refs(), t.chunks())


@query("refs", "WITH p AS (SELECT DISTINCT s + k AS ref FROM refs, unnest(range(0, e - s + 1)) AS u(k) WHERE s // 1000 = e // 1000) SELECT query_id, chunk_id, rank, round(1 - (rank - 1) / 20, 6) AS score, retriever FROM (" + _hits("(SELECT 'verse:' || ref AS chunk_id, 1.0 AS score FROM p)", "cfabric", "chunk_id", 20) + ")")
def ret_13_minted(t):
    return retrieve.minted(t.refs())


@query("tokens tags", f"WITH tk AS (SELECT * FROM tokens WHERE doc_id IN (SELECT doc_id FROM tags WHERE tag = 'resource:aquifer')), {_Q}, {_BM.format(u='chunk_id', t='tk')} " + _hits("(SELECT u AS chunk_id, score FROM bm)", "aquifer"))
def ret_14_isolated(t):
    return retrieve.by_tagged_text(t.bags(), t.tags(), "resource:aquifer", question(t), "aquifer")


@query("tokens refs speakers", f"WITH {_FTS}, said AS (SELECT DISTINCT doc_id FROM refs r JOIN speakers x ON r.s BETWEEN x.s AND x.e WHERE speaker = 'user'), c AS (SELECT DISTINCT chunk_id FROM tokens WHERE doc_id IN (SELECT doc_id FROM said)) " + _hits("(SELECT u AS chunk_id, score FROM bm WHERE u IN (SELECT chunk_id FROM c))", "speaker", limit=40))
def ret_15_speaker(t):
    return retrieve.by_speaker(t.bags(), question(t), t.refs(), t.speakers(), "user")


@query("tokens", "WITH m AS (SELECT term FROM tokens GROUP BY term ORDER BY count(*) DESC, term LIMIT 60), n AS (SELECT chunk_id, count(DISTINCT term) AS score FROM tokens JOIN m USING (term) GROUP BY 1) " + _hits("n", "semdomain"))
def ret_16_domain(t):
    m = t.tokens().groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(60)
    return retrieve.by_domain(t.tokens(), m)


@query("words", "SELECT surface AS word, strong, max(is_content + 1) AS quality FROM words GROUP BY 1, 2")
def exp_01_reverse_index(t):
    return expand.reverse_index(t.words())


_KEY = "k AS (SELECT strong, round(ln(1 + count(*)), 6) AS keyness FROM words GROUP BY 1)"


def _keyness(t):
    return t.words().groupBy("strong").agg(F.round(F.log1p(F.count("*")), 6).alias("keyness"))


@query("words", f"WITH {_KEY}, i AS (SELECT surface AS word, strong, max(is_content + 1) AS quality FROM words GROUP BY 1, 2), r AS (SELECT word, strong, keyness, row_number() OVER (PARTITION BY word ORDER BY quality DESC, keyness DESC, strong) AS rn FROM i JOIN k USING (strong)) SELECT word, strong, keyness FROM r WHERE rn <= 2 ORDER BY keyness DESC, word, strong LIMIT 40")
def exp_02_concepts(t):
    return expand.concepts(expand.reverse_index(t.words()), _keyness(t), total=40)


@query("words", f"WITH {_KEY}, i AS (SELECT DISTINCT surface AS word, strong FROM words WHERE is_content = 1) SELECT word, strong FROM (SELECT word, strong, row_number() OVER (PARTITION BY word ORDER BY keyness DESC, strong) AS rn FROM i JOIN k USING (strong)) WHERE rn <= 12")
def exp_04_terms(t):
    i = t.words().where("is_content = 1").select(F.col("surface").alias("word"), "strong").distinct().join(_keyness(t), "strong")
    return ranking.per_key(i, ["word"], 12, F.desc("keyness"), F.col("strong")).select("word", "strong")


@query("words", "WITH s AS (SELECT surface, strong, n, round(n / sum(n) OVER (PARTITION BY strong), 4) AS share FROM (SELECT surface, strong, count(*) AS n FROM words GROUP BY 1, 2)), o AS (SELECT * FROM s WHERE share >= 0.15), p AS (SELECT a.surface AS word, b.surface AS other, max(b.share) AS share FROM o a JOIN o b USING (strong) WHERE a.surface <> b.surface GROUP BY 1, 2) SELECT word, other FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY share DESC, other) AS rn FROM p) WHERE rn <= 4")
def exp_05_family(t):
    return expand.family(ranking.share(t.words().groupBy("surface", "strong").agg(F.count("*").alias("n")), "n", ["strong"], digits=4))


@query("", "WITH c AS (SELECT l_suppkey AS s, l_partkey AS p, count(*) AS n FROM lineitem GROUP BY 1, 2), f AS (SELECT l_suppkey AS s, count(*) AS freq FROM lineitem GROUP BY 1) SELECT s, p, n FROM (SELECT s, p, n, row_number() OVER (PARTITION BY s ORDER BY n DESC, p) AS rn FROM c WHERE n >= 2 AND s IN (SELECT s FROM f WHERE freq < 1500)) WHERE rn <= 2")
def exp_06_bridge(t):
    li = t.table("lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"))
    return expand.bridge(li.groupBy("s", "p").agg(F.count("*").alias("n")), li.groupBy("s").agg(F.count("*").alias("freq")))


_DOM = "c AS (SELECT strong, lemma[1:3] AS domain, count(*) AS n FROM words GROUP BY 1, 2), d AS (SELECT strong, domain, n / sum(n) OVER (PARTITION BY strong) AS share, n AS centrality FROM c)"


@query("words", f"WITH {_DOM}, o AS (SELECT * FROM d WHERE share >= 0.5), z AS (SELECT domain FROM o GROUP BY 1 HAVING count(*) <= 80), x AS (SELECT * FROM o WHERE domain IN (SELECT domain FROM z)) SELECT strong, other FROM (SELECT a.strong, b.strong AS other, row_number() OVER (PARTITION BY a.strong ORDER BY b.centrality DESC, b.strong) AS rn FROM x a JOIN x b USING (domain) WHERE a.strong <> b.strong) WHERE rn <= 2")
def exp_07_siblings(t):
    c = t.words().groupBy("strong", F.substring("lemma", 1, 3).alias("domain")).agg(F.count("*").alias("centrality"))
    return expand.siblings(ranking.share(c, "centrality", ["strong"], digits=12))


@query("", f"WITH {_NN} SELECT q, (vec_id % 66 + 1) * 1000000 + 1001 AS ref, sim FROM nn WHERE sim >= 0.3 AND rn <= 10")
def exp_09_clause_points(t):
    v = t.table("embeddings")
    near = vectors.ranked_neighbours(v.where("vec_id % 50 = 0"), v, 10).where("sim >= 0.3")
    return near.select("q", ((F.col("vec_id") % 66 + 1) * 1000000 + 1001).alias("ref"), "sim")


@query("refs xref", "WITH h AS (SELECT DISTINCT s FROM refs WHERE doc_id % 50 = 0), g AS (SELECT DISTINCT h.s AS source, ts, te FROM h JOIN xref ON xref.source = h.s) SELECT doc_id, round(sum(1.0 / (60 + k)), 8) AS score FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM (SELECT DISTINCT doc_id, source FROM refs JOIN g ON refs.s <= te AND ts <= refs.e)) WHERE k <= 20 GROUP BY doc_id")
def exp_10_snowball(t):
    from lectern.operators.intervals import overlap_join

    h = t.refs().where("doc_id % 50 = 0").select(F.col("s").alias("source")).distinct()
    g = t.xref().join(h, "source").select("source", "ts", "te").distinct()
    met = overlap_join(t.refs(), g).select("doc_id", "source").distinct()
    k = ranking.per_key(met, ["source"], 20, F.col("doc_id"), name="k")
    return k.groupBy("doc_id").agg(F.round(F.sum(1.0 / (60 + F.col("k"))), 8).alias("score"))


@query("topics occurrences", "WITH m AS (SELECT name, lex, count(*) AS n FROM topics JOIN occurrences ON ref BETWEEN s AND e GROUP BY 1, 2) SELECT name, lex, n FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, lex) AS rn FROM m) WHERE rn <= 5")
def exp_11_topic_lemmas(t):
    from lectern.plans.aggregates import topic_lexemes

    m = topic_lexemes(t)
    return ranking.per_key(m, ["name"], 5, F.desc("n"), F.col("lex")).select("name", "lex", "n")


@query("words", "SELECT word, arg_min(strong, (-n, strong)) AS strong FROM (SELECT surface AS word, strong, count(*) AS n FROM words GROUP BY 1, 2) GROUP BY word")
def exp_12_gloss_translation(t):
    c = t.words().groupBy(F.col("surface").alias("word"), "strong").agg(F.count("*").alias("n"))
    return c.groupBy("word").agg(F.min_by("strong", F.struct(-F.col("n"), "strong")).alias("strong"))


@query("words", "SELECT book, chapter, verse, 'Location: ' || book || ':' || chapter || ':' || verse || ' | ' || string_agg(strong, ' ' ORDER BY idx, strong) AS text FROM words GROUP BY 1, 2, 3")
def exp_13_prefix_text(t):
    own = t.words().groupBy("book", "chapter", "verse").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "strong"))), lambda x: x["strong"]), " ").alias("codes"))
    place = F.concat_ws(":", *[F.col(c).cast("string") for c in ("book", "chapter", "verse")])
    return own.select("book", "chapter", "verse", F.concat(F.lit("Location: "), place, F.lit(" | "), "codes").alias("text"))


@query("occurrences", "SELECT 'lex:' || lex AS tag, count(*) AS n FROM occurrences GROUP BY 1 UNION ALL SELECT 'lexstem:' || lex || '.' || stem, count(*) FROM occurrences GROUP BY 1 UNION ALL SELECT 'sense:' || lex || '.' || stem || '.' || sense, count(*) FROM occurrences GROUP BY 1")
def exp_14_synthetic_tags(t):
    tag = F.explode(F.array(F.concat(F.lit("lex:"), "lex"), F.concat(F.lit("lexstem:"), F.concat_ws(".", "lex", "stem")), F.concat(F.lit("sense:"), F.concat_ws(".", "lex", "stem", F.col("sense").cast("string")))))
    return t.occurrences().select(tag.alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def _three(t):
    index, heads = t.index(), t.heads()
    words = index.frequent(3)
    return retrieve.by_index(index, words).unionByName(retrieve.by_title_index(t.title_index(), words, heads)).unionByName(retrieve.by_tags(t.tags(), heads, ["toxic:1", "kind:term"]))


_THREE = (
    f"{_FTS}, {_TT}, {_CAN}, tdl AS (SELECT doc_id AS u, count(*) AS dl FROM tt GROUP BY 1), tst AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM tdl), tp AS (SELECT doc_id AS u, term, count(*) AS tf FROM tt WHERE term IN (SELECT term FROM q) GROUP BY 1, 2), tdf AS (SELECT term, count(*) AS df FROM tp GROUP BY term), "
    "tbm AS (SELECT tp.u, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tp JOIN tdf USING (term) JOIN tdl USING (u), tst GROUP BY tp.u), hits AS (SELECT chunk_id, rank, retriever FROM ("
    + _hits("(SELECT u AS chunk_id, score FROM bm)", "fts")
    + ") UNION ALL SELECT chunk_id, rank, 'title' FROM (SELECT u AS doc_id, row_number() OVER (ORDER BY score DESC, u) AS rank FROM tbm) JOIN can USING (doc_id) WHERE rank <= 20 UNION ALL SELECT chunk_id, rank, retriever FROM ("
    + _hits("(SELECT chunk_id, 1.0 AS score FROM can WHERE doc_id IN (SELECT doc_id FROM tags WHERE tag IN ('toxic:1', 'kind:term')) AND doc_id NOT IN (SELECT doc_id FROM tags WHERE tag = 'resource:aquifer'))", "tag", "chunk_id")
    + "))"
)


@query("tokens titles chunks tags", f"WITH {_THREE}, w(retriever, weight) AS (VALUES ('fts', 1.0), ('title', 0.5), ('tag', 1.0)) SELECT 0::BIGINT AS query_id, chunk_id, round(sum(weight / (60 + rank)), 8) AS score, list_sort(list_distinct(list(retriever))) AS retrievers FROM hits JOIN w USING (retriever) GROUP BY chunk_id")
def fus_01_rrf(t):
    return fusion.rrf(_three(t), fusion.weights(t.spark).where("intent = 'thematic'"))


#: The matrix written out once more, so that the SQL doesn't come from the value it is to check.
_WEIGHTS = """
thematic 1.0 0.5 1.0 0.0 1.0 1.0 0.0 0.0 0.0 0.5 0.0 0.0 0.0 0.5 0.0 0.8
entity_lookup 1.0 2.5 0.8 0.0 1.5 1.0 0.0 0.0 0.5 0.5 0.0 0.0 0.0 0.2 0.0 0.0
passage_specific 1.0 0.6 1.2 0.0 1.0 1.0 0.0 0.0 0.0 2.0 0.0 0.5 1.5 0.2 0.0 0.0
passage_book 1.0 0.6 1.1 0.0 1.0 1.0 0.0 0.0 0.0 1.5 0.0 0.0 0.5 0.2 0.0 0.0
methodology 1.0 1.5 1.0 0.0 1.0 1.2 0.0 0.0 0.0 0.0 0.0 0.0 0.0 0.0 0.0 0.0
word_study 0.3 0.5 0.0 0.0 0.5 0.5 3.0 1.5 0.0 0.0 0.0 0.0 2.0 0.2 0.0 1.0
morphology 0.3 0.3 0.5 0.0 0.5 0.0 1.0 3.0 0.0 0.5 0.0 0.0 2.5 0.2 0.0 0.0
genealogy 0.5 1.0 0.0 0.0 1.0 0.5 0.0 0.0 3.0 0.5 0.0 0.0 0.0 0.2 0.0 0.0
topic 0.5 0.5 0.5 0.0 0.5 0.5 0.0 0.0 0.0 0.5 3.0 0.0 0.0 0.4 0.0 0.5
xref 0.5 0.5 0.5 0.0 0.5 0.5 0.0 0.0 0.0 0.5 0.0 3.0 0.0 0.2 0.0 0.0
speaker 0.5 0.3 0.0 0.0 0.5 0.5 0.0 0.0 0.0 0.5 0.0 0.0 0.0 0.3 3.0 0.0
"""


@query("", "WITH b AS (SELECT vec_id, row_number() OVER (ORDER BY label DESC, vec_id) - 1 AS b, list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS sim FROM embeddings), c AS (SELECT vec_id, b, row_number() OVER (ORDER BY round(sim, 6) DESC, vec_id) - 1 AS c FROM b) SELECT vec_id AS chunk_id, round(1.0 / (60 + b) + 1.0 / (60 + c), 8) AS score FROM c")
def fus_03_rerank(t):
    v = t.table("embeddings")
    q = v.where("vec_id = 0").select(F.col("embedding").alias("qe"))
    sims = v.crossJoin(F.broadcast(q)).select(F.col("vec_id").alias("chunk_id"), F.round(vectors.dot("qe", "embedding"), 6).alias("sim"))
    return fusion.folded(v.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("score")), sims)


@query("tokens titles chunks tags", f"WITH {_THREE} SELECT 0::BIGINT AS query_id, chunk_id, round(sum(1.0 / (60 + rank)), 8) AS score, list_sort(list_distinct(list(retriever))) AS retrievers FROM hits GROUP BY chunk_id")
def fus_05_gather(t):
    return fusion.rrf(_three(t))


@query("tokens titles chunks tags", f"WITH {_THREE}, f AS (SELECT chunk_id, round(sum(1.0 / (60 + rank)), 8) AS score, count(*) AS agree FROM hits GROUP BY chunk_id) SELECT chunk_id, score, agree, score >= 0.8 * max(score) OVER () AS featured FROM f ORDER BY score DESC, chunk_id LIMIT 10")
def fus_07_featured(t):
    f = fusion.rrf(_three(t)).withColumn("agree", F.size("retrievers").cast("long"))
    top = f.agg(F.max("score").alias("top"))
    return f.crossJoin(F.broadcast(top)).select("chunk_id", "score", "agree", (F.col("score") >= 0.8 * F.col("top")).alias("featured")).orderBy(F.desc("score"), "chunk_id").limit(10)


@query("tokens titles chunks tags", f"WITH {_THREE}, f AS (SELECT chunk_id, round(sum(1.0 / (60 + rank)), 8) AS score FROM hits GROUP BY chunk_id) SELECT c.chunk_id, f.score, t.title FROM f JOIN chunks c USING (chunk_id) JOIN titles t USING (doc_id) ORDER BY score DESC, chunk_id LIMIT 10")
def fus_08_flat(t):
    top = fusion.rrf(_three(t)).orderBy(F.desc("score"), "chunk_id").limit(10).withColumn("doc_id", doc_of(F.col("chunk_id")))
    return top.join(t.titles(), "doc_id").select("chunk_id", "score", "title")


@query("", f"WITH {_NN} SELECT q, vec_id, sim, rn FROM nn WHERE rn <= 20")
def vec_01_knn(t):
    v = t.table("embeddings")
    return vectors.ranked_neighbours(v.where("vec_id % 50 = 0"), v, 20)


_KINDED = "ok AS (SELECT doc_id AS vec_id FROM tags WHERE tag = 'lang:en' AND doc_id IN (SELECT doc_id FROM tags WHERE tag IN ('kind:note', 'kind:article', 'kind:term')))"


@query("tags", f"WITH {_NN}, {_KINDED}, f AS (SELECT q, vec_id, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, vec_id) AS rn FROM nn JOIN ok USING (vec_id) WHERE rn <= 160) SELECT * FROM f WHERE rn <= 20")
def vec_01b_filtered(t):
    """Over-fetched eightfold, then filtered by language and kind."""
    v = t.table("embeddings")
    return lists.post_filtered(vectors.ranked_neighbours(v.where("vec_id % 50 = 0"), v, 160), _scoped(t), 20)


def _scoped(t):
    own = t.table("documents").select("doc_id")
    for wanted in (["lang:en"], ["kind:note", "kind:article", "kind:term"]):
        own = tags.tagged(own, t.tags(), *wanted)
    return own.withColumnRenamed("doc_id", "vec_id")


@query("", "SELECT count(*) AS vectors, 2 * count(*) AS stored FROM embeddings WHERE embedding IS NOT NULL")
def snk_08_lists(t):
    return t.vector_index().lists().agg(F.countDistinct("vec_id").alias("vectors"), F.count("*").alias("stored"))


@query("", "SELECT unnest(['plain', 'filtered']) AS search, count(*) FILTER (vec_id % 50 = 0) AS queries, true AS reached FROM embeddings")
def snk_08_recall(t):
    """Whether 95 of 100 of the exact 20 nearest come out of the stored lists, without and with a post-filter."""
    v, index = t.table("embeddings"), t.vector_index()
    q = v.where("vec_id % 50 = 0")
    found = {"plain": (vectors.ranked_neighbours(q, v, 20), index.search(q, 20)), "filtered": (lists.post_filtered(vectors.ranked_neighbours(q, v, 160), _scoped(t), 20), lists.post_filtered(index.search(q, 20, over=8), _scoped(t), 20))}
    asked = q.agg(F.count("*").alias("queries"))
    out = None
    for name, (exact, near) in found.items():
        met = exact.select("q", "vec_id").join(near.select("q", "vec_id", F.lit(1).alias("hit")), ["q", "vec_id"], "left").agg((F.count("hit") >= 0.95 * F.count("*")).alias("reached"))
        row = met.crossJoin(asked).select(F.lit(name).alias("search"), "queries", "reached")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


@query("tokens titles", f"WITH {_TT} SELECT 'chunks' AS name, count(DISTINCT chunk_id) AS units, count(DISTINCT term) AS terms, count(DISTINCT (chunk_id, term)) AS postings, count(*) AS words FROM tokens UNION ALL SELECT 'titles', count(DISTINCT doc_id), count(DISTINCT term), count(DISTINCT (doc_id, term)), count(*) FROM tt")
def snk_02_index(t):
    """What the stored indexes hold, read back from their blocks."""
    out = None
    for name, index in (("chunks", t.index()), ("titles", t.title_index())):
        own = index.spark.read.parquet(f"{index.path}/blocks")
        n = own.agg(F.countDistinct("term").alias("terms"), F.sum("n").alias("postings"), F.sum(F.aggregate("tf", F.lit(0).cast("long"), lambda s, x: s + x)).alias("words"))
        row = n.select(F.lit(name).alias("name"), F.lit(index.stats["n"]).cast("long").alias("units"), "terms", "postings", "words")
        out = row if out is None else out.unionByName(row)
    return out


@query("", "SELECT d.doc_id, v.label FROM documents d JOIN embeddings v ON v.vec_id = d.doc_id")
def vec_02_fetch(t):
    return t.table("documents").select("doc_id").join(t.table("embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id").select("doc_id", "label")


@query("", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), q AS (SELECT x FROM v WHERE vec_id = 1) SELECT vec_id, round(list_cosine_similarity(v.x, q.x), 4) AS score FROM v, q")
def vec_03_cosine(t):
    v = t.table("embeddings")
    q = v.where("vec_id = 1").select(F.col("embedding").alias("qe"))
    return v.crossJoin(F.broadcast(q)).select("vec_id", F.round(vectors.cosine("qe", "embedding"), 4).alias("score"))


_SIGN = "v AS (SELECT vec_id, embedding::DOUBLE[] AS x, list_transform(embedding, lambda a: (a > 0)::INT) AS b FROM embeddings), h AS (SELECT q.vec_id AS q, v.vec_id, list_dot_product(q.x, v.x) AS sim, list_sum(list_transform(list_zip(q.b, v.b), lambda p: (p[1] <> p[2])::INT)) AS far FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0), c AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY far, vec_id) AS c FROM h), f AS (SELECT q, vec_id, row_number() OVER (PARTITION BY q ORDER BY round(sim, 6) DESC, vec_id) AS rn FROM c WHERE c <= 80)"


@query("", f"WITH {_SIGN} SELECT q, vec_id, rn FROM f WHERE rn <= 10")
def vec_07_sign_bits(t):
    v = t.table("embeddings")
    return vectors.quantised_search(v.where("vec_id % 50 = 0"), v, 80, 10)


@query("", f"WITH {_SIGN}, e AS (SELECT q, vec_id FROM (SELECT q, vec_id, row_number() OVER (PARTITION BY q ORDER BY round(sim, 6) DESC, vec_id) AS rn FROM h) WHERE rn <= 10) SELECT round(count(f.vec_id) / count(*), 4) AS recall FROM e LEFT JOIN (SELECT q, vec_id FROM f WHERE rn <= 10) f USING (q, vec_id)")
def vec_08_recall(t):
    v = t.table("embeddings")
    q = v.where("vec_id % 50 = 0")
    found = vectors.quantised_search(q, v, 80, 10).select("q", "vec_id", F.lit(1).alias("hit"))
    return vectors.ranked_neighbours(q, v, 10).join(found, ["q", "vec_id"], "left").agg(F.round(F.count("hit") / F.count("*"), 4).alias("recall"))


@query("", "WITH m AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY 1, 2) SELECT label, i AS dim, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 5) AS value FROM m")
def vec_09_centroids(t):
    return vectors.centroids(t.table("embeddings"), "label")


@query("", f"WITH {_NN} SELECT round(avg(sim) FILTER (a.label = b.label), 4) AS within, round(avg(sim) FILTER (a.label <> b.label), 4) AS across FROM nn JOIN v a ON a.vec_id = nn.q JOIN v b ON b.vec_id = nn.vec_id")
def vec_11_separation(t):
    v = t.table("embeddings")
    own = vectors.separation(v.where("vec_id % 50 = 0"), v, "label")
    return own.select(F.round("within", 4).alias("within"), F.round("across", 4).alias("across"))


@query("edges", "SELECT target_id AS id, source_id AS other FROM edges WHERE relation = 'located-in' AND target_id LIKE 'region:%'")
def gr_02_hop(t):
    return graph.neighbours(t.edges(), t.entities().where("type = 'region'"), "located-in", reverse=True)


@query("edges", "SELECT source_id AS id, target_id AS other FROM edges WHERE relation = 'same-segment' UNION SELECT target_id, source_id FROM edges WHERE relation = 'same-segment'")
def gr_03_symmetric(t):
    return graph.symmetric(t.edges(), "same-segment")


@query("tags", "SELECT DISTINCT doc_id FROM tags WHERE tag IN ('kind:term', 'source:src1', 'source:SRC1')")
def gr_05_taxonomy(t):
    return t.tags().where(F.col("tag").isin("kind:term", "source:src1", "source:SRC1")).select("doc_id").distinct()


@query("edges", "WITH RECURSIVE r AS (SELECT source_id AS id, target_id AS ancestor, 1::BIGINT AS hops FROM edges WHERE relation = 'located-in' UNION ALL SELECT r.id, e.target_id, hops + 1 FROM r JOIN edges e ON e.source_id = r.ancestor WHERE e.relation = 'located-in' AND hops < 8) SELECT id, ancestor, min(hops) AS hops FROM r GROUP BY 1, 2")
def gr_06_ancestors(t):
    return graph.ancestors(t.edges(), "located-in")


@query("", "SELECT a.n_name AS lang, b.n_name AS related FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def gr_07_related(t):
    n = t.table("nation").select("n_regionkey", "n_nationkey", "n_name")
    b = n.select("n_regionkey", F.col("n_nationkey").alias("k"), F.col("n_name").alias("related"))
    return n.join(b, "n_regionkey").where("n_nationkey <> k").select(F.col("n_name").alias("lang"), "related")


@query("", "SELECT l_orderkey AS verb, list(l_linenumber || ':' || l_partkey ORDER BY l_linenumber, l_linenumber || ':' || l_partkey) AS frame FROM lineitem GROUP BY 1")
def gr_08_frames(t):
    x = F.struct("l_linenumber", F.concat_ws(":", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("a"))
    return t.table("lineitem").groupBy(F.col("l_orderkey").alias("verb")).agg(F.transform(F.array_sort(F.collect_list(x)), lambda y: y["a"]).alias("frame"))


@query("words", "SELECT book, count(DISTINCT chapter) AS chapters FROM words GROUP BY book")
def cor_01_books(t):
    return t.words().groupBy("book").agg(F.countDistinct("chapter").alias("chapters"))


@query("words", "SELECT book, chapter, verse, string_agg(surface, ' ' ORDER BY idx, surface) AS text FROM words GROUP BY 1, 2, 3")
def cor_02_verses(t):
    return corpus.verses(t.words())


@query()
def cor_03_syntax(t):
    return corpus.syntax_tree(t.words()).select("book", "chapter", "verse", F.size("clauses").alias("phrases"), F.to_json("clauses").alias("tree"))


@query("words", "SELECT a.book, a.chapter, a.verse, a.idx AS first, min(b.idx) AS second FROM words a JOIN words b USING (book, chapter, verse) WHERE a.morph = 'V-qal' AND b.morph = 'P' AND b.idx > a.idx GROUP BY ALL")
def cor_04_constructions(t):
    return corpus.construction(t.words(), "V-qal", "P").distinct()


@query("words", "SELECT book, chapter, verse, idx, idx // 4 AS phrase, count(*) OVER (PARTITION BY book, chapter, verse, idx // 4) AS size FROM words")
def cor_05_context(t):
    p = F.floor(F.col("idx") / 4).cast("long")
    return t.words().select("book", "chapter", "verse", "idx", p.alias("phrase"), F.count("*").over(Window.partitionBy("book", "chapter", "verse", p)).alias("size"))


@query("words", "SELECT book, chapter, verse, idx // 4 AS clause, string_agg(surface, ' ' ORDER BY idx, surface) AS text FROM words GROUP BY ALL")
def cor_06_clauses(t):
    own = t.words().withColumn("clause", F.floor(F.col("idx") / 4).cast("long")).groupBy("book", "chapter", "verse", "clause")
    return own.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "surface"))), lambda x: x["surface"]), " ").alias("text"))


@query("words", "SELECT lemma, n, row_number() OVER (ORDER BY n DESC, lemma) - 1 AS rank FROM (SELECT lemma, count(*) AS n FROM words WHERE is_content = 1 GROUP BY lemma)")
def cor_07_rank_map(t):
    n = t.words().where("is_content = 1").groupBy("lemma").agg(F.count("*").alias("n"))
    return n.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("n"), "lemma")) - 1).cast("long"))


@query("words", "SELECT lemma, count(*) AS n, min(book * 100000000 + chapter * 100000 + verse * 100 + idx) AS node FROM words WHERE morph = 'N-msa' GROUP BY lemma ORDER BY n DESC, lemma LIMIT 50")
def cor_08_feed(t):
    return corpus.lexeme_feed(t.words().where("morph = 'N-msa'"), "frequency", 50)


@query("words", "SELECT lemma, count(*) AS n, arg_min(strong, (book * 100000000 + chapter * 100000 + verse * 100 + idx, strong)) AS first FROM words GROUP BY lemma")
def cor_09_lexeme(t):
    return t.words().groupBy("lemma").agg(F.count("*").alias("n"), F.min_by("strong", F.struct(corpus.node().alias("n"), F.col("strong"))).alias("first"))


@query("words", "WITH g AS (SELECT lemma, min(surface) FILTER (morph = 'V-qal') AS stem, min(surface) FILTER (morph = 'N-msa') AS noun, min(surface) AS any_ FROM words GROUP BY lemma) SELECT lemma, coalesce(stem, noun, any_) AS gloss FROM g")
def cor_12_gloss(t):
    least = lambda m: F.min(F.when(F.col("morph") == m, F.col("surface")))
    return t.words().groupBy("lemma").agg(F.coalesce(least("V-qal"), least("N-msa"), F.min("surface")).alias("gloss"))


@query("words", f"WITH {_DOM} SELECT domain, strong, centrality AS n, round(share, 3) AS share FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY centrality DESC, round(share, 3) DESC, strong) AS rn FROM d) WHERE rn <= 200")
def cor_14_domain_members(t):
    c = ranking.share(t.words().groupBy("strong", F.substring("lemma", 1, 3).alias("domain")).agg(F.count("*").alias("n")), "n", ["strong"])
    return ranking.per_key(c, ["domain"], 200, F.desc("n"), F.desc("share"), F.col("strong")).select("domain", "strong", "n", "share")


@query("words", f"WITH {_KEY} SELECT strong, keyness, keyness > 3 AS is_key FROM k")
def cor_16_keyness(t):
    return _keyness(t).withColumn("is_key", F.col("keyness") > 3)


@query()
def seq_01_lcs(t):
    w = t.words().withColumn("key", (F.col("book") * 1000000 + F.col("chapter") * 1000 + F.col("verse"))).select("key", corpus.node().alias("n"), "strong", "is_content")
    return align.lcs_align(w, w.where("is_content = 1"), "key", "n", "strong")


@query("", "WITH RECURSIVE v AS (SELECT label AS key, vec_id AS item, embedding::DOUBLE[] AS x FROM embeddings), e AS (SELECT a.item AS u, b.item AS v FROM v a JOIN v b ON a.key = b.key AND a.item <> b.item AND list_cosine_similarity(a.x, b.x) >= 0.72), r AS (SELECT item AS u, item AS v FROM v UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v) SELECT key, item, (SELECT min(r.v) FROM r WHERE r.u = item) AS cluster FROM v")
def seq_03_linkage(t):
    return align.single_linkage(t.table("embeddings").select("label", "vec_id", "embedding"), "label", "vec_id", "embedding", 0.72, across=True, undefined=True)


@query("titles refs tags", cards.SQL)
def crd_01_cards(t):
    return cards.assemble(t.titles(), t.refs(), t.tags())


@query("titles refs tags", f"WITH c AS ({cards.SQL}) SELECT kind, count(*) AS n, CASE WHEN count(*) >= 200 THEN 'tree' WHEN count(*) >= 50 THEN 'deck' ELSE 'hero' END AS layout FROM c GROUP BY kind")
def crd_04_layout(t):
    return cards.layout(cards.assemble(t.titles(), t.refs(), t.tags()))


@query("", "SELECT time_bucket(INTERVAL 60 SECOND, ts) AS start, user_id, count(*) AS n FROM events GROUP BY 1, 2")
def str_03_rate_windows(t):
    return windows.tumbling(t.table("events"), "60 seconds", "user_id")


@query("", "WITH s AS (SELECT time_bucket(INTERVAL 650 SECOND, ts, TIMESTAMP '1970-01-01') AS b, ts, value FROM events), x AS (SELECT b - INTERVAL 650 SECOND * k AS start, ts, value FROM s, range(0, 2) AS r(k)) SELECT start, count(*) AS n, round(sum(value), 4) AS total FROM x WHERE ts < start + INTERVAL 800 SECOND GROUP BY 1")
def str_04_sliding(t):
    return windows.sliding(t.table("events"), "800 seconds", "650 seconds")


@query("", "WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events), i AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT user_id, min(ts) AS first, count(*) AS n FROM i GROUP BY user_id, k")
def str_05_sessions(t):
    return windows.sessions(t.table("events").select("user_id", "ts"), "10 minutes")


_UP = "new AS (SELECT doc_id, 'new' AS title FROM titles WHERE doc_id % 10 = 0 UNION ALL SELECT item_id + 1000000, 'added' FROM benchmark)"


@query("titles", f"WITH {_UP} SELECT doc_id, title FROM titles WHERE doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT * FROM new")
def snk_01_upsert(t):
    from lectern.operators.incremental import upsert

    new = t.titles().where("doc_id % 10 = 0").select("doc_id", F.lit("new").alias("title"))
    new = new.unionByName(t.table("benchmark").select((F.col("item_id") + 1000000).alias("doc_id"), F.lit("added").alias("title")))
    return upsert(t.titles(), new, "doc_id")


@query("titles", f"WITH {_UP} SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'delete' ELSE 'update' END AS change FROM titles o FULL JOIN new n ON o.doc_id = n.doc_id WHERE o.title IS DISTINCT FROM n.title")
def str_01_delta(t):
    from lectern.operators.incremental import changes

    new = t.titles().where("doc_id % 10 = 0").select("doc_id", F.lit("new").alias("title"))
    new = new.unionByName(t.table("benchmark").select((F.col("item_id") + 1000000).alias("doc_id"), F.lit("added").alias("title")))
    return changes(t.titles(), new, "doc_id", "title")


@query("edges entities", "SELECT source_id, target_id, relation FROM edges WHERE source_id IN (SELECT id FROM entities WHERE type <> 'supplier') AND target_id IN (SELECT id FROM entities WHERE type <> 'supplier')")
def snk_04_dangling(t):
    return graph.without_dangling(t.edges(), t.entities().where("type <> 'supplier'"))


_BRANCH = "CASE kind WHEN 'lexicon' THEN 'lexicon' WHEN 'term' THEN 'terms' WHEN 'question' THEN 'terms' WHEN 'bible' THEN 'verses' WHEN 'morphology' THEN 'morphology' ELSE 'other' END"


@query("tokens titles chunks tags", f"""WITH {_THREE}, f0 AS (SELECT chunk_id, round(sum(1.0 / (60 + rank)), 8) AS score FROM hits GROUP BY chunk_id), f AS (SELECT chunk_id, score, split_part(chunk_id, ':', 1)::BIGINT AS d FROM f0 WHERE split_part(chunk_id, ':', 1)::BIGINT IN (SELECT doc_id FROM documents WHERE lang = 'en')), k AS (SELECT doc_id, min(tag[6:]) AS kind FROM tags WHERE tag LIKE 'kind:%' GROUP BY 1),
b AS (SELECT chunk_id, score, {_BRANCH} AS branch, row_number() OVER (PARTITION BY {_BRANCH} ORDER BY score DESC, chunk_id) - 1 AS base, list_dot_product(v.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS sim FROM f JOIN k ON k.doc_id = d LEFT JOIN embeddings v ON v.vec_id = d),
c AS (SELECT *, count(sim) OVER (PARTITION BY branch) AS m, CASE WHEN sim IS NOT NULL THEN row_number() OVER (PARTITION BY branch ORDER BY round(sim, 6) DESC NULLS LAST, base) - 1 END AS c FROM b), o AS (SELECT branch, chunk_id, score, 1 AS t, CASE WHEN m < 2 OR branch = 'terms' THEN base::DOUBLE ELSE -round(1.0 / (60 + base) + coalesce(1.0 / (60 + c), 0), 12) END AS by_, base FROM c),
a AS (SELECT min(chunk_id) AS chunk_id, doc_id FROM chunks JOIN (SELECT DISTINCT doc_id FROM tags WHERE tag = 'kind:term') USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM tags WHERE tag = 'quality:1') AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') GROUP BY doc_id), l AS (SELECT 'terms' AS branch, chunk_id, 1.0::DOUBLE AS score, 0 AS t, -1.0::DOUBLE AS by_, 0 AS base FROM a WHERE chunk_id NOT IN (SELECT chunk_id FROM o WHERE branch = 'terms') ORDER BY chunk_id LIMIT 30),
s AS (SELECT branch, chunk_id, score, count(*) OVER (PARTITION BY branch) AS total, row_number() OVER (PARTITION BY branch ORDER BY t, by_, base, chunk_id) AS place FROM (SELECT * FROM o UNION ALL SELECT * FROM l)), e(branch, featured, number) AS (VALUES ('lexicon', true, 0), ('study', true, 1), ('terms', false, 2), ('verses', true, 3), ('morphology', false, 4), ('methodology', false, 5), ('media', false, 6), ('other', false, 7))
SELECT e.branch, featured, number, coalesce(place, 0) AS place, chunk_id, score, coalesce(total, 0) AS total FROM e LEFT JOIN s ON s.branch = e.branch AND place <= 8 WHERE chunk_id IS NOT NULL OR featured""")
def fus_06_branches(t):
    """Gated hits by branch: reranked by cosine, anchored articles leading the terms, empty branches only if featured."""
    doc = doc_of(F.col("chunk_id")).alias("doc_id")
    fused = tags.language_gate(fusion.rrf(_three(t)).drop("retrievers").withColumn("doc_id", doc), t.tags(), "en")
    ids = fused.select("chunk_id", "doc_id")
    kinds = ids.join(tags.kind_of(t.tags()), "doc_id").select("chunk_id", "kind")
    q = t.table("embeddings").where("vec_id = 0").select(F.col("embedding").alias("qe"))
    near = ids.join(t.table("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").crossJoin(F.broadcast(q))
    sims = near.select("chunk_id", F.round(vectors.dot("qe", "embedding"), 6).alias("sim"))
    articles = tags.language_gate(tags.with_all(t.heads(), t.tags(), "kind:term", "quality:1"), t.tags(), "en")
    return fusion.branched(fused, kinds, ("lexicon", "study", "verses"), articles.select("chunk_id", F.lit(1).alias("m")), sims)


@query("entities", "SELECT 0 AS q, id, type, name, 0 AS tier FROM entities WHERE lower(name) = 'nation_1' UNION ALL SELECT 1, id, type, name, 1 FROM (SELECT * FROM entities WHERE starts_with(lower(name), 'customer#00000') ORDER BY name, id LIMIT 8) UNION ALL SELECT 2, id, type, name, 2 FROM entities WHERE lower(name) = 'asia'")
def gr_01_resolve(t):
    """A name, a prefix, and a name of another language."""
    bridge = t.table("region").select(F.concat(F.lit("Región "), "r_name").alias("alias"), F.col("r_name").alias("name"))
    out = None
    for i, name in enumerate(("Nation_1", "Customer#00000", "región ASIA")):
        own = graph.resolve_named(t.entities(), name, bridge).select(F.lit(i).alias("q"), "id", "type", "name", "tier")
        out = own if out is None else out.unionByName(own)
    return out


@query("edges refs", "SELECT source_id AS id, relation, 'out' AS direction, target_id AS other FROM edges UNION ALL SELECT target_id, relation, 'in', source_id FROM edges UNION ALL SELECT 'customer:' || doc_id, 'mentioned', 'passage', s || '-' || e FROM refs")
def gr_04_view(t):
    mentions = t.refs().select(F.concat(F.lit("customer:"), F.col("doc_id").cast("string")).alias("id"), "s", "e")
    return graph.full_view(t.edges(), mentions)
