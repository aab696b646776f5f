"""Queries of cards by kind, word studies with all their parts, and the service's and sources' remaining surface."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from lectern.functions.vocabulary import ENGLISH
from lectern.operators import corpus, intents, senses, strategies
from lectern.operators.graph import cut
from lectern.plans.registry import query
from lectern.plans.service import Service
from lectern.sources import files, sinks, store

#: One question a customer, of five kinds, and what each is about.
_ASK = "q AS (SELECT c_custkey AS k, c_nationkey AS n, c_custkey % 5 AS kind FROM customer)"


def _asked(t):
    k, n, s = F.col("c_custkey"), F.col("c_nationkey"), lambda x: x.cast("string")
    name = F.concat(F.lit("NATION-"), F.translate(s(n), "0123456789", "abcdefghij"))
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("what did "), F.element_at(F.array(*map(F.lit, ("user", "assistant", "system"))), (k % 3 + 1).cast("int")), F.lit(" say about hope")))
        .when((k % 5 == 1) & (k % 2 == 0), F.concat(F.lit("Who is the father of "), name, F.lit("?"))).when(k % 5 == 1, F.concat(F.lit("Who was "), name, F.lit("?")))
        .when((k % 5 == 2) & (k % 2 == 0), F.concat(F.lit("explain GEN "), s(k % 3 + 1), F.lit(":1"))).when(k % 5 == 2, F.concat(F.lit("explain EXO "), s(k % 3 + 1), F.lit(":1-30")))
        .when(k % 5 == 3, F.concat(F.lit("cross-references for LEV "), s((n * 7 % 50) + 1), F.lit(":"), s(k % 30 + 1)))
        .otherwise(F.concat(F.lit("look up H"), s(k % 997)))
    )
    v = replace(ENGLISH, relations={"father": "located-in-rev"})
    speakers = t.speakers().select(F.col("speaker").alias("name")).distinct()
    return cut(intents.analysed(t.table("customer").select(k.alias("k"), text.alias("text")), "k", "text", speakers, v))  # builders read it several times


@query("speakers", f"WITH {_ASK}, s AS (SELECT speaker, bool_or(divine) AS divine, count(DISTINCT (s, e)) AS n FROM speakers GROUP BY 1) SELECT k, 'speaker' AS kind, 1.0::DOUBLE AS confidence, NULL::VARCHAR AS synthesis, 'SPEAKER — ' || speaker || CASE WHEN divine THEN ' | red-letter / divine speech' ELSE '' END || ' | ' || s.n || ' quoted passages — answer from their actual words' AS headline, speaker AS anchor, '/speaker/' || speaker AS drill FROM q JOIN s ON speaker = ['user', 'assistant', 'system'][k % 3 + 1] WHERE kind = 0")
def crd_02_speaker(t):
    return strategies.speaker(_asked(t), "k", t.speakers())


def _named(t):
    """The entities with names that a question can hold: of letters."""
    return t.entities().withColumn("name", F.when(F.col("type") == "nation", F.translate("name", "_0123456789", "-abcdefghij")).otherwise(F.col("name")))


@query("entities edges", f"WITH {_ASK}, e AS (SELECT id, type, name, lower(name) AS low, metadata FROM (SELECT id, type, CASE WHEN type = 'nation' THEN translate(name, '_0123456789', '-abcdefghij') ELSE name END AS name, metadata FROM entities)), x AS (SELECT k, k % 2 = 0 AS rel, e.id, e.type, e.name, metadata->>'description' AS d FROM q JOIN e ON low = 'nation-' || translate(n::VARCHAR, '0123456789', 'abcdefghij') WHERE kind = 1), r AS (SELECT k, relative, row_number() OVER (PARTITION BY k ORDER BY relative) AS rn FROM (SELECT DISTINCT k, o.name AS relative FROM x JOIN edges g ON g.target_id = x.id AND g.relation = 'located-in' JOIN e o ON o.id = g.source_id WHERE rel)), l AS (SELECT k, string_agg(relative, ', ' ORDER BY relative) AS who FROM r WHERE rn <= 8 GROUP BY k), z AS (SELECT x.k, name, who, rel, CASE WHEN rel THEN 'ENTITY — located-in of ' || name || ' → ' || coalesce(who, '—') ELSE 'ENTITY — ' || name || ' (' || type || '): ' || d END AS line FROM x LEFT JOIN l USING (k)) SELECT k, 'entity' AS kind, 1.0::DOUBLE AS confidence, CASE WHEN who IS NOT NULL THEN line END AS synthesis, line AS headline, name AS anchor, NULL::VARCHAR AS drill FROM z")
def crd_02_entity(t):
    return strategies.entity(_asked(t), "k", _named(t), t.edges())


_WORDS = "n AS (SELECT strong, count(*) AS n, min(surface) FILTER (is_content = 1) AS gloss FROM words GROUP BY 1), k AS (SELECT strong, gloss, (n % 7) / 7.0::DOUBLE AS keyness FROM n), d AS (SELECT DISTINCT book * 1000000 + chapter * 1000 + verse AS ref, idx, surface AS word, strong FROM words), w AS (SELECT d.*, gloss, keyness FROM d JOIN k USING (strong))"


def _interlinear(t):
    w = t.words()
    known = w.groupBy("strong").agg(((F.count("*") % 7) / F.lit(7.0)).alias("keyness"), F.min(F.when(F.col("is_content") == 1, F.col("surface"))).alias("gloss"))
    place = (F.col("book") * 1000000 + F.col("chapter") * 1000 + F.col("verse")).alias("ref")
    return w.select(place, "idx", F.col("surface").alias("word"), "strong").distinct().join(known, "strong").withColumn("language", F.lit("hbo"))


@query("words speakers", f"WITH {_ASK}, {_WORDS}, p AS (SELECT k, k % 2 <> 0 AS opening, CASE WHEN k % 2 = 0 THEN 1000000 ELSE 2000000 END + (k % 3 + 1) * 1000 + 1 AS ref FROM q WHERE kind = 2), top AS (SELECT * FROM w WHERE keyness > 0 AND gloss IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ref ORDER BY keyness DESC, idx, word) <= 6), told AS (SELECT ref, string_agg(word || '=' || gloss, ' · ' ORDER BY keyness DESC, idx, word, gloss) AS shown FROM top GROUP BY ref), s AS (SELECT p.ref, arg_min({{'a': speaker, 'b': divine}}, (e - s, speaker)) AS voice FROM (SELECT DISTINCT ref FROM p) p JOIN speakers ON ref BETWEEN s AND e GROUP BY 1), z AS (SELECT p.k, p.ref, CASE WHEN p.ref < 2000000 THEN 'GEN' ELSE 'EXO' END AS code, opening, shown, voice FROM p JOIN told USING (ref) LEFT JOIN s USING (ref)), l AS (SELECT *, code || ' ' || (ref // 1000 % 1000) || ':' || (ref % 1000) AS place FROM z), m AS (SELECT *, 'PASSAGE ' || place || CASE WHEN opening THEN ' (opening)' ELSE '' END || ' (hbo)' || CASE WHEN voice IS NOT NULL THEN ' [' || voice.a || CASE WHEN voice.b THEN ', red-letter' ELSE '' END || ']' ELSE '' END || ' — ' || shown AS line FROM l) SELECT k, 'passage' AS kind, 1.0::DOUBLE AS confidence, line AS synthesis, line AS headline, place AS anchor, '/verse/' || code || '/' || (ref // 1000 % 1000) || '/' || (ref % 1000) AS drill FROM m")
def crd_02_passage(t):
    return strategies.passage(_asked(t), "k", _interlinear(t), t.speakers())


_BOOK = "['GEN','EXO','LEV','NUM','DEU','JOS','JDG','RUT','1SA','2SA','1KI','2KI','1CH','2CH','EZR','NEH','EST','JOB','PSA','PRO','ECC','SNG','ISA','JER','LAM','EZK','DAN','HOS','JOL','AMO','OBA','JON','MIC','NAM','HAB','ZEP','HAG','ZEC','MAL','MAT','MRK','LUK','JHN','ACT','ROM','1CO','2CO','GAL','EPH','PHP','COL','1TH','2TH','1TI','2TI','TIT','PHM','HEB','JAS','1PE','2PE','1JN','2JN','3JN','JUD','REV']"


@query("xref", f"WITH {_ASK}, p AS (SELECT k, 3000000 + (n * 7 % 50 + 1) * 1000 + k % 30 + 1 AS source FROM q WHERE kind = 3), h AS (SELECT p.k, p.source, ts, te, rank FROM p JOIN xref USING (source) QUALIFY row_number() OVER (PARTITION BY k ORDER BY rank NULLS LAST, ts, te) <= 8), l AS (SELECT k, source, string_agg({_BOOK}[ts // 1000000] || ' ' || (ts // 1000 % 1000) || ':' || (ts % 1000) || CASE WHEN te > ts THEN '-' || (te % 1000) ELSE '' END, ', ' ORDER BY rank NULLS LAST, ts, te) AS shown FROM h GROUP BY ALL), m AS (SELECT k, 'LEV ' || (source // 1000 % 1000) || ':' || (source % 1000) AS place, shown FROM l) SELECT k, 'xref' AS kind, 1.0::DOUBLE AS confidence, 'CROSS-REFS ' || place || ' → ' || shown AS synthesis, 'CROSS-REFS ' || place || ' → ' || shown AS headline, place AS anchor, NULL::VARCHAR AS drill FROM m")
def crd_02_cross_references(t):
    return strategies.cross_references(_asked(t), "k", t.xref())


def _studies(t):
    """Of each code: gloss, senses, equivalents (codes that share a lemma), keyness, domain and its other codes."""
    w = t.words().groupBy(F.col("strong").alias("code"), "lemma", "surface").agg(F.count("*").alias("m"))
    base = w.groupBy("code").agg(F.min("lemma").alias("gloss"), F.array_sort(F.collect_set("surface")).alias("senses"), ((F.sum("m") % 7) / F.lit(7.0)).alias("keyness"))
    by = base.select("code", F.substring("gloss", 1, 1).alias("domain"))
    several = by.groupBy("domain").agg((F.count("*") > 1).alias("more"))
    none = F.array().cast("array<string>")
    own = base.join(by, "code").join(several, "domain")
    return own.select("code", "gloss", "senses", none.alias("equivalents"), "keyness", "domain", F.when(F.col("more"), F.array("domain")).otherwise(none).alias("siblings"))


@query("words", f"WITH {_ASK}, b AS (SELECT strong AS code, min(lemma) AS gloss, list_slice(list_sort(list_distinct(list(surface))), 1, 4) AS senses, (count(*) % 7) / 7.0::DOUBLE AS keyness FROM words GROUP BY 1), l AS (SELECT k, code, 'CONCEPT — ' || code || ' = ' || gloss || ' | sense: ' || array_to_string(senses, '; ') || CASE WHEN keyness > 0 THEN ' | keyness ' || round(keyness, 2) ELSE '' END || ' | domain: ' || gloss[1] AS line FROM q JOIN b ON code = 'H' || lpad((k % 997)::VARCHAR, 4, '0') WHERE kind = 4) SELECT k, 'concept' AS kind, 1.0::DOUBLE AS confidence, NULL::VARCHAR AS synthesis, line AS headline, code AS anchor, '/wordstudy/' || code AS drill FROM l")
def crd_02_concept(t):
    return strategies.concept(_asked(t), "k", t.words().select(F.col("lemma").alias("word"), F.col("strong").alias("code")), _studies(t))


@query("", "WITH RECURSIVE v AS (SELECT label AS lex, vec_id AS sense, vec_id % 7 + 1 AS n, 'g' || vec_id AS label, embedding::DOUBLE[] AS x FROM embeddings), e AS (SELECT a.sense AS u, b.sense AS v FROM v a JOIN v b ON a.lex = b.lex AND a.sense <> b.sense AND list_cosine_similarity(a.x, b.x) >= 0.72), r AS (SELECT sense AS u, sense AS v FROM v UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v), c AS (SELECT u AS sense, min(v) AS merged FROM r GROUP BY 1) SELECT lex, merged, sum(n)::BIGINT AS n, arg_min(label, (-n, sense)) AS label FROM v JOIN c USING (sense) GROUP BY 1, 2")
def seq_04_sense_merge(t):
    own = t.table("embeddings").select(F.col("label").cast("long").alias("lex"), F.col("vec_id").alias("sense"), (F.col("vec_id") % 7 + 1).alias("n"), F.concat(F.lit("g"), F.col("vec_id").cast("string")).alias("label"), "embedding")
    return senses.merge_by_vector(own, across=True, undefined=True)


@query("", "SELECT substr(sha256('in/' || doc_id || '.md'), 1, 16) AS id, 'in/' || doc_id || '.md' AS path, CASE WHEN doc_id % 3 = 0 THEN doc_id::VARCHAR ELSE 'Title of ' || doc_id END AS title, 'lang:' || lang || CASE WHEN doc_id % 2 = 0 THEN ',source:' || source ELSE '' END AS tags, CASE WHEN doc_id % 4 = 0 THEN '' ELSE (1000000 + doc_id % 900 + 1) || '-' || (1000000 + doc_id % 900 + 5) END AS passages, sha256(coalesce(nullif(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), ''), '-')) AS body FROM documents")
def src_01_markdown(t):
    """The documents as markdown files with front matter, scanned: id from the path, title, tags, passages in order, body."""
    d, s = F.col("doc_id"), lambda x: x.cast("string")
    head = F.concat(
        F.lit("---\n"), F.when(d % 3 == 0, "").otherwise(F.concat(F.lit('title: "Title of '), s(d), F.lit('"\n'))),
        F.when(d % 2 == 0, F.concat(F.lit("tags:\n  - lang:"), "lang", F.lit("\n  - source:"), "source", F.lit("\n"))).otherwise(F.concat(F.lit("tags: lang:"), "lang", F.lit("\n"))),
        F.when(d % 4 == 0, "passages: oops\n").otherwise(F.concat(F.lit("passages:\n  - ["), s(1000000 + d % 900 + 5), F.lit(", "), s(1000000 + d % 900 + 1), F.lit("]\n"))), F.lit("---\n"),
    )
    raw = t.dealt("documents", "doc_id", "text", "lang", "source").select(F.concat(F.lit("in/"), s(d), F.lit(".md")).alias("path"), F.concat(head, F.coalesce("text", F.lit(""))).alias("raw"))
    own = files.markdown_documents(raw)
    spans = F.array_join(F.transform(F.arrays_zip("s", "e"), lambda x: F.concat_ws("-", x["s"].cast("string"), x["e"].cast("string"))), ",")
    return own.select("id", "path", "title", F.array_join("tags", ",").alias("tags"), spans.alias("passages"), F.sha2(F.coalesce("body", F.lit("-")), 256).alias("body"))


@query("", "SELECT CASE page_id % 5 WHEN 0 THEN 'md' WHEN 1 THEN 'markdown' WHEN 2 THEN 'mdx' WHEN 3 THEN 'MD' ELSE 'pdf' END AS extension, CASE WHEN page_id % 5 < 4 THEN 'markdown' END AS reader, count(*) AS files FROM pages GROUP BY ALL")
def src_03_readers(t):
    """The files of a folder by extension and the reader that each has; null where none is registered."""
    ext = F.element_at(F.array(*map(F.lit, ("md", "markdown", "mdx", "MD", "pdf"))), (F.col("page_id") % 5 + 1).cast("int"))
    return files.routed(t.table("pages").select(F.concat_ws(".", F.col("page_id").cast("string"), ext).alias("path"))).groupBy("extension", "reader").agg(F.count("*").alias("files"))


@query("words", "WITH o AS (SELECT book, chapter, verse, row_number() OVER (PARTITION BY book, chapter, verse ORDER BY idx, surface, strong) - 1 AS idx, surface, strong FROM words) SELECT * FROM o")
def src_07_usfm_words(t):
    """The word store written as USFM, a file a verse, and read back word by word."""
    verse = t.words().groupBy("book", "chapter", "verse").agg(F.array_sort(F.collect_list(F.struct("idx", "surface", "strong"))).alias("w"))
    body = F.array_join(F.transform("w", lambda x: F.concat(F.lit("\\w "), x["surface"], F.lit('|strong="'), x["strong"], F.lit('" x-morph="N"\\w*'))), " ")
    raw = F.format_string("\\id X\n\\c %d\n\\p\n\\v %d %s \\f + \\ft note\\f*", "chapter", "verse", body)
    own = verse.select("book", F.explode(files.usfm_word_rows(raw)).alias("x"))
    return own.select("book", "x.chapter", "x.verse", F.col("x.idx").alias("idx"), "x.surface", "x.strong")


@query("", "SELECT p_partkey, p_name, p_size::BIGINT AS p_size, NULL::DOUBLE AS odd FROM part")
def snk_06_tables(t):
    """The parts written as a tab-separated table with comment lines in front, and read back; what isn't a number becomes null."""
    path, _ = store.derived(t.spark, "parts", [t.path("part")], lambda p: files.write_table(t.table("part").select("p_partkey", "p_name", "p_size", F.lit("n/a").alias("odd")), f"{p}/parts", "p_partkey", notes=("source: part", "license: none")) or {})
    return files.read_table(t.spark, f"{path}/parts", "p_partkey long, p_name string, p_size long, odd double")


@query("refs chunks tags titles", """WITH c AS (SELECT doc_id, arg_min(chunk_id, chunk_index) AS chunk_id FROM chunks GROUP BY doc_id), m AS (SELECT doc_id, min(e - s) AS width FROM refs WHERE s <= 2999999 AND e >= 2001001 AND e - s <= 3000 AND doc_id NOT IN (SELECT doc_id FROM tags WHERE tag IN ('kind:bible', 'kind:morphology')) GROUP BY 1),
p AS (SELECT doc_id, chunk_id, row_number() OVER (ORDER BY width, chunk_id) AS rank FROM m JOIN c USING (doc_id)) SELECT chunk_id, round(1.1 / (60 + rank), 8) AS score, ['passage'] AS retrievers, title FROM p JOIN titles USING (doc_id) WHERE rank <= 50 AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') ORDER BY score DESC, chunk_id LIMIT 10""")
def api_01_search(t):
    """A search by passage: the book alone is named, so its weights and its documents count, gated by language."""
    return Service(t).search("what is in Exodus").select("chunk_id", "score", "retrievers", "title")


@query("refs chunks tags", """WITH c AS (SELECT doc_id, arg_min(chunk_id, chunk_index) AS chunk_id FROM chunks GROUP BY doc_id), m AS (SELECT doc_id, min(e - s) AS width FROM refs WHERE s <= 2999999 AND e >= 2001001 AND e - s <= 3000 AND doc_id NOT IN (SELECT doc_id FROM tags WHERE tag IN ('kind:bible', 'kind:morphology')) GROUP BY 1),
p AS (SELECT doc_id, chunk_id, row_number() OVER (ORDER BY width, chunk_id) AS rank FROM m JOIN c USING (doc_id)), k AS (SELECT doc_id, min(tag[6:]) AS kind FROM tags WHERE tag LIKE 'kind:%' GROUP BY 1), f AS (SELECT kind, chunk_id, round(1.0 / (60 + rank), 8) AS score FROM p JOIN k USING (doc_id) WHERE rank <= 50)
SELECT 0::BIGINT AS query_id, kind, chunk_id, score, round(score / max(score) OVER w, 4) AS relative, row_number() OVER (PARTITION BY kind ORDER BY score DESC, chunk_id) AS place, count(*) OVER w AS total FROM f WINDOW w AS (PARTITION BY kind) QUALIFY place <= 8""")
def api_02_branched(t):
    return Service(t).branched("what is in Exodus")


@query("words", "SELECT 'verse' AS call, count(DISTINCT verse) AS n FROM words WHERE book = 1 AND chapter = 1 AND verse BETWEEN 1 AND 3 UNION ALL SELECT 'word', count(*) FROM words WHERE strong = 'H0001' UNION ALL SELECT 'lexemes', count(DISTINCT lemma) FROM words WHERE morph = 'N-msa'")
def api_14_words(t):
    """The original-language calls over the word store: a verse, a code, the lexemes of a form."""
    s, w = Service(t), t.words()
    n = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("call"), "n")
    return n("verse", s.verse(1, 1, 1, 3)).unionByName(n("word", corpus.frame_filter(w, strong="H0001"))).unionByName(n("lexemes", s.words("frequency", 1 << 30, morph="N-msa").select("lemma").distinct()))


@query("xref", "WITH s AS (SELECT min(source) AS s FROM xref) SELECT ts, te, rank FROM xref, s WHERE source = s ORDER BY rank NULLS LAST, ts, te LIMIT 100")
def sup_33_cross_references(t):
    least = t.xref().agg(F.min("source")).first()[0]
    return Service(t).cross_references(least).select("ts", "te", "rank")


@query("chunks tags refs", "SELECT 'chunks' AS name, count(*) AS n FROM chunks UNION ALL SELECT 'tags', count(*) FROM tags UNION ALL SELECT 'refs', count(*) FROM refs UNION ALL SELECT 'missing', NULL")
def sup_35_health(t):
    """Counts of the store's tables; one that isn't there has none."""
    return Service(t).health("chunks", "tags", "refs", "missing")


@query("tags", "WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 7 = 0 THEN 'aquifer' WHEN doc_id % 8 = 5 THEN 'bible' WHEN doc_id % 8 = 4 THEN 'lexicon' WHEN doc_id % 8 = 6 THEN 'morphology' ELSE 'main' END AS corpus FROM documents), w AS (SELECT corpus, doc_id, unnest(regexp_extract_all(lower(text), '[a-zà-öø-ÿß]{3,}')) AS term FROM d) SELECT corpus AS name, count(DISTINCT doc_id) AS units, count(DISTINCT (doc_id, term)) AS postings FROM w GROUP BY 1 UNION ALL SELECT 'documents', count(*), 0 FROM documents UNION ALL SELECT 'chunks', count(*), 0 FROM documents WHERE regexp_replace(coalesce(text, ''), '\\s+', '', 'g') <> '' UNION ALL SELECT 'vectors', count(*), 0 FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE regexp_replace(coalesce(text, ''), '\\s+', '', 'g') <> '')")
def snk_02_published(t):
    """The documents published as a whole index, and what its manifest counts: tables, orphan-free vectors, postings by corpus."""
    d, none = F.col("doc_id"), F.array().cast("array<bigint>")
    own = t.table("documents").select("doc_id", "text").where("doc_id IS NOT NULL").join(tags_of(t), "doc_id", "left")  # texts alone are read without the tags
    body = F.nullif(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""), F.lit(""))
    documents = own.select(d.cast("string").alias("id"), F.concat(d.cast("string"), F.lit(".md")).alias("path"), F.lit("t").alias("title"), body.alias("body"), "tags", none.alias("s"), none.alias("e"), F.lit("{}").alias("metadata"))
    vectors = t.table("embeddings").select(F.concat(F.col("vec_id").cast("string"), F.lit(":0000")).alias("id"), "embedding")
    folder = f"{store.shared_root(t.spark)}/published-1/{store.snapshot(t.spark, t.path('documents'), t.path('embeddings'))}"
    if store.current(t.spark, folder) is None:
        sinks.publish_index(documents, folder, vectors)
    found = store.current(t.spark, folder)[1]
    rows = [(n, s["n"], s["postings"]) for n, s in found["fts"].items() if s["n"]] + [(n, found["counts"][n], 0) for n in ("documents", "chunks", "vectors")]
    return t.spark.createDataFrame(rows, "name string, units long, postings long")


def tags_of(t):
    """doc_id, tags: all tags of each document."""
    return t.tags().groupBy("doc_id").agg(F.collect_set("tag").alias("tags"))
