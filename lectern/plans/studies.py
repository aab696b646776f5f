"""Queries of word studies with all their parts, over two stores out of the conversations' words."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import composites, study
from lectern.operators.graph import cut
from lectern.plans.completion import _ART, _CODES, _KEY, articles, keyness
from lectern.plans.registry import query

_STORES = "st AS (SELECT 'spine' AS corpus, book, chapter, verse, idx, surface, strong, lemma, morph FROM words UNION ALL SELECT 'lxx', book, chapter, verse, idx, surface, 'G' || substr(strong, 2), lemma, morph FROM words WHERE idx % 2 = 0)"
_PARTS = "gl AS (SELECT strong AS code, min(surface) AS gloss FROM st WHERE length(surface) > 4 GROUP BY 1), sn AS (SELECT corpus, book, chapter, verse, strong AS code, min(length(surface) % 4) AS sense FROM st GROUP BY ALL), dm0 AS (SELECT strong AS code, lemma[1] AS domain, count(*) AS m FROM st GROUP BY ALL), dm AS (SELECT code, domain, m / sum(m) OVER (PARTITION BY code) AS share FROM dm0), dd AS (SELECT code, domain FROM dm QUALIFY row_number() OVER (PARTITION BY code ORDER BY share DESC, domain) = 1 AND share >= 0.5)"


def stores(t):
    """The word store, and one of another language over every second word."""
    w = t.words().select("book", "chapter", "verse", "idx", "surface", "strong", "lemma", "morph")
    other = w.where("idx % 2 = 0").withColumn("strong", F.concat(F.lit("G"), F.substring("strong", 2, 8)))
    return cut(w.select(F.lit("spine").alias("corpus"), "*").unionByName(other.select(F.lit("lxx").alias("corpus"), "*")))


def parts(s):
    """(glosses, senses by verse, domains with shares) of the stores."""
    gloss = s.where(F.length("surface") > 4).groupBy(F.col("strong").alias("code")).agg(F.min("surface").alias("gloss"))
    sense = s.groupBy("corpus", "book", "chapter", "verse", F.col("strong").alias("code")).agg(F.min(F.length("surface") % 4).cast("long").alias("sense"))
    one = s.groupBy(F.col("strong").alias("code"), F.substring("lemma", 1, 1).alias("domain")).agg(F.count("*").alias("m"))
    total = one.groupBy("code").agg(F.sum("m").alias("total"))
    return gloss, sense, one.join(total, "code").select("code", "domain", (F.col("m") / F.col("total")).alias("share"))


@query("words", f"WITH {_STORES}, {_PARTS} SELECT st.corpus, st.book, st.chapter, st.verse, st.idx, st.surface, st.strong AS code, st.lemma, st.morph, gloss, sense::BIGINT AS sense, domain FROM st LEFT JOIN gl ON gl.code = st.strong LEFT JOIN sn ON sn.corpus = st.corpus AND sn.book = st.book AND sn.chapter = st.chapter AND sn.verse = st.verse AND sn.code = st.strong LEFT JOIN dd ON dd.code = st.strong")
def cor_10_interlinear(t):
    s = stores(t)
    gloss, sense, domain = parts(s)
    return composites.interlinear(s, gloss, sense, composites.dominant_domains(domain))


@query("words", f"WITH {_STORES}, {_PARTS}, o AS (SELECT strong AS code, st.*, book * 1000000 + chapter * 1000 + verse AS ref, count(*) OVER (PARTITION BY strong, corpus) AS n, row_number() OVER (PARTITION BY strong, corpus ORDER BY book * 1000000 + chapter * 1000 + verse, idx, surface) AS place FROM st) SELECT o.code, o.corpus, place, ref, surface, morph, sense::BIGINT AS sense, n, n > 200 AS truncated FROM o LEFT JOIN sn ON sn.corpus = o.corpus AND sn.book = o.book AND sn.chapter = o.chapter AND sn.verse = o.verse AND sn.code = o.code WHERE place <= 200")
def cor_11_concordance(t):
    s = stores(t)
    return composites.concordance(s, parts(s)[1])


_LEX = "lx AS (SELECT DISTINCT strong AS code, lemma AS lex FROM words), ls AS (SELECT lemma AS lex, morph[1] AS stem, surface AS gloss, count(*) AS n FROM words GROUP BY ALL), lt AS (SELECT *, lex || '.' || stem || ': ' || gloss || ' (' || round(n / sum(n) OVER (PARTITION BY lex, stem), 3) || ')' AS told FROM ls), hg AS (SELECT code, list(lex ORDER BY lex) AS lexemes, flatten(list(told ORDER BY lex)) AS senses FROM lx JOIN (SELECT lex, list(told ORDER BY stem, n DESC, gloss) AS told FROM lt GROUP BY lex) USING (lex) GROUP BY code)"


def _homographs(w):
    return composites.homographs(w.select(F.col("strong").alias("code"), F.col("lemma").alias("lex")), w.groupBy(F.col("lemma").alias("lex"), F.substring("morph", 1, 1).alias("stem"), F.col("surface").alias("gloss")).agg(F.count("*").alias("n")))


@query("words", f"WITH {_LEX} SELECT * FROM hg")
def cor_15_homographs(t):
    return _homographs(t.words())


_BASE = "s0 AS (SELECT strong AS code, surface, count(*) AS m FROM words GROUP BY 1, 2), b AS (SELECT code, arg_min(surface, (-m, surface)) AS gloss, sum(m)::BIGINT AS n FROM s0 GROUP BY 1), d0 AS (SELECT DISTINCT strong AS code, lemma[1] AS domain FROM words), f0 AS (SELECT code, min(domain) AS domain FROM d0 GROUP BY 1), r0 AS (SELECT domain, code AS other, row_number() OVER (PARTITION BY domain ORDER BY n DESC, code) AS place FROM f0 JOIN b USING (code)), x0 AS (SELECT f0.code, other, row_number() OVER (PARTITION BY f0.code ORDER BY place) AS rn FROM f0 JOIN r0 ON r0.domain = f0.domain AND other <> f0.code WHERE place <= 7), n0 AS (SELECT code, list(other ORDER BY rn) AS siblings FROM x0 WHERE rn <= 6 GROUP BY 1), dl AS (SELECT code, list(domain ORDER BY domain) AS domains FROM d0 GROUP BY 1), sl AS (SELECT code, list(v ORDER BY v) AS stems FROM (SELECT strong AS code, morph[1] || '=' || count(*) AS v FROM words GROUP BY strong, morph[1]) GROUP BY 1), bl AS (SELECT code, list(v ORDER BY v) AS books FROM (SELECT strong AS code, book || '=' || count(*) AS v FROM words GROUP BY strong, book) GROUP BY 1)"


@query("words", f"""WITH {_CODES}, {_KEY}, {_ART}, {_LEX}, {_BASE}, ds0 AS (SELECT strong AS code, lemma[1] AS domain, count(*) AS m FROM words GROUP BY ALL), ds1 AS (SELECT code, domain, m / sum(m) OVER (PARTITION BY code) AS share FROM ds0), ds AS (SELECT code, list(domain || ' ' || round(share, 3) ORDER BY share DESC, domain) AS domain_shares FROM ds1 GROUP BY 1),
ar AS (SELECT code, list_sort(list_distinct(list(slug || ': ' || title))) AS articles FROM articles WHERE head GROUP BY 1), cl0 AS (SELECT a.code, 'G' || substr(c.code, 2) AS other, count(*) AS n FROM lx a JOIN lx c ON a.lex = c.lex AND a.code <> c.code GROUP BY ALL), cl1 AS (SELECT * FROM cl0 QUALIFY row_number() OVER (PARTITION BY code ORDER BY n DESC, other) <= 3), cl AS (SELECT code, list(other || '=' || n ORDER BY n DESC, other) AS equivalents FROM cl1 GROUP BY 1),
o AS (SELECT strong AS code, (length(surface) % 4)::BIGINT AS sense, book * 1000000 + chapter * 1000 + verse AS ref FROM words), on0 AS (SELECT code, sense, count(*) AS n FROM o GROUP BY ALL), od AS (SELECT DISTINCT * FROM o), of0 AS (SELECT code, sense, string_agg(ref::VARCHAR, ',' ORDER BY ref) AS refs FROM (SELECT * FROM od QUALIFY row_number() OVER (PARTITION BY code, sense ORDER BY ref) <= 3) GROUP BY ALL), ot AS (SELECT code, sense, n, n / sum(n) OVER (PARTITION BY code) AS share FROM on0), di AS (SELECT code, list(sense || ' ' || n || ' ' || round(share, 3) || ' ' || refs ORDER BY n DESC, sense) AS distribution FROM ot JOIN of0 USING (code, sense) GROUP BY 1)
SELECT b.code, b.gloss, b.n, k.score AS keyness, dl.domains, coalesce(n0.siblings, []) AS siblings, stems, books, domain_shares, coalesce(articles, []) AS articles, coalesce(equivalents, []) AS equivalents, distribution, lexemes, senses FROM b LEFT JOIN keyness k USING (code) JOIN dl USING (code) LEFT JOIN n0 USING (code) JOIN sl USING (code) JOIN bl USING (code) JOIN ds USING (code) LEFT JOIN ar USING (code) LEFT JOIN cl USING (code) JOIN di USING (code) JOIN hg USING (code)""")
def cor_13_word_study(t):
    words = cut(t.words())  # read by every part
    w = words.select(F.col("strong").alias("code"), "surface", F.substring("morph", 1, 1).alias("stem"), "book", F.substring("lemma", 1, 1).alias("domain"))
    base = study.word_study(w, w.select("code", "domain"), keyness(t))
    one = w.groupBy("code", "domain").agg(F.count("*").alias("m"))
    domains = one.join(one.groupBy("code").agg(F.sum("m").alias("total")), "code").select("code", "domain", (F.col("m") / F.col("total")).alias("share"))
    lexemes = words.select(F.col("strong").alias("code"), F.col("lemma").alias("lex")).distinct()
    bridge = lexemes.join(lexemes.withColumnRenamed("code", "other"), "lex").where("code != other").groupBy("code", F.concat(F.lit("G"), F.substring("other", 2, 8)).alias("other")).agg(F.count("*").alias("n"))
    senses = words.select(F.col("strong").alias("code"), (F.length("surface") % 4).cast("long").alias("sense"), (F.col("book") * 1000000 + F.col("chapter") * 1000 + F.col("verse")).alias("ref"))
    return composites.full_study(base, domains, articles(t), bridge, senses, _homographs(words))
