"""Views that present the driver tables in the shape of the engine's stores, in Spark and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import terms
from lectern.operators import lists, postings
from lectern.sources import store

KINDS = ("article", "note", "question", "term", "lexicon", "bible", "morphology", "transcript")


class Tables:
    """The tables of one directory and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def dealt(self, name: str, *columns: str) -> DataFrame:
        """Columns of a table whose texts are to be parsed, dealt evenly over the cores if it has fewer files than them.

        A file of one row group is read by one task. Tables of many files stay where they are read, without a shuffle.
        """
        own, cores = self.table(name).select(*columns), self.spark.sparkContext.defaultParallelism
        return own.repartition(cores) if store.files(self.spark, self.path(name)) < cores else own

    def path(self, name: str) -> str:
        return f"{self.dir}/{name}.parquet"

    def index(self) -> postings.Postings:
        """The chunks' stored inverted index, built once for the table as it lies there, with each document's first chunk."""

        def build(path: str) -> dict:
            self.chunks().select("chunk_id", "doc_id", "chunk_index").groupBy("doc_id").agg(F.min_by("chunk_id", "chunk_index").alias("chunk_id"), F.min("chunk_index").alias("chunk_index")).write.parquet(f"{path}/heads")
            return postings.build(self.bags(), path)

        return postings.Postings(self.spark, *store.derived(self.spark, f"chunks-{postings.FORMAT}", [self.path("documents")], build))

    def title_index(self) -> postings.Postings:
        """The titles' stored inverted index; its units are documents."""
        return postings.Postings(self.spark, *store.derived(self.spark, f"titles-{postings.FORMAT}", [self.path("documents")], lambda path: postings.build(self.title_bags(), path, "doc_id")))

    def heads(self) -> DataFrame:
        """doc_id, chunk_id, chunk_index of each document's first chunk, as stored with the index."""
        return self.spark.read.parquet(f"{self.index().path}/heads")

    def vector_index(self) -> lists.Lists:
        """The embeddings' stored inverted lists."""
        return lists.Lists(self.spark, *store.derived(self.spark, f"vectors-{lists.FORMAT}", [self.path("embeddings")], lambda path: lists.build(self.table("embeddings"), path)))

    def chunks(self) -> DataFrame:
        """chunk_id, doc_id, chunk_index, body: the documents' lines."""
        lines = self.dealt("documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "body")).where(F.trim("body") != "")
        return lines.select(F.format_string("%d:%04d", "doc_id", "i").alias("chunk_id"), "doc_id", F.col("i").cast("long").alias("chunk_index"), "body")

    def titles(self) -> DataFrame:
        """doc_id, title: the first six words of the first line."""
        first = F.get(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), F.lit(0))
        return self.table("documents").select("doc_id", F.array_join(F.slice(F.split(first, " "), 1, 6), " ").alias("title"))

    def tokens(self) -> DataFrame:
        """chunk_id, doc_id, pos, term."""
        return self.chunks().select("chunk_id", "doc_id", F.posexplode(terms(F.col("body"))).alias("pos", "term")).withColumn("pos", F.col("pos").cast("long"))

    def bags(self) -> DataFrame:
        """chunk_id, doc_id, words: the terms of each chunk as one array."""
        return self.chunks().select("chunk_id", "doc_id", terms(F.col("body")).alias("words"))

    def title_bags(self) -> DataFrame:
        """doc_id, words of the title."""
        return self.titles().select("doc_id", terms(F.col("title")).alias("words"))

    def tags(self) -> DataFrame:
        """doc_id, tag: language, source, kind, labels and one resource."""
        d = self.table("documents")
        tag = lambda *c: F.concat(*c).alias("tag")
        kind = F.get(F.array(*map(F.lit, KINDS)), F.pmod("doc_id", F.lit(8)).cast("int"))
        labels = self.table("labels")
        parts = (
            d.select("doc_id", tag(F.lit("lang:"), "lang")),
            d.select("doc_id", tag(F.lit("source:"), "source")),
            d.select("doc_id", tag(F.lit("kind:"), kind)),
            d.where("doc_id % 7 = 0").select("doc_id", F.lit("resource:aquifer").alias("tag")),
            labels.select("doc_id", tag(F.lit("quality:"), F.col("quality").cast("string"))),
            labels.select("doc_id", tag(F.lit("toxic:"), F.col("toxic").cast("string"))),
        )
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def refs(self) -> DataFrame:
        """doc_id, s, e: a passage for each document, of a verse, some verses or a whole chapter."""
        d = F.col("doc_id")
        s = (d % 66 + 1) * 1000000 + (d * 7 % 50 + 1) * 1000 + d * 13 % 30 + 1
        more = F.when(d % 10 == 0, 998).when(d % 10 == 1, 20).otherwise(d % 4)
        return self.table("documents").select("doc_id", s.cast("long").alias("s")).withColumn("e", (F.col("s") + more).cast("long"))

    def topics(self) -> DataFrame:
        """topic_id, name, s, e: topics from the parts."""
        p = F.col("p_partkey")
        s = (p % 66 + 1) * 1000000 + (p * 7 % 50 + 1) * 1000 + p * 13 % 30 + 1
        return self.table("part").select(p.alias("topic_id"), F.concat_ws(" ", "p_type", "p_brand").alias("name"), s.cast("long").alias("s"), (s + p % 12).cast("long").alias("e"))

    def xref(self) -> DataFrame:
        """source, ts, te, attribution, rank (null for returned lines)."""
        o, p = F.col("l_orderkey"), F.col("l_partkey")
        key = lambda k: (k % 66 + 1) * 1000000 + (k * 7 % 50 + 1) * 1000 + k * 13 % 30 + 1
        return self.table("lineitem").select(key(o).cast("long").alias("source"), key(p).cast("long").alias("ts"), (key(p) + p % 3).cast("long").alias("te"), F.col("l_linestatus").alias("attribution"), F.when(F.col("l_returnflag") != "R", F.col("l_linenumber")).cast("long").alias("rank"))

    def speakers(self) -> DataFrame:
        """speaker, s, e, divine: ranges from the conversations' turns."""
        c, t = F.col("conv_id").cast("long"), F.col("turn")
        s = (c % 66 + 1) * 1000000 + (t + 1) * 1000 + c % 20 + 1
        return self.table("conversations").select(F.col("role").alias("speaker"), s.cast("long").alias("s"), (s + 5).cast("long").alias("e"), (F.col("role") == "system").alias("divine"))

    def entities(self) -> DataFrame:
        """id, type, name, metadata."""
        e = lambda t, k, n, kind, meta: self.table(t).select(F.concat(F.lit(f"{kind}:"), F.col(k).cast("string")).alias("id"), F.lit(kind).alias("type"), F.col(n).alias("name"), F.to_json(F.struct(F.col(meta).alias("description"))).alias("metadata"))
        return e("region", "r_regionkey", "r_name", "region", "r_name").unionByName(e("nation", "n_nationkey", "n_name", "nation", "n_name")).unionByName(e("customer", "c_custkey", "c_name", "customer", "c_mktsegment")).unionByName(e("supplier", "s_suppkey", "s_name", "supplier", "s_name"))

    def edges(self) -> DataFrame:
        """source_id, target_id, relation; same-segment is symmetric and stored with the lesser id first."""
        link = lambda df, a, ka, b, kb, rel: df.select(F.concat(F.lit(f"{a}:"), F.col(ka).cast("string")).alias("source_id"), F.concat(F.lit(f"{b}:"), F.col(kb).cast("string")).alias("target_id"), F.lit(rel).alias("relation"))
        c = self.table("customer")
        near = c.alias("a").join(c.alias("b"), (F.col("a.c_mktsegment") == F.col("b.c_mktsegment")) & (F.col("a.c_nationkey") == F.col("b.c_nationkey")) & (F.col("b.c_custkey") == F.col("a.c_custkey") + 100))
        pair = near.select(F.concat(F.lit("customer:"), F.col("a.c_custkey").cast("string")).alias("x"), F.concat(F.lit("customer:"), F.col("b.c_custkey").cast("string")).alias("y"))
        return (
            link(self.table("nation"), "nation", "n_nationkey", "region", "n_regionkey", "located-in")
            .unionByName(link(c, "customer", "c_custkey", "nation", "c_nationkey", "located-in"))
            .unionByName(link(self.table("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", "located-in"))
            .unionByName(pair.select(F.least("x", "y").alias("source_id"), F.greatest("x", "y").alias("target_id"), F.lit("same-segment").alias("relation")))
        )

    def words(self, *more: str) -> DataFrame:
        """book, chapter, verse, idx, surface, strong, lemma, morph, is_content: conversations as a word store.

        ``more`` may name c, t, i as well: the conversation, turn and place of a word, its place in reading order.
        """
        t = self.dealt("conversations", "conv_id", "turn", "text").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("t"), F.posexplode(terms(F.col("text"))).alias("i", "surface"))
        n = F.length("surface")
        return t.select(
            (F.col("c") % 66 + 1).alias("book"), (F.col("t") + 1).alias("chapter"), (F.floor(F.col("c") / 66) * 20 + F.floor(F.col("i") / 12) + 1).cast("long").alias("verse"), (F.col("i") % 12).cast("long").alias("idx"), "surface",
            F.concat(F.lit("H"), F.lpad((F.conv(F.substring(F.md5("surface"), 1, 4), 16, 10).cast("long") % 997).cast("string"), 4, "0")).alias("strong"),
            F.substring("surface", 1, 5).alias("lemma"), F.when(n % 3 == 0, "N-msa").when(n % 3 == 1, "V-qal").otherwise("P").alias("morph"), (n > 4).cast("long").alias("is_content"), *more,
        )

    def occurrences(self, *more: str) -> DataFrame:
        """node, ref, lex, stem, sense over the word store, and ``more`` of its columns."""
        w = self.words(*more)
        ref = F.col("book") * 1000000 + F.col("chapter") * 1000 + F.col("verse")
        return w.select((ref * 100 + F.col("idx")).alias("node"), ref.alias("ref"), F.col("lemma").alias("lex"), F.substring("morph", 1, 1).alias("stem"), (F.length("surface") % 4).cast("long").alias("sense"), "surface", *more)


def doc_of(chunk_id: Column) -> Column:
    """The document of a chunk, which its key begins with."""
    return F.substring_index(chunk_id, ":", 1).cast("long")


_KEY = "({0} % 66 + 1) * 1000000 + ({0} * 7 % 50 + 1) * 1000 + {0} * 13 % 30 + 1"
#: The same views as DuckDB CTEs; those they need come first.
CTES = {
    "chunks": ((), "SELECT printf('%d:%04d', doc_id, i - 1) AS chunk_id, doc_id, (i - 1)::BIGINT AS chunk_index, body FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(body) <> ''"),
    "titles": ((), "SELECT doc_id, array_to_string(list_slice(string_split(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1], ' '), 1, 6), ' ') AS title FROM documents"),
    "tokens": (("chunks",), "SELECT chunk_id, doc_id, (i - 1)::BIGINT AS pos, term FROM (SELECT chunk_id, doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS i FROM (SELECT chunk_id, doc_id, regexp_extract_all(lower(body), '[a-zà-öø-ÿß]{3,}') AS t FROM chunks))"),
    "tags": ((), "SELECT doc_id, 'lang:' || lang AS tag FROM documents UNION ALL SELECT doc_id, 'source:' || source FROM documents UNION ALL SELECT doc_id, 'kind:' || ['" + "', '".join(KINDS) + "'][doc_id % 8 + 1] FROM documents UNION ALL SELECT doc_id, 'resource:aquifer' FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id, 'quality:' || quality FROM labels UNION ALL SELECT doc_id, 'toxic:' || toxic FROM labels"),
    "refs": ((), f"SELECT doc_id, s, s + CASE WHEN doc_id % 10 = 0 THEN 998 WHEN doc_id % 10 = 1 THEN 20 ELSE doc_id % 4 END AS e FROM (SELECT doc_id, {_KEY.format('doc_id')} AS s FROM documents)"),
    "topics": ((), f"SELECT p_partkey AS topic_id, p_type || ' ' || p_brand AS name, {_KEY.format('p_partkey')} AS s, {_KEY.format('p_partkey')} + p_partkey % 12 AS e FROM part"),
    "xref": ((), f"SELECT {_KEY.format('l_orderkey')} AS source, {_KEY.format('l_partkey')} AS ts, {_KEY.format('l_partkey')} + l_partkey % 3 AS te, l_linestatus AS attribution, CASE WHEN l_returnflag <> 'R' THEN l_linenumber::BIGINT END AS rank FROM lineitem"),
    "speakers": ((), "SELECT role AS speaker, s, s + 5 AS e, role = 'system' AS divine FROM (SELECT role, (conv_id::BIGINT % 66 + 1) * 1000000 + (turn + 1) * 1000 + conv_id::BIGINT % 20 + 1 AS s FROM conversations)"),
    "entities": ((), "SELECT 'region:' || r_regionkey AS id, 'region' AS type, r_name AS name, '{\"description\":\"' || r_name || '\"}' AS metadata FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, '{\"description\":\"' || n_name || '\"}' FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, '{\"description\":\"' || c_mktsegment || '\"}' FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, '{\"description\":\"' || s_name || '\"}' FROM supplier"),
    "edges": ((), "SELECT 'nation:' || n_nationkey AS source_id, 'region:' || n_regionkey AS target_id, 'located-in' AS relation FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'located-in' FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'located-in' FROM supplier UNION ALL SELECT least('customer:' || a.c_custkey, 'customer:' || b.c_custkey), greatest('customer:' || a.c_custkey, 'customer:' || b.c_custkey), 'same-segment' FROM customer a JOIN customer b ON a.c_mktsegment = b.c_mktsegment AND a.c_nationkey = b.c_nationkey AND b.c_custkey = a.c_custkey + 100"),
    "words": ((), "SELECT c % 66 + 1 AS book, t + 1 AS chapter, (c // 66 * 20 + (i - 1) // 12 + 1)::BIGINT AS verse, ((i - 1) % 12)::BIGINT AS idx, surface, 'H' || lpad((('0x' || substr(md5(surface), 1, 4))::BIGINT % 997)::VARCHAR, 4, '0') AS strong, substr(surface, 1, 5) AS lemma, CASE length(surface) % 3 WHEN 0 THEN 'N-msa' WHEN 1 THEN 'V-qal' ELSE 'P' END AS morph, (length(surface) > 4)::BIGINT AS is_content FROM (SELECT c, t, unnest(w) AS surface, generate_subscripts(w, 1) AS i FROM (SELECT conv_id::BIGINT AS c, turn::BIGINT AS t, regexp_extract_all(lower(text), '[a-zà-öø-ÿß]{3,}') AS w FROM conversations))"),
    "occurrences": (("words",), "SELECT (book * 1000000 + chapter * 1000 + verse) * 100 + idx AS node, book * 1000000 + chapter * 1000 + verse AS ref, lemma AS lex, substr(morph, 1, 1) AS stem, (length(surface) % 4)::BIGINT AS sense, surface FROM words"),
}


def with_views(names: str, sql: str) -> str:
    """DuckDB SQL with the named views (and those they need) as CTEs in front; ``sql`` may begin with more CTEs."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in CTES[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    head = ", ".join(f"{n} AS ({CTES[n][1]})" for n in order)
    body = sql.strip()
    recursive = body.startswith("WITH RECURSIVE ")
    if body.startswith("WITH "):
        body = body.removeprefix("WITH RECURSIVE ").removeprefix("WITH ")
        return f"WITH {'RECURSIVE ' if recursive else ''}{head}{', ' if head else ''}{body}"
    return f"WITH {head} {body}" if head else body
