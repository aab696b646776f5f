"""The service's calls as compositions of operators over one store.

A store is a set of DataFrames with the columns of ``views.Tables`` (chunks, titles, tokens, bags, title_bags, tags, refs, topics,
xref, speakers, entities, edges, words, embeddings through ``table``). Every call returns a lazy DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lectern.functions.text import excerpt
from lectern.operators import corpus, fts, fusion, graph, intents, intervals, retrieve, tags, vectors
from lectern.plans.views import Tables, doc_of


class Service:
    def __init__(self, store: Tables):
        self.store = store

    def _terms(self, words: list[str]) -> DataFrame:
        return self.store.spark.createDataFrame([(w,) for w in words] or [("",)], "term string")

    def analyse(self, question: str) -> Row:
        """What a question asks for: intent, passages, keywords, tags, words, codes, related, topic, xref_source, speaker."""
        s = self.store
        asked = s.spark.createDataFrame([(0, question)], "id long, text string")
        return intents.analysed(asked, "id", "text", s.speakers().select(F.col("speaker").alias("name")).distinct()).first()

    def _hits(self, question: str, book: int | None = None) -> tuple[DataFrame, Row]:
        """All retrievers that a question calls for, as one union, and its analysis."""
        s, found = self.store, self.analyse(question)
        words = list(dict.fromkeys(found["keywords"]))
        q, heads = self._terms(words), s.heads()
        out = retrieve.by_index(s.index(), words)
        out = out.unionByName(retrieve.by_title_index(s.title_index(), words, heads))
        out = out.unionByName(retrieve.by_kind_text(s.bags(), s.tags(), "bible", words, "bible"))
        out = out.unionByName(retrieve.by_tagged_text(s.bags(), s.tags(), "resource:aquifer", words, "aquifer"))
        if found["tags"]:
            out = out.unionByName(retrieve.by_tags(s.tags(), heads, found["tags"]))
        spans = [(p["s"], p["e"]) for p in found["passages"]] or ([(book * 1000000, book * 1000000 + 999999)] if book else [])
        if spans:
            p = s.spark.createDataFrame([(0, a, b) for a, b in spans], "query_id long, qs long, qe long")
            out = out.unionByName(retrieve.by_passage(s.refs(), heads, s.tags(), p))
        if found["xref_source"] is not None:
            source = s.spark.createDataFrame([(found["xref_source"],)], "source long")
            out = out.unionByName(retrieve.by_cross_reference(s.xref(), source, s.refs(), heads))
        if found["words"]:
            k = s.tokens()
            out = out.unionByName(retrieve.tiered("lexicon", (k.where(F.col("term").isin(*found["words"])), 1.0), limit=200))
        if found["related"] is not None:
            named = s.entities().where(F.lower("name") == found["related"]["name"].lower())
            relation = found["related"]["relation"].removesuffix("-rev")
            out = out.unionByName(retrieve.by_entity(s.edges(), named, relation))
        if found["topic"]:
            out = out.unionByName(retrieve.by_topic(s.topics(), found["topic"], s.refs(), heads))
        if found["speaker"]:
            out = out.unionByName(retrieve.by_speaker(s.bags(), q, s.refs(), s.speakers(), found["speaker"]))
        return out, found

    def search(self, question: str, language: str = "en", source: str = "all", top_k: int = 10, book: int | None = None) -> DataFrame:
        """chunk_id, score, retrievers, title, excerpt: fused by the intent's weights, gated by language and source."""
        hits, found = self._hits(question, book)
        weights = fusion.weights(self.store.spark).where(F.col("intent") == found["intent"])
        fused = fusion.rrf(hits, weights).join(self.store.chunks(), "chunk_id")
        own = tags.from_source(tags.language_gate(fused, self.store.tags(), language), self.store.tags(), source)
        return own.orderBy(F.desc("score"), "chunk_id").limit(top_k).join(self.store.titles(), "doc_id").select("chunk_id", "score", "retrievers", "title", excerpt(F.col("body")).alias("excerpt"))

    def branched(self, question: str, per_branch: int = 8) -> DataFrame:
        """Hits by kind, unweighted, each branch capped."""
        fused = fusion.rrf(self._hits(question)[0]).drop("retrievers")
        kinds = fused.select("chunk_id", doc_of(F.col("chunk_id")).alias("doc_id")).join(tags.kind_of(self.store.tags()), "doc_id").select("chunk_id", "kind")
        return fusion.branches(fused, kinds, per_branch)

    def passage(self, s: int, e: int) -> DataFrame:
        """Everything over an interval, narrowest first."""
        own = intervals.overlapping(self.store.refs(), [(s, e)])
        return own.join(self.store.titles(), "doc_id").withColumn("width", F.col("e") - F.col("s")).orderBy("width", "doc_id")

    def cross_references(self, key: int, limit: int = 100) -> DataFrame:
        return self.store.xref().where(F.col("source") == key).orderBy(F.asc_nulls_last("rank"), "ts", "te").limit(limit)

    def concordance(self, word: str, offset: int = 0, limit: int = 50) -> DataFrame:
        return self.store.tokens().where(F.col("term") == word.lower()).select("chunk_id").distinct().orderBy("chunk_id").offset(offset).limit(limit)

    def entity(self, name: str) -> DataFrame:
        """Everything that touches the entities of a name."""
        return graph.view(self.store.edges()).join(graph.resolve(self.store.entities(), name), "id")

    def tree(self, namespace: str) -> DataFrame:
        return tags.facets(self.store.tags(), f"{namespace}:")

    def verse(self, book: int, chapter: int, start: int = 1, end: int | None = None) -> DataFrame:
        return corpus.passage(self.store.words(), book, chapter, start, end)

    def words(self, order: str = "frequency", limit: int = 50, **features) -> DataFrame:
        own = self.store.words()
        return corpus.lexeme_feed(corpus.frame_filter(own, **features) if any(v is not None for v in features.values()) else own, order, limit)

    def similar(self, vec_id: int, k: int = 20) -> DataFrame:
        """The nearest vectors out of the stored lists: only those that this one probes are read."""
        v = self.store.table("embeddings").where(F.col("vec_id") == vec_id)
        return self.store.vector_index().search(v, k)

    def similar_exactly(self, vec_id: int, k: int = 20) -> DataFrame:
        v = self.store.table("embeddings")
        return vectors.ranked_neighbours(v.where(F.col("vec_id") == vec_id), v, k)

    def phrase(self, *words: str) -> DataFrame:
        return fts.phrase(self.store.tokens(), [w.lower() for w in words])

    def health(self, *names: str) -> DataFrame:
        """name, n: the store's counts; a table that the store doesn't have is named without a count."""
        out = None
        for name in names or ("chunks", "tags", "refs"):
            table = getattr(self.store, name, None)
            n = table().agg(F.count("*").alias("n")) if callable(table) else self.store.spark.createDataFrame([(None,)], "n long")
            row = n.select(F.lit(name).alias("name"), "n")
            out = row if out is None else out.unionByName(row)
        return out
