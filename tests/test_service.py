"""The service's calls, the sinks and the sense tables."""

import pytest

from lectern.operators import senses
from lectern.plans.service import Service
from lectern.plans.views import Tables
from lectern.sources import files, sinks


def test_service(spark, sf_dir):
    s = Service(Tables(spark, sf_dir))
    found = s.search("thor or inti, ntble", top_k=5).collect()
    assert len(found) == 5
    assert found[0]["score"] >= found[-1]["score"]
    assert s.branched("thor or inti").count() > 0
    assert s.passage(1001001, 20001001).count() > 0 and s.tree("kind").count() == 8
    assert s.concordance("The", limit=3).count() == 3 and s.similar(0, 4).count() == 4
    assert s.words(morph="N-msa", limit=7).count() == 7 and s.health().count() == 3
    asia = s.entity("ASIA").collect()
    assert len(asia) == 5 and {(r["relation"], r["direction"]) for r in asia} == {("located-in", "in")}
    assert s.entity("nobody").count() == 0 and s.phrase("the", "the").count() > 0
    assert [r["vec_id"] for r in s.similar_exactly(0, 1).collect()] == [r["vec_id"] for r in s.similar(0, 1).collect()]


def test_search_follows_the_intent(spark, sf_dir):
    s = Service(Tables(spark, sf_dir))
    seen = lambda q: {x for r in s._hits(q)[0].select("retriever").distinct().collect() for x in r}
    assert "topic" in seen("verses about economy") and s.analyse("verses about economy")["intent"] == "topic"
    assert s.analyse("cross-references for GEN 1:2")["xref_source"] == 1001002
    assert seen("summarize EXO 8:1-40") == {"passage"}
    assert s.analyse("what did user say about inti")["intent"] == "speaker" and "fts" in seen("what did user say about inti")
    assert "lexicon" in seen("the Greek word inti")


def test_index(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("---\ntags: [kind:bible]\npassages: [[1001001, 1001003]]\n---\nIn the beginning")
    (tmp_path / "in" / "b.md").write_text("---\ntitle: B\n---\n")
    counts = sinks.build_index(files.read_markdown(spark, str(tmp_path / "in")), str(tmp_path / "out"))
    assert counts == {"documents": 2, "chunks": 1, "passage_refs": 1, "tags": 1}
    chunks = spark.read.parquet(str(tmp_path / "out" / "chunks"))
    none = spark.createDataFrame([], "id string, embedding array<float>")
    vectors = sinks.embed_missing(chunks, none, sinks.hashed, "hash")
    assert vectors.count() == 1 and sinks.without_orphans(vectors, chunks.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sinks.embed_missing(chunks, none, sinks.hashed, "hash", "other")
    sinks.init_schema(spark)
    assert spark.catalog.tableExists("passage_refs")


def test_senses(spark):
    s = spark.createDataFrame([(1, 1, 5, "go"), (1, 2, 9, "walk"), (1, 3, 1, "eat")], "lex long, sense long, n long, label string")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "sense long, embedding array<double>")
    assert sorted(map(tuple, senses.merge_by_vector(s, v).collect())) == [(1, 1, 14, "walk"), (1, 3, 1, "eat")]
    o = spark.createDataFrame([("a", "q", "To.go")] * 3 + [("a", "q", "go")] * 2, "lex string, stem string, gloss string")
    assert [tuple(r) for r in senses.anchored(o).orderBy("number").select("label", "n", "number").collect()] == [("To.go", 3, 1), ("go", 2, 2)]
