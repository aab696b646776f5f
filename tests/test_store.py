"""Stored indexes: publication, block-max search, inverted lists."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import fts, lists, postings
from lectern.operators.vectors import ranked_neighbours
from lectern.sources import store


@pytest.fixture(scope="module")
def root(spark):
    return store.shared_root(spark) + "/store-tests"


def test_a_failed_build_is_never_seen(spark, root):
    def fails(path):
        spark.range(3).write.parquet(f"{path}/t")
        raise RuntimeError("lost")

    folder = f"{root}/a"
    assert store.current(spark, folder) is None
    with pytest.raises(RuntimeError):
        store.publish(spark, folder, fails)
    assert store.current(spark, folder) is None
    first = store.publish(spark, folder, lambda path: {"rows": 1})
    second = store.publish(spark, folder, lambda path: {"rows": 2})
    assert store.current(spark, folder) == (second, {"rows": 2}) and first != second
    assert store.versions(spark, folder) == [2, 3]
    assert store.prune(spark, folder, 1) == [2] and store.versions(spark, folder) == [3]


def test_derived_follows_its_source(spark, root):
    source, built = f"{root}/source", []

    def build(path):
        built.append(path)
        return {"n": spark.read.parquet(source).count()}

    spark.range(5).write.parquet(source)
    assert store.derived(spark, "counted", [source], build)[1] == {"n": 5}
    assert store.derived(spark, "counted", [source], build)[1] == {"n": 5} and len(built) == 1
    spark.range(2).write.mode("append").parquet(source)
    assert store.derived(spark, "counted", [source], build)[1] == {"n": 7} and len(built) == 2


def bags_of(spark, n=3000, seed=5):
    rng = random.Random(seed)
    words = [f"w{i:03d}" for i in range(300)]
    rows = [(f"c{i:05d}", [words[min(int(rng.paretovariate(0.6)) - 1, 299)] for _ in range(rng.randrange(0, 40))]) for i in range(n)]
    rows += [("c-null", None), (None, ["w001"]), ("c-tie1", ["w001", "w002"]), ("c-tie0", ["w001", "w002"])]
    return spark.createDataFrame(rows, "chunk_id string, words array<string>").repartition(3)


@pytest.fixture(scope="module")
def index(spark, root):
    bags = bags_of(spark)
    postings.SHARD, shard = 32, postings.SHARD
    postings.BLOCK, block = 16, postings.BLOCK
    path = store.publish(spark, f"{root}/fts", lambda p: postings.build(bags, p))
    postings.SHARD, postings.BLOCK = shard, block
    return bags.where("chunk_id IS NOT NULL"), postings.Postings(spark, *store.current(spark, f"{root}/fts"))


@pytest.mark.parametrize("terms", [["w000"], ["w000", "w001", "w002"], ["w007", "w150"], ["w299", "nowhere"], ["nowhere"], []])
def test_index_scores_like_a_scan(index, terms):
    bags, own = index
    want = {r["chunk_id"]: r["score"] for r in fts.bm25(bags, terms or ["-"]).collect()}
    got = {r["chunk_id"]: r["score"] for r in own.bm25(terms).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    best = [(r["chunk_id"], r["score"]) for r in own.best(terms, 20).collect()]
    assert best == [(r["chunk_id"], r["score"]) for r in own.bm25(terms).orderBy(F.desc("score"), "chunk_id").limit(20).collect()]


def test_blocks_are_skipped(index):
    _, own = index
    terms = ["w000", "w001", "w020"]
    assert own.promising(terms, 10).count() < 0.5 * own.blocks(terms).count()


def test_only_partitions_of_the_terms_are_read(index):
    _, own = index
    plan = own.blocks(["w003"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan
    assert "In(term" in plan or "EqualTo(term" in plan


def test_frequent_terms(index):
    bags, own = index
    assert own.frequent(3, 0.5) == [r["term"] for r in fts.frequent_terms(bags, 3, 0.5).collect()]


def test_empty_index(spark, root):
    empty = spark.createDataFrame([], "chunk_id string, words array<string>")
    store.publish(spark, f"{root}/none", lambda p: postings.build(empty, p))
    own = postings.Postings(spark, *store.current(spark, f"{root}/none"))
    assert own.frequent() == [] and own.best(["x"], 5).count() == 0 and own.bm25(["x"]).count() == 0


@pytest.mark.parametrize("rank", [64, 8])
def test_lists_reach_their_recall(spark, root, rank):
    rng = np.random.default_rng(rank)
    x = rng.normal(size=(1500, rank)) @ rng.normal(size=(rank, 64))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9000, None), (9001, [0.0] * 64), (9002, [float("nan")] * 64), (9003, [None] * 64)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    store.publish(spark, f"{root}/vec{rank}", lambda p: lists.build(v, p))
    index = lists.Lists(spark, *store.current(spark, f"{root}/vec{rank}"))
    assert index.lists().select("vec_id").distinct().count() == 1500
    unit = spark.createDataFrame([(i, [float(c) for c in r / np.linalg.norm(r)]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    q = unit.where("vec_id % 50 = 7")
    exact = {(r["q"], r["vec_id"]) for r in ranked_neighbours(q, unit, 20).collect()}
    found = {(r["q"], r["vec_id"]) for r in index.search(v.where("vec_id % 50 = 7"), 20).collect()}
    assert len(exact & found) >= 0.95 * len(exact)
    if rank == 8:
        assert index.stats["probes"] < 0.4 * index.stats["lists"]


def test_only_probed_lists_are_read(spark, root):
    index = lists.Lists(spark, *store.current(spark, f"{root}/vec8"))
    assert "PartitionFilters: [isnotnull(list" in index.lists([3])._jdf.queryExecution().toString() or "PartitionFilters: [(list" in index.lists([3])._jdf.queryExecution().toString()


@pytest.mark.parametrize("carried", [4096, 1])
def test_neighbours_of_mixed_lengths(spark, monkeypatch, carried):
    monkeypatch.setattr("lectern.operators.vectors.CARRIED", carried)
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.0]), (5, None), (6, [None, 1.0]), (7, [])], "vec_id long, embedding array<double>")
    got = sorted((r["q"], r["vec_id"], r["sim"], r["rn"]) for r in ranked_neighbours(v, v, 3).collect())
    assert got == [(1, 2, 0.5, 1), (2, 1, 0.5, 1), (3, 4, 0.0, 1), (4, 3, 0.0, 1)]


def test_a_whole_index_is_one_version(spark, root):
    from lectern.sources import sinks

    rows = [("a", "a.md", "A", "the word here", ["kind:bible"], [1], [2], "{}"), ("b", "b.md", "B", "the other word", [], [], [], "{}"), ("b", "b.md", "B", "the other word", [], [], [], "{}"), ("c", "c.md", "C", None, ["resource:aquifer"], [], [], "{}")]
    docs = spark.createDataFrame(rows, "id string, path string, title string, body string, tags array<string>, s array<long>, e array<long>, metadata string")
    vectors = spark.createDataFrame([("a:0000", [1.0]), ("gone:0000", [1.0])], "id string, embedding array<double>")
    path = sinks.publish_index(docs, f"{root}/whole", vectors)
    found, manifest = store.current(spark, f"{root}/whole")
    assert found == path and manifest["counts"] == {"documents": 3, "chunks": 2, "passage_refs": 1, "tags": 2, "vectors": 1}
    assert {n: s["n"] for n, s in manifest["fts"].items()} == {"aquifer": 0, "bible": 1, "lexicon": 0, "morphology": 0, "main": 1}
    own = postings.Postings(spark, f"{path}/fts/bible", manifest["fts"]["bible"])
    assert [r["chunk_id"] for r in own.best(["the", "word"], 5).collect()] == ["a:0000"]
