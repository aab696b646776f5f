"""Operators against brute force, hand-made goldens and properties."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions.text import porter
from lectern.operators import align, analyze, fusion, incremental, intervals, ranking
from lectern.sources import files
from lectern.streaming import windows


@pytest.mark.parametrize("size", [10, 1000])
def test_overlap_join_is_brute_force(spark, size):
    rng = random.Random(size)
    a = [(i, s, s + rng.choice([0, 3, 50, 2500])) for i, s in enumerate(rng.randrange(20000) for _ in range(150))]
    b = [(i, s, s + rng.choice([0, 7, 900])) for i, s in enumerate(rng.randrange(20000) for _ in range(150))]
    got = intervals.overlap_join(spark.createDataFrame(a, "a long, s long, e long"), spark.createDataFrame(b, "b long, ts long, te long"), size=size).select("a", "b").collect()
    want = {(x, y) for x, s, e in a for y, ts, te in b if s <= te and ts <= e}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_islands_and_carry(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 5), (1, 6), (2, 6)], "k long, at long")
    assert ranking.islands(df, ["k"], "at", 2).groupBy("k", "island").count().count() == 3


def test_rrf_ignores_the_order_of_branches(spark):
    hits = [(0, "a", 1, 1.0, "x"), (0, "b", 2, 0.5, "x"), (0, "a", 3, 0.1, "y"), (0, "c", 1, 0.9, "y")]
    schema = "query_id long, chunk_id string, rank long, score double, retriever string"
    one = sorted(map(tuple, fusion.rrf(spark.createDataFrame(hits, schema)).select("chunk_id", "score").collect()))
    two = sorted(map(tuple, fusion.rrf(spark.createDataFrame(hits[::-1], schema)).select("chunk_id", "score").collect()))
    assert one == two and one[0] == ("a", round(1 / 61 + 1 / 63, 8))


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("relational", "relat"), ("happy", "happi"), ("electrical", "electr"), ("adjustment", "adjust"), ("controll", "control")])
def test_porter(word, stem):
    assert porter(word) == stem


def test_references():
    assert analyze.parse_references("see GEN 1:3-5 and also 1 SA 2") == [(1001003, 1001005), (9002001, 9002999)]
    assert analyze.parse_references("ROM 3:24-4:2") == [(45003024, 45004002)]
    assert analyze.parse_references("nothing 12") == []


def test_speaker():
    assert analyze.speaker("what did Simon Peter say", ["Peter", "Simon Peter"]) == "Simon Peter"
    assert analyze.speaker("who was Peter", ["Peter"]) is None


def test_lcs():
    assert align.lcs(["a", "", "b", "c"], ["a", "b", "", "c"]) == [(0, 0), (2, 1), (3, 3)]
    assert align.lcs([], ["a"]) == []


def test_single_linkage(spark):
    df = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 2, [0.9, 0.1]), (0, 3, [0.0, 1.0]), (0, 4, [0.0, 0.0])], "k long, i long, v array<double>")
    assert {r["item"]: r["cluster"] for r in align.single_linkage(df, "k", "i", "v", 0.8).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    once = incremental.upsert(old, new, "k")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, incremental.upsert(once, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(ValueError):
        incremental.import_delta(old, new, old, "k")


def test_markdown_source(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("---\ntitle: Sun\ntags: [kind:note, lang:en]\npassages: [[1001005, 1001001]]\nby: me\n---\nbody\n")
    (tmp_path / "y.md").write_text("plain")
    rows = {r["path"]: r for r in files.read_markdown(spark, str(tmp_path)).collect()}
    assert rows["a/x.md"]["tags"] == ["kind:note", "lang:en"] and rows["a/x.md"]["s"] == [1001001] and rows["a/x.md"]["body"] == "body"
    assert rows["y.md"]["title"] == "y" and len(rows["y.md"]["id"]) == 16
    with pytest.raises(ValueError):
        files.reader("exe")


def test_markup_sources(spark):
    assert files.usfm_words(r'\c 3 \w A|strong="H1"\w* \v 1 \w B\w* \c 4 \w C\w*') == [(3, 0, 0, "A", "H1"), (3, 1, 0, "B", None), (4, 0, 0, "C", None)]
    df = spark.createDataFrame([(1, "logos<S>3056</S><m>N</m> kai<m>C</m>")], "v long, t string")
    assert [tuple(r) for r in files.inline_tagged(df, ["v"], "t").orderBy("idx").collect()] == [(1, 1, "logos", "3056", "N"), (1, 2, "kai", None, "C")]


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k long, v string")
    files.write_table(df, str(tmp_path / "t"), "k")
    assert [tuple(r) for r in files.read_table(spark, str(tmp_path / "t"), "k long, v string").orderBy("k").collect()] == [(1, "a"), (2, "b")]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windows.tumbling(windows.zoned(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "1 day"), "1 hour", "event_type")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("hourly").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = windows.tumbling(windows.zoned(events), "1 hour", "event_type")
    assert sorted(map(tuple, spark.table("hourly").collect())) == sorted(map(tuple, batch.collect()))


def test_language_by_script(spark):
    df = spark.createDataFrame([("привет",), ("hello",)], "t string").select(analyze.script_language(F.col("t")).alias("l"))
    assert [r["l"] for r in df.collect()] == ["rus", None]


@pytest.mark.parametrize("block,k", [(8192, 3), (7, 3), (7, 100)])
def test_ranked_neighbours_are_brute_force(spark, monkeypatch, block, k):
    import numpy as np

    from lectern.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(60)] + [(60, None), (61, [1.0, None, 0.0, 0.0]), (62, [1.0, 2.0]), (64, [2.0, 2.0]), (65, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["q"], r["rn"], r["vec_id"], r["sim"]) for r in vectors.ranked_neighbours(df.where("vec_id % 2 = 0"), df, k).collect())
    sound = {i: x for i, x in rows if x and None not in x}
    want = []
    for q in sorted(i for i in sound if i % 2 == 0):
        near = sorted((-sum(a * b for a, b in zip(sound[q], x)), i) for i, x in sound.items() if i != q and len(x) == len(sound[q]))
        want += [(q, n, i, -s) for n, (s, i) in enumerate(near[:k], 1)]
    assert got == want
    assert vectors.ranked_neighbours(df.where("false"), df, k).count() == 0


def test_ancestors_of_a_cycle_and_a_diamond(spark):
    from lectern.operators import graph

    edges = spark.createDataFrame([(a, b, "r") for a, b in ["ab", "bc", "ca", "xy", "xz", "yw", "zw", "xw", "wv"]] + [("v", "u", "s")], "source_id string, target_id string, relation string")
    got = {tuple(r) for r in graph.ancestors(edges, "r").collect()}
    assert {x for x in got if x[0] in "abc"} == {("a", "b", 1), ("a", "c", 2), ("a", "a", 3), ("b", "c", 1), ("b", "a", 2), ("b", "b", 3), ("c", "a", 1), ("c", "b", 2), ("c", "c", 3)}
    assert {x for x in got if x[0] == "x"} == {("x", "y", 1), ("x", "z", 1), ("x", "w", 1), ("x", "v", 2)}
    assert graph.ancestors(edges, "none").count() == 0


def test_bm25_is_brute_force(spark):
    import math

    from lectern.operators import fts

    bags = [("a", ["x", "y", "x"]), ("b", ["y"]), ("c", ["z", "x"]), ("d", []), ("e", None)]
    df = spark.createDataFrame(bags, "chunk_id string, words array<string>")
    full = {u: w for u, w in bags if w}
    mean = sum(map(len, full.values())) / len(full)
    want = {}
    for u, words in full.items():
        for term in {"x", "z"} & set(words):
            tf, n = words.count(term), sum(term in w for w in full.values())
            want[u] = want.get(u, 0) + math.log(1 + (len(full) - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
    for terms in (["x", "z"], spark.createDataFrame([("x",), ("z",)], "term string")):
        assert {r["chunk_id"]: r["score"] for r in fts.bm25(df, terms).collect()} == {u: round(s, 6) for u, s in want.items()}
    assert [r["term"] for r in fts.frequent_terms(df, 2, 1.0).collect()] == ["x", "y"]
    assert fts.bm25(df.where("false"), ["x"]).count() == 0 and fts.frequent_terms(df.where("false")).count() == 0
