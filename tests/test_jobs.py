"""Stateful jobs and readers against plain versions of themselves."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import align, checks, coreference, graph, linkage, senses
from lectern.sources import aligned, editions, places, sinks, store, transcripts
from lectern.streaming import lookups, refresh


def root_of(spark, name):
    return f"{store.shared_root(spark)}/job-tests/{name}"


@pytest.mark.parametrize("edges", [[], [("a", "b")], [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(40)], [("hub", f"s{i}") for i in range(50)] + [("x", "y"), ("y", "x"), ("z", "z")]])
def test_components(spark, edges):
    parent = {n: n for e in edges for n in e if e[0] != e[1]}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {n: find(n) for n in parent}


@pytest.mark.parametrize("block", [1024, 7])
def test_linkage_in_blocks(spark, block):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(9, 6))
    x = [(f"k{i % 2}", f"i{i:03d}", [float(v) for v in centres[i % 9] + rng.normal(size=6) * 0.15]) for i in range(120)]
    x += [("k0", "zero", [0.0] * 6), ("k0", "null", None), ("k0", "hole", [None] * 6), ("k0", "short", [1.0, 2.0])]
    label = {i: i for _, i, _ in x}
    vec = {i: (k, np.array(v) / np.linalg.norm(v)) for k, i, v in x if i.startswith("i")}
    for a in vec:
        for b in vec:
            if a < b and vec[a][0] == vec[b][0] and vec[a][1] @ vec[b][1] >= 0.9:
                p, q = sorted((label[a], label[b]))
                label = {i: p if c == q else c for i, c in label.items()}
    got = {r["id"]: r["cluster"] for r in linkage.linked(spark.createDataFrame(x, "key string, id string, vector array<double>"), 0.9, block).collect()}
    assert got == label


def test_single_linkage_orders_numbers(spark):
    df = spark.createDataFrame([("a", 10, [1.0, 0.0]), ("a", 9, [1.0, 0.01]), ("b", 9, [0.0, 1.0])], "k string, i long, v array<double>")
    assert sorted(map(tuple, align.single_linkage(df, "k", "i", "v", 0.9).collect())) == [("a", 9, 9), ("a", 10, 9), ("b", 9, 9)]


def test_linkage_equals_its_sql_on_odd_rows(spark, tmp_path):
    """Ids that repeat over labels are one item, and a vector without a cosine is linked with all of its label."""
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    far = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    rows = [(i, far[i % 3], i // 3) for i in range(12)] + [(20, far[0], 0), (0, far[1], 1), (21, [0.0] * 3, 2), (22, [float("nan"), 0.0, 1.0], 3), (23, None, 3), (24, far[0], None), (None, far[0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(str, map(tuple, queries()["seq_03_linkage"](spark, str(tmp_path)).collect())))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        assert got == sorted(map(str, c.execute(oracle_sql()["seq_03_linkage"]).fetchall()))


def test_senses_by_context(spark):
    rows = [("l", "q", "Walk", [1.0, 0.0]), ("l", "q", "walk", [1.0, 0.1]), ("l", "q", "go.out", [1.0, 0.05]), ("l", "q", "eat", [0.0, 1.0]), ("l", "p", "eat", [0.0, 1.0]), ("l", "p", " ", [1.0, 0.0]), ("l", "p", "x", None), (None, None, "n", [1.0, 1.0])]
    occ = spark.createDataFrame(rows, "lex string, stem string, gloss string, vector array<double>")
    curated = spark.createDataFrame([("l", "p", "devour")], "lex string, stem string, label string")
    got = sorted((r["lex"] or "", r["stem"] or "", r["sense"], r["gloss"], r["n"], r["share"]) for r in senses.by_context(occ, curated).collect())
    assert got == [("", "", 1, "n", 1, 1.0), ("l", "p", 1, "devour", 1, 1.0), ("l", "q", 1, "Walk", 3, 0.75), ("l", "q", 2, "eat", 1, 0.25)]


SCHEMA = "doc_id long, text string"


def states(own):
    docs = sorted((r["doc_id"], r["digest"]) for r in own.documents().collect())
    chunks = sorted((r["doc_id"], r["chunk_index"], r["body"]) for r in own.chunks().collect())
    return docs, chunks, sorted(r["digest"] for r in own.vectors().collect())


def test_refresh_of_growing_copies(spark):
    base = [(i, f"line {i % 7}\n\nmore {i}") for i in range(40)] + [(100, None), (101, ""), (None, "lost")]
    later = [(3, "line 3 changed"), (200, "line 1"), (4, base[4][1])]
    landing, whole = root_of(spark, "landing"), root_of(spark, "whole")

    def encode(texts):
        return [[float(len(t))] for t in texts]

    own = refresh.Refresh(spark, root_of(spark, "grow"), encode, "length")
    spark.createDataFrame(base, SCHEMA).coalesce(1).write.mode("append").parquet(landing)
    assert own.run(landing, spark.createDataFrame([], SCHEMA).schema) == 1
    first = states(own)
    assert own.run(landing, spark.createDataFrame([], SCHEMA).schema) == 0 and states(own) == first
    spark.createDataFrame(later, SCHEMA).coalesce(1).write.mode("append").parquet(landing)
    own.run(landing, spark.createDataFrame([], SCHEMA).schema)
    grown = states(own)
    own.batch(spark.createDataFrame(later, SCHEMA), 1)  # the same batch once more
    assert states(own) == grown
    final = {i: t for i, t in base if i is not None} | dict(later)
    spark.createDataFrame(list(final.items()), SCHEMA).write.parquet(whole)
    once = refresh.Refresh(spark, root_of(spark, "once"), encode, "length")
    once.run(whole, spark.createDataFrame([], SCHEMA).schema)
    docs, chunks, vectors = states(once)
    assert (docs, chunks) == grown[:2]
    assert len(vectors) == len(set(vectors)) and len(grown[2]) == len(set(grown[2])) and set(vectors) <= set(grown[2])
    with pytest.raises(ValueError):
        refresh.Refresh(spark, root_of(spark, "grow"), encode, "other").run(landing, spark.createDataFrame([], SCHEMA).schema)


@pytest.mark.parametrize("period", [None, 60])
def test_cached_lookups(spark, period):
    rng = random.Random(2)
    rows = [(f"k{rng.randrange(5)}", 1_700_000_000 + rng.randrange(300), i, rng.random() < 0.4, float(i)) for i in range(200)] + [(None, 1, 900, True, 1.0), ("k1", None, 901, True, 1.0)]
    df = spark.createDataFrame(rows, "key string, s long, id long, ok boolean, value double").withColumn("ts", F.timestamp_seconds("s"))
    want, held = {}, {}
    for key, s, i, ok, value in sorted((r for r in rows if r[0] and r[1]), key=lambda r: (r[1], r[2])):
        slot = (key, s // period if period else 0)
        if slot in held:
            want[i] = ("cache", held[slot])
        elif ok:
            held[slot] = value
            want[i] = ("fetched", value)
        else:
            want[i] = ("failed", None)
    assert {r["id"]: (r["source"], r["value"]) for r in lookups.cached(df, period).collect()} == want


def test_editions_read_alike(spark):
    md = spark.createDataFrame([("a", "---\npassages:\n  - [1001001, 1001001]\n---\n1 In the beginning --- so"), ("b", "no front matter"), ("c", None), ("d", "---\npassages:\n  - [40001001,40001001]\n---\n\n")], "path string, raw string")
    usfm = spark.createDataFrame([("a", "\\id GEN x\n\\c 1\n\\s Title\n\\p\n\\v 1 \\zaln-s |x=\"1\"\\*\\w In|strong=\"H1\"\\w*\\zaln-e\\* the\n\\q beginning\\f + \\ft a \\w note\\w*\\f*.\n\\v 2 \\v 3 third\n\\c 2\n\\v 1 second"), ("b", "\\id XXX\n\\c 1\n\\v 1 lost"), ("c", "")], "path string, raw string")
    usfx = spark.createDataFrame([("a", '<usfx><book id="GEN"><h>t</h><c id="1"/><p><v id="1" bcv="q"/>In the <wj>beginning</wj>.<f caller="+">note</f><ve/></p><v id="2-3"/>A &amp; B<ve/><c id="2"/><v id="1"/>second</book><book id="QQQ"><c id="1"/><v id="1"/>x</book></usfx>')], "path string, raw string")
    got = lambda f, d, **k: sorted((r["ref"], r["text"]) for r in f(d, **k).collect())
    assert got(editions.markdown_verses, md) == [(1001001, "In the beginning --- so")]
    assert got(editions.usfm_verses, usfm) == [(1001001, "In the beginning."), (1001003, "third"), (1002001, "second")]
    assert got(editions.usfx_verses, usfx) == [(1001001, "In the beginning ."), (1001002, "A & B"), (1002001, "second")]
    assert got(editions.usfm_verses, usfm, books=(40, 66)) == []


def test_edition_from_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "gen.usfm").write_text("\\id GEN\n\\c 1\n\\v 1 eins")
    (tmp_path / "zgen.usfm").write_text("\\id GEN\n\\c 1\n\\v 1 zwei\n\\v 2 drei")
    (tmp_path / "x.txt").write_text("\\id EXO\n\\c 1\n\\v 1 no")
    rows = editions.read_edition(spark, str(tmp_path), "usfm", "E").orderBy("ref").collect()
    assert [tuple(r) for r in rows] == [("E", 1001001, "eins"), ("E", 1001002, "drei")]


def test_places(spark):
    entries = [
        {"id": "1", "friendly_id": " Dan ", "types": ["city"], "verses": [{"osis": "Gen.1.1"}, {"osis": 5}, "x", {"osis": "1Kgs.2.3"}], "identifications": ["odd", {"resolutions": [{"lonlat": None}, {"lonlat": "1,x"}]}, {"resolutions": [{"lonlat": "35.5, 33.2"}]}], "linked_data": {"s7cc8b2": {"id": "Q1"}}, "modern_associations": {"m2": {"name": "b"}, "m1": {"name": "a", "score": 3}}, "translation_name_counts": {"Dan": 2}},
        {"friendly_id": "Bare"}, {"friendly_id": "  "}, {"id": 7}, {"friendly_id": "Odd", "identifications": {"a": 1}, "linked_data": {"s7cc8b2": {"id": 4}}, "types": "city"},
    ]
    lines = spark.createDataFrame([(json.dumps(e),) for e in entries] + [("{",), ("",), (None,), ("nonsense",)], "value string")
    got = {r["name"]: r for r in places.places(lines).collect()}
    assert set(got) == {"Dan", "Bare", "Odd"}
    dan = got["Dan"]
    assert (dan["id"], dan["types"], dan["verses"], dan["lon"], dan["lat"], dan["wikidata"]) == ("1", ["city"], [1001001, 11002003], 35.5, 33.2, "Q1")
    assert [tuple(m) for m in dan["modern"]] == [("m1", "a", 3.0, None), ("m2", "b", None, None)] and [tuple(v) for v in dan["variants"]] == [("Dan", 2)]
    assert got["Odd"]["lon"] is None and got["Odd"]["wikidata"] is None
    assert tuple(places.malformed(lines).first()) == (7, 2, 2)


def plain_references(text):
    seen, out = set(), []
    for i, pattern in enumerate(transcripts.REFERENCES):
        for m in re.finditer(pattern, text, re.IGNORECASE):
            if m[0] in seen:
                continue
            seen.add(m[0])
            g = m.groups()
            out.append((m.start(), m[0], g[0], int(g[1]), int(g[2]) if len(g) > 2 else None, int(g[3]) if len(g) > 3 else None, text[max(0, m.start() - 50) : m.start() + len(m[0]) + 50].strip()))
    return sorted(out, key=repr)


def test_transcripts_against_a_plain_scanner(spark):
    rng = random.Random(4)
    words = ["Genesis 1:2-3", "genesis 4", "1 Kings 3-5", "Song of  Songs 2:1", "verse 7", "vv. 8-9", "John 3:16", "1 John 2", "and", "12:30-14:05", "1:02:03-1:05:00", "Psalm 23", "ü", "1Corinthians 13:4–7"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 25)))) for i in range(60)] + [(100, None), (101, ""), (102, "Genesis 1:1")]
    df = spark.createDataFrame(texts, "id long, text string")
    want = sorted(((i, *r) for i, t in texts for r in plain_references(t or "")), key=repr)
    assert sorted((tuple(r) for r in transcripts.references(df, ["id"], "text").collect()), key=repr) == want
    clocks = sorted((i, m.start(), m[1], m[2]) for i, t in texts for p in transcripts.TIMES for m in re.finditer(p, t or ""))
    assert sorted(tuple(r)[:4] for r in transcripts.times(df, ["id"], "text").collect()) == clocks
    bare = []
    for i, t in texts:
        last = None
        found = [(m.start(), 0, m) for m in re.finditer(rf"({transcripts.BOOK})\s+(\d+)(?::(\d+))?", t or "", re.I)] + [(m.start(), 1, m) for m in re.finditer(transcripts.BARE, t or "", re.I)]
        for at, kind, m in sorted(found, key=lambda x: x[:2]):
            if kind == 0:
                last = m
            elif last:
                bare.append((i, at, last[1], int(last[2]), int(m[1]), int(m[2]) if m[2] else None))
    assert sorted(map(tuple, transcripts.carried(df, ["id"], "text").collect()), key=repr) == sorted(bare, key=repr)


def test_aligned_reader(spark):
    targets = spark.createDataFrame([("V", "01001001001", "In", False), ("V", "01001001002", "prin", True), ("V", "01001001003", "cipio", None), ("V", "x", "bad", False)], "version string, id string, text string, skip boolean")
    sources = spark.createDataFrame([("S", "n1", "", "e"), ("S", "o2", "H1", "l1"), ("S", "3", "H2", "l2"), ("T", "n3", "G9", "g")], "source_corpus string, id string, strong string, lemma string")
    records = spark.createDataFrame([("S", "V", "manual", 2, ["n3"], ["01001001002"]), ("S", "V", "manual", 1, ["n1", "n2"], ["01001001001", "01001001002"]), ("S", "V", "transfer", 1, ["n3"], ["01001001003"]), ("T", "V", "transfer", 1, ["3"], ["01001001003", "x"]), ("T", "V", "transfer", 2, ["9"], ["01001001003"]), ("T", "V", "transfer", 3, [], ["01001001003"])], "source_corpus string, version string, method string, place long, source array<string>, target array<string>")
    verse = aligned.aligned_verses(records, sources, targets).collect()
    assert [(v["ref"], v["text"], v["strongs"], [tuple(t) for t in v["tokens"]]) for v in verse] == [(1001001, "In principio", ["G9", "H1"], [("In", "H1"), ("prin", "H1"), ("cipio", "G9")])]
    seen = sorted((r["target_id"][-1], r["source_id"], r["method"], r["source_corpus"]) for r in aligned.attestations(records, sources, targets).collect())
    assert seen == [("1", "o2", "manual", "S"), ("2", "3", "manual", "S"), ("2", "o2", "manual", "S"), ("3", "3", "transfer", "S"), ("3", "n3", "transfer", "T")]


def test_checks_and_refusal(spark):
    df = spark.createDataFrame([("H0001", 1), ("H1", 2), ("H0001", None)], "code string, n long")
    rules = [checks.rows(most=3), checks.always("padded", F.col("code").rlike("^H[0-9]{4}$")), checks.never("empty", F.col("n").isNull()), checks.Constraint("most", F.max("n"), 0, 2)]
    got = {r["constraint"]: (r["value"], r["passed"]) for r in checks.measured(df, "t", rules).collect()}
    assert got == {"rows": (3.0, True), "padded": (1.0, False), "empty": (1.0, False), "most": (2.0, True)}
    assert tuple(checks.repeated(df, "t", ["code"]).first())[2:] == (1.0, False)
    empty = {r["constraint"]: r["passed"] for r in checks.measured(df.where("false"), "t", rules).collect()}
    assert empty == {"rows": False, "padded": True, "empty": True, "most": False}
    folder = root_of(spark, "guarded")
    with pytest.raises(checks.Refused):
        checks.published(df, folder, rules)
    assert store.current(spark, folder) is None
    path = checks.published(df.where("code = 'H0001' AND n = 1"), folder, rules)
    assert store.current(spark, folder) == (path, {"rows": 1.0, "padded": 0.0, "empty": 0.0, "most": 1.0}) and spark.read.parquet(f"{path}/table").count() == 1


def test_coreference_chains(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (7, 6), (8, 9), (9, 8), (None, 1), (6, None)] + [(100 + i, 101 + i) for i in range(20)], "node long, refers_to long")
    got = {r["node"]: (r["last"], r["hops"]) for r in coreference.resolved(links, 4).collect()}
    assert got == {5: (3, 2), 4: (3, 1), 7: (6, 1), 116: (120, 4), 117: (120, 3), 118: (120, 2), 119: (120, 1)}
    assert coreference.resolved(links.where("false")).count() == 0


def test_contexts_are_encoded_once(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, " "), (5, None)], "id long, text string")
    new, joined = sinks.embed_contexts(rows, "id", "text", sinks.hashed, "m")
    assert new.count() == 2 and sorted(r["id"] for r in joined.collect()) == [1, 2, 3]
    again, joined = sinks.embed_contexts(rows, "id", "text", sinks.hashed, "m", new, "m")
    assert again.count() == 0 and joined.count() == 3
    with pytest.raises(ValueError):
        sinks.embed_contexts(rows, "id", "text", sinks.hashed, "m", new, "other")


def test_first_hits_take_slices_of_queries(spark, monkeypatch):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from lectern.operators import vectors

    cells = []
    meet = vectors._meet
    monkeypatch.setattr(vectors, "_meet", lambda q, v, cell, *more: cells.append(cell) or meet(q, v, cell, *more))
    r = np.random.default_rng(3)
    few = spark.createDataFrame([(i, r.normal(size=4).tolist(), i % 3) for i in range(40)], "vec_id long, embedding array<double>, label int")
    vectors.first_hits(few, few, "label")
    n, m = 4096, 2048
    table = lambda k, name, at: pa.table({name: pa.array(range(at, at + k), pa.int64()), "qe" if name == "q" else "embedding": pa.array(list(r.normal(size=(k, 4)))), "label": pa.array([i % 3 for i in range(k)], pa.int64())})
    left, right = table(n, "q", 0), table(m, "vec_id", n)
    left = left.append_column("mark", pa.array([0.5] * n)).append_column("at", pa.array([n] * n, pa.int64()))
    sims = np.round(vectors.matrix_of(left, "qe") @ vectors.matrix_of(right, "embedding").T, 6)
    for cell in cells:
        tracemalloc.start()
        got = cell(left, right)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got.column("q").to_pylist() == list(range(n)) and peak < n * m * 8  # all products at once are as much alone
    ahead = (sims > 0.5) | (sims == 0.5) & (np.arange(n, n + m) < n)
    assert len(cells) == 2 and got.column("n").to_pylist() == ahead.sum(1).tolist()


def test_markdown_is_parsed_few_texts_at_a_time():
    import pyarrow as pa

    from lectern.sources import files

    class Raw:  # a table that hands back what would run in its tasks
        def select(self, *columns):
            return self

        def mapInPandas(self, run, schema):
            return lambda batch: run(iter([batch.to_pandas()]))

        def mapInArrow(self, run, schema):
            return lambda batch: run(iter([batch]))

    n = 1000
    made = [b if isinstance(b, pa.RecordBatch) else pa.RecordBatch.from_pandas(b) for b in files.markdown_documents(Raw())(pa.record_batch({"path": [f"a/{i}.md" for i in range(n)], "raw": [None if i == 5 else f"---\ntags: t{i}\n---\nx {i}" for i in range(n)]}))]
    rows = [r for b in made for r in b.to_pylist()]
    assert max(b.num_rows for b in made) <= 256 and [r["body"] for r in rows] == [None if i == 5 else f"x {i}" for i in range(n)]
    assert rows[7]["tags"] == ["t7"] and rows[5]["tags"] == [] and rows[7]["s"] == []


def test_sense_merge_keeps_senses_without_a_lexeme(spark):
    from lectern.operators import senses

    s = spark.createDataFrame([(1, 1, 2, "a"), (1, 2, 5, "b"), (None, 3, 1, "c"), (None, 4, 1, "d")], "lex long, sense long, n long, label string")
    v = spark.createDataFrame([(i, [1.0, 0.1]) for i in range(1, 5)], "sense long, embedding array<double>")
    assert sorted(senses.merge_by_vector(s, v).collect(), key=lambda r: r["merged"]) == [(1, 1, 7, "b"), (None, 3, 1, "c"), (None, 4, 1, "d")]


@pytest.mark.parametrize("name", ["seq_03_linkage", "seq_04_sense_merge"])
def test_linkage_of_odd_vectors_and_ids_equals_its_sql(spark, tmp_path, name):
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(7, 8))
    rows = [(i, [float(x) for x in centres[i * 5 % 7] + rng.normal(size=8) * 0.1], i % 4) for i in range(60)]
    rows += [(70, [0.0] * 8, 1), (71, [float("inf")] + [1.0] * 7, 2), (72, None, 2), (5, rows[6][1], 3), rows[9], (None, rows[0][1], 0), (73, rows[0][1], None), (-5, rows[0][1], 0), (-50, rows[1][1], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(str, map(tuple, queries()[name](spark, str(tmp_path)).collect())))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        assert got == sorted(map(str, c.execute(oracle_sql()[name]).fetchall()))
