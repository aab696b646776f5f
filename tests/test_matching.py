"""Matching, cards, scans, studies and numbering against plain versions and odd rows."""

import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lectern.operators import composites, fusion, graph, matching, ranking, strategies
from lectern.sources import files, scans


def test_blocks_against_a_plain_matcher(spark):
    rng = random.Random(3)
    pairs = [(i, [f"c{rng.randrange(6)}" for _ in range(rng.randrange(0, 25))], [f"c{rng.randrange(6)}" for _ in range(rng.randrange(0, 25))]) for i in range(80)] + [(900, None, ["a"]), (901, [], [])]
    got = matching.block_ops(spark.createDataFrame(pairs, "k long, a array<string>, b array<string>").repartition(3), "k")
    ops = {}
    for r in got.collect():
        ops.setdefault(r["k"], []).append((r["op"], r["left"], r["right"]))
    name = {"equal": "equal", "replace": "replace", "delete": "insert", "insert": "delete"}  # named from the right side
    for k, a, b in pairs:
        a, b = a or [], b or []
        want = [(name[op], a[i1:i2], b[j1:j2]) for op, i1, i2, j1, j2 in SequenceMatcher(None, a, b, autojunk=False).get_opcodes()]
        assert ops.get(k, []) == want, k
    totals, residual, even = matching.reconciled(got, F.lit(0))
    every = [o for v in ops.values() for o in v]
    t = totals.first()
    assert (t["left"], t["right"], t["matched"]) == (sum(len(a or []) for _, a, _ in pairs), sum(len(b) for _, _, b in pairs), sum(len(r) for op, _, r in every if op == "equal"))
    assert {r["code"]: r["n"] for r in residual.collect()} == Counter(c for op, _, r in every if op in ("replace", "delete") for c in r)
    assert {(r["left"], r["right"]): r["n"] for r in even.collect()} == Counter(p for op, x, y in every if op == "replace" and len(x) == len(y) for p in zip(x, y))


def test_fuzzy_names(spark):
    found = spark.createDataFrame([(1, "Béthel (1)", [1]), (2, "Dan", [5, 6, 6]), (3, "Dan", [99]), (4, "Nowhere", [1]), (5, None, [1]), (6, "Gath", None)], "id long, name string, verses array<long>")
    known = spark.createDataFrame([("b", "bethel"), ("d1", "DAN"), ("d2", "Dan!"), ("d3", "dan"), (None, "x"), ("g1", "gath"), ("g2", "Gath")], "id string, name string")
    mentions = spark.createDataFrame([("d2", 5), ("d3", 6), ("d1", 7)], "id string, ref long")
    assert sorted(map(tuple, matching.fuzzy(found, known, mentions).collect())) == [(1, "b", "single"), (2, "d2", "overlap"), (3, None, "new"), (4, None, "new"), (5, None, "new"), (6, None, "new")]


def test_frames(spark):
    frames = spark.createDataFrame([(1, "A0", 10), (1, "A1", 11), (2, "A0", 11), (3, "A0", 10)], "verb_key long, role string, arg_key long")
    words = spark.createDataFrame([(1, "go"), (2, "see"), (3, "go"), (10, "king"), (11, "land")], "key long, lemma string")
    got = matching.frames_with(frames, words, 1, role="a0", argument=F.col("lemma") == "king", verb=F.col("lemma") == "go").collect()
    assert [tuple(r) for r in got] == [(1, "go", ["A0=king", "A1=land"], 2)]
    with pytest.raises(ValueError):
        matching.frames_with(frames, words)


def test_citations(spark):
    row = spark.createDataFrame([("see [a:1] and  [x] then [b] [a:1]", ["c", "b", "z"], ["a:1", "b", "c"])], "t string, l array<string>, v array<string>")
    named, plain = matching.cited(F.col("t"), F.col("l"), F.col("v"))
    assert tuple(row.select(named, plain).first()) == (["a:1", "b", "c"], "see [a:1] and then [b] [a:1]")


def test_clusters(spark):
    text = " ".join(f"w{i}" for i in range(2000))
    at = lambda i: len(" ".join(f"w{k}" for k in range(i))) + (i > 0)
    refs = spark.createDataFrame([(1, at(i)) for i in (0, 50, 150, 300, 1500)] + [(1, at(900) + 1), (2, 0)], "k long, position long")
    texts = spark.createDataFrame([(1, text), (2, "a b c")], "k long, text string")
    got = [tuple(r) for r in matching.clusters(refs, texts, "k").orderBy("k", "start", "center").collect()]
    # a position inside a word counts as the first word
    assert got[-1] == (2, 0, 1, 0, 0, 3 + (200 - 3) // 2 if False else 3)
    assert {(r[2], r[3], r[4], r[5]) for r in got if r[0] == 1} >= {(3, (0 + 50 + 150) // 3, 0, 666)} and sum(r[2] for r in got) == 7


def test_gloss_cleaning(spark):
    rows = ["[he].went.out", "to go: went", "spirit/breath: spirit", "(of men) God-", "-", "NAME", "", None]
    df = spark.createDataFrame([(r,) for r in rows], "g string")
    got = [tuple(r) for r in df.select(matching.without_markup(F.col("g")), matching.headword_sense(F.col("g")), matching.real_gloss(F.col("g"))).collect()]
    assert [g[0] for g in got[:1]] == ["went out"] and [g[1] for g in got[1:4]] == ["go", "spirit", "God"]
    assert [g[2] for g in got[4:]] == [None] * 4 and got[1][2] == "to go: went"


def test_numbering_has_no_gaps(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(500)], "i long, v long").repartition(7)
    got = ranking.numbered(df, F.desc("v"), F.col("i")).collect()
    order = sorted(range(500), key=lambda i: (-(i % 3), i))
    assert {r["i"]: r["place"] for r in got} == {i: p for p, i in enumerate(order)}
    assert ranking.numbered(df.where("false"), F.col("i")).count() == 0
    names = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "b"), (5, "a")], "k long, s string")
    assert sorted(map(tuple, ranking.suffixed(names, "s", "k", "id").select("k", "id").collect())) == [(1, "a"), (2, "b"), (3, "a-1"), (4, "b-2"), (5, "a-3")]


def test_branches(spark):
    fused = spark.createDataFrame([("l1", 0.9), ("l2", 0.8), ("l3", 0.7), ("t1", 0.5), ("x1", 0.4)], "chunk_id string, score double")
    kinds = spark.createDataFrame([("l1", "lexicon"), ("l2", "lexicon"), ("l3", "lexicon"), ("t1", "term")], "chunk_id string, kind string")
    anchored = spark.createDataFrame([("t0", 2), ("t1", 9), ("t9", 3)], "chunk_id string, m long")
    sims = spark.createDataFrame([("l3", 0.9), ("l2", 0.1), ("t1", 0.1)], "chunk_id string, sim double")
    rows = fusion.branched(fused, kinds, ("verses",), anchored, sims, per_branch=2).orderBy("number", "place").collect()
    assert [(r["branch"], r["place"], r["chunk_id"], r["total"]) for r in rows] == [("lexicon", 1, "l3", 3), ("lexicon", 2, "l2", 3), ("terms", 1, "t9", 3), ("terms", 2, "t0", 3), ("verses", 0, None, 0), ("other", 1, "x1", 1)]
    plain = fusion.branched(fused, kinds).orderBy("number", "place").collect()
    assert [r["chunk_id"] for r in plain] == ["l1", "l2", "l3", "t1", "x1"]


ASKED = "k long, intent string, passages array<struct<s:long,e:long>>, keywords array<string>, tags array<string>, words array<string>, codes array<string>, related struct<name:string,relation:string>, topic string, xref_source long, speaker string"


def asked(spark, *rows):
    base = {"intent": "thematic", "passages": [], "keywords": [], "tags": [], "words": [], "codes": [], "related": None, "topic": None, "xref_source": None, "speaker": None}
    names = [c.split()[0] for c in ASKED.replace("struct<s:long,e:long>", "x").replace("struct<name:string,relation:string>", "x").split(", ")]
    return spark.createDataFrame([tuple({"k": i, **base, **r}[n] for n in names) for i, r in enumerate(rows)], ASKED)


def test_cards(spark):
    q = asked(
        spark, {"intent": "speaker", "speaker": "God"}, {"intent": "genealogy", "related": ("david", "father-of-rev")}, {"intent": "entity_lookup", "tags": ["term:boa"]}, {"intent": "passage_specific", "passages": [(1001001, 1001001)]},
        {"intent": "xref", "passages": [(1001001, 1001001)]}, {"intent": "thematic", "keywords": ["love", "zzz"]}, {"intent": "word_study", "codes": ["G0026"]}, {"intent": "methodology", "keywords": ["love"]}, {"intent": "speaker", "speaker": "Nobody"}, {"intent": "passage_book", "passages": [(1001001, 1001999)]},
    )
    speakers = spark.createDataFrame([("God", 1001001, 1001003, True), ("God", 1001001, 1001003, True), ("Eve", 1003002, 1003002, False)], "speaker string, s long, e long, divine boolean")
    got = {r["k"]: r for r in strategies.speaker(q, "k", speakers).collect()}
    assert set(got) == {0} and got[0]["headline"] == "SPEAKER — God | red-letter / divine speech | 1 quoted passages — answer from their actual words" and got[0]["synthesis"] is None
    entities = spark.createDataFrame([("p:1", "person", "David", '{"description":"King of [Israel](x). Second."}'), ("p:2", "person", "Jesse", "{}"), ("p:3", "person", "Boaz", '{"description":"Kinsman"}'), ("p:4", "place", "Boaz", "{}")], "id string, type string, name string, metadata string")
    edges = spark.createDataFrame([("p:2", "p:1", "father-of")], "source_id string, target_id string, relation string")
    got = {r["k"]: r for r in strategies.entity(q, "k", entities, edges).collect()}
    assert got[1]["synthesis"] == got[1]["headline"] == "ENTITY — father of David → Jesse" and got[2]["headline"] == "ENTITY — Boaz (person): Kinsman" and got[2]["synthesis"] is None
    words = spark.createDataFrame([(1001001, 0, "bereshit", "beginning", 2.0, "hbo"), (1001001, 1, "et", "", 9.0, "hbo"), (1001001, 2, "bara", "create", 3.0, "hbo"), (1001001, 3, "ha", "the", 0.0, "hbo")], "ref long, idx long, word string, gloss string, keyness double, language string")
    got = {r["k"]: r for r in strategies.passage(q, "k", words, speakers).collect()}
    assert got[3]["headline"] == "PASSAGE GEN 1:1 (hbo) [God, red-letter] — bara=create · bereshit=beginning" and got[3]["drill"] == "/verse/GEN/1/1" and "(opening)" in got[9]["headline"]
    xref = spark.createDataFrame([(1001001, 43001001, 43001003, None), (1001001, 58011003, 58011003, 1), (2, 3, 4, 1)], "source long, ts long, te long, rank long")
    got = {r["k"]: r for r in strategies.cross_references(q, "k", xref).collect()}
    assert set(got) == {4} and got[4]["headline"] == "CROSS-REFS GEN 1:1 → HEB 11:3, JHN 1:1-3"
    index = spark.createDataFrame([("love", "G0026"), ("love", "G0025")], "word string, code string")
    studies = spark.createDataFrame([("G0026", "love", ["charity"], ["H0157"], 3.456, "Attitudes", ["G0025"]), ("G0025", "to love", [], [], 1.0, "", [])], "code string, gloss string, senses array<string>, equivalents array<string>, keyness double, domain string, siblings array<string>")
    got = {r["k"]: r for r in strategies.concept(q, "k", index, studies).collect()}
    line = "CONCEPT — G0026 = love | sense: charity | equiv: H0157 | keyness 3.46 | domain: Attitudes"
    assert got[5]["headline"] == got[5]["synthesis"] == line and got[5]["confidence"] == 0.7 and got[6]["synthesis"] is None and got[6]["confidence"] == 1.0 and 7 not in got
    both = strategies.speaker(q, "k", speakers).unionByName(strategies.concept(q, "k", index, studies))
    assert {(r["k"], r["place"], r["featured"]) for r in strategies.ranked(both, "k").collect()} >= {(0, 1, True), (5, 1, True), (6, 1, True)}


def test_scans_of_odd_rows(spark):
    people = spark.createDataFrame([("b", "Ben", "a", None, "c, ", "a,c", "GEN.1.1, BAD, XXX.1.1"), (" ", "x", None, None, None, None, None), ("a", " ", None, "m", None, "b", None)], "id string, name string, father string, mother string, partners string, siblings string, verses string")
    places = spark.createDataFrame([("p", "Place", None)], "id string, name string, verses string")
    events = spark.createDataFrame([("e", None, "a,b", "p", "EXO.2.3")], "id string, title string, participants string, locations string, verses string")
    vertices, edges, mentions = scans.graph(people, places, events)
    assert sorted(map(tuple, vertices.collect())) == [("event:e", "event", "e"), ("person:a", "person", "a"), ("person:b", "person", "Ben"), ("place:p", "place", "Place")]
    assert sorted(map(tuple, edges.collect())) == sorted([("person:a", "person:b", "father-of"), ("person:m", "person:a", "mother-of"), ("person:b", "person:c", "partner-of"), ("person:b", "person:c", "sibling-of"), ("person:a", "person:b", "sibling-of"), ("person:a", "event:e", "participates-in"), ("person:b", "event:e", "participates-in"), ("event:e", "place:p", "occurred-at")])
    assert sorted(map(tuple, mentions.collect())) == [("event:e", 2002003), ("person:b", 1001001)]
    entries = spark.createDataFrame([("g26a", "x", None, None, None), ("G26", "agape", "Agápē, pl", "love", "<b>love</b><br>  a &lt; b<script>"), ("H1", " ", None, None, None)], "code string, headword string, translit string, short string, html string")
    got = scans.lexicon_documents(entries, "lsj").collect()
    assert [(r["code"], r["body"]) for r in got] == [("G0026", "love\n\n**love**\na < b")] and "lemma:agap" in " ".join(got[0]["tags"])
    words = spark.createDataFrame([(1001001, 1, "b", "", [], None, None), (1001001, 0, "a", "Á b", ["H1", None], "N", "g"), (40001001, 0, None, None, ["G1", "G2"], "V", "")], "ref long, idx long, original string, translit string, strongs array<string>, morph string, gloss string")
    docs = {r["ref"]: r for r in scans.morphology_documents(words).collect()}
    assert docs[1001001]["body"] == '1. **a** *Á b* [H1 / N] = "g"\n2. **b**' and docs[40001001]["body"] == "1. — [G1, G2 / V]"
    assert docs[40001001]["tags"] == ["book:MAT", "kind:morphology", "lang:grc", "morph:V", "strongs:G1", "strongs:G2"] and "lemma:a-b" in docs[1001001]["tags"]
    links = spark.createDataFrame([("bible/kt/love", 1001001, 1001001), ("bible/kt/love", 1001001, 1001001), ("bible/kt/gone", 1, 2), (None, 1, 2), ("bible/kt/love", None, 2)], "path string, s long, e long")
    articles = spark.createDataFrame([("bible/kt/love", " text "), ("bible/kt/gone", None), ("bible/kt/none", "x")], "path string, text string")
    rows = scans.inherited(articles, links, spark.createDataFrame([("Love", "G0026")], "term string, code string")).collect()
    assert [(r["title"], r["body"], len(r["passages"]), "strongs:G0026" in r["tags"], "book:GEN" in r["tags"]) for r in rows] == [("TW — Love (kt)", "text", 1, True, True)]


def test_words_of_usfm_as_the_plain_reader(spark):
    text = '\\id X\n\\w lost|strong="H9"\\w*\n\\c 1\n\\s \\w title|x="1"\\w*\n\\v 1 \\w In|strong="H1"\\w* \\w a \\w*\n\\v 2-3 \\w b|x-morph="N" strong="H2"\\w*\\c 2 \\w top|\\w* \\v 9 \\w z\\w*'
    got = [tuple(x) for x in spark.createDataFrame([(text,)], "t string").select(files.usfm_word_rows(F.col("t")).alias("w")).first()["w"]]
    assert got == files.usfm_words(text)


def test_studies_of_stores(spark):
    stores = spark.createDataFrame([("spine", 1, 1, 1, i, f"s{i}", "H1" if i < 5 else "H2", "l", "V") for i in range(8)], "corpus string, book long, chapter long, verse long, idx long, surface string, strong string, lemma string, morph string")
    senses = spark.createDataFrame([("spine", 1, 1, 1, "H1", 2)], "corpus string, book long, chapter long, verse long, code string, sense long")
    rows = composites.concordance(stores, senses, 3).orderBy("code", "place").collect()
    assert [(r["code"], r["place"], r["n"], r["truncated"], r["sense"]) for r in rows] == [("H1", 1, 5, True, 2), ("H1", 2, 5, True, 2), ("H1", 3, 5, True, 2), ("H2", 1, 3, False, None), ("H2", 2, 3, False, None), ("H2", 3, 3, False, None)]
    domains = spark.createDataFrame([("H1", "a", 0.6), ("H1", "b", 0.4), ("H2", "c", 0.4)], "code string, domain string, share double")
    assert [tuple(r) for r in composites.dominant_domains(domains).collect()] == [("H1", "a")]
    lex = spark.createDataFrame([("H1", "x"), ("H1", "y"), ("H2", "z")], "code string, lex string")
    inv = spark.createDataFrame([("x", "qal", "go", 3), ("x", "qal", "walk", 1), ("y", "nif", "be", 2)], "lex string, stem string, gloss string, n long")
    assert {r["code"]: (r["lexemes"], r["senses"]) for r in composites.homographs(lex, inv).collect()} == {"H1": (["x", "y"], ["x.qal: go (0.75)", "x.qal: walk (0.25)", "y.nif: be (1.0)"]), "H2": (["z"], [])}


def test_homographs_send_texts_only(spark):
    lex = spark.createDataFrame([("H1", "x"), ("H2", "x")], "code string, lex string")
    inv = spark.createDataFrame([("x", "qal", "walk", 1), ("x", "qal", "go", 3), ("x", "nif", "be", 2)], "lex string, stem string, gloss string, n long")
    got = composites.homographs(lex, inv)
    assert {tuple(r["senses"]) for r in got.collect()} == {("x.nif: be (1.0)", "x.qal: go (0.75)", "x.qal: walk (0.25)")}
    listed = got._jdf.queryExecution().optimizedPlan().children().head().schema().simpleString()
    assert "told:array<string>" in listed  # what a code's row collects


def test_resolving_by_tiers(spark):
    e = spark.createDataFrame([("1", "t", "Dan"), ("2", "t", "Daniel"), ("3", "t", "Gath")], "id string, type string, name string")
    bridge = spark.createDataFrame([("Гат", "gath")], "alias string, name string")
    one = lambda n: [(r["id"], r["tier"]) for r in graph.resolve_named(e, n, bridge).orderBy("id").collect()]
    assert one("dan") == [("1", 0)] and one("dani") == [("2", 1)] and one("гат") == [("3", 2)] and one("none") == []


def test_speaker_ranges_parse_equal_rows_once(spark):
    from lectern.operators import tidying

    row = ("GEN.1.3", "GEN.1.1", "God", "", "", "")
    df = spark.createDataFrame([row] * 5 + [("BAD", *row[1:])] * 3, "start string, end string, speaker string, alt string, kind string, delivery string")
    made = df.withColumn("start", F.concat_ws(".", F.substring("start", 1, 3), F.substring("start", 5, 3)))
    named, skipped = tidying.speaker_ranges(made, spark.createDataFrame([("God", True)], "name string, divine boolean"))
    assert [tuple(r) for r in named.collect()] == [("God", "", 1001001, 1001003, "", "", "Y")] and skipped.first()["skipped"] == 3
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat_ws(") == 1  # the text is made once, not once for each use of its keys


def test_tidying(spark):
    from lectern.operators import tidying

    rows = [("GEN.1.3", "GEN.1.1", " God ", None, "Q", None), ("Gen.1.1", "Gen.1.3", "God", "", "Q", ""), ("BAD", "GEN.1.1", "x", None, None, None), ("GEN.1.1", "GEN.1.1", " ", None, None, None), (None, None, None, None, None, None)]
    named, skipped = tidying.speaker_ranges(spark.createDataFrame(rows, "start string, end string, speaker string, alt string, kind string, delivery string"), spark.createDataFrame([("God", False), ("God", True)], "name string, divine boolean"))
    assert [tuple(r) for r in named.collect()] == [("God", "", 1001001, 1001003, "Q", "", "Y")] and skipped.first()["skipped"] == 3
    docs = spark.createDataFrame([("s", "Talks — A b (one)"), ("s", "Talks — A b (two)"), ("s", "A-b"), ("s", "Other — (x)")], "series string, title string")
    assert sorted((r["slug"], r["n"]) for r in tidying.series(docs, "Talks").collect()) == [("a-b", 3), ("other", 1)]
    topics = spark.createDataFrame([(1, "Faith", 5), (1, "Faith", 4), (2, "Faithful", 1), (3, "faith", 9)], "topic_id long, name string, s long")
    asked = spark.createDataFrame([("a", "FAITH"), ("b", "fait"), ("c", "none")], "q string, name string")
    assert {r["q"]: r["refs"] for r in tidying.topic_verses(topics, asked).collect()} == {"a": [4, 5, 9], "b": [1, 4, 5, 9]}
    res = spark.createDataFrame([("q", 2, "s"), ("q", 1, "n"), ("q", 3, None), ("p", 1, "s")], "q string, rank long, code string")
    sub, bad = spark.createDataFrame([("q", "s"), ("p", "s")], "q string, code string"), spark.createDataFrame([("q", "n")], "q string, code string")
    assert sorted(map(tuple, tidying.denoised(res, sub, bad).collect())) == [("p", 0, True, True), ("q", 1, False, True)]
    f = spark.createDataFrame([("H9003/{H7225G}=N-x=y",), ("{G26}",), (None,)], "f string")
    assert [(r[0], r[1]) for r in f.select(tidying.codes_in(F.col("f")), tidying.morphology_in(F.col("f"))).collect()] == [(["H7225G", "H9003"], "N-x=y"), (["G0026"], "{G26}"), ([], "")]
    n = spark.createDataFrame([("К Римлянам",), ("1-е Коринфянам",), ("Бытие",)], "n string")
    assert [r[0] for r in n.select(tidying.bare_forms(F.col("n"), ("К", "Ко"))).collect()] == [["Римлянам"], ["1 Коринфянам"], []]
    cut = tidying.strategies(spark.createDataFrame([(1, "a b\n\nc"), (2, None), (3, "")], "doc_id long, text string"), 2, 1)
    assert {"line:1:00000", "line:1:00002", "document:1:00000", "window:1:00001"} <= {r["id"] for r in cut.collect()}
