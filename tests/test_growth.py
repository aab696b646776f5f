"""Queries whose work or rows went wrong only on larger or odd tables."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import align, composites, fts, lists, matching, postings, retrieve, strategies, vectors
from lectern.plans.catalog import ORACLE, QUERIES
from lectern.sources import editions, sinks, store
from lectern.streaming import lookups


def stages(spark):
    """The stages of the session so far."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    known = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return [known.apply(i) for i in range(known.size())]


def shuffled(spark, run):
    """(result, rows written to shuffles) of a run."""
    last = max((s.stageId() for s in stages(spark)), default=-1)
    out = run()
    return out, sum(s.shuffleWriteRecords() for s in stages(spark) if s.stageId() > last)


def against_sql(spark, name, folder, **tables):
    """Rows of a query and of its SQL over tables written into a folder."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    r = con.execute(ORACLE[name])
    columns = [d[0] for d in r.description]
    return sorted(map(tuple, df.select(*columns).collect()), key=repr), sorted(r.fetchall(), key=repr)


def test_relatives_of_an_entity_are_found_once_for_all_questions(spark):
    n = 400
    related = F.struct(F.lit("rome").alias("name"), F.lit("located-in-rev").alias("relation"))
    asked = spark.range(n).select(F.col("id").alias("k"), F.lit("genealogy").alias("intent"), related.alias("related"), F.array().cast("array<string>").alias("tags"))
    people = spark.range(n).select(F.concat(F.lit("p:"), "id").alias("id"), F.lit("person").alias("type"), F.format_string("p%04d", "id").alias("name"), F.lit("{}").alias("metadata"))
    entities = people.unionByName(spark.createDataFrame([("c:1", "city", "Rome", "{}")], people.schema))
    edges = people.select(F.col("id").alias("source_id"), F.lit("c:1").alias("target_id"), F.lit("located-in").alias("relation"))
    rows, moved = shuffled(spark, strategies.entity(asked, "k", entities, edges).collect)
    assert len(rows) == n and {r["headline"] for r in rows} == {"ENTITY — located-in of Rome → " + ", ".join(f"p{i:04d}" for i in range(8))}
    assert moved < 20 * n


def test_places_of_one_name_and_verses_meet_their_entities_once(spark):
    n = 400
    found = spark.range(n).select("id", F.lit("Dan").alias("name"), F.array(F.col("id") % 3, F.col("id") % 3 + 1).alias("verses"))
    known = spark.range(n).select("id", F.lit("DAN").alias("name"))
    mentions = known.select("id", (F.col("id") % 5).alias("ref"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, moved = shuffled(spark, matching.fuzzy(found, known, mentions).collect)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert {(r["id"], r["entity"], r["how"]) for r in rows} == {(i, i % 3, "overlap") for i in range(n)}
    assert moved < 10 * n


def texts(spark, *lines):
    return spark.createDataFrame([(8 * i + k, t, "en", "s", len(t)) for i, t in enumerate(lines) for k in (2, 3)], "doc_id long, text string, lang string, source string, n_chars long")


ODD = ("ßa b", "ŉb c", "ﬁne day", "ǰc", "ᾳ", "ᾼ", "été", "abc", "Zed", "1st", "", "\u00a0nbsp first", "İx")


@pytest.mark.parametrize("name", ["agg_02_letters", "flt_15_other_letters"])
def test_first_letters_of_any_script_are_one_character(name, spark, tmp_path):
    got, want = against_sql(spark, name, tmp_path, documents=texts(spark, *ODD))
    assert got == want


def test_tree_letters_of_any_script_are_one_character(spark, tmp_path, sf_dir):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    others = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(20) for t in ("region", "nation", "customer", "supplier", "part", "conversations")}
    got, want = against_sql(spark, "api_06_overview", tmp_path, documents=texts(spark, *ODD), labels=labels, **others)
    assert got == want


def talk(spark):
    """Conversations whose verses beyond 999, and whose turns of more than 240 words, meet others in one reference and node."""
    long = " ".join(f"{a}{b}{c}x" for a in "abcdefg" for b in "abcdefg" for c in "abcdefg")
    other = " ".join(f"{a}{b}{c}yy" for a in "nopqrst" for b in "nopqrst" for c in "nopqrst")
    return spark.createDataFrame([(66 * 50, 0, "user", long), (0, 1, "user", other), (66, 1, "user", long), (132, 1, "user", other)], "conv_id long, turn int, role string, text string")


def test_words_of_one_reference_whatever_their_chapter(spark, tmp_path):
    got, want = against_sql(spark, "etl_01_sidecar", tmp_path, conversations=talk(spark))
    assert got == want


def test_words_that_share_a_node_in_reading_order(spark, tmp_path):
    got = []
    for i, order in enumerate((F.asc, F.desc)):
        talk(spark).orderBy(order("conv_id"), order("turn")).coalesce(1).write.parquet(f"{tmp_path}/{i}/conversations.parquet")
        got.append(sorted(map(tuple, QUERIES["jn_19_senses"](spark, f"{tmp_path}/{i}").collect())))
    assert got[0] == got[1] and (1002001, "nnnyy", "nnnyy") in got[0]


def test_tasks_that_group_an_index_grow_with_its_words(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "GROUPED", 100)
    bags = spark.range(200).select(F.col("id").alias("doc_id"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("w"), ((F.col("id") * i) % 37).cast("string"))).alias("words"))
    last = max((s.stageId() for s in stages(spark)), default=-1)
    stats = postings.build(bags, f"{tmp_path}/index", "doc_id")
    assert stats["n"] == 200 and 20 in {s.numTasks() for s in stages(spark) if s.stageId() > last}


def test_an_index_is_built_from_units_not_from_rows_of_words(spark, tmp_path):
    words = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("w"), ((F.col("id") * i) % 37).cast("string")))
    bags = spark.range(200).select((F.col("id") % 190).cast("string").alias("chunk_id"), words.alias("words"))  # ten keys come twice
    stats, n = shuffled(spark, lambda: postings.build(bags, f"{tmp_path}/index"))
    own = postings.Postings(spark, f"{tmp_path}/index", stats)
    want = bags.select("chunk_id", F.explode("words").alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))
    got = own.postings(spark.read.parquet(f"{tmp_path}/index/blocks")).select("term", F.col("unit").alias("chunk_id"), F.col("tf").cast("long"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert n < 2000  # 20,000 words


def test_a_search_of_lists_sends_the_best_of_bundles_not_of_lists(spark, tmp_path):
    x = np.random.default_rng(3).integers(-3, 4, size=(1500, 16)).astype(float)
    x[700:720] = x[5]  # equal products
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    own = lists.Lists(spark, f"{tmp_path}/lists", lists.build(v, f"{tmp_path}/lists"))
    found, n = shuffled(spark, lambda: own.search(v.where("vec_id % 50 = 5"), 20, probes=own.stats["lists"]).collect())
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 6)
    np.fill_diagonal(sims, -np.inf)
    want = [(q, i) for q in range(5, 1500, 50) for i in sorted(range(1500), key=lambda j: (-sims[q, j], j))[:20]]
    assert [(r["q"], r["vec_id"]) for r in sorted(found, key=lambda r: (r["q"], r["rn"]))] == want
    assert n < 20_000  # 30 queries, 58 lists: 34,800 from each list


def test_texts_of_a_published_index_are_parsed_once_for_all_corpora(spark, tmp_path, monkeypatch):
    from lectern.sources import sinks

    plans = []
    monkeypatch.setattr(postings, "build", lambda bags, path: plans.append(bags._jdf.queryExecution().optimizedPlan().toString()) or {"n": 0})
    docs = spark.createDataFrame([("a", "a.md", "A", "the word here", ["kind:bible"], [1], [2], "{}")], "id string, path string, title string, body string, tags array<string>, s array<long>, e array<long>, metadata string")
    sinks.publish_index(docs, f"{tmp_path}/whole")
    assert len(plans) == 5 and not any("regexp" in p or "Join" in p for p in plans)


def test_greatest_values_of_rows():
    rng = np.random.default_rng(4)
    sims = rng.integers(0, 6, (50, 40)).astype(float)
    sims[rng.random(sims.shape) < 0.3] = -np.inf
    sims[0] = -np.inf
    for k in (1, 7, 40, 99):
        row, place = vectors.greatest(sims, k)
        want = [(i, j) for i, s in enumerate(sims) for j in sorted(range(40), key=lambda j: (-s[j], j))[:k] if s[j] > -np.inf]
        assert list(zip(row.tolist(), place.tolist())) == want


def test_long_sequences_align_as_short_ones(spark, monkeypatch):
    rng = random.Random(5)
    pairs = [([rng.choice(["a", "b", "c", "", None]) for _ in range(rng.randrange(30))], [rng.choice(["a", "b", "c", "d", ""]) for _ in range(rng.randrange(30))]) for _ in range(200)]
    short = [align.lcs(a, b) for a, b in pairs]
    monkeypatch.setattr(align, "SMALL", 0)
    assert [align.lcs(a, b) for a, b in pairs] == short


def test_places_of_one_order_align_by_code(spark):
    """Many keys meet in few batches; the order of the rows changes nothing."""
    rows = [(k, n // 2, "abcab"[(k + n) % 5]) for k in range(300) for n in range(6)]
    got = []
    for own in (rows, rows[::-1]):
        df = spark.createDataFrame(own, "k long, n long, c string")
        out = align.lcs_align(df, df.where("n > 0"), "k", "n", "c")
        assert "FlatMapCoGroups" not in out._jdf.queryExecution().toString()
        got.append(sorted(map(tuple, out.collect())))
    assert got[0] == got[1] and {r[0] for r in got[0]} == set(range(300)) and len(got[0]) == 1200


def test_topics_of_one_passage_meet_its_words_once(spark, tmp_path):
    parts = spark.range(3000).select((F.col("id") * 3300).alias("p_partkey"), F.lit("t").alias("p_type"), (F.col("id") % 3).cast("string").alias("p_brand"))
    words = spark.range(660).select("id", F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("alpha beta gamma delta").alias("text")).withColumnRenamed("id", "conv_id")
    got, want = against_sql(spark, "agg_16_topic_codes", tmp_path, part=parts, conversations=words)
    assert got == want
    plan = QUERIES["agg_16_topic_codes"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("sum") < plan.rindex("sum") and "distinct" not in plan and plan.count("Join Inner") == 2


def test_chunks_meet_titles_as_whole_rows(spark, tmp_path):
    docs = texts(spark, *(f"word{i % 7} " + "alpha beta word1 " * 20 for i in range(100)))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        (got, want), moved = shuffled(spark, lambda: against_sql(spark, "agg_31_anchor_matches", tmp_path, documents=docs))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == want and moved < 10 * len(want)


def test_a_chunk_travels_as_one_row_to_its_concordance(spark):
    """Words are made distinct in a chunk's row, so the shuffle has a row a chunk; rows of one chunk still meet."""
    rows = [("a", ["x", "y", "x"]), ("a", ["y", "z"]), ("b", ["x"]), (None, ["x"]), (None, ["x"]), ("c", []), ("d", None)]
    found = fts.concordance(spark.createDataFrame(rows, "chunk_id string, w array<string>"), F.col("w"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("x", "a"), ("y", "a"), ("z", "a"), ("x", "b"), ("x", None)], key=str)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" in plan[: plan.index("Aggregate")]  # words become rows only above what is shuffled


def test_cross_references_pair_distinct_intervals(spark):
    """A target that many lines name meets an interval that many documents have once."""
    refs = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 3 * 10 + 1001001).alias("s"), (F.col("id") % 3 * 10 + 1001004).alias("e"))
    heads = refs.select("doc_id", F.concat("doc_id", F.lit(":0000")).alias("chunk_id"), F.lit(0).alias("chunk_index"))
    lines = spark.range(600).select(F.lit(7).cast("long").alias("source"), (F.col("id") % 2 * 10 + 1001002).alias("ts"), (F.col("id") % 2 * 10 + 1001003).alias("te"), F.when(F.col("id") % 2 == 0, "O").otherwise("F").alias("attribution"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("rank"))
    found = retrieve.by_cross_reference(lines, spark.createDataFrame([(7,)], "source long"), refs, heads, 150)
    got = found.collect()
    assert [r["chunk_id"] for r in got] == [f"{d}:0000" for k in (1, 0) for d in sorted((d for d in range(300) if d % 3 == k), key=lambda d: f"{d}:0000")][:150]
    assert joined(found) < 1000


def test_a_search_within_a_tag_sends_lengths_and_its_words(spark):
    """The other words of a unit don't travel, and its scores are those of the tagged bags."""
    rng = random.Random(3)
    words = [f"word{i:04d}" for i in range(400)]
    rows = [(f"{d}:{i:04d}", d, rng.sample(words, 120) + ["common"] * (i % 3) + ["rare"] * (d % 11 == 0)) for d in range(120) for i in range(4)]
    bags = spark.createDataFrame([*rows, ("3:9999", 3, []), ("3:9998", 3, None)], "chunk_id string, doc_id long, words array<string>").repartition(4)
    tags = spark.range(120).select(F.col("id").alias("doc_id"), F.concat(F.lit("kind:"), (F.col("id") % 3).cast("string")).alias("tag"))
    own = [r for r in rows if r[1] % 3 == 0]
    asked = ["common", "rare", "absent"]
    want = fts.bm25(spark.createDataFrame(own, "chunk_id string, doc_id long, words array<string>"), asked).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        last = max((s.stageId() for s in stages(spark)), default=-1)
        got = retrieve.by_kind_text(bags, tags, "0", asked, "k", 1000).collect()
        sent = sorted(s.shuffleWriteBytes() for s in stages(spark) if s.stageId() > last)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r["chunk_id"], r["score"]) for r in got} == {tuple(r) for r in want} and len(got) > 50
    assert sum(sent[:-1]) < sent[-1] / 4  # beside the bags as they are dealt at first


def joined(df):
    """The most rows that a join of an executed plan gave."""
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        elif "JoinExec" in name:
            most = max(most, p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return most


def test_a_stream_keeps_its_answers_by_buckets_of_keys(spark, tmp_path, monkeypatch):
    """Many keys meet few states, over batches; the answers are those of the table, expiry, failures and nulls included."""
    monkeypatch.setattr(lookups, "BUCKETS", 3)
    ok, value = F.when(F.col("id") % 11 != 0, F.col("id") % 3 > 0), F.when(F.col("id") % 5 > 0, F.col("id") * 0.5)
    rows = spark.range(900).select(F.concat(F.lit("k"), (F.col("id") * 7 % 60).cast("string")).alias("key"), F.timestamp_seconds(F.col("id") * 400).alias("ts"), "id", ok.alias("ok"), value.alias("value"))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (rows.where("id < 500"), rows.where("id >= 500")):
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            run = lookups.cached_stream(stream, 86400).writeStream.option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
            run.awaitTermination()
    finally:
        spark.conf.set(conf, before)
    got = spark.read.schema(lookups.ANSWER).parquet(f"{tmp_path}/out").collect()
    assert sorted(map(tuple, got), key=lambda r: r[2]) == sorted(map(tuple, lookups.cached(rows, 86400).collect()), key=lambda r: r[2])
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress) <= 3  # of sixty keys


def untitled(spark):
    """Documents of one kind, of which every third has no text or no line, and so no title."""
    text = F.when(F.col("id") % 9 == 0, F.lit(None)).when(F.col("id") % 9 == 3, "").when(F.col("id") % 9 == 6, " \n ").otherwise(F.format_string("t%d of it", F.col("id") % 5))
    return spark.range(420).select((F.col("id") * 8).alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"))


@pytest.mark.parametrize("name", ["api_04_study_packet", "api_10_leaves", "fn_21_gloss_clean", "srt_03_page", "srt_07_featured", "sup_31_leaves"])
def test_documents_without_a_title(spark, tmp_path, name):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    lines = spark.createDataFrame([(1, 2, 1, "O", "N")], "l_orderkey long, l_partkey long, l_linenumber int, l_linestatus string, l_returnflag string")
    documents = untitled(spark)
    if name == "srt_03_page":  # the page lies behind the titles that there are
        documents = documents.where("doc_id < 500")
    if name == "fn_21_gloss_clean":
        documents = documents.withColumn("doc_id", F.expr("doc_id div 8"))
    got, want = against_sql(spark, name, tmp_path, documents=documents, labels=labels, lineitem=lines)
    assert got == want


@pytest.mark.parametrize("form", ["usfm", "usfx"])
def test_verses_do_not_carry_their_file(spark, form):
    """What is found in a whole file or chapter is found once, not again for each of its verses."""
    raw = "\\id GEN x\n\\c 1\n\\v 1 a\n\\v 2 b\n\\c 2\n\\v 1 c" if form == "usfm" else '<usfx><book id="GEN"><c id="1"/><v id="1"/>a<ve/><v id="2"/>b<ve/><c id="2"/><v id="1"/>c &amp;lt;<ve/></book></usfx>'
    own = editions.READERS[form](spark.range(3).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.lit(raw).alias("raw")).repartition(2))
    rows = sorted(map(tuple, own.collect()))
    assert rows[:3] == [("f0", 1001001, "a"), ("f0", 1001002, "b"), ("f0", 1002001, "c" if form == "usfm" else "c &lt;")] and len(rows) == 9
    plan = own._jdf.queryExecution().executedPlan().toString()
    carried = re.findall(r"Generate .*\), \[([^\[\]]*)\], (?:true|false), \[\w+#\w+\]", plan)
    assert len(carried) >= 2 and {re.sub("#.*", "", c) for x in carried for c in x.split(", ")} <= {"path", "book", "chapter"}


def test_publishing_shuffles_no_text_for_repeats_and_keeps_no_bags(spark, tmp_path):
    none = F.array().cast("array<bigint>")
    body = F.concat_ws(" ", F.lit("word"), *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{i}")), 256) for i in range(100)])
    docs = spark.range(100).select((F.col("id") % 98).cast("string").alias("id"), F.lit("p").alias("path"), F.lit("t").alias("title"), body.alias("body"), F.array(F.when(F.col("id") % 2 == 0, "kind:bible").otherwise("x")).alias("tags"), none.alias("s"), none.alias("e"), F.lit("{}").alias("metadata")).repartition(3)
    docs.write.parquet(f"{tmp_path}/docs")
    docs, last = spark.read.parquet(f"{tmp_path}/docs"), max((s.stageId() for s in stages(spark)), default=-1)
    tables = {name: df.collect() for name, df in sinks.tables_of(docs).items()}
    assert {n: len(rows) for n, rows in tables.items()} == {"documents": 98, "chunks": 98, "passage_refs": 0, "tags": 98}
    assert sum(s.shuffleWriteBytes() for s in stages(spark) if s.stageId() > last) < 100_000  # 650 kB of texts
    path = sinks.publish_index(docs, f"file://{tmp_path}/whole")
    found = store.current(spark, f"file://{tmp_path}/whole")[1]
    assert found["fts"]["bible"]["n"] == 49 and found["fts"]["main"]["n"] == 49
    assert not (tmp_path / "whole" / path.rsplit("/", 1)[1] / "bags").exists()


def test_tasks_of_homographs_grow_with_their_texts(spark, monkeypatch):
    """The texts of a code are collected only where they end up, a few codes to a task."""
    monkeypatch.setattr(composites, "HELD", 10_000)
    name = lambda c, n: F.concat(F.lit(c), (F.col("id") % n).cast("string"))
    lex = spark.range(600).select(name("H", 30).alias("code"), name("l", 50).alias("lex"))
    inv = spark.range(500).select(name("l", 50).alias("lex"), F.lit("qal").alias("stem"), F.concat(F.lit("x" * 100), F.col("id").cast("string")).alias("gloss"), F.lit(1).alias("n"))
    own, last = composites.homographs(lex, inv), max((s.stageId() for s in stages(spark)), default=-1)
    rows = own.collect()
    assert len(rows) == 30 and all(len(r["senses"]) == 10 * len(r["lexemes"]) for r in rows)
    assert 10 < max(s.numTasks() for s in stages(spark) if s.stageId() > last) <= 30
