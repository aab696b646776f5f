"""The corpus operators against brute force on a small corpus of copies, near copies, edges and odd rows."""

import random
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import ballmeans, components, decontam, minhash, multiset, packing, periods, pii, pq, quality, sharding, suffix, superkmer, toxicity
from lectern.llm.common import materialise
from lectern.llm.queries import ORACLE, QUERIES, tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, m long, spans string"


def corpus():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, shared = prose(120), prose(40)
    out = [(i, prose(rng.randrange(1, 150))) for i in range(60)]
    for i in range(60):
        w = base.split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append((100 + i, " ".join(w)))
    out += [(200 + i, f"{prose(5)} {shared} {prose(5)}") for i in range(50)]
    out += [(300, None), (301, ""), (302, "   "), (303, "one"), (304, "one"), (305, "ab" * 300), (306, "x " * 200), (307, "ü" * 120 + base), (308, "A" * 99), (None, base), (310, prose(30_000)), (311, base), (311, base)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, "x") for i, t in corpus()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def unique():
    return {i: (t or "") for i, t in corpus() if i is not None}


def covered(window, split):
    seen, out = set(), {}
    for i, t in sorted(unique().items()):
        items = split(t.encode())
        mark = bytearray(len(items))
        for at in range(len(items) - window + 1):
            key = bytes(items[at : at + window]) if isinstance(items, bytes) else tuple(items[at : at + window])
            if key in seen:
                mark[at : at + window] = b"\1" * window
            seen.add(key)
        out[i] = items, mark
    return out


@pytest.mark.parametrize("block", [2048, 3])
def test_repeated_bytes(docs, block, monkeypatch):
    monkeypatch.setattr("lectern.llm.repeats.BLOCK", block)  # 3: buckets in several blocks
    got = {r["doc_id"]: r for r in suffix.remove_repeated_bytes(docs).collect()}
    for i, (text, mark) in covered(100, lambda b: b).items():
        kept = bytes(c for c, m in zip(text, mark) if not m)
        spans = sum(m and not (at and mark[at - 1]) for at, m in enumerate(mark))
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(text), sum(mark), spans, sha256(kept).hexdigest()), i


@pytest.mark.parametrize("block", [2048, 3])
def test_repeated_words(docs, block, monkeypatch):
    monkeypatch.setattr("lectern.llm.repeats.BLOCK", block)
    got = {r["doc_id"]: r for r in superkmer.remove_repeated_words(docs).collect()}
    for i, (words, mark) in covered(20, lambda b: b.split()).items():
        kept = b" ".join(w for w, m in zip(words, mark) if not m)
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (sum(mark), sha256(kept).hexdigest()), i


def test_suffix_array_is_sorted():
    text = bytes(random.Random(1).choice(b"ab") for _ in range(300)) + b"abcabc" * 20
    order, lcp = suffix.suffix_array(text)
    suffixes = [text[i:] for i in order]
    assert suffixes == sorted(suffixes)
    assert all(suffix.common_prefix(a, b) == n for a, b, n in zip(suffixes, suffixes[1:], lcp[1:]))


def links(words):
    low = lambda t: t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    sets = {}
    for i, t in unique().items():
        w = low(t).encode().split()
        k = min(words, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(docs, words):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, words).collect()}
    assert got == links(words)


def test_estimate_is_near_the_similarity():
    a = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    one, two = (np.frombuffer(minhash.pack(minhash.minima(x)), np.uint8)[None] for x in (a, a[100:]))
    assert abs(minhash.agreement(one, two)[0] - 0.9) < 0.15


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (7, 7)]
    got = {r["u"]: r["v"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, 200: 100, 300: 100}


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    x[100:160] = x[:60] + rng.normal(size=(60, 16)) * 0.3
    x[200:230] = x[5]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, []), (904, [1.0, None]), (905, [1.0, 2.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in pq.near_vectors(df).collect()}
    f = np.array([r[1] for r in rows[:300]])
    sim = f @ f.T / np.outer(np.linalg.norm(f, axis=1), np.linalg.norm(f, axis=1))
    assert all(got[i]["n_links"] == (sim[i] >= 0.9).sum() - 1 for i in range(300))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 906)) and len(got) == 306
    assert all(got[i]["component_id"] == got[int(j)]["component_id"] for i in range(300) for j in np.flatnonzero(sim[i] >= 0.9))


@pytest.mark.parametrize("block", [4096, 100])
def test_near_vectors_of_few_varying_dimensions(spark, block, monkeypatch):
    monkeypatch.setattr(pq, "BLOCK", block)  # 100: many groups, in blocks
    rng = np.random.default_rng(4)
    x = np.zeros((1200, 64))
    x[:, :6] = rng.normal(size=(1200, 6))
    x[600:] = x[:600] + np.pad(rng.normal(size=(600, 6)) * 0.15, ((0, 0), (0, 58)))
    f = x.astype(np.float32).astype(float)
    got = {r["vec_id"]: r["n_links"] for r in pq.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(f)], "vec_id long, embedding array<float>")).collect()}
    f /= np.linalg.norm(f, axis=1)[:, None]
    assert got == dict(enumerate(((f @ f.T) >= 0.9).sum(1) - 1))


@pytest.mark.parametrize("text,found", [
    ("write a.b+c@x-y.example.com. or x@y", "email:6:27"), ("at 10.0.0.1 and 300.1.1.1", "ip:3:11"), ("card 4111 1111 1111 1111!", "card:5:24"), ("call +1 (555) 010-9999 now", "phone:5:22"),
    ("jane dot doe at example dot com", "email:0:31"), ("jane [at] example (dot) com", "email:0:27"), ("jоhn@exаmple.com", "email:0:16"), ("plus one five five five 0 1 0 nine nine nine nine", "phone:0:49"),
    ("look at the dot, at noon", ""), ("one two three four go", ""), ("１２７.0.0.1", "ip:0:9"), ("", ""), ("un un un un", ""),
])
def test_personal_data(text, found):
    base, added = pii.all_spans(text)
    assert pii.spelled(sorted(base + added)) == found


@pytest.mark.parametrize("text,found", [
    ("to jane@example dot com", "email:3:23"), ("jane@example[.]com", "email:0:18"), ("jane.doe@example (dot) com now", "email:0:26"), ("jane dot doe@example dot com", "email:0:28"),
    ("10[.]0[.]0[.]1", "ip:0:14"), ("on 192 dot 168 dot 1 dot 1", "ip:3:26"), ("10.0[.]0.1", "ip:0:10"), ("300 dot 1 dot 1 dot 1", ""), ("a dot b dot c dot d", ""), ("5 point 3", ""),
])
def test_disguised_dots_alone(text, found):
    base, added = pii.all_spans(text)
    assert pii.spelled(sorted(base + added)) == found


@pytest.mark.parametrize("text,found", [
    ("¹⁰.0.0.1", "ip:0:8"), ("১২৭.0.0.1", "ip:0:9"), ("plus one double five five twenty-two thirty three 0 1 9", "phone:0:55"), ("triple one two three forty-four went by", ""), ("eleven twelve men", ""), ("jane@exⅯple.com", "email:0:15"), ("é ü ß … ½", ""),
])
def test_digits_of_any_script_and_tens(text, found):
    base, added = pii.all_spans(text)
    assert pii.spelled(sorted(base + added)) == found


def test_find_keeps_odd_rows(spark):
    long = "x " * 300_000 + "a@b.co"
    rows = [(1, None), (1, None), (None, "10.0.0.1"), (2, ""), (3, long)]
    got = sorted((r["doc_id"] or 0, r["spans"]) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, "ip:0:8"), (1, ""), (1, ""), (2, ""), (3, f"email:{len(long) - 6}:{len(long)}")]


def test_base_cards_and_phones_are_the_patterns():
    import re

    rng = random.Random(4)
    for _ in range(400):
        t = "".join(rng.choice(["4111", "1111 ", "-", " ", "+", "(5", ") ", "55", "x", ".", "4012888888881881"]) for _ in range(30))
        cards = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0]
        phones = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert [x[1:] for x in pii.detect(t) if x[0] == 2] == cards and [x[1:] for x in pii.detect(t) if x[0] == 3] == phones


def test_base_spans_are_the_patterns():
    import re

    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice(["a", "@", ".", "1", "23", "-", " ", "+", "b.c", "(", "9.9"]) for _ in range(60))
        assert [x[1:] for x in pii.detect(t) if x[0] == 0] == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        assert [x[1:] for x in pii.detect(t) if x[0] == 1] == [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]


def test_redaction(docs, spark):
    assert pii.masked("to a@b.co and 10.0.0.1") == "to <EMAIL> and <IP>" and pii.masked(None) is None
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs).count() == docs.count()


def test_packing_is_a_round_trip(docs, monkeypatch):
    monkeypatch.setattr(packing, "LEAF", 40)  # several leaves and rounds
    e = packing.encoder(tokenizer())
    rows = packing.packed(docs, tokenizer()).collect()
    want = Counter()
    for i, t in corpus():
        ids = e.whole(t or "") + b"\0\0\0\0"
        for k, at in enumerate(range(0, len(ids), 8192)):
            want[i, k, at // 4, len(ids[at : at + 8192]) // 4, zlib.crc32(ids[at : at + 8192])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.1 * sum(r["length"] for r in rows) / 2048 + 2


def test_shortcut_of_the_encoder():
    e = packing.Encoder(tokenizer())
    for t in ["it's ''s 'LL x_y don't", "É ÀÉ ß × ÷", "<|endoftext|>", "İ ΑΣ ﬁ", "12ab 3.4\n\tq", "naïve'd über"]:
        assert e.encode(t) == e.whole(t)


def test_shortcut_only_for_its_kind():
    other = packing.Encoder(tokenizer("byte_bpe_50k.json"))
    assert not other.short and packing.Encoder(tokenizer()).short
    assert all(other.encode(t) == other.whole(t) for t in ("Hello World, it's 12ab", "É ÀÉ ß", "plain words here"))


def test_toxicity_learns_and_keeps_out(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows = []
    for i in range(1200):
        w = [rng.choice(words) for _ in range(40)]
        if i % 6 == 0:
            w[rng.randrange(40)] = rng.choice(["vile", "nasty", "rotten"])
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame([*rows, (5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(1200)], "doc_id long, quality int, toxic int")
    got = toxicity.scores(docs, labels).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 1200]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 6 == 0) for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, labels).collect()}
    assert 5000 in kept and 5001 in kept and 1 in kept and 0 not in kept
    assert toxicity.scores(docs, labels.limit(0)).agg(F.max("predicted")).first()[0] == 1  # nothing known: 0.5


def test_toxicity_learns_from_few_examples(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows = [(i, " ".join([rng.choice(words) for _ in range(40)] + [("vile", "nasty")[i % 2]] * (i < 14))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i < 14)) for i in range(90)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.scores(docs, labels).collect()}
    held = [i for i in range(14) if got[i]["held_out"]]
    assert held and all(got[i]["predicted"] for i in held) and not got[50]["predicted"]


def test_block_max_index_is_exact():
    rng = np.random.default_rng(1)
    dense = rng.random((300, 50)) * (rng.random((300, 50)) < 0.15)
    dense[7] = dense[3]  # a tie
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    doc, term = np.nonzero(dense)
    index = toxicity.BlockMaxIndex(doc, term, dense[doc, term], 300, 50, 16)
    for i in range(40):
        terms = np.flatnonzero(dense[i])
        got, number = index.nearest(terms, dense[i, terms], 9, without=i)
        want = dense @ dense[i]
        want[i] = -1
        order = np.lexsort((np.arange(300), -want.round(12)))[:9]
        assert np.allclose(got, want[order][want[order] > 0]) and (i != 10 or number.tolist() == order.tolist())


def test_toxicity_is_the_vote_of_brute_force(spark, sf_dir):
    """Every score of the query again, by dense matrices over all words of the examples."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    got = {r["doc_id"]: r["score"] for r in QUERIES["op5_nearest_example_toxicity"](spark, sf_dir).collect()}
    model = toxicity.fit(read("documents"), read("labels"))
    names = {t: i for i, t in enumerate(model.spelt.split(b"\n"))}
    texts = {r["doc_id"]: toxicity.words((r["text"] or "").encode()) for r in read("documents").collect()}
    holds = Counter(t for w in texts.values() for t in set(w))
    assert np.allclose(model.idf, [np.log((1 + len(texts)) / (1 + holds[t])) + 1 for t in names])

    def vector(w):
        v = np.zeros(len(names))
        for t, c in Counter(w).items():
            if t in names:
                v[names[t]] = (1 + np.log(c)) * model.weights[names[t]]
        return v / max(np.linalg.norm(v), 1e-300)

    examples = np.stack([vector(texts[i]) for i in model.ids.tolist()])
    prior = 0.5 * model.scale.mean()
    for i, w in texts.items():
        cosine = examples @ vector(w)
        near = np.lexsort((np.arange(len(cosine)), -cosine.round(12)))[:15]
        near = near[cosine[near] > 0]
        weight = cosine[near] * model.scale[model.y[near]]
        vote = (weight @ model.y[near] + prior * model.share) / (weight.sum() + prior) if len(near) else model.share
        assert abs(got[i] - 1 / (1 + np.exp(-(model.curve[0] * toxicity.logit(np.array(vote)) + model.curve[1])))) < 1e-6, i


def test_quality_separates(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    good = lambda: ". ".join(" ".join(rng.choice(words) for _ in range(9)) for _ in range(6)) + "."
    bad = lambda: " ".join(rng.choice(words) + rng.choice(["###", "%%%", " | "]) for _ in range(50))
    rows = [(i, good() if i % 4 else bad()) for i in range(600)]
    docs = spark.createDataFrame([*rows, (5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    got = quality.scores(docs, labels).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 > 0) for r in held]) > 0.97
    assert len(got) == 602 and all(np.isfinite(r["score"]) for r in got)


def test_decontamination(spark):
    item = "Q: what is the tall tower of the old town called today"
    bench = spark.createDataFrame([(1, item), (2, "short item"), (3, None), (4, "!!"), (5, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"so {item.upper()}?! yes"), (2, "a SHORT, item here"), (3, "short old item"), (4, None), (5, ""), (None, item), (6, item[:30])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontam.contamination(docs, bench).collect()}
    assert got[1]["n_hit"] == 12 and got[1]["n_items"] == 2 and got[1]["items_sha256"] == sha256(b"1,5").hexdigest()
    assert got[2]["n_hit"] == 2 and not got[3]["contaminated"] and got[4]["n_words"] == 0 and not got[6]["contaminated"]
    assert {r["doc_id"] for r in decontam.drop_contaminated(docs, bench).collect()} == {3, 4, 5, 6, None}
    assert {r["doc_id"]: r["text"] for r in decontam.clean_spans(docs, bench).collect()}[1] == "so yes"
    assert decontam.contamination(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


@pytest.mark.parametrize("broadcast", [64 << 20, 0])
def test_windows_of_all_sizes(spark, broadcast):
    """hits() against every window by hand, broadcast or shuffled; items of 1 to 14 words, one without an id, extra columns."""
    rng = random.Random(3)
    prose = lambda n: [rng.choice("abcdef") + rng.choice("xyz") for _ in range(n)]
    items = {i: prose(i) for i in range(1, 15)}
    texts = {i: prose(rng.randrange(0, 40)) for i in range(30)} | {50: items[12] + prose(3) + items[14], 51: prose(30_000)}
    bench = spark.createDataFrame([(i, " ".join(w), 1) for i, w in items.items()] + [(None, "ax by", 2)], "item_id long, text string, doc_id long")
    docs = spark.createDataFrame([(i, " ".join(w), 0) for i, w in texts.items()], "doc_id long, text string, item_id long")
    got = {tuple(r) for r in decontam.hits(docs, bench, 10, broadcast).collect()}
    want = set()
    for item, w in [*items.items(), (None, ["ax", "by"])]:
        n = min(len(w), 10)
        windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        want |= {(i, s, n, item) for i, t in texts.items() for s in range(len(t) - n + 1) if tuple(t[s : s + n]) in windows}
    assert got == want and any(x[2] == 10 for x in want)


def test_names_with_dots(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (3, "to a@b.co", None), (3, "to a@b.co", None)], "doc_id long, text string, `a.b` string")
    bench = spark.createDataFrame([(1, "zz yy")], "item_id long, text string")
    assert [r["doc_id"] for r in minhash.drop_near_duplicates(docs).orderBy("doc_id").collect()] == [1, 3]
    assert decontam.drop_contaminated(docs, bench).columns == docs.columns and decontam.drop_contaminated(docs, bench).count() == 4
    assert {r["text"] for r in pii.redact(docs).collect()} == {"a b c d e f g", "to <EMAIL>"} and pii.redact(docs).columns == docs.columns


def test_sharding(docs, spark, tmp_path):
    rows = sharding.sharded(docs, shards=5).collect()
    load, places = Counter(), {}
    for r in rows:
        load[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    sizes = [r["size"] for r in rows]
    assert max(load.values()) - min(load.values()) <= max(sizes)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    records = sharding.sized(docs)
    per_slot = sharding.slot_sizes(records)
    first = sharding.balanced(per_slot, 5)
    second = sharding.grown(first, per_slot, 5)
    assert all(a == b or b == 5 for a, b in zip(first, second)) and 5 in second
    for version, m in enumerate((first, second), 1):
        sharding.save_map(spark, str(tmp_path / "map"), version, m)
    with pytest.raises(ValueError):
        sharding.save_map(spark, str(tmp_path / "map"), 2, first)
    third = sharding.grown_to(first, per_slot, 5, 3)
    assert set(third) == set(range(8)) and all(a == b or b >= 5 for a, b in zip(first, third))
    assert sharding.load_map(spark, str(tmp_path / "map")) == second and sharding.load_map(spark, str(tmp_path / "map"), 1) == first


def test_empty_tables(empty, spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for df in (
        suffix.remove_repeated_bytes(empty), superkmer.remove_repeated_words(empty), minhash.near_duplicates(empty), pq.near_vectors(vectors), pii.find(empty),
        packing.packed(empty, tokenizer()), toxicity.scores(empty, labels), quality.scores(empty, labels), decontam.contamination(empty, bench), sharding.sharded(empty),
    ):
        assert df.count() == 0


def test_pipeline(spark, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    sf = "/root/testdata/sf0.001"
    stage = materialise(pipeline.STAGES[1][1](spark, docs, sf), "stage")
    five = links(5)
    assert {r["doc_id"] for r in stage.collect()} == {i for i, (_, c) in five.items() if i == c} | {None}
    assert stage.columns == docs.columns
    rows = pipeline.run(spark, sf)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 100


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(name, spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    r = con.execute(ORACLE[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(x[columns.index(c)] for c in sorted(columns)) for x in r.fetchall()) == sorted(tuple(x[c] for c in sorted(columns)) for x in df.collect())


def lloyd(x, centroids, rounds):
    """Plain k-means over whole numbers: (clusters, distances, centroids)."""
    x, c = [list(map(int, v)) for v in x], [list(map(int, v)) for v in centroids]

    def assign():
        d = [[sum((a - b) ** 2 for a, b in zip(v, k)) for k in c] for v in x]
        return [min(range(len(c)), key=lambda j: (row[j], j)) for row in d], [min(row) for row in d]

    for _ in range(rounds):
        own, _ = assign()
        for j in range(len(c)):
            mine = [v for v, o in zip(x, own) if o == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    return *assign(), c


@pytest.mark.parametrize("k", [8, 3])
def test_ball_kmeans_is_lloyd(spark, k):
    rng = np.random.default_rng(k)
    x = np.concatenate([rng.normal(size=(60, 4)), rng.normal(size=(60, 4)) * 0.05 + 2, np.repeat([[0.5, -0.5, 0.25, 0.0]], 40, 0)])
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    odd = [(900, None, 1), (901, [1.0], 1), (902, [None] * 4, 1), (903, [float("nan")] * 4, 1), (904, [float("inf"), 0.0, 0.0, 0.0], 1), (905, [1e300, -1e300, 0.0, 0.0], 1), (None, [0.1, 0.2, 0.3, 0.4], 1), (7, rows[7][1], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, cluster int").repartition(5)
    kept = [(i, [max(-(1 << 26), min(1 << 26, int(np.floor(np.float64(v) * 1024)) if abs(v) < 1e20 else int(np.sign(v)) * (1 << 26))) for v in e]) for i, e, _ in rows + odd[5:]]
    named = sorted((r for r in kept if r[0] is not None), key=lambda r: (sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    own, far, centres = lloyd([v for _, v in kept], [v for _, v in named], 10)
    got = sorted(((r["vec_id"] if r["vec_id"] is not None else -1, r["cluster"], r["distance"]) for r in ballmeans.clustered(df, clusters=k, dimensions=4).collect()))
    assert got == sorted((i if i is not None else -1, c, d) for (i, _), c, d in zip(kept, own, far))
    first = ballmeans.clustered(df, clusters=k, dimensions=4).where("vec_id = 0").first()
    assert first["inertia"] == sum(far) and first["cluster_inertia"] == sum(d for c, d in zip(own, far) if c == first["cluster"])
    assert first["centroid_sha256"] == sha256(",".join(map(str, centres[first["cluster"]])).encode()).hexdigest()


def test_balls_spare_distances():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(-30, 30, (300, 8)) + 1000 * np.eye(8, dtype=int)[i] for i in range(8)])
    c = np.array([x[i * 300 : (i + 1) * 300].mean(0) for i in range(8)]).astype(np.int64)
    own, d, all_done = ballmeans.Balls(c, None).nearest(x, None)
    again, _, done = ballmeans.Balls(c, [int(d[own == i].max()) for i in range(8)]).nearest(x, own)
    assert (again == own).all() and done == len(x) and all_done == 8 * len(x)  # all in stable cores


def test_ball_kmeans_of_little(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ballmeans.clustered(df).count() == 0
    two = spark.createDataFrame([(1, [1.0] * 64), (2, [2.0] * 64)], "vec_id long, embedding array<float>")
    assert sorted(r["distance"] for r in ballmeans.clustered(two).collect()) == [0, 0]


def plain_sums(text):
    """Fingerprint lanes of a text: identity lanes, then signed likeness lanes."""
    import re
    from hashlib import md5

    identity, likeness = [0] * 16, [0] * 128
    for p in text.split("\n"):
        h = "".join(sha256(f"{k}:{p}".encode()).hexdigest() for k in range(2))
        for i in range(16):
            identity[i] = (identity[i] + int(h[8 * i : 8 * i + 8], 16)) % 2**32
    for piece in re.findall(multiset.PIECE, text):
        m = md5(piece.encode()).hexdigest()
        for t in range(2):
            b = int(m[16 * t : 16 * t + 16], 16)
            for j in range(32):
                for high in range(2):
                    likeness[64 * t + 2 * j + high] += 1 if b >> (32 * high + j) & 1 else -1
    return identity, likeness


def plain_fingerprint(text):
    identity, likeness = plain_sums(text)
    return "".join(f"{v:08x}" for v in identity) + "".join(f"{v % 2**24:06x}" for v in likeness)


def plain_likeness(a, b):
    if plain_fingerprint(a) == plain_fingerprint(b):
        return 1.0
    x, y = plain_sums(a)[1], plain_sums(b)[1]
    norm = (sum(v * v for v in x) * sum(v * v for v in y)) ** 0.5
    return round(min(max(sum(p * q for p, q in zip(x, y)) / norm, 0.0), 1.0), 6) if norm else 0.0


TEXTS = {1: "one, two three four five six.\nnext line\n\nlast", 2: None, 3: "", 4: "a", 5: "b\nc", 6: "c\nb", 7: "ü€𝄞 x\n" * 30, 8: "same text here", 9: "same text here", 10: "word " * 5000, 11: "\n\n"}


@pytest.mark.parametrize("partitions", ["4", "1"])
def test_multiset_fingerprints(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame([(i, t, 3) for i, t in TEXTS.items()] + [(None, "no id\nat all", 3)], "doc_id long, text string, sums int").repartition(3)
        got = {r["doc_id"]: r for r in multiset.edited(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    order = sorted(TEXTS, reverse=True)
    for i in [*TEXTS, None]:
        text = (TEXTS[i] if i is not None else "no id\nat all") or ""
        follows = TEXTS[order[(order.index(i) + 1) % len(order)]] or "" if i is not None else None
        half = len(text) // 2
        edit = text[: len(text) - half] + (follows or "")[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha256(edit.encode()).hexdigest()), i
        assert (r["fingerprint"], r["edited_fingerprint"]) == (plain_fingerprint(text), plain_fingerprint(edit)), i
        assert r["near_edited"] == pytest.approx(plain_likeness(text, edit), abs=2e-6), i
        assert r["near_next"] == (pytest.approx(plain_likeness(text, follows), abs=2e-6) if follows is not None else 0.0), i
    assert got[5]["fingerprint"] == got[6]["fingerprint"] and got[8]["fingerprint"] == got[9]["fingerprint"] != got[5]["fingerprint"]


def test_fingerprints_of_shared_ids(spark):
    rows = [(5, f"text {i % 7}") for i in range(40)] + [(9, "top"), (1, "low")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = multiset.edited(df).collect()
    assert len(got) == 42
    heads = {i: [r for r in got if r["doc_id"] == i] for i in (9, 5, 1)}
    half = lambda a, b: sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest()
    assert heads[1][0]["edited_sha256"] == half("low", "top")
    assert sum(r["edited_sha256"] == half("text 0", "low") for r in heads[5]) <= 1 and heads[9][0]["edited_sha256"] in {half("top", f"text {i}") for i in range(7)}
    assert multiset.edited(df.where("false")).count() == 0
    one = multiset.edited(df.where("doc_id = 9")).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == half("top", "top")


def test_fingerprints_grow_and_shrink(spark):
    df = spark.createDataFrame([("a, b c\nd", "e f\nd", "d\na, b c\ne f\nd")], "x string, y string, both string")
    p = lambda c: multiset.fingerprints(df.select(F.lit(1).alias("doc_id"), F.col(c).alias("text"))).select(F.col("fingerprint").alias(c))
    row = p("x").crossJoin(p("y")).crossJoin(p("both"))
    r = row.select("*", multiset.inserted(F.col("x"), F.col("y")).alias("sum"), multiset.deleted(F.col("both"), F.col("y")).alias("rest"), multiset.likeness(multiset.decoded(F.col("both")), multiset.decoded(F.col("x"))).alias("near")).first()
    assert r["sum"] == r["both"] and r["rest"] == r["x"] and 0.4 < r["near"] < 1


def plain_runs(w):
    """Every run by looking at every lag and place."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        s = 0
        while s < len(w):
            e = s
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            length = e - s + q
            if e > s and length >= max(6, 4 * q) and not any(all(w[s + i] == w[s + i + d] for i in range(length - d)) for d in range(1, q)):
                out.append((s, length, q))
            s = e + 1
    return sorted(out)


@pytest.mark.parametrize("heavy", [64, 3])
def test_periodic_runs(spark, monkeypatch, heavy):
    monkeypatch.setattr(periods, "HEAVY", heavy)
    rng = random.Random(heavy)
    texts = {}
    for i in range(120):
        k = rng.choice([1, 2, 3, 30])
        w = [f"w{rng.randrange(k)}" for _ in range(rng.randrange(0, 160))]
        for _ in range(rng.randrange(4)):
            unit = [f"w{rng.randrange(k)}" for _ in range(rng.randrange(1, 45))]
            at = rng.randrange(len(w) + 1)
            w[at:at] = unit * rng.randrange(2, 7) + unit[: rng.randrange(len(unit))]
        texts[i] = " ".join(w)
    texts |= {500: None, 501: "", 502: "a a a a a", 503: "a a a a a a", 504: "\ta\x0bb a b\x0ca b a b ", 505: "x y z " * 4000}
    batch = [(i, (t or "").encode().split()) for i, t in texts.items()]
    import pyarrow as pa

    rows = pa.RecordBatch.from_arrays([pa.array([i for i, _ in batch]), pa.array([b" ".join(w) for _, w in batch])], ["doc_id", "text"])
    found = {i: runs for i, _, runs in periods.searched([rows])}
    for i, w in batch:
        want = plain_runs(w) if i != 505 else [(0, 12000, 3)]
        assert found[i] == want, i
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()] + [(None, "q " * 9, 1)], "doc_id long, text string, n_runs int").repartition(3)
    got = {r["doc_id"]: r for r in periods.report(df, periods.planted).collect()}
    for i, w in [*batch, (None, [b"q"] * 9)]:
        w = periods.planted(i, w)
        runs = plain_runs(w) if len(w) < 3000 else [(0, 12000, 3)]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        r, best = got[i], min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *(best or (None,) * 3)), i
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest(), i
    rows = sorted(map(tuple, periods.periodic_runs(df.where("doc_id = 505")).collect()))
    assert rows == [(505, 0, 12000, 3)] and periods.collapsed(df.where("doc_id = 505")).first()["text"] == "x y z"
    assert periods.report(df.where("false")).count() == 0


def test_planted_follows_the_rule():
    done = 0
    for i in range(300):
        words = [b"%d" % k for k in range(50)]
        h = zlib.crc32(str(i).encode())
        if h % 10:
            assert periods.planted(i, words) == words
            continue
        g = h // 10
        a, n = g % 50, 50
        p = 1 + (n - a) // (3 + g % 8)
        assert periods.planted(i, words) == [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        done += 1
    assert done > 10 and periods.planted(None, [b"a"]) == [b"a"] and periods.planted(1, []) == []


def test_many_lags_of_a_long_text():
    rng = random.Random(3)
    word = np.array([rng.randrange(2) for _ in range(60_000)])
    counts, base = periods.lag_counts(word, np.array([len(word)]))
    assert base.tolist() == [0, 15_001] and counts[7] == (word[7:] == word[:-7]).sum() and counts[15_000] == (word[15_000:] == word[:-15_000]).sum()
    assert len(periods.runs_of(word, counts)) > 500
