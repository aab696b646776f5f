"""The registered queries of the corpus operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from lectern.llm import ballmeans, decontam, minhash, multiset, packing, periods, pii, pq, quality, sharding, suffix, superkmer, toxicity
from lectern.llm.common import read


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_dedup(spark, sf_dir):
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op2_product_quantisation_dedup(spark, sf_dir):
    return pq.near_vectors(read(spark, sf_dir, "embeddings"))


def op3_pii_deobfuscation(spark, sf_dir):
    return pii.find(read(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark, sf_dir):
    return packing.packed(read(spark, sf_dir, "documents"), tokenizer())


def op5_nearest_example_toxicity(spark, sf_dir):
    return toxicity.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_benchmark_decontamination(spark, sf_dir):
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_suffix_array_dedup(spark, sf_dir):
    return suffix.remove_repeated_bytes(read(spark, sf_dir, "documents"))


def op8_super_kmer_dedup(spark, sf_dir):
    return superkmer.remove_repeated_words(read(spark, sf_dir, "documents"))


def op9_virtual_slot_sharding(spark, sf_dir):
    return sharding.sharded(read(spark, sf_dir, "documents"), shards=40)


def op10_quadratic_discriminant_quality(spark, sf_dir):
    return quality.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_ball_kmeans(spark, sf_dir):
    return ballmeans.clustered(read(spark, sf_dir, "embeddings"))


def op12_multiset_fingerprint(spark, sf_dir):
    return multiset.edited(read(spark, sf_dir, "documents"))


def op13_periodic_runs(spark, sf_dir):
    return periods.report(read(spark, sf_dir, "documents"), periods.planted)


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_product_quantisation_dedup, op3_pii_deobfuscation, op4_best_fit_packing, op5_nearest_example_toxicity, op6_benchmark_decontamination, op7_suffix_array_dedup, op8_super_kmer_dedup, op9_virtual_slot_sharding, op10_quadratic_discriminant_quality, op11_ball_kmeans, op12_multiset_fingerprint, op13_periodic_runs)}

#: DuckDB: words are what Python's bytes.split() gives; windows are lists of 20 words.
_OP8 = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), p AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + 19), ' ') AS win
  FROM w, unnest(range(1, len(words) - 18)) AS t(i)
), f AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM p) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS pos FROM f, unnest(range(0, 20)) AS t(k)
), g AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, string_agg(u.word, ' ' ORDER BY u.pos) AS s
  FROM w, LATERAL (SELECT unnest(words) AS word, generate_subscripts(words, 1) AS pos) AS u
  LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.pos = u.pos
  WHERE gone.pos IS NULL GROUP BY w.doc_id
)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: All pairs by shared shingles, then reachability.
_OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) = 1 THEN words[1] ELSE words[i] || ' ' || words[i + 1] END AS sh
  FROM w, unnest(range(1, greatest(len(words), 2))) AS t(i) WHERE len(words) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)
), b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), r AS (
  SELECT x, y FROM b UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x
), m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.y, w.doc_id)) AS component_id, w.doc_id <= coalesce(m.y, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = w.doc_id
"""

#: Every window of a document against every window of an item.
_OP6 = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS win
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM bw
), h AS (
  SELECT doc_id, i, x.n, item_id
  FROM (SELECT doc_id, sizes.n, i, list_slice(w, i, i + sizes.n - 1) AS win FROM d, sizes, unnest(range(1, len(w) - sizes.n + 2)) AS t(i)) x
  JOIN bw ON bw.win = x.win AND bw.n = x.n
), c AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM h, unnest(range(0, h.n)) AS t(k) GROUP BY doc_id
), s AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""

#: Brute force over all pairs in double precision, then reachability.
_OP2 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
), u AS (
  SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda a: a * a))) AS norm FROM v
  WHERE x IS NOT NULL AND len(list_filter(x, lambda a: a IS NULL OR NOT isfinite(a))) = 0 AND list_sum(list_transform(x, lambda a: a * a)) > 0
), e AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.9
), r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
), m AS (SELECT x, min(y) AS y FROM r GROUP BY x
), n AS (SELECT x, count(*) AS n FROM e GROUP BY x)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(m.y, v.vec_id)) AS component_id, v.vec_id <= coalesce(m.y, v.vec_id) AS kept
FROM v LEFT JOIN n ON n.x = v.vec_id LEFT JOIN m ON m.x = v.vec_id
"""


def _op11() -> str:
    """Lloyd's rounds, one pair of CTEs each; sums of whole numbers, so floor division is exact."""
    steps = ["c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT sha256('3:' || vec_id) AS h, x FROM v ORDER BY h LIMIT 8))"]
    for t in range(11):
        steps.append(f"a{t} AS MATERIALIZED (SELECT vec_id, any_value(v.x) AS x, min(list_sum(list_transform(list_zip(v.x, k.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT * 8 + k.c) AS m FROM v, c{t} k GROUP BY vec_id)")
        if t < 10:
            steps.append(f"s{t} AS (SELECT m % 8 AS c, i, sum(x[i]) AS s, count(*) AS n FROM a{t}, unnest(range(1, 65)) AS t(i) GROUP BY 1, 2)")
            steps.append(f"c{t + 1} AS MATERIALIZED (SELECT k.c, coalesce(q.x, k.x) AS x FROM c{t} k LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{t} GROUP BY c) q ON q.c = k.c)")
    usable = "len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0"
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE {usable}
), {", ".join(steps)}
SELECT vec_id, (m % 8)::INTEGER AS cluster, (m // 8)::BIGINT AS distance, (sum(m // 8) OVER (PARTITION BY m % 8))::BIGINT AS cluster_inertia, (sum(m // 8) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(k.x, ',')) AS centroid_sha256
FROM a10 JOIN c10 k ON k.c = m % 8
"""


def _op12() -> str:
    """Every paragraph and piece of every text and edited text, summed lane by lane."""
    identity = [f"sum(('0x' || substr(h{k}, {8 * i + 1}, 8))::BIGINT) % 4294967296" for k in range(2) for i in range(8)]
    likeness = [f"2 * sum((w{2 * t + 1 - high} >> {j}) & 1) - count(*)" for t in range(2) for j in range(32) for high in range(2)]
    dot = lambda p, q: f"list_sum(list_transform(list_zip({p}, {q}), lambda z: z[1] * z[2]))::DOUBLE"
    near = lambda p, q: f"CASE WHEN {p}.f = {q}.f THEN 1.0::DOUBLE WHEN {dot(p + '.v', p + '.v')} * {dot(q + '.v', q + '.v')} > 0 THEN round(least(greatest({dot(p + '.v', q + '.v')} / sqrt({dot(p + '.v', p + '.v')} * {dot(q + '.v', q + '.v')}), 0.0), 1.0), 6) ELSE 0.0 END"
    return rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), max(doc_id) OVER ()) AS next FROM documents
), x AS MATERIALIZED (
  SELECT doc_id, 0 AS edit, text FROM d
  UNION ALL SELECT d.doc_id, 1, left(d.text, length(d.text) - length(d.text) // 2) || left(n.text, length(d.text) // 2) FROM d JOIN d n ON n.doc_id = d.next
), p AS (
  SELECT doc_id, edit, sha256('0:' || p) AS h0, sha256('1:' || p) AS h1 FROM (SELECT doc_id, edit, unnest(string_split(text, chr(10))) AS p FROM x)
), i AS MATERIALIZED (
  SELECT doc_id, edit, [{", ".join(identity)}]::BIGINT[] AS v FROM p GROUP BY ALL
), m AS (
  SELECT doc_id, edit, md5(q) AS h FROM (SELECT doc_id, edit, unnest(regexp_extract_all(text, '[^\x00-\x20.,;:!?]+(?: [^\x00-\x20.,;:!?]+){{0,3}}', 0)) AS q FROM x)
), w AS (
  SELECT doc_id, edit, {", ".join(f"('0x' || substr(h, {8 * t + 1}, 8))::BIGINT AS w{t}" for t in range(4))} FROM m
), l AS MATERIALIZED (
  SELECT doc_id, edit, [{", ".join(likeness)}]::BIGINT[] AS v FROM w GROUP BY doc_id, edit
), f AS MATERIALIZED (
  SELECT x.doc_id, x.edit, x.text, coalesce(l.v, list_transform(range(0, 128), lambda z: 0::BIGINT)) AS v,
    array_to_string(list_transform(i.v, lambda z: printf('%08x', z)), '') || array_to_string(list_transform(coalesce(l.v, list_transform(range(0, 128), lambda z: 0::BIGINT)), lambda z: printf('%06x', (z + 16777216) % 16777216)), '') AS f
  FROM x JOIN i USING (doc_id, edit) LEFT JOIN l USING (doc_id, edit)
)
SELECT a.doc_id, length(a.text)::BIGINT AS n_chars, sha256(b.text) AS edited_sha256, a.f AS fingerprint, b.f AS edited_fingerprint,
  {near("a", "b")} AS near_edited, {near("a", "c")} AS near_next
FROM d JOIN f a ON a.doc_id = d.doc_id AND a.edit = 0 JOIN f b ON b.doc_id = d.doc_id AND b.edit = 1 JOIN f c ON c.doc_id = d.next AND c.edit = 0
"""


#: All pairs of equal words up to a quarter of the text apart, as islands by lag; of one stretch the least period counts.
_OP13 = r"""
WITH t AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), h AS (
  SELECT doc_id, w, len(w) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295::BIGINT) AS h FROM t
), g AS (
  SELECT doc_id, w, n, h % 10 = 0 AND n > 0 AS hit, (h // 10) % greatest(n, 1) AS a, (h // 10) % 8 AS k FROM h
), e AS MATERIALIZED (
  SELECT doc_id, n, CASE WHEN hit THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + k)) END]) ELSE w END AS w FROM g
), p AS MATERIALIZED (
  SELECT doc_id, n, i - 1 AS i, w[i] AS word FROM e, unnest(range(1, n + 1)) AS t(i)
), m AS (
  SELECT a.doc_id, b.i - a.i AS p, a.i FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n
), s AS (
  SELECT doc_id, p, min(i) AS s, count(*) + p AS len FROM (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM m) GROUP BY doc_id, p, island
), r AS MATERIALIZED (
  SELECT doc_id, s, len, min(p) AS q FROM s WHERE len >= greatest(6, 4 * p) GROUP BY doc_id, s, len
), gone AS (
  SELECT DISTINCT doc_id, i FROM r, unnest(range(s + q, s + len)) AS t(i)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM p ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
), best AS (
  SELECT doc_id, count(*) AS n, min({'a': -len, 'b': s, 'c': q}) AS x, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM r GROUP BY doc_id
)
SELECT e.doc_id, coalesce(best.n, 0)::BIGINT AS n_runs, x.b::BIGINT AS start, (-x.a)::BIGINT AS length, x.c::BIGINT AS period, (1000 * -x.a // x.c)::BIGINT AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM e LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLE = {"op11_ball_kmeans": _op11(), "op12_multiset_fingerprint": _op12(), "op13_periodic_runs": _OP13, "op2_product_quantisation_dedup": _OP2, "op6_benchmark_decontamination": _OP6, "op1_minhash_dedup": _OP1, "op8_super_kmer_dedup": _OP8}
