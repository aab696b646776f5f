"""Queries of question analysis; their SQL has the fixed values and shapes written out once more."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import intents
from lectern.plans.registry import query

_Q = """q AS (SELECT c_custkey AS k, n_name, CASE c_custkey % 18
 WHEN 0 THEN 'cross-references for GEN ' || (c_custkey % 50 + 1) || ':3' WHEN 1 THEN 'Who was the father of ' || n_name || '?' WHEN 2 THEN n_name || '''s wife' WHEN 3 THEN 'the Greek word agape of ' || n_name
 WHEN 4 THEN 'look up Strong''s g' || (c_custkey % 6000 + 1) WHEN 5 THEN 'what tense is ' || n_name || ' here' WHEN 6 THEN 'What does the Bible say about the ' || lower(n_name) || '?' WHEN 7 THEN 'Who was ' || n_name || '?'
 WHEN 8 THEN 'What does ' || lower(n_name) || ' mean?' WHEN 9 THEN 'How should we render ' || n_name WHEN 10 THEN 'summarize ROM ' || (c_custkey % 16 + 1) || ':1-' || (c_custkey % 20 + 2) WHEN 11 THEN 'themes of 1 Samuel ' || (c_custkey % 16 + 1)
 WHEN 12 THEN 'mercy according to Ruth and ' || n_name WHEN 13 THEN 'hope and different kinds of ' || n_name WHEN 14 THEN 'what did ' || n_name || ' say about faith' WHEN 15 THEN 'see also ' || n_name || ', JHN 3:18-16'
 WHEN 16 THEN 'what did ' || n_name || ' say in LUK 4' ELSE 'verses about a very long and winding story' END AS text FROM customer JOIN nation ON n_nationkey = c_nationkey)"""
_SHAPES = (
    ("cross-references for GEN ", 50, ":3"), ("Who was the father of ", "n", "?"), ("n", "'s wife"), ("the Greek word agape of ", "n"), ("look up Strong's g", 6000), ("what tense is ", "n", " here"), ("What does the Bible say about the ", "l", "?"),
    ("Who was ", "n", "?"), ("What does ", "l", " mean?"), ("How should we render ", "n"), ("summarize ROM ", 16, ":1-", 20), ("themes of 1 Samuel ", 16), ("mercy according to Ruth and ", "n"), ("hope and different kinds of ", "n"),
    ("what did ", "n", " say about faith"), ("see also ", "n", ", JHN 3:18-16"), ("what did ", "n", " say in LUK 4"), ("verses about a very long and winding story",),
)


def asked(t):
    """k, n_name, text: a question of one of eighteen shapes from each customer."""
    k, name = F.col("c_custkey"), F.col("n_name")

    def part(x):
        if isinstance(x, int):
            return (k % x + (2 if x == 20 else 1)).cast("string")
        return {"n": name, "l": F.lower(name)}.get(x, F.lit(x))

    text = F.lit(None).cast("string")
    for i, shape in enumerate(_SHAPES):
        text = F.when(k % len(_SHAPES) == i, F.concat(*map(part, shape))).otherwise(text)
    return t.table("customer").join(t.table("nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(k.alias("k"), "n_name", text.alias("text"))


def known_speakers(t):
    return t.table("nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"))


_CODES = "['GEN','EXO','LEV','NUM','DEU','JOS','JDG','RUT','1SA','2SA','1KI','2KI','1CH','2CH','EZR','NEH','EST','JOB','PSA','PRO','ECC','SNG','ISA','JER','LAM','EZK','DAN','HOS','JOL','AMO','OBA','JON','MIC','NAM','HAB','ZEP','HAG','ZEC','MAL','MAT','MRK','LUK','JHN','ACT','ROM']"
#: The references by their last word before the number; the two names in full that the questions use are read as their codes.
_SPANS = rf"""r AS (SELECT *, replace(replace(text, '1 Samuel', '1SA'), 'Ruth', 'RUT') AS plain FROM q), m AS (SELECT *, list_filter(list_transform(regexp_extract_all(plain, '[1-3]?[A-Za-z]+\s+\d{{1,3}}\b(?::\d{{1,3}}(?:-\d{{1,3}})?)?'), lambda y: [list_position({_CODES}, upper(regexp_extract(y, '^\S+')))::BIGINT, regexp_extract(y, '\s(\d+)', 1)::BIGINT, nullif(regexp_extract(y, ':(\d+)', 1), '')::BIGINT, nullif(regexp_extract(y, '-(\d+)', 1), '')::BIGINT]), lambda z: z[1] > 0) AS found FROM r),
p AS (SELECT *, CASE WHEN len(found) > 0 THEN list_transform(found, lambda z: CASE WHEN z[3] IS NULL THEN [z[1] * 1000000 + z[2] * 1000 + 1, z[1] * 1000000 + z[2] * 1000 + 999] ELSE [z[1] * 1000000 + z[2] * 1000 + least(z[3], coalesce(z[4], z[3])), z[1] * 1000000 + z[2] * 1000 + greatest(z[3], coalesce(z[4], z[3]))] END)
 WHEN regexp_matches(plain, '\b(?:in|of|from|throughout|according\s+to)\s+RUT\b') THEN [[8001001, 8999999]] ELSE [] END AS spans FROM m)"""
_STOP = "'a','about','above','all','also','an','and','any','are','as','at','be','been','being','below','between','bible','book','but','by','chapter','did','do','does','down','explain','explaining','for','from','give','had','has','have','he','her','his','how','i','if','in','into','is','it','its','just','least','less','me','mean','meaning','means','mine','more','most','my','no','not','of','off','on','only','or','our','out','over','passage','passages','said','say','saying','says','scripture','scriptures','she','show','so','some','such','tell','telling','testament','than','that','the','their','them','then','these','they','this','those','to','too','under','us','verse','verses','very','was','we','were','what','when','where','which','who','whom','whose','why','with','yes','you','your'"
_FRAME = "'different','differing','kinds','sorts','speak','speaks','speaking','talk','talks','say','says','said','mention','mentions','discuss','discusses','describe','describes'"
_SPEECH = r"(?:say|says|said|saying|speak|speaks|spoke|teach|teaches|taught|command|commands|commanded|declare|declares|declared|promis\w+|replied|replies|answered|answers|asks|asked|preach\w*|tells|told)"
_RELATED = "MAP {'brother':'sibling-of','child':'father-of','children':'father-of','daughter':'father-of','father':'father-of-rev','husband':'partner-of','mother':'mother-of-rev','parent':'father-of-rev','parents':'father-of-rev','partner':'partner-of','sibling':'sibling-of','sister':'sibling-of','son':'father-of','spouse':'partner-of','wife':'partner-of'}"
_PARTS = rf"""{_Q}, {_SPANS},
sp AS (SELECT p.k, arg_min(n.n_name, (-length(n.n_name), n.n_name)) AS said FROM p JOIN nation n ON n_nationkey % 2 = 0 AND regexp_matches(lower(text), '\b' || lower(n.n_name) || '(?:''s\b|\s+{_SPEECH}\b)|\b(?:did|does|do|will|would)\s+' || lower(n.n_name) || '\s+{_SPEECH}\b|\bwords? of ' || lower(n.n_name) || '\b') GROUP BY 1),
x AS (SELECT p.k, text, spans, CASE WHEN len(spans) = 0 THEN said END AS speaker,
 list_filter(regexp_extract_all(lower(regexp_replace(text, '((?:(?:[1-3]\s*)?\pL+\s+){{1,7}})(\d{{1,3}})(?::(\d{{1,3}})(?:\s*[-–]\s*(?:(\d{{1,3}}):)?(\d{{1,3}}))?)?', ' ', 'g')), '[^\s\d_.,:;!?()"''/]{{3,}}'), lambda w: w NOT IN ({_STOP}, {_FRAME})) AS words,
 coalesce(nullif(regexp_extract(text, '(?i)^who (?:is|are|was|were)\s+(?:the\s+)?([a-z][\w-]+)\??\s*$', 1), ''), nullif(regexp_extract(text, '(?i)^what does\s+(?:the term\s+)?([a-z][\w-]+)\s+mean\??\s*$', 1), ''), nullif(regexp_extract(text, '(?i)^what (?:is|are|was|were)\s+(?:the\s+|a\s+|an\s+)?([a-z][\w-]+)\??\s*$', 1), '')) AS term,
 nullif(regexp_extract(text, '(?i)\b(?:greek|hebrew)\s+word\s+([A-Za-z]{{2,}})\b', 1), '') AS studied, nullif(upper(regexp_extract(text, '(?i)\blook\s+up\s+strong''?s?\s+([GH]\d{{1,5}})\b', 1)), '') AS code,
 regexp_matches(text, '(?i)\bwhat\s+(?:tense|case|gender|mood|voice)\s+is\b') AS morphology, regexp_matches(text, '(?i)\b(?:translate|translating|translation|translated|how\s+(?:do|should|can|to)\s+(?:i|we|one|it|you))\b') AS method,
 nullif(lower(regexp_extract(text, '(?i)\b(father|mother|son|wife)\s+of\s+(?:the\s+)?[a-z][a-z''-]+', 1)), '') AS r1, nullif(regexp_extract(text, '(?i)\b(?:father|mother|son|wife)\s+of\s+(?:the\s+)?([a-z][a-z''-]+)', 1), '') AS n1,
 nullif(lower(regexp_extract(text, '(?i)\b[a-z][a-z''-]*?''s\s+(father|mother|son|wife)\b', 1)), '') AS r2, nullif(regexp_extract(text, '(?i)\b([a-z][a-z''-]*?)''s\s+(?:father|mother|son|wife)\b', 1), '') AS n2,
 regexp_replace(coalesce(nullif(regexp_extract(text, '(?i)\bwhat\s+does\s+the\s+bible\s+say\s+about\s+(.+?)(?:\?|$)', 1), ''), nullif(regexp_extract(text, '(?i)\bverses\s+about\s+(.+?)(?:\?|$)', 1), '')), '(?i)^(?:the|a|an)\s+', '') AS about,
 regexp_matches(text, '(?i)\b(?:cross.?references?\s+(?:for|to)|see\s+also)\s+.') AS linked FROM p LEFT JOIN sp USING (k)),
y AS (SELECT *, CASE WHEN linked THEN spans[1][1] END AS source, CASE WHEN len(string_split_regex(trim(text), '\s+')) <= 10 AND length(term) >= 3 AND lower(term) NOT IN ({_STOP}) THEN lower(term) END AS entity, CASE WHEN len(string_split_regex(about, '\s+')) <= 4 AND lower(about) NOT IN ('all','any','some','the','these','this') THEN about END AS topic,
 coalesce({_RELATED}[r1], {_RELATED}[r2]) AS relation, coalesce(n1, n2) AS name FROM x),
i AS (SELECT *, CASE WHEN speaker IS NOT NULL THEN 'speaker' WHEN source IS NOT NULL THEN 'xref' WHEN relation IS NOT NULL THEN 'genealogy' WHEN studied IS NOT NULL OR code IS NOT NULL THEN 'word_study' WHEN morphology THEN 'morphology' WHEN topic IS NOT NULL THEN 'topic' WHEN entity IS NOT NULL THEN 'entity_lookup' WHEN method THEN 'methodology'
 WHEN len(list_filter(spans, lambda s: s[2] - s[1] < 999)) > 0 THEN 'passage_specific' WHEN len(spans) > 0 THEN 'passage_book' ELSE 'thematic' END AS intent FROM y)"""
_SHOWN = "array_to_string(list_transform(spans, lambda s: s[1] || '-' || s[2]), ' ')"


def _analysed(t):
    return intents.analysed(asked(t), "k", "text", known_speakers(t))


def _spans():
    return F.array_join(F.transform("passages", lambda p: F.concat_ws("-", p["s"].cast("string"), p["e"].cast("string"))), " ")


@query("", f"WITH {_PARTS} SELECT k, coalesce(lower(studied), '') AS words, coalesce('G' || lpad(substr(code, 2), 4, '0'), '') AS codes, name, relation, topic, source AS xref_source FROM i")
def fn_26_sub_classifiers(t):
    return _analysed(t).select("k", F.array_join("words", ",").alias("words"), F.array_join("codes", ",").alias("codes"), "related.name", "related.relation", "topic", "xref_source")


@query("", f"WITH {_PARTS} SELECT k, intent FROM i")
def fn_27_intent(t):
    return _analysed(t).select("k", "intent")


@query("", f"WITH {_PARTS} SELECT intent, count(*) AS n FROM i GROUP BY intent")
def fn_27b_intents_met(t):
    """How often each of the eleven intents is met; all are."""
    return _analysed(t).groupBy("intent").agg(F.count("*").alias("n"))


@query("", f"WITH {_PARTS} SELECT k, intent, {_SHOWN} AS passages, array_to_string(CASE WHEN speaker IS NULL THEN words ELSE list_filter(words, lambda w: w NOT IN (SELECT unnest(string_split(lower(speaker), ' ')))) END, ' ') AS keywords, concat_ws(' ', 'term:' || entity, 'strongs:G' || lpad(substr(code, 2), 4, '0')) AS tags, speaker FROM i".replace("list_filter(words, lambda w: w NOT IN (SELECT unnest(string_split(lower(speaker), ' '))))", "list_filter(words, lambda w: NOT list_contains(string_split(lower(speaker), ' '), w))"))
def fn_28_analysis(t):
    return _analysed(t).select("k", "intent", _spans().alias("passages"), F.array_join("keywords", " ").alias("keywords"), F.array_join("tags", " ").alias("tags"), "speaker")


_STOPPED = {"eng": "the and for with this that from was are", "deu": "der die das und", "fra": "les des que une", "spa": "los las una por que"}


@query("", "WITH s AS (SELECT * FROM (VALUES " + ", ".join(f"('{lang}', '{w}')" for lang, ws in (("eng", ("the", "and", "for", "with", "this", "that", "from", "was", "are")), ("deu", ("der", "die", "das", "und")), ("fra", ("les", "des", "que", "une")), ("spa", ("los", "las", "una", "por", "que"))) for w in ws) + r") t(lang, word)), d AS (SELECT doc_id, text, CASE doc_id % 11 WHEN 0 THEN 'мир ' WHEN 1 THEN 'سلام ' WHEN 2 THEN 'शांति ' WHEN 3 THEN 'শান্তি ' WHEN 4 THEN 'שלום ' ELSE '' END AS head FROM documents), w AS (SELECT doc_id, len(regexp_extract_all(lower(text), '\pL{2,}')) AS n, unnest(regexp_extract_all(lower(text), '\pL{2,}')) AS word FROM d WHERE head = ''), h AS (SELECT doc_id, n, lang, count(*) AS hits FROM w JOIN s USING (word) GROUP BY ALL), b AS (SELECT doc_id, arg_min(lang, (-hits, lang)) AS lang, max(hits) / any_value(n) AS share FROM h GROUP BY doc_id) SELECT d.doc_id, CASE head WHEN 'мир ' THEN 'rus' WHEN 'سلام ' THEN 'arb' WHEN 'शांति ' THEN 'hin' WHEN 'শান্তি ' THEN 'ben' WHEN 'שלום ' THEN 'heb' ELSE CASE WHEN share >= 0.15 THEN lang ELSE 'eng' END END AS language FROM d LEFT JOIN b USING (doc_id)")
def fn_13_detect_language(t):
    heads = ("мир ", "سلام ", "शांति ", "শান্তি ", "שלום ")
    head = F.lit("")
    for i, h in enumerate(heads):
        head = F.when(F.col("doc_id") % 11 == i, h).otherwise(head)
    stops = t.spark.createDataFrame([(lang, w) for lang, ws in _STOPPED.items() for w in ws.split()], "lang string, word string")
    return intents.detected(t.dealt("documents", "doc_id", "text").select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("text")), "doc_id", "text", stops)
