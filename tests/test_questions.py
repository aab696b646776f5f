"""Question analysis: shapes, precedence, speakers, languages."""

import pytest

from lectern.functions.vocabulary import FRAMES, STOPWORDS, SUFFIXES
from lectern.operators import intents

ASKED = {
    "cross-references for Romans 5:1": ("xref", 45005001), "see also love in JHN 3:16-18": ("xref", 43003016), "parallel passages to nothing": ("thematic", None),
    "Who is the father of David?": ("genealogy", ("David", "father-of-rev")), "Boaz's wife": ("genealogy", ("Boaz", "partner-of")), "children of the 'Israel'": ("genealogy", ("Israel", "father-of")),
    "What does the Greek word AGAPE mean?": ("word_study", ["agape"]), "Strong's number G26": ("word_study", ["G0026"]), "BDB definition of H7225": ("word_study", ["H7225"]),
    "what tense is said": ("morphology", None), "morphology of John 1:1": ("morphology", None),
    "What does the Bible say about the covenant?": ("topic", "covenant"), "verses about a very long and winding tale": ("thematic", None), "verses on any": ("thematic", None),
    "Who was Boaz?": ("entity_lookup", ["term:boaz"]), "What is 'grace'?": ("entity_lookup", ["term:grace"]), "what does godliness mean?": ("entity_lookup", ["term:godliness"]), "who is he": ("thematic", []),
    "How should we translate mercy here and there": ("methodology", None), "what is figs-metaphor for": ("methodology", None),
    "summarize ROM 3:24-4:2": ("passage_specific", [(45003024, 45004002)]), "summarize ROM 3:4-8 now": ("passage_specific", [(45003004, 45003008)]), "chapter 1 Samuel 2": ("passage_specific", [(9002001, 9002999)]),
    "mercy according to Titus": ("passage_book", [(56001001, 56999999)]), "what is he in love": ("thematic", []),
    "what did Simon Peter say about faith": ("speaker", "Simon Peter"), "the words of Peter": ("speaker", "Peter"), "the faith of Peter": ("thematic", None), "what did Peter say in ACT 2:1": ("passage_specific", [(44002001, 44002001)]), "what does scripture say of hope": ("thematic", None),
    "": ("thematic", []), None: ("thematic", []),
}


@pytest.fixture(scope="module")
def found(spark):
    asked = list(ASKED)
    df = spark.createDataFrame(list(enumerate(asked)), "id long, text string")
    names = spark.createDataFrame([("Peter",), ("Simon Peter",), ("scripture",)], "name string")
    return {asked[r["id"]]: r for r in intents.analysed(df, "id", "text", names).collect()}


@pytest.mark.parametrize("question", list(ASKED))
def test_intent(found, question):
    kind, part = ASKED[question]
    r = found[question]
    assert r["intent"] == kind
    if kind == "genealogy":
        assert (r["related"]["name"], r["related"]["relation"]) == part
    elif kind == "word_study":
        assert r["words"] + r["codes"] == part
    elif kind == "entity_lookup":
        assert r["tags"] == part
    elif kind.startswith("passage"):
        assert [tuple(p) for p in r["passages"]] == part
    elif kind in ("xref", "topic", "speaker"):
        assert {"xref": r["xref_source"], "topic": r["topic"], "speaker": r["speaker"]}[kind] == part


def test_all_intents_are_met():
    assert len({k for k, _ in ASKED.values()}) == 11


def test_keywords(found):
    assert found["what did Simon Peter say about faith"]["keywords"] == ["faith"]
    assert found["Who was Boaz?"]["keywords"] == ["boaz"]


def test_fixed_values():
    assert (len(STOPWORDS), len(FRAMES), SUFFIXES) == (113, 18, ("d", "s", "es", "ed", "ing", "er", "est", "ly", "ness"))


def test_languages(spark):
    stops = spark.createDataFrame([("eng", "the"), ("eng", "and"), ("deu", "der"), ("deu", "und"), ("fra", "la"), ("spa", "la")], "lang string, word string")
    texts = {"der Hund und the": "deu", "привет the and": "rus", "שלום": "heb", "la casa": "fra", "Boaz": "eng", "": "eng", None: "eng", "und " + "wort " * 9: "eng"}
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert {r["id"]: r["language"] for r in intents.detected(df, "id", "text", stops).collect()} == dict(enumerate(texts.values()))
