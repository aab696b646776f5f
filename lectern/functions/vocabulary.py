"""Fixed values of question analysis in English: words, relations and the shapes that give an intent away.

Other languages are a :class:`Vocabulary` of their own; what they leave out stays English.
"""

from __future__ import annotations

from dataclasses import dataclass, field

#: Function words and words about the text itself that carry no meaning of their own in a question.
STOPWORDS = (
    "a about above all also an and any are as at be been being below between bible book but by chapter did do does down explain explaining for from give had has have he her his how i if in into is it its "
    "just least less me mean meaning means mine more most my no not of off on only or our out over passage passages said say saying says scripture scriptures she show so some such tell telling testament than "
    "that the their them then these they this those to too under us verse verses very was we were what when where which who whom whose why with yes you your"
).split()
#: Words that frame a question without being its subject.
FRAMES = "different differing kinds sorts speak speaks speaking talk talks say says said mention mentions discuss discusses describe describes".split()
#: Words that are no topic.
TOPIC_STOPWORDS = "all any some the these this".split()
#: Relation words and the edges they follow; ``-rev`` asks for the other end.
RELATIONS = {
    "brother": "sibling-of", "child": "father-of", "children": "father-of", "daughter": "father-of", "father": "father-of-rev", "husband": "partner-of", "mother": "mother-of-rev", "parent": "father-of-rev",
    "parents": "father-of-rev", "partner": "partner-of", "sibling": "sibling-of", "sister": "sibling-of", "son": "father-of", "spouse": "partner-of", "wife": "partner-of",
}
#: English suffixes of the naive stripper, in the order they are tried.
SUFFIXES = ("d", "s", "es", "ed", "ing", "er", "est", "ly", "ness")
#: Speakers that are also ordinary framing of a question.
GENERIC_SPEAKERS = ("scripture", "scriptures", "prophet", "prophets", "psalmist", "prophetess")
SPEECH = r"(?:say|says|said|saying|speak|speaks|spoke|teach|teaches|taught|command|commands|commanded|declare|declares|declared|promis\w+|replied|replies|answered|answers|asks|asked|preach\w*|tells|told)"
#: Fixed value: a character of a word in any script.
WORD = r"[^\s\d_.,:;!?()\[\]{}«»\"'“”’/\\।॥–—…]"
#: The shapes of questions. Each list is tried in order; the part is the last group of an entity's shape, and the first group that is there of the others.
ENTITY = (
    r"^who (?:is|are|was|were)\s+(?:the\s+)?(['\"]?)([A-Za-z][\w-]+)\1\??\s*$",
    r"^what (?:is|are|was|were)\s+(?:the\s+|a\s+|an\s+)?(['\"]?)([a-z][\w-]+)\1\??\s*$",
    r"^what does\s+(?:the term\s+)?(['\"]?)([a-z][\w-]+)\1\s+mean\??\s*$",
    r"^tell me about\s+(?:the\s+)?(['\"]?)([A-Za-z][\w-]+)\1\??\s*$",
    r"^define\s+(['\"]?)([A-Za-z][\w-]+)\1\??\s*$",
)
BOOK_CONTEXT = r"\b(?:in|of|from|throughout|according\s+to|the\s+book\s+of|the\s+letter(?:s)?\s+(?:to|from)|the\s+gospel\s+of)\s+((?:[123]\s*)?[A-Za-z]+)\b"
METHODOLOGY = r"\b(?:translate|translating|translation|translated|figs-[a-z]+|how\s+(?:do|should|can|to)\s+(?:i|we|one|it|you))\b"
WORD_STUDY = (
    r"\b(?:(?:greek|hebrew)\s+word\s+([A-Za-z]{2,})|(?:meaning\s+of\s+)?([A-Za-z]{2,})\s+in\s+(?:greek|hebrew)|strong'?s?\s+(?:number\s+)?([GH]\d{1,5})|look\s+up\s+(?:strong'?s?\s+)?(?:number\s+)?([GH]\d{1,5})"
    r"|lexicon\s+(?:entry|definition)\s+(?:for|of)\s+(?:the\s+)?(?:greek\s+|hebrew\s+)?(?:word\s+)?([A-Za-z]{2,}|[GH]\d+)|(?:BDB|LSJ|Abbott[\s-]?Smith|TBESH|TBESG)\s+(?:definition|entry)\s+(?:of|for)\s+([HG]\d+|[A-Za-z]{2,}))\b"
)
MORPHOLOGY = r"\b(?:morphology\s+of|what\s+(?:tense|case|gender|mood|voice)\s+is|parse\s+(?:the\s+word|this\s+verse)|word.by.word\s+(?:parse|breakdown|analysis))\b"
GENEALOGY = r"\b(father|mother|parents?|son|daughter|child(?:ren)?|wife|husband|spouse|partner|brother|sister|sibling)\s+of\s+(?:the\s+)?(['\"]?)([A-Z][a-zA-Z'-]+)\2"
POSSESSIVE = r"\b([A-Z][a-zA-Z'-]+?)'s\s+(father|mother|son|daughter|wife|husband|spouse|partner|brother|sister|child(?:ren)?|parents?)\b"
TOPIC = (
    r"\b(?:(?:what|which)\s+(?:does\s+|do\s+|did\s+)?(?:the\s+)?bible\s+say\s+about\s+(.+?)(?:\?|$)|(?:bible\s+)?(?:verses|scriptures|passages)\s+(?:about|on|concerning|regarding)\s+(.+?)(?:\?|$)"
    r"|(?:show\s+me\s+)?(?:bible\s+)?verses\s+(?:about|on)\s+(.+?)(?:\?|$)|what\s+(?:scripture|scriptures|verses)\s+(?:are\s+)?about\s+(.+?)(?:\?|$))"
)
XREF = (
    r"\b(?:cross.?references?\s+(?:for|to)\s+(.+?)(?:\?|$)|parallel\s+passages?\s+(?:for|to)\s+(.+?)(?:\?|$)|related\s+(?:verses?|passages?)\s+(?:to|with|for)\s+(.+?)(?:\?|$)"
    r"|what\s+other\s+(?:verses?|passages?)\s+(?:relate\s+to|are\s+(?:like|similar))\s+(.+?)(?:\?|$)|see\s+also\s+(?:for\s+)?(.+?)(?:\?|$))"
)
#: The scripts that settle a language at once, in the order they are tried.
SCRIPTS = (("rus", r"[\x{0400}-\x{04FF}]"), ("arb", r"[\x{0600}-\x{06FF}]"), ("hin", r"[\x{0900}-\x{097F}]"), ("ben", r"[\x{0980}-\x{09FF}]"), ("heb", r"[\x{0590}-\x{05FF}]"))


@dataclass(frozen=True)
class Vocabulary:
    """What the analysis of one language goes by."""

    stopwords: tuple[str, ...] = tuple(STOPWORDS)
    frames: tuple[str, ...] = tuple(FRAMES)
    topic_stopwords: tuple[str, ...] = tuple(TOPIC_STOPWORDS)
    relations: dict[str, str] = field(default_factory=lambda: dict(RELATIONS))
    entity: tuple[str, ...] = ENTITY
    book_context: str = BOOK_CONTEXT
    methodology: str = METHODOLOGY
    word_study: str = WORD_STUDY
    morphology: str = MORPHOLOGY
    genealogy: str = GENEALOGY
    possessive: str = POSSESSIVE
    topic: str = TOPIC
    xref: str = XREF
    drops_article: bool = False


ENGLISH = Vocabulary()
