"""Text, code and tag expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.vocabulary import SUFFIXES

TERM = "[a-zà-öø-ÿß]{3,}"
#: Function words of four languages that the queries over the given tables drop; a parameter of the functions below.
STOPWORDS = ("the", "and", "for", "with", "this", "that", "from", "was", "are", "der", "die", "das", "und", "les", "des", "que", "los", "las", "una", "por")
#: Legacy language codes and their ISO 639-3 forms.
LANGUAGES = {"en": "eng", "de": "deu", "es": "spa", "fr": "fra", "he": "heb", "el": "grc"}


#: White space that DuckDB's trim drops: Unicode's space separators.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Characters whose upper case has several letters ("SS"), with the one that stands for it, if there is one, else themselves.
_SEVERAL = {c: c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x80, 0xFFFF)) if len(c.upper()) > 1} | {"ß": "ẞ"}


def initial(text: Column) -> Column:
    """The first character in upper case, always one character."""
    c = F.substring(text, 1, 1)
    return F.when(F.length(F.upper(c)) <= 1, F.upper(c)).otherwise(F.translate(c, "".join(_SEVERAL), "".join(_SEVERAL.values())))


def terms(text: Column) -> Column:
    """Lower-cased words of three letters and more."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def keywords(text: Column, stop: tuple[str, ...] = STOPWORDS) -> Column:
    """Distinct terms without stopwords, in order."""
    return F.array_except(F.array_distinct(terms(text)), F.array(*map(F.lit, stop)))


def concordance_words(text: Column, stop: tuple[str, ...] = STOPWORDS) -> Column:
    """Distinct English words, inner apostrophes kept, of three characters and more."""
    found = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]+(?:'[A-Za-z]+)?"), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(*stop)))


def excerpt(text: Column, most: int = 240) -> Column:
    """White space collapsed; beyond ``most`` characters cut, right-trimmed, with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…"))).otherwise(flat)


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def strip_suffix(word: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The word without the first of the suffixes that leaves more than two letters; itself without one."""
    tried = [F.when(word.endswith(s) & (F.length(word) > len(s) + 2), F.substring(word, F.lit(1), F.length(word) - len(s))) for s in suffixes]
    return F.coalesce(*tried, word)


def known_stem(word: Column, known: Column) -> Column:
    """The word if the map or array ``known`` has it, else the first of its stripped forms that it has, else null."""
    forms = [word, *[F.when(word.endswith(s) & (F.length(word) > len(s) + 2), F.substring(word, F.lit(1), F.length(word) - len(s))) for s in SUFFIXES]]
    return F.coalesce(*[F.when(F.array_contains(known, f), f) for f in forms])


def gloss(text: Column) -> Column:
    """A gloss without brackets, punctuation and function words."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(text), r"\([^)]*\)|\[[^\]]*\]", " "), r"[^a-z ]+", " ")
    return F.array_join(F.filter(F.split(F.trim(flat), " +"), lambda w: (w != "") & ~w.isin("a", "an", "the", "to", "of", "be")), " ")


def lexical_code(code: Column) -> Column:
    """Prefix upper-cased, number padded to four digits (never cut), sense suffix dropped; null if malformed."""
    letter, number = F.regexp_extract(code, r"^([GHgh])0*(\d+)", 1), F.regexp_extract(code, r"^([GHgh])0*(\d+)", 2)
    return F.when(letter != "", F.concat(F.upper(letter), F.lpad(number, F.greatest(F.lit(4), F.length(number)), "0")))


def code_variants(code: Column) -> dict[str, Column]:
    """The other spellings of a code: with suffix, of a bare number, unpadded, and the first four Greek digits."""
    number = F.regexp_extract(code, r"^[GHgh]?0*(\d+)", 1)
    pad = lambda c: F.lpad(c, F.greatest(F.lit(4), F.length(c)), "0")
    return {
        "suffixed": F.concat(lexical_code(code), F.regexp_extract(code, r"^[GHgh]\d+([a-z]?)", 1)),
        "bare": F.when(code.rlike(r"^\d+$"), F.concat(F.lit("H"), pad(number))).otherwise(lexical_code(code)),
        "unpadded": F.concat(F.upper(F.substring(code, 1, 1)), number),
        "greek4": F.when(code.rlike(r"^[Gg]\d{5}"), F.concat(F.lit("G"), F.substring(code, 2, 4))).otherwise(lexical_code(code)),
    }


def language(tag: Column) -> Column:
    """Canonical three-letter tag; unknown tags pass through."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[F.lower(tag)], tag)


def first_tag(tags: Column, prefix: str) -> Column:
    """Value of the first tag with a prefix."""
    return F.substring(F.get(F.filter(tags, lambda t: t.startswith(prefix)), F.lit(0)), len(prefix) + 1, 1000)


def all_tags(tags: Column, prefix: str) -> Column:
    return F.filter(tags, lambda t: t.startswith(prefix))


def fold(text: Column) -> Column:
    """Latin-1 accents folded to plain letters."""
    return F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def ascii_digits(text: Column) -> Column:
    """Arabic-Indic, Persian and Devanagari digits as ASCII ones."""
    return F.translate(text, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९", "0123456789" * 3)


def alias(text: Column) -> Column:
    """A book alias for look-ups: no Arabic marks, white space or periods, ASCII digits, lower case."""
    return F.regexp_replace(F.lower(ascii_digits(text)), r"[\x{064B}-\x{065F}\s.]+", "")


def _measure(stem: str) -> int:
    """Number of vowel-consonant sequences of a stem."""
    form = ""
    for i, c in enumerate(stem):
        vowel = c in "aeiou" or (c == "y" and i > 0 and stem[i - 1] not in "aeiou")
        form += "v" if vowel else "c"
    return sum(1 for a, b in zip(form, form[1:]) if a == "v" and b == "c")


def _vowel(stem: str) -> bool:
    return any(c in "aeiou" or (c == "y" and i > 0) for i, c in enumerate(stem))


def _short(word: str) -> bool:
    return len(word) > 2 and word[-1] not in "aeiouwxy" and word[-2] in "aeiouy" and word[-3] not in "aeiou"


#: The published rules of Porter (1980), steps 2 to 4.
_STEP2 = dict(zip("ational tional enci anci izer abli alli entli eli ousli ization ation ator alism iveness fulness ousness aliti iviti biliti".split(), "ate tion ence ance ize able al ent e ous ize ate ate al ive ful ous al ive ble".split()))
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def porter(word: str) -> str:
    """The stem of an English word, after the published algorithm."""
    if len(word) <= 2 or not word.isascii():
        return word
    for suffix, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + to
            break
    again = False
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix):
                if _vowel(word[: -len(suffix)]):
                    word, again = word[: -len(suffix)], True
                break
    if again:
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and word[-1] not in "aeioulsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and _vowel(word[:-1]):
        word = word[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        for suffix in sorted(rules, key=len, reverse=True):
            if word.endswith(suffix):
                if _measure(word[: len(word) - len(suffix)]) > 0:
                    word = word[: len(word) - len(suffix)] + rules[suffix]
                break
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def porter_stem(words: Column | str) -> Column:
    """Porter stems; meant for the distinct vocabulary, joined back."""

    def stems(batch: pd.Series) -> pd.Series:
        return batch.map(lambda w: None if w is None else porter(w))

    return F.pandas_udf(stems, "string")(words)
