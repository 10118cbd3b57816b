"""English stems (the published Snowball English rules) for distinct terms."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words of full-text search.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she "
    "her hers herself it its itself they them their theirs themselves what which who whom this that "
    "these those am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here "
    "there when where why how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don should now"
).split()

# Words with irregular stems, words that stay, words that stay after step 1a.
_IRREGULAR = {
    "skis": "ski",
    "skies": "sky",
    "dying": "die",
    "lying": "lie",
    "tying": "tie",
    "idly": "idl",
    "gently": "gentl",
    "ugly": "ugli",
    "early": "earli",
    "only": "onli",
    "singly": "singl",
}
_UNCHANGED = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_UNCHANGED_AFTER_1A = {
    "inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed",
}

# Suffix tables of steps 2, 3 and 4.
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "fulli": "ful", "lessli": "less",
}
_STEP3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic",
    "ical": "ic", "ful": "", "ness": "",
}
_STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism",
    "ate", "iti", "ous", "ive", "ize",
)

_VOWEL = "aeiouy"
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_DOUBLE_END = re.compile(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _regions(word: str) -> tuple[int, int]:
    prefix = re.match(r"gener|commun|arsen", word)
    first = _REGION.search(word)
    r1 = prefix.end() if prefix else first.end() if first else len(word)
    second = _REGION.search(word, r1)
    return r1, second.end() if second else len(word)


def _step1(word: str, r1: int) -> str:
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")):
        if any(c in _VOWEL for c in word[:-2]):
            word = word[:-1]
    if word in _UNCHANGED_AFTER_1A:
        return word

    suffix = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if suffix in ("eed", "eedly"):
        if len(word) - len(suffix) >= r1:
            word = word[: -len(suffix)] + "ee"
    elif suffix and any(c in _VOWEL for c in word[: -len(suffix)]):
        word = word[: -len(suffix)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _DOUBLE_END.search(word):
            word = word[:-1]
        elif r1 >= len(word) and _SHORT_END.search(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWEL:
        word = word[:-1] + "i"
    return word


def _step234(word: str, r1: int, r2: int) -> str:
    suffix = _longest(word, (*_STEP2, "ogi", "li"))
    if suffix and len(word) - len(suffix) >= r1:
        if suffix in _STEP2:
            word = word[: -len(suffix)] + _STEP2[suffix]
        elif suffix == "ogi" and word.endswith("logi"):
            word = word[:-1]
        elif suffix == "li" and len(word) > 2 and word[-3] in "cdeghkmnrt":
            word = word[:-2]
    suffix = _longest(word, (*_STEP3, "ative"))
    if suffix and len(word) - len(suffix) >= r1:
        if suffix in _STEP3:
            word = word[: -len(suffix)] + _STEP3[suffix]
        elif len(word) - len(suffix) >= r2:
            word = word[: -len(suffix)]
    suffix = _longest(word, (*_STEP4, "ion"))
    if suffix and len(word) - len(suffix) >= r2:
        if suffix != "ion" or word.endswith(("sion", "tion")):
            word = word[: -len(suffix)]
    return word


def english_stem(word: str) -> str:
    if len(word) <= 2 or word in _UNCHANGED:
        return word
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word.lstrip("'"))
    r1, r2 = _regions(word)
    word = _step1(word, r1)
    if word not in _UNCHANGED_AFTER_1A:
        word = _step234(word, r1, r2)
        if word.endswith("e"):
            at = len(word) - 1
            if at >= r2 or (at >= r1 and not _SHORT_END.search(word[:-1])):
                word = word[:-1]
        elif word.endswith("ll") and len(word) - 1 >= r2:
            word = word[:-1]
    return word.replace("Y", "y")


def stem_terms(term: Column) -> Column:
    """Stem of a term column. Meant for a column of distinct terms, not for running text."""

    @F.pandas_udf("string")
    def stems(terms: pd.Series) -> pd.Series:
        return terms.map(english_stem, na_action="ignore")

    # A filter on a stem must not be moved below the step that makes the terms distinct.
    return stems.asNondeterministic()(term)
