"""The English Snowball stemmer (Porter 2) for single lower-case terms, and the usual English stop words of full-text search."""

from __future__ import annotations

import re
from functools import lru_cache

# The stop words of the English text-search configuration.
STOP_WORDS = frozenset("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom
this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don should now
""".split())
# Fixed values of the published algorithm.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
WHOLE |= {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
# End of the fixed values.

_REGION = re.compile("[^aeiouy]*[aeiouy]+[^aeiouy]").match
_AFTER = re.compile("gener|commun|arsen").match
_VOWEL = re.compile("[aeiouy]").search
_SHORT = re.compile("(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$").search
_DOUBLE = re.compile("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$").search


def _ending(word: str, suffixes) -> str:
    """The longest of the suffixes that the word ends with, or nothing."""
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _regions(word: str) -> tuple[int, int]:
    """Where the regions behind the first, and behind the second vowel and consonant begin."""
    found = _AFTER(word) or _REGION(word)
    if not found:
        return len(word), len(word)
    second = _REGION(word[found.end() :])
    return found.end(), found.end() + second.end() if second else len(word)


@lru_cache(200_000)
def english_stem(word: str) -> str:
    """The stem of a lower-case word of letters a to z; other terms, and those of two letters or fewer, are their own stems."""
    if len(word) <= 2 or not (word.isascii() and word.isalpha()):
        return word
    if word in WHOLE:
        return WHOLE[word]
    word = re.sub("(?<=[aeiouy])y|^y", "Y", word)
    r1, r2 = _regions(word)
    # plurals
    suffix = _ending(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if suffix == "sses":
        word = word[:-2]
    elif suffix in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif suffix == "s" and _VOWEL(word[:-2]):
        word = word[:-1]
    if word in KEPT:
        return word
    # past and present forms
    suffix = _ending(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if suffix in ("eed", "eedly"):
        if len(word) - len(suffix) >= r1:
            word = word[: -len(suffix)] + "ee"
    elif suffix and _VOWEL(word[: -len(suffix)]):
        word = word[: -len(suffix)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _DOUBLE(word):
            word = word[:-1]
        elif r1 >= len(word) and _SHORT(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    # derivations, in the first region
    suffix = _ending(word, STEP_2)
    if suffix and len(word) - len(suffix) >= r1:
        before = word[: -len(suffix)][-1:]
        if (suffix != "ogi" or before == "l") and (suffix != "li" or before in tuple("cdeghkmnrt")):
            word = word[: -len(suffix)] + STEP_2[suffix]
    suffix = _ending(word, STEP_3)
    if suffix and len(word) - len(suffix) >= (r2 if suffix == "ative" else r1):
        word = word[: -len(suffix)] + STEP_3[suffix]
    # endings, in the second region
    suffix = _ending(word, STEP_4)
    if suffix and len(word) - len(suffix) >= r2 and (suffix != "ion" or word[: -len(suffix)].endswith(("s", "t"))):
        word = word[: -len(suffix)]
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _SHORT(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()
