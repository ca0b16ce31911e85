"""Porter's suffix stripping (1980): as column expressions, for tables of distinct terms, and of one word, for tasks that read texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: Stems of measure above 0, exactly 1, above 1; with a vowel; with a final consonant-vowel-consonant.
_M0, _M1, _MM = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$", f"^({_C})?{_V}{_C}{_V}{_C}"
_VOWEL, _CVC = f"^({_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"

# Fixed values of the published algorithm: suffixes with what replaces them.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
# End of the fixed values.


def _cut(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.greatest(F.lit(0), F.length(w) - n))


def _longest(w: Column, table: tuple[tuple[str, str], ...], measure: str) -> Column:
    """The longest suffix of the table decides, whether or not its stem is long enough."""
    out = w
    for suffix, to in sorted(table, key=lambda x: len(x[0])):  # the last test made is the longest suffix's
        stem = _cut(w, len(suffix))
        out = F.when(w.endswith(suffix), F.when(stem.rlike(measure), F.concat(stem, F.lit(to))).otherwise(w)).otherwise(out)
    return out


def steps() -> list:
    """Functions of a term, to be applied one after the other."""

    def plural(w):
        return F.when(w.endswith("sses") | w.endswith("ies"), _cut(w, 2)).when(w.endswith("s") & ~w.endswith("ss"), _cut(w, 1)).otherwise(w)

    def past(w):
        bare = F.when(w.endswith("ed"), _cut(w, 2)).when(w.endswith("ing"), _cut(w, 3))
        whole = (
            F.when(bare.rlike("(at|bl|iz)$"), F.concat(bare, F.lit("e")))
            .when(bare.rlike(r"([^aeiouylsz])\1$"), _cut(bare, 1))
            .when(bare.rlike(_CVC), F.concat(bare, F.lit("e")))
            .otherwise(bare)
        )
        agreed = F.when(_cut(w, 3).rlike(_M0), _cut(w, 1)).otherwise(w)
        return F.when(w.endswith("eed"), agreed).when(bare.isNotNull() & bare.rlike(_VOWEL), whole).otherwise(w)

    def final_y(w):
        stem = _cut(w, 1)
        return F.when(w.endswith("y") & stem.rlike(_VOWEL), F.concat(stem, F.lit("i"))).otherwise(w)

    def endings(w):
        out = _longest(w, tuple((s, "") for s in STEP_4), _MM)
        stem = _cut(w, 3)
        return F.when(w.endswith("ion") & stem.rlike("[st]$"), F.when(stem.rlike(_MM), stem).otherwise(w)).otherwise(out)

    def final_e(w):
        stem = _cut(w, 1)
        return F.when(w.endswith("e") & (stem.rlike(_MM) | (stem.rlike(_M1) & ~stem.rlike(_CVC))), stem).otherwise(w)

    def double_l(w):
        return F.when(w.endswith("ll") & w.rlike(_MM), _cut(w, 1)).otherwise(w)

    return [plural, past, final_y, lambda w: _longest(w, STEP_2, _M0), lambda w: _longest(w, STEP_3, _M0), endings, final_e, double_l]


_m0, _m1, _mm, _vowel, _cvc = (re.compile(p).search for p in (_M0, _M1, _MM, _VOWEL, _CVC))
_e_again, _double, _s_or_t = (re.compile(p).search for p in ("(at|bl|iz)$", r"([^aeiouylsz])\1$", "[st]$"))
_TABLES = [(tuple(x[0] for x in table), sorted(table, key=lambda x: -len(x[0])), measure) for table, measure in ((STEP_2, _m0), (STEP_3, _m0), ([(s, "") for s in STEP_4], _mm))]


def _replaced(w: str, step: int) -> str:
    suffixes, table, measure = _TABLES[step]
    if w.endswith(suffixes):
        suffix, to = next(x for x in table if w.endswith(x[0]))
        stem = w[: -len(suffix)]
        return stem + to if measure(stem) else w
    return w


def porter_stem(w: str) -> str:
    """What ``steps`` make of a lower-case word; words of fewer than three characters stay."""
    if len(w) < 3:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _m0(w[:-3]) else w
    elif w.endswith(("ed", "ing")):
        bare = w[:-2] if w.endswith("ed") else w[:-3]
        if _vowel(bare):
            w = bare + "e" if _e_again(bare) else bare[:-1] if _double(bare) else bare + "e" if _cvc(bare) else bare
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, 0), 1)
    stem = w[:-3]
    if w.endswith("ion") and _s_or_t(stem):
        w = stem if _mm(stem) else w
    else:
        w = _replaced(w, 2)
    if w.endswith("e") and (_mm(w[:-1]) or (_m1(w[:-1]) and not _cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _mm(w) else w
