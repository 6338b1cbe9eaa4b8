"""English stems by the published Porter algorithm (M. F. Porter, An algorithm for suffix stripping, 1980)."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

# The suffixes of the published steps with what replaces them, longest first where one ends another.
_STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
           ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou"]


def _shape(word: str) -> str:
    """The word as c and v: y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or c == "y" and i > 0 and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _replaced(word: str, rules: list[tuple[str, str]], fits: Callable[[str], bool]) -> str:
    """The first suffix that the word has decides; it is replaced if the rest fits."""
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            return rest + new if fits(rest) else word
    return word


@lru_cache(200_000)
def porter(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters, or with other signs than a to z, stay as they are."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    word = _replaced(word, [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")], lambda r: True)
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        rest = word[:-2] if word.endswith("ed") else word[:-3] if word.endswith("ing") else ""
        if rest and "v" in _shape(rest):
            word = rest
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _shape(word).endswith("cc") and word[-1] == word[-2] and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(word, _STEP_2, lambda r: _measure(r) > 0)
    word = _replaced(word, _STEP_3, lambda r: _measure(r) > 0)
    for suffix in sorted(_STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest[-1:] in ("s", "t")):
                word = rest
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short_end(word[:-1])):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def stems(column: Column) -> Column:
    """Stems of a column of terms, in Arrow batches; meant for vocabularies, not for texts."""

    @pandas_udf("string")
    def run(terms: pd.Series) -> pd.Series:
        return terms.map(porter, na_action="ignore")

    return run(column)
