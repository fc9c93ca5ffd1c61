"""Stemming by Porter's algorithm (1980), applied to a column's distinct words only."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Suffixes and what replaces them, longest first where one ends another.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
_PLAIN = re.compile("[a-z]{3,}")


def _kinds(w: str) -> str:
    """c and v for each letter: y is a vowel after a consonant."""
    out = ""
    for ch in w:
        out += "v" if ch in "aeiou" or ch == "y" and out.endswith("c") else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _kinds(w)))


def _ends_cvc(w: str) -> bool:
    return _kinds(w).endswith("cvc") and w[-1] not in "wxy"


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _kinds(w)[-1] == "c"


def stem(w: str) -> str:
    """Words of other letters than a-z, and of fewer than three, stay."""
    if not _PLAIN.fullmatch(w):
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: -len(end)] + new
            break
    again = False
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and "v" in _kinds(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and not w.endswith("eed") and "v" in _kinds(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _ends_cvc(w):
            w += "e"
    if w.endswith("y") and "v" in _kinds(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP2, STEP3):
        hit = max((r for r in rules if w.endswith(r[0])), key=lambda r: len(r[0]), default=None)
        if hit and _measure(w[: -len(hit[0])]) > 0:
            w = w[: -len(hit[0])] + hit[1]
    hit = max((s for s in STEP4 if w.endswith(s)), key=len, default=None)
    if hit and _measure(w[: -len(hit)]) > 1 and (hit != "ion" or w[-4] in "st"):
        w = w[: -len(hit)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _ends_cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.StringType())
def stem_column(words: pd.Series) -> pd.Series:
    known = {w: stem(w) for w in words.dropna().unique()}
    return words.map(known)


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_arrays(texts: pd.Series) -> pd.Series:
    """The words of each text stemmed, in their places: no word leaves its row, and a batch's distinct words are stemmed once."""
    known: dict[str, str] = {}

    def one(w: str) -> str:
        if (s := known.get(w)) is None:
            s = known[w] = stem(w)
        return s

    return texts.map(lambda words: None if words is None else [one(w) for w in words])
