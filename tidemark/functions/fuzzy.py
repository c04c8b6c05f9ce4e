"""Porter stems and Jaro-Winkler similarity: vectorised Python, meant for distinct terms (see `stems_of`)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOWELS = frozenset("aeiou")


def _consonant(w: str, i: int) -> bool:
    if w[i] in VOWELS:
        return False
    return w[i] != "y" or i == 0 or not _consonant(w, i - 1)


def _measure(w: str) -> int:
    """Vowel-consonant sequences."""
    kinds = [_consonant(w, i) for i in range(len(w))]
    return sum(b and not a for a, b in zip(kinds, kinds[1:], strict=False))


def _vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


# The suffix tables of Porter's algorithm.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


def porter(word: str) -> str:
    """Porter's 1980 algorithm; words below three letters are left as they are."""
    w = word
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _vowel(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and _vowel(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP_2, STEP_3):
        s = _longest(w, table)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = _longest(w, STEP_4)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if _measure(w) > 1 and w.endswith("ll"):
        w = w[:-1]
    return w


def jaro_winkler(a: str, b: str, scale: float = 0.1, prefix: int = 4) -> float:
    """Jaro similarity raised by up to ``prefix`` equal first characters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, left = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [y for y, t in zip(b, taken, strict=True) if t]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = 0
    for x, y in zip(a[:prefix], b[:prefix], strict=False):
        if x != y:
            break
        same += 1
    return jaro + same * scale * (1 - jaro)


def porter_stem(word: Column) -> Column:
    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(porter, na_action="ignore")

    return run(word)


def similarity(a: Column, b: Column) -> Column:
    """Jaro-Winkler; 0 if either has fewer than three characters."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([0.0 if p is None or q is None or len(p) < 3 or len(q) < 3 else jaro_winkler(p, q) for p, q in zip(x, y, strict=True)])

    return run(a, b)


def stems_of(terms: DataFrame, term: str = "term") -> DataFrame:
    """(term, stem) of distinct terms: Python sees each term once, the corpus is joined to the result."""
    return terms.select(term).distinct().withColumn("stem", porter_stem(F.col(term)))
