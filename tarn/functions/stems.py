"""English stemming (Porter's second algorithm, as published with Snowball) of terms, each different one once a batch."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

V = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Words with stems of their own, words left as they are (also after step 1a), and starts whose first region is theirs.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
LATER = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STARTS = ("gener", "commun", "arsen")
# Suffixes of steps 2, 3 and 4 (longest first) and what replaces them.
STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")]
STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()


def _region(w: str, at: int) -> int:
    """Behind the first non-vowel that follows a vowel, from ``at`` on."""
    for i in range(at + 1, len(w)):
        if w[i] not in V and w[i - 1] in V:
            return i + 1
    return len(w)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in V and w[1] not in V
    return len(w) > 2 and w[-1] not in V + "wxY" and w[-2] in V and w[-3] not in V


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    w = word.removeprefix("'")
    if len(w) <= 2:
        return w
    if w in SPECIAL:
        return SPECIAL[w]
    w = re.sub(rf"(^|(?<=[{V}]))y", "Y", w)
    r1 = next((len(s) for s in STARTS if w.startswith(s)), None)
    r1 = _region(w, 0) if r1 is None else r1
    r2 = _region(w, r1)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in V for c in w[:-2]):
        w = w[:-1]
    if w in LATER:
        return w
    # 1b
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(s):
            if s in ("eedly", "eed"):
                w = w[: -len(s)] + "ee" if len(w) - len(s) >= r1 else w
            elif any(c in V for c in w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(_DOUBLE):
                    w = w[:-1]
                elif r1 >= len(w) and _short_end(w):
                    w += "e"
            break
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in V:
        w = w[:-1] + "i"
    # 2
    for s, new in STEP2:
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                before = w[: -len(s)]
                if s == "ogi":
                    w = before + new if before.endswith("l") else w
                elif s == "li":
                    w = before if before[-1:] in tuple("cdeghkmnrt") else w
                else:
                    w = before + new
            break
    # 3
    for s, new in STEP3:
        if w.endswith(s):
            if len(w) - len(s) >= (r2 if s == "ative" else r1):
                w = w[: -len(s)] + new
            break
    # 4
    for s in STEP4:
        if w.endswith(s):
            if len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(s)]
            break
    # 5
    if w.endswith("e"):
        if len(w) > r2 or len(w) > r1 and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.replace("Y", "y")


STEMMERS = {"english": stem}


def stemmed(rows: DataFrame, column: str, language: str) -> DataFrame:
    """The rows with stems in place of the words of a column: batches of Arrow, each different word of one once."""
    f = STEMMERS[language]

    @F.pandas_udf("string")
    def stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for words in batches:
            codes, different = pd.factorize(words)
            yield pd.Series([f(w) for w in different], dtype=object).take(codes).reset_index(drop=True)

    return rows.withColumn(column, stems(F.col(column)))
