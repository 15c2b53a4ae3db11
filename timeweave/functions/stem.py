"""Porter's suffix-stripping algorithm (1980) over the distinct words of a table.

The vocabulary is stemmed in an Arrow UDF, a word at a time, and joined to the
rows; no row's text passes through Python.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The suffix rules of steps 2-4 of the published algorithm.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]

_RUNS = re.compile(r"v+c+")


def _shape(stem: str) -> str:
    """Vowel/consonant pattern; y is a vowel after a consonant."""
    out = []
    for i, ch in enumerate(stem):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(_RUNS.findall(_shape(stem)))


def _short_end(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    w = word
    # plurals
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # past and gerund
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and "v" in _shape(w[: -len(s)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP2, STEP3):
        found = _longest(w, rules)
        if found and _measure(w[: -len(found)]) > 0:
            w = w[: -len(found)] + rules[found]
    found = _longest(w, STEP4)
    if found and _measure(w[: -len(found)]) > 1 and (found != "ion" or w[: -len(found)].endswith(("s", "t"))):
        w = w[: -len(found)]
    # final e and double l
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def _stem_words(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else stem(w))


def stem_word(word: Column) -> Column:
    """Stem of a single word; meant for tables of distinct words."""
    return F.pandas_udf(_stem_words, T.StringType())(word)


#: Copies of a vocabulary, so that a word that most rows hold meets its stem in as many tasks.
SPREAD = 16


def with_stems(rows: DataFrame, word: str, keys: Sequence[str], name: str = "stem") -> DataFrame:
    """``rows`` with the stem of a word column: each distinct word is stemmed once and joined; null stays null."""
    slots = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    vocabulary = rows.select(F.col(word).alias("_word")).filter("_word IS NOT NULL").distinct().withColumn(name, stem_word(F.col("_word"))).withColumn("_copy", slots)
    placed = rows.withColumn("_slot", F.pmod(F.xxhash64(*keys), F.lit(SPREAD)).cast("int"))
    return placed.join(vocabulary, (F.col(word) == F.col("_word")) & (F.col("_slot") == F.col("_copy")), "left").drop("_word", "_copy", "_slot")
