"""The Porter stemmer for English words, as a function on words and as a column."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

#: Suffixes of steps 2 and 3 with what they become, and those of step 4.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_ASCII = re.compile("[a-z]+")


def _shape(stem: str) -> str:
    """A letter for each one of the stem: ``v`` or ``c``; y is a vowel behind a consonant."""
    out = ""
    for letter in stem:
        out += "v" if letter in "aeiou" or (letter == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    """How often vowels are followed by consonants."""
    return len(re.findall("v+c+", _shape(stem)))


def _ends_short(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _replaced(word: str, table: dict[str, str]) -> str:
    suffix = max((s for s in table if word.endswith(s)), key=len, default=None)
    if suffix is None or not _measure(word[: -len(suffix)]):
        return word
    return word[: -len(suffix)] + table[suffix]


@lru_cache(200_000)
def stem(word: str) -> str:
    """Words of other letters than a to z, and words of one or two letters, stay."""
    if len(word) < 3 or not _ASCII.fullmatch(word):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        suffix = next((s for s in ("ed", "ing") if word.endswith(s) and "v" in _shape(word[: -len(s)])), "")
        if suffix:
            word = word[: -len(suffix)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _shape(word).endswith("cc") and word[-1] == word[-2] and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _ends_short(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP_2), STEP_3)
    suffix = max((s for s in STEP_4 if word.endswith(s)), key=len, default="")
    rest = word[: len(word) - len(suffix)]
    if suffix and _measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
        word = rest
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _ends_short(rest)):
            word = rest
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def stem_column(word: Column) -> Column:
    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(stem, na_action="ignore")

    return run(word)


def stems_column(words: Column) -> Column:
    """The stems of an array of words; each distinct word of a batch is stemmed once."""

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        known = lists.flatten().dictionary_encode()
        stems = pa.array([w if w is None else stem(w) for w in known.dictionary.to_pylist()], pa.string()).take(known.indices)
        ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int32()))
        return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), stems, mask=lists.is_null())

    return run(words)
