"""The English suffix-stripping stemmer of the Snowball project (its second English algorithm), by regions R1 and R2.

Words are taken in lower case; other than English ones go through the same rules. stemmed() is an Arrow-batched column
function over arrays of words; each worker keeps the stems of words it has seen.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

KEPT_WORDS = 1 << 18

# Fixed values of the algorithm: letters, exceptional words, and the suffixes of each step with what takes their place.
VOWELS, DOUBLES, BEFORE_LI = "aeiouy", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"), "cdeghkmnrt"
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
UNCHANGED_SINGULAR = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
WHOLE_STARTS = ("gener", "commun", "arsen")
STEP_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_REGION = re.compile(f"[{VOWELS}][^{VOWELS}]")
_SHORT_END = re.compile(f"(?:[^{VOWELS}][{VOWELS}][^{VOWELS}wxY]|^[{VOWELS}][^{VOWELS}])$")
_VOWEL = re.compile(f"[{VOWELS}]")
_CONSONANT_Y = re.compile(f"^y|(?<=[{VOWELS}])y")


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _after(word: str, at: int) -> int:
    """Where the region begins behind the first vowel and consonant from a place on."""
    found = _REGION.search(word, at)
    return found.end() if found else len(word)


def _plural(word: str) -> str:
    end = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        return word[:-2]
    if end in ("ied", "ies"):
        return word[:-2] if len(word) > 4 else word[:-1]
    return word[:-1] if end == "s" and _VOWEL.search(word[:-2]) else word


def _past(word: str, r1: int) -> str:
    end = _longest(word, ("eedly", "eed", "edly", "ed", "ingly", "ing"))
    rest = word[: len(word) - len(end)]
    if end.startswith("eed"):
        return rest + "ee" if len(rest) >= r1 else word
    if not end or not _VOWEL.search(rest):
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if rest.endswith(DOUBLES):
        return rest[:-1]
    return rest + "e" if r1 >= len(rest) and _SHORT_END.search(rest) else rest


def _replaced(word: str, r1: int, r2: int) -> str:
    """Steps 2 and 3: derivational endings inside R1."""
    for table in (STEP_2, STEP_3):
        end = _longest(word, table)
        rest = word[: len(word) - len(end)]
        if not end or len(rest) < r1:
            continue
        if (end == "ogi" and not rest.endswith("l")) or (end == "li" and rest[-1:] not in BEFORE_LI) or (end == "ative" and len(rest) < r2):
            continue
        word = rest + table[end]
    return word


def _stripped(word: str, r1: int, r2: int) -> str:
    """Steps 4 and 5: endings inside R2, a last e or l."""
    end = _longest(word, STEP_4)
    rest = word[: len(word) - len(end)]
    if end and len(rest) >= r2 and (end != "ion" or rest.endswith(("s", "t"))):
        word = rest
    rest = word[:-1]
    if word.endswith("e") and (len(rest) >= r2 or (len(rest) >= r1 and not _SHORT_END.search(rest))):
        return rest
    return rest if word.endswith("ll") and len(rest) >= r2 else word


@lru_cache(KEPT_WORDS)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2 or word in UNCHANGED:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    word = _CONSONANT_Y.sub("Y", word.removeprefix("'"))
    start = _longest_start(word)
    r1 = start or _after(word, 0)
    r2 = _after(word, r1)
    end = _longest(word, ("'s'", "'s", "'"))
    word = _plural(word[: len(word) - len(end)])
    if word in UNCHANGED_SINGULAR:
        return word
    word = _past(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    return _stripped(_replaced(word, r1, r2), r1, r2).replace("Y", "y")


def _longest_start(word: str) -> int:
    return next((len(s) for s in WHOLE_STARTS if word.startswith(s)), 0)


@F.pandas_udf(ArrayType(StringType()))
def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [stem(w) for w in ws])


def stemmed(words: Column) -> Column:
    """An array of lower-case words as their stems, in place."""
    return _stems(words)
