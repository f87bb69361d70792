"""Porter's stemming algorithm (1980) with the later extensions of its common Python version.

Pure Python on single words; ``stem_column`` applies it to Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F

# Words whose stem no rule gives.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
# Suffixes of steps 2 to 4 and what replaces them.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def shape(word: str) -> str:
    """``c`` or ``v`` for each letter; y is a vowel after a consonant."""
    out = []
    for i, letter in enumerate(word):
        vowel = letter in "aeiou" or (letter == "y" and i > 0 and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def measure(stem: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    return shape(stem).count("vc")


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y; or a two-letter vowel, consonant."""
    s = shape(word)
    return (s.endswith("cvc") and word[-1] not in "wxy") or s == "vc"


def _double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def _replace(word: str, rules: list[tuple[str, str]], allowed: Callable[[str, str], bool]) -> str:
    """The first suffix that fits decides, whether its condition holds or not."""
    for suffix, new in rules:
        if word.endswith(suffix):
            base = word[: len(word) - len(suffix)]
            return base + new if allowed(base, suffix) else word
    return word


def _plural(word: str) -> str:
    if word.endswith("ies") and len(word) == 4:
        return word[:-1]
    return _replace(word, [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")], lambda *_: True)


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) else word
    base = next((word[: -len(x)] for x in ("ed", "ing") if word.endswith(x) and "v" in shape(word[: -len(x)])), None)
    if base is None:
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if _double_end(base):
        return base if base[-1] in "lsz" else base[:-1]
    return base + "e" if measure(base) == 1 and _short_end(base) else base


def _final_y(word: str) -> str:
    return word[:-1] + "i" if word.endswith("y") and len(word) > 2 and shape(word)[-2] == "c" else word


def _second(word: str) -> str:
    if word.endswith("alli") and measure(word[:-4]):
        return _second(word[:-2])
    return _replace(word, STEP2, lambda base, suffix: measure(base + "l" if suffix == "logi" else base) > 0)


def _fourth(word: str) -> str:
    return _replace(word, [(x, "") for x in STEP4], lambda base, suffix: measure(base) > 1 and (suffix != "ion" or base[-1:] in ("s", "t")))


def _final_e(word: str) -> str:
    if word.endswith("e"):
        base = word[:-1]
        if measure(base) > 1 or (measure(base) == 1 and not _short_end(base)):
            word = base
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    word = word.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _second(_final_y(_past(_plural(word))))
    word = _replace(word, STEP3, lambda base, _: measure(base) > 0)
    return _final_e(_fourth(word))


def stem_column(column):
    """Stems of a string column: each distinct word of an Arrow batch once."""
    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(words)
        stems = pd.Series([stem(w) for w in distinct], dtype=object)
        return pd.Series(stems.to_numpy()[codes] if len(stems) else [], dtype=object)

    return run(column)
