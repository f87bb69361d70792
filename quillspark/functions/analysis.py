"""Analyzers: from text to terms, as Spark expressions, and the same for query operands."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.porter import stem, stem_column

# Unicode white space as Python counts it.
WHITE = r"\s\x1c-\x1f\u0085\p{Z}"


@dataclass(frozen=True)
class Analyzer:
    """``letters``: split at white space, lower-case, delete all but a-z. ``whitespace``: split and lower-case only."""

    kind: str = "letters"
    stemmer: str = "none"

    def __post_init__(self):
        if self.kind not in ("letters", "whitespace") or self.stemmer not in ("none", "porter"):
            raise ValueError(f"unknown analyzer {self}")

    def _cleaned(self, text: Column) -> Column:
        low = F.lower(text)
        # Deleting inside the whole text first is one pass and gives the same words.
        return F.regexp_replace(low, f"[^a-z{WHITE}]+" if self.kind == "letters" else "�", "")

    def surface(self, text: Column) -> Column:
        """The words of a text before stemming, as an array without empty ones."""
        return F.filter(F.split(self._cleaned(text), f"[{WHITE}]+"), lambda w: w != "")

    def blanked(self, text: Column) -> Column:
        """The words of ``surface`` as one string, a blank between each two, and perhaps at the ends."""
        return F.regexp_replace(self._cleaned(text), f"[{WHITE}]+", " ")

    def terms(self, word: Column) -> Column:
        return stem_column(word) if self.stemmer == "porter" else word

    def query_term(self, operand: str) -> str:
        """The term of a whole query operand, or '' if nothing of it is left."""
        word = operand.strip().lower()
        if self.kind == "letters":
            word = re.sub("[^a-z]", "", word)
        return stem(word) if self.stemmer == "porter" and word else word


LETTERS = Analyzer("letters")
LETTERS_PORTER = Analyzer("letters", "porter")
WHITESPACE_PORTER = Analyzer("whitespace", "porter")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
