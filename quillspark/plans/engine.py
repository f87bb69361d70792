"""The search engine's face: Boolean and ranked search over an index, comparison, prompt."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.analysis import base_name
from quillspark.operators import ranking
from quillspark.operators.index import Index
from quillspark.plans import boolean


@dataclass(frozen=True)
class SearchEngine:
    """An immutable engine; ``with_ranking`` gives one with another method."""

    index: Index
    method: str = "tfidf"
    mode: str = "compat"
    bm25: ranking.Bm25 = ranking.Bm25()

    def with_ranking(self, method: str) -> "SearchEngine":
        """An unknown method falls back to tfidf, as it always did at the prompt."""
        return replace(self, method=method if method in ranking.METHODS else "tfidf")

    def parse(self, text: str) -> boolean.Query:
        return boolean.parse(text, self.index.analyzer, self.mode)

    def matches(self, text: str) -> DataFrame:
        """doc_id of every match, unranked."""
        return ranking.search(self.index, self.parse(text), "none").select("doc_id")

    def search(self, text: str) -> DataFrame:
        """(doc_id, score) of every match."""
        return ranking.search(self.index, self.parse(text), self.method, self.bm25)

    def search_any(self, text: str) -> DataFrame:
        """(doc_id, score) of documents with any of the words; there are no operators."""
        words = [self.index.analyzer.query_term(w) for w in text.split()]
        return ranking.search(self.index, boolean.any_of([w for w in words if w]), self.method, self.bm25)

    def top(self, text: str, k: int = 10) -> DataFrame:
        if self.method == "none":
            return preview(self.matches(text), k)
        return ranking.top(self.search(text), k)

    def compare(self, text: str, k: int = 5) -> DataFrame:
        """Rank by rank, the first ``k`` ranked and unranked documents; ``-`` where one list is shorter."""
        ranked = ranking.top(self.search(text), k).select("rank", F.col("doc_id").cast("string").alias("ranked"))
        plain = preview(self.matches(text), k).select("rank", F.col("doc_id").cast("string").alias("unranked"))
        both = ranked.join(plain, "rank", "full_outer")
        return both.select("rank", F.coalesce("ranked", F.lit("-")).alias("ranked"), F.coalesce("unranked", F.lit("-")).alias("unranked"))

    def chart(self, text: str, k: int = 10) -> DataFrame:
        """Bars of the score chart: short name and share of the best score."""
        best = ranking.top(self.search_any(text), k)
        most = F.max("score").over(Window.partitionBy())
        return best.select("rank", F.substring(base_name(F.col("doc_id").cast("string")), 1, 6).alias("name"), F.when(most > 0, F.col("score") / most).otherwise(F.col("score")).alias("share"))


def preview(matches: DataFrame, k: int = 5) -> DataFrame:
    """(rank, doc_id) of the first ``k`` ids."""
    first = matches.orderBy("doc_id").limit(k)
    return first.select(F.row_number().over(Window.orderBy("doc_id")).cast("long").alias("rank"), "doc_id")


def prompt(engine: SearchEngine, ask: Callable[[str], str] = input, say: Callable[[str], None] = print, k: int = 10) -> None:
    """Read queries until ``quit`` or ``!quit``; ``!ranking m`` sets the method, ``!compare q`` compares."""
    while True:
        text = ask("query> ").strip()
        if text in ("quit", "!quit"):
            return
        command, _, rest = text.partition(" ")
        if command == "!ranking" and rest.strip():
            engine = engine.with_ranking(rest.split()[0])
            say(f"ranking: {engine.method}")
            continue
        try:
            if command == "!compare" and rest.strip():
                for r in engine.compare(rest).orderBy("rank").collect():
                    say(f"{r['rank']}. {r['ranked']} | {r['unranked']}")
                continue
            found = engine.search(text).count()
            for r in engine.top(text, k).orderBy("rank").collect():
                say(f"{r['rank']}. {r['doc_id']}")
            if found > k:
                say(f"... and {found - k} more")
            if not found:
                say("no documents")
        except boolean.QuerySyntaxError as e:
            say(f"not a query: {e}")
