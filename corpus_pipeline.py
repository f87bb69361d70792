"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run``
writes its result as Parquet in the shared folder and reads it again for the next. All but
the last return the columns of ``documents``, further columns of the input included, also
where their names clash with what an operator adds.

Stages and their defined results for odd rows:
1. language_id drops documents without a letter (null and empty texts, too) and those whose
   language is a toss-up (score under ``LEAST_SCORE``).
2. quality_rules drops what the base rule or the learned decision list rejects.
3. near_dedup keeps of each group of near copies the document with the smallest id; rows
   without an id stay; repeated rows of one id stand or fall together.
4. secret_scan masks confirmed secrets and brings n_chars up to date; no document goes.
5. packing returns the packed pieces instead of documents.
An empty table passes through every stage; very long texts are judged and packed whole; ties
fall as each operator's docstring says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import langid, near_dup, packing, quality, secrets
from quillspark.llm._common import Scratch, table

LEAST_SCORE = 0.5
# No stage of these can be told in SQL; the tests hold them against brute force.
ORACLE_SQL = None


def _unused(columns: list[str], name: str) -> str:
    """A column name like ``name`` that none of ``columns`` has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _filtered(docs: DataFrame, judged: Callable[[DataFrame], DataFrame], added: tuple[str, ...], condition) -> DataFrame:
    """Rows that ``judged`` finds good, with their own columns under their own names."""
    aside: dict[str, str] = {}
    for c in docs.columns:
        if c.lower() in added:
            aside[c] = _unused([*docs.columns, *aside.values()], f"_own_{c}")
    kept = judged(docs.withColumnsRenamed(aside)).where(condition)
    return kept.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs)
    good = (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)
    return _filtered(docs, lambda d: langid.predict(d, model), ("lang_pred", "score"), good)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rules = quality.learn(docs, table(spark, sf_dir, "labels"))
    return _filtered(docs, lambda d: quality.judge(d, rules), ("stats", "base_failed", "kept", "_judged"), F.col("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = near_dup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = secrets.fit(spark, secrets.dictionary_words(public_tokenizers.path("word_bpe_49k.json")))
    before = _unused(docs.columns, "_before")
    masked = secrets.redact(docs.withColumn(before, F.col("text")), model)
    same = F.col(before).eqNullSafe(F.col("text"))
    n_chars = F.when(same, F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return masked.select(*[n_chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.query(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
