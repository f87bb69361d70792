"""The registered queries of the operators here, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm._common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import licenses

    return licenses.query(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import sharding

    return sharding.query(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import packing

    return packing.query(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quillspark.llm import bpe_codec

    return bpe_codec.query(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import near_dup

    return near_dup.query(table(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import chat

    return chat.query(table(spark, sf_dir, "conversations"))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import topk

    return topk.query(table(spark, sf_dir, "embeddings"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import secrets

    return secrets.query(table(spark, sf_dir, "documents"), secrets.dictionary_words(_vocabulary("word_bpe_49k.json")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import quality

    return quality.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import langid

    return langid.query(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import runs

    return runs.query(table(spark, sf_dir, "documents"))


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import align

    return align.query(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import warc

    return warc.query(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_license_scan, op2_sharding, op3_packing, op4_bpe_codec, op5_near_dup, op6_chat_formatting, op7_topk_search, op8_secret_scan,
            op9_quality_rules, op10_language_id, op11_periodic_runs, op12_token_align, op13_warc,
        )
    }


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
m AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role
    AND row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) > 1 AS joins,
    length(replace(text, '<|', '<||')) AS inner_chars
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(inner_chars + CASE WHEN joins THEN 8 ELSE 12 + length(role) + 1 + 11 END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""

OP7_SQL = """
WITH u AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, v FROM u WHERE vec_id % 50 = 0),
s AS (
  SELECT q.vec_id AS query_id, q.v, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM q JOIN u c ON c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    from quillspark.llm import warc

    return {"op6_chat_formatting": OP6_SQL, "op7_topk_search": OP7_SQL, "op13_warc": warc.SQL}
