"""The ten operators as queries with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, langid, lm, mixing, mixing_sql, neardup, oracles, quality, suffixdedup, topk, toxicity
from .common import fold, read

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_quotas(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 3) == 1)
    model = langid.train(docs.where("not held_out"))
    return langid.predict(docs, model, keep=("doc_id", "held_out"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.segments(told.unionByName(own))).drop("valid")


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) == 2)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 5) == 0)
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs.where("not held_out"), labels)
    return toxicity.score(docs, model, keep=("doc_id", "held_out"))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdedup.repeated_passages(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return bpe.digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = read(spark, sf_dir, "labels").where("quality = 1")
    return quality.judge(read(spark, sf_dir, "documents"), trusted)


def quality_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base measures of op10 alone: these have SQL."""
    return quality.measures(read(spark, sf_dir, "documents")).drop("features")


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), TRUE)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

OP3_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, length(text)
    + 4 * (length(text) - length(replace(text, '<|', ''))) // 2 + 2 * (length(text) - length(replace(text, '</s>', ''))) // 4
    + 3 * (length(text) - length(replace(text, '<s>', ''))) // 3 + 0 * (length(text) - length(replace(text, '[INST]', ''))) // 6
    - 1 * (length(text) - length(replace(text, '[/INST]', ''))) // 7 - 1 * (length(text) - length(replace(text, '<<SYS>>', ''))) // 7
    - 2 * (length(text) - length(replace(text, '<</SYS>>', ''))) // 8 + 1 * (length(text) - length(replace(text, '<unk>', ''))) // 5
    + 1 * (length(text) - length(replace(text, '<pad>', ''))) // 5 AS escaped
  FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(escaped + length('<|im_start|>') + length(role) + 1 + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_mixing": op1_mixing, "op2_language": op2_language, "op3_chat": op3_chat, "op9_near_duplicates": op9_near_duplicates, "op7_top_k": op7_top_k, "op6_suffix_array": op6_suffix_array, "op4_lm_scores": op4_lm_scores, "op5_toxicity": op5_toxicity, "op8_byte_bpe": op8_byte_bpe, "op10_quality": op10_quality, "quality_measures": quality_measures}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing_sql.oracle(), "op3_chat": OP3_SQL, "op6_suffix_array": oracles.PASSAGES, "op7_top_k": OP7_SQL, "op9_near_duplicates": oracles.NEAR_DUPLICATES, "quality_measures": oracles.QUALITY_MEASURES}
