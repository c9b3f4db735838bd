"""Queries opN_<name> of the ten operators, their oracle SQL where SQL can say it, and the pipeline."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, gif_media, html_extract, lang_id, license_scan, near_dup, packing, substring_dup, top_k, trie_bpe

#: Folder of tokenizer files, if not that of the installed vocabulary package.
TOKENIZERS = os.environ.get("QUILLON_TOKENIZERS", "")


def tokenizer(name: str) -> str:
    return os.path.join(TOKENIZERS, name) if TOKENIZERS else str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


def op2_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.stored_features(gif_media.store_texts(_table(spark, sf_dir, "documents")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = lang_id.fit(docs.where(~lang_id.held_out()))
    found = lang_id.identify(docs, model)
    return found.select("doc_id", lang_id.held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(_table(spark, sf_dir, "embeddings"), k=10, every=100, scale=1024.0)


def op5_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.encode_texts(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), digests=True)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dup.without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), size=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = r"\### Assistant: </turn> ok"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(told).alias("text"))
    return chat_format.conversation_digests(chat_format.format_conversations(rows.unionByName(extra), tokenizer("byte_bpe_50k.json")))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), capacity=2048, end_id=0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_near_dedup, op2_gif_media, op3_language_id, op4_top_k, op5_trie_bpe, op6_substring_dedup, op7_html_text, op8_chat_format, op9_license_scan, op10_best_fit_packing, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_top_k": OP4_SQL}


OP4_SQL = """
WITH kept AS (
  SELECT DISTINCT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, max(CAST(list_inner_product(q.v, c.v) AS BIGINT)) AS score
  FROM kept q JOIN kept c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
  GROUP BY 1, 2
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
