"""The corpus pipeline: language ID, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a
DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import lang_id, near_dup, packing, substring_dup
from quillon.llm.queries import tokenizer
from quillon.llm.storage import stored

#: SQL can't express hashed n-gram centroids or a packing search.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay: those without letters or far from every language's centroids go. It is the text alone that decides, so rows meet their verdict by its 64-bit hash, with or without doc_id."""
    model = lang_id.fit(docs.where(~lang_id.held_out()))
    hashed = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    refused = stored(lang_id.identify(hashed, model).where(~F.col("accepted")).select(F.col("doc_id").alias("refused_text")).distinct(), "refused")
    return docs.join(refused, F.xxhash64("text") == F.col("refused_text"), "left_anti").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more) stays: the one of smallest doc_id."""
    gone = near_dup.near_duplicates(docs, shingle=5, num=4, den=5).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(stored(gone, "copies"), "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 13-word passages that a document of smaller doc_id has go; text and n_chars follow. Texts that lose nothing stay as they are, documents left without words go."""
    found = substring_dup.without_repeats(docs, size=13)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    left = found.where("n_removed = 0 or n_removed < n_words").withColumn("text", text)
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 2048."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES = [("language_id", language), ("near_dedup", near_duplicates), ("substring_dedup", repeated_passages), ("best_fit_packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
