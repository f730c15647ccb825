"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import embedding_dedup, gam, language_model, ngram_join, oracles, packing, pieces, quality_rules, token_counts, token_files, toxicity
from tidewater.llm.shared import load, scratch_path


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(load(spark, sf_dir, "documents"))[0].select("doc_id", "n_shingles", "component_id")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    out = scratch_path(spark, "tokens")
    token_files.write_tokens(docs, out, shards=int(spark.conf.get("spark.sql.shuffle.partitions")))
    return token_files.digest(token_files.read_tokens(spark, out))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(load(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"))


def pack_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations under limits that all bind: tokens, segments, answers' tokens."""
    turns = packing.conversation_examples(load(spark, sf_dir, "conversations"))
    return packing.pack_examples(turns, packing.Limits(tokens=2048, segments=8, loss_tokens=1024))


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = gam.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality_rules.judge(load(spark, sf_dir, "documents")).select("doc_id", *counts, "base_failed", "kept")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(load(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, as a checksum, and whether they decode to it."""
    made = pieces.encode_documents(load(spark, sf_dir, "documents"))
    back = F.xxhash64(pieces.decode(F.col("ids"))) == F.col("text_hash")
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_crc32", back.alias("round_trip"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_token_files": op2_token_files,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_packing": op4_packing,
    "pack_conversations": pack_conversations,
    "op5_quality_gam": op5_quality_gam,
    "op6_toxicity": op6_toxicity,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_counts": op8_token_counts,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_language_model": op10_language_model,
}

#: The tokenizers' files and fitted models are beyond SQL.
ORACLE_SQL: dict[str, str] = {"op1_ngram_join": oracles.OP1, "op3_embedding_dedup": oracles.OP3, "op7_quality_rules": oracles.OP7}
