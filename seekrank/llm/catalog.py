"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekrank.llm import bpe, chat, common, divergence, jaccard, packing, pseudonyms, quality, secrets, shards, sketch, token_files, topk, variants
from seekrank.sources.tables import load

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"
#: Key of the registered query; real jobs pass their own secret.
DEMO_KEY = b"a key for the registered query only"
#: Both texts of the conversation that op13 adds to the table.
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "token-files")
    token_files.write_token_files(load(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_TOKENIZER), end_id=2)
    return token_files.read_token_files(spark, path)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), end_id=0, capacity=2048)


def op3_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprint_documents(load(spark, sf_dir, "documents"))


def op4_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(load(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(load(spark, sf_dir, "documents"), 16)


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(load(spark, sf_dir, "documents"))


def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(load(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(load(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(load(spark, sf_dir, "documents"), vary=31)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(load(spark, sf_dir, "documents"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    path = common.scratch(spark, "chats")
    chat.write_chats(chat.as_log(rows.unionByName(hard)), path)
    return chat.digests(chat.read_chats(spark, path))


SPARK = {
    "op1_token_files": op1_token_files,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_scaled_sketch": op3_scaled_sketch,
    "op4_pivot_topk": op4_pivot_topk,
    "op5_ngram_join": op5_ngram_join,
    "op6_hilbert_shards": op6_hilbert_shards,
    "op7_secret_ledger": op7_secret_ledger,
    "op8_feistel_pseudonyms": op8_feistel_pseudonyms,
    "op9_quality": op9_quality,
    "op10_bpe_codec": op10_bpe_codec,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_source_divergence": op12_source_divergence,
    "op13_chat_format": op13_chat_format,
}

SQL: dict[str, str] = {
    "op4_pivot_topk": topk.TOP5_SQL,
    "op11_spelling_variants": variants.VARIANTS_SQL,
    "op12_source_divergence": divergence.AUDIT_SQL,
    "op13_chat_format": chat.CHAT_SQL,
}
