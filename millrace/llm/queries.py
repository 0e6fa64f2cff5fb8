"""Queries over the tables of a data folder, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import chat_format, decontaminate, lm_score, mixing, near_dedup, nearest, quality, repeats, sharding, token_counts, url_filter, vector_codes, whitening
from millrace.llm.common import read, settle
from millrace.llm.oracle import ORACLE_SQL

#: Bytes of text in a shard.
SHARD_BYTES = 16 << 20

#: Rules of the URL query as (host, path, verdict).
URL_RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = settle(quality.measure(read(spark, sf_dir, "documents"), keep_text=False), "measured")
    judged = quality.judge(measured, quality.thresholds(quality.sketch(measured)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), SHARD_BYTES).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "oversized")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    chats = chat_format.format_chats(turns)
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.transform("loss_spans", lambda s: chat_format.read_span(F.col("formatted"), s))
    return chats.withColumn("_loss", F.array_join(loss, "")).select(
        "conv_id", "n_turns", F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return lm_score.train_and_score(docs).select("doc_id", "n_tokens", "log_prob", "mean_log_prob")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = T.StructType([T.StructField(c, T.StringType()) for c in ("host", "path", "verdict")])
    return url_filter.filter_urls(read(spark, sf_dir, "pages"), spark.createDataFrame(list(URL_RULES), kind))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_quality, op3_near_dedup, op4_mixing, op5_token_counts, op6_sharding, op7_chat_format, op8_repeats, op9_lm_score, op10_url_filter, op11_whitening, op12_nearest, op13_vector_codes)}
