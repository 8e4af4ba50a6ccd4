"""The queries of this subpackage's operators, each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import quality, toxicity
from vecloom.llm.audio import media_features
from vecloom.llm.common import documents, public_id
from vecloom.llm.decontaminate import contamination, digest
from vecloom.llm.edit_counts import edited_counts
from vecloom.llm.line_dedup import dedup_lines
from vecloom.llm.mixing import mix
from vecloom.llm.oracle import ORACLE_SQL
from vecloom.llm.simhash import near_duplicates
from vecloom.llm.substring_dedup import remove_repeats
from vecloom.llm.token_files import tokens_of


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select(public_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select(public_id(), "size", "source_size", "target", "taken", "source", "copies")


def op3_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = edited_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return counts.select(public_id(), *counts.columns[2:])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = documents(spark, sf_dir), quality.fold(4) == 2
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held)
    return toxicity.score(docs, model).select(public_id(), F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select(public_id(), "n_lines", "n_dropped", "kept_sha256")


def op6_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select(public_id(), "fingerprint", public_id("component_id"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def op7_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = documents(spark, sf_dir), quality.fold(3) == 1
    net = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", ~held)
    return quality.score(docs, net).select(public_id(), F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(documents(spark, sf_dir)).select(
        public_id(), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
    )


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_of(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_edit_counts": op3_edit_counts,
    "op4_toxicity": op4_toxicity,
    "op5_line_dedup": op5_line_dedup,
    "op6_simhash_neardup": op6_simhash_neardup,
    "op7_quality_cnn": op7_quality_cnn,
    "op8_audio_features": op8_audio_features,
    "op9_token_files": op9_token_files,
    "op10_decontaminate": op10_decontaminate,
}
