"""The corpus pipeline: each stage takes what its predecessor kept, from Parquet, and its decisions take effect."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vecloom.llm import quality
from vecloom.llm.common import documents, settle
from vecloom.llm.decontaminate import drop_contaminated
from vecloom.llm.mixing import mixed
from vecloom.llm.simhash import keep_first, similar
from vecloom.llm.token_files import tokens_of


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier scores below 0.5; it learns from labelled rows among docs."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles are 0.8 alike; fingerprints and minima give candidates, sets of shingles decide."""
    return keep_first(docs, similar(docs))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark, or are contaminated by its short items."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files; what they hold of each row."""
    return tokens_of(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", good), ("SimHash near-dedup", distinct), ("benchmark decontamination", clean), ("mixing sources", mix), ("token-ID output", tokens)]
#: Training and rounding are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
