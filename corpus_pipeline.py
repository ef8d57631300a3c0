"""The corpus pipeline: quality rules, near duplicates, personal data, packing; each stage works on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memlake.llm import near_dup, packing, pii, quality
from memlake.llm.common import dropped, scratch, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the rules nor the perplexity bands reject."""
    return quality.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8."""
    return near_dup.keep_one_of_each(docs, width=5, percent=80)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts replaced by its kind; n_chars follows the new text."""
    return pii.mask_pii(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, separator=0)


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("personal_data", without_personal_data), ("packing", packed)]

#: SQL can't express the perplexity model, the trained classifier or the tokenizer: a brute-force test covers them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each written as Parquet in the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with scratch() as made:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped(*before, *made[:-1])  # what the stage read, and what it made on the way
        before = made[-1:]
    return docs
