"""The registered queries over this subpackage and their DuckDB oracles; each runs over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import bpe, conversations, extraction, infilling, licenses, near_dup, nearest, packing, pii, quality, secrets, token_counts, urls
from memlake.llm.common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_text(table(spark, sf_dir, "pages"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"), words_path=_tokenizer("word_bpe_49k.json"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), capacity=2048, separator=0)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.find_near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), limit=512)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


def op12_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infilling.fill_in_middle_digests(table(spark, sf_dir, "documents"))


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("toxic") == 1).alias("block"))
    return urls.judge(table(spark, sf_dir, "pages"), labels)


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_licenses, op2_main_text, op3_secrets, op4_nearest, op5_packing, op6_bpe, op7_near_duplicates, op8_quality, op9_personal_data, op10_token_counts,
            op11_conversations, op12_infilling, op13_urls,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_licenses": licenses.oracle(), "op11_conversations": conversations.oracle(), "op12_infilling": infilling.oracle()}
