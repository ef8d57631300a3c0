"""Reading the bundled tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; a file or a folder of Parquet parts."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
