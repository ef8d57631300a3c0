"""Writes that are safe to repeat: guarded updates, content-addressed blobs, number-stamped appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def guarded_update(current: DataFrame, new: DataFrame, key: str, identity: str) -> DataFrame:
    """current with new rows replacing those of the same key; fails when read if a key's identity would change."""
    now = current.select(key, F.col(identity).alias("_was"))
    same = F.col("_was").isNull() | (F.col("_was") == F.col(identity))
    checked = new.join(now, key, "left").filter(F.when(same, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("another identity: "), F.col(key).cast("string"))))).drop("_was")
    return current.join(new.select(key), key, "left_anti").unionByName(checked)


def new_blobs(stored: DataFrame, contents: DataFrame, content: str = "content") -> DataFrame:
    """sha and content of what isn't stored yet, each once."""
    blobs = contents.select(F.sha2(F.col(content).cast("binary"), 256).alias("sha"), content).dropDuplicates(["sha"])
    return blobs.join(stored.select("sha"), "sha", "left_anti")


def corrupt_blobs(stored: DataFrame, content: str = "content") -> DataFrame:
    """Blobs whose content no longer has its name."""
    return stored.filter(F.sha2(F.col(content).cast("binary"), 256) != F.col("sha"))


def numbered(stored: DataFrame, rows: DataFrame, key: str, order: str, out: str = "attempt_no") -> DataFrame:
    """rows with attempts numbered on from the highest stored one of their key, from 0."""
    top = stored.groupBy(key).agg(F.max(out).alias("_top"))
    turn = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return rows.join(top, key, "left").withColumn(out, (F.coalesce(F.col("_top") + 1, F.lit(0)) + turn).cast("long")).drop("_top")


def transition(rows: DataFrame, status: str, before: str, after: str, condition) -> DataFrame:
    """Rows with `before` that meet the condition get `after`."""
    return rows.withColumn(status, F.when((F.col(status) == before) & condition, after).otherwise(F.col(status)))
