"""Records as they come: manifests with their outcome, sealed tables, inventories, guarded thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifests(files: DataFrame, body: str) -> DataFrame:
    """files with path, blob, at, size and a verdict: unparseable, not_an_object, missing_field, wrong_type or ok."""
    v = F.try_parse_json(body)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    text = lambda name: F.coalesce(kind(f"$.{name}") == "STRING", F.lit(False))
    whole = F.schema_of_variant(v).startswith("OBJECT")
    verdict = (
        F.when(v.isNull(), "unparseable")
        .when(~whole, "not_an_object")
        .when(~text("path") | ~text("blob") | kind("$.at").isNull(), "missing_field")
        .when(F.coalesce(kind("$.size") != "BIGINT", F.lit(True)), "wrong_type")
        .otherwise("ok")
    )
    get = lambda name, to: F.try_variant_get(v, f"$.{name}", to).alias(name)
    return files.select("*", get("path", "string"), get("blob", "string"), get("at", "bigint"), get("size", "bigint"), verdict.alias("verdict"))


def unsealed(files: DataFrame, text: str) -> DataFrame:
    """files with body and whether the digest in the first line is the body's."""
    head = F.substring_index(text, "\n", 1)
    body = F.substring(F.col(text), F.length(head) + 2, F.length(text))
    return files.withColumn("body", body).withColumn("intact", head == F.concat(F.lit("#sha256 "), F.sha2(body, 256)))


def inventory(state: DataFrame, disk: DataFrame) -> DataFrame:
    """path, verdict of recorded files (path, size, h) against those found (path, size, h, sent)."""
    a = state.select("path", F.col("size").alias("_s"), F.col("h").alias("_h"))
    b = disk.select("path", "size", "h", "sent")
    verdict = (
        F.when(F.col("size").isNull(), "fail")
        .when(F.col("_s").isNull() & F.col("sent"), "adopt")
        .when(F.col("_s").isNull(), "rogue")
        .when((F.col("_s") == F.col("size")) & (F.col("_h") == F.col("h")), "keep")
        .when(F.col("sent") & (F.col("size") > F.col("_s")), "self_heal")
        .when(F.col("size") < F.col("_s"), "shrunk")
        .otherwise("drift")
    )
    return a.join(b, "path", "full_outer").select("path", verdict.alias("verdict"))


def best_threshold(sweep: DataFrame, precision: float) -> DataFrame:
    """theta: of those precise enough the one of best recall, else the most precise; the lower one at a tie."""
    enough = F.col("precision") >= precision
    return sweep.orderBy(F.desc(enough), F.desc(F.when(enough, F.col("recall")).otherwise(F.col("precision"))), "theta").limit(1).select("theta")
