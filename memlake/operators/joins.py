"""Completeness checks, reconciliations and state updates as joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def closure(expected: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Each id that is missing, unexpected or given more than once, with its problem."""
    left = expected.select(key).distinct().withColumn("_want", F.lit(True))
    right = given.groupBy(key).agg(F.count("*").alias("_n"))
    both = left.join(right, key, "full_outer")
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_want").isNull(), "unexpected").when(F.col("_n") > 1, "duplicate")
    return both.select(key, problem.alias("problem")).filter("problem is not null")


def unique_or_fail(df: DataFrame, key: str) -> DataFrame:
    """df, failing when a row of a repeated key is read: the check is part of the plan, not a second job."""
    many = df.groupBy(key).agg(F.count("*").alias("_n"))
    guarded = df.join(many, key).withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated key: "), F.col(key).cast("string")))).otherwise(F.lit(True)))
    return guarded.filter("_ok").drop("_n", "_ok")


def insert_new(target: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows whose key the target lacks, the first of each key: what INSERT OR IGNORE would add."""
    from memlake.operators.windows import first_per_key

    return first_per_key(rows.join(target.select(*keys).distinct(), keys, "left_anti"), keys, order)


def upsert_latest(target: DataFrame, rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """For each key the row with the highest position of both sides."""
    both = target.unionByName(rows)
    return both.groupBy(*keys).agg(F.max(position).alias(position))


def reconcile(known: DataFrame, found: DataFrame, key: str, size: str, digest: str) -> DataFrame:
    """Full outer comparison: keep, drift, shrunk, grown, adopt or gone for each key."""
    a = known.select(key, F.col(size).alias("_s0"), F.col(digest).alias("_d0"))
    b = found.select(key, F.col(size).alias("_s1"), F.col(digest).alias("_d1"))
    verdict = (
        F.when(F.col("_s0").isNull(), "adopt")
        .when(F.col("_s1").isNull(), "gone")
        .when((F.col("_s0") == F.col("_s1")) & (F.col("_d0") == F.col("_d1")), "keep")
        .when(F.col("_s1") < F.col("_s0"), "shrunk")
        .when(F.col("_s1") > F.col("_s0"), "grown")
        .otherwise("drift")
    )
    return a.join(b, key, "full_outer").select(key, verdict.alias("verdict"))


def layered(base: DataFrame, override: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """base with each column replaced where the override has the row and a value."""
    over = override.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = base.join(over, keys, "left")
    return joined.select(*keys, *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


def under_any_root(paths: DataFrame, path: str, roots: list[str]) -> Column:
    """The longest of a few fixed roots that a path lies under, null if none; the roots are settings, not data."""
    ordered = sorted(roots, key=len, reverse=True)
    return reduce(lambda w, r: w.when(F.col(path).startswith(r), r), ordered[1:], F.when(F.col(path).startswith(ordered[0]), ordered[0]))


#: A side is broadcast only if it was measured to be no larger than this.
BROADCAST_BYTES = 32 << 20


def joined_small(left: DataFrame, right: DataFrame, on: Column, measured_bytes: int, salts: int = 64, how: str = "inner") -> DataFrame:
    """Join with a right side that is unique on its key: broadcast if its measured size allows, else repeated over salts, so that a hot
    key of the left side spreads over that many tasks."""
    if measured_bytes <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), on, how)
    salted = right.withColumn("_salt_r", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    row = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(salts)).cast("int")
    return left.withColumn("_salt", row).join(salted, on & (F.col("_salt") == F.col("_salt_r")), how).drop("_salt", "_salt_r")
