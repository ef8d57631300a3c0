"""Integrity of versioned data: censuses, chains, retention, digests."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def census(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def census_verdicts(prev: DataFrame, cur: DataFrame, name: str, before: str, after: str) -> DataFrame:
    """What was there before and has disappeared or shrunk."""
    verdict = F.when(F.col(after).isNull(), "disappeared").when(F.col(after) < F.col(before), "shrunk").otherwise("ok")
    return prev.join(cur, name, "left").select(name, before, after, verdict.alias("verdict"))


def victims(df: DataFrame, keys: list[str], newest: list[Column], keep: int) -> DataFrame:
    """All but the newest `keep` of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))).filter(F.col("_r") > keep).drop("_r")


def walk_chain(links: DataFrame, node: str, prev: str) -> DataFrame:
    """Depth of each node from the chain's tip, the highest node; nodes that the walk doesn't reach, and those that it reaches
    twice because they stand in a cycle, are orphans.

    Pointer doubling: after r rounds a node knows its 2**r-th predecessor, so a chain of n nodes takes log2 n joins. Each round
    is cut off by a checkpoint; rounds end at the latest once twice the number of nodes is covered.
    """
    tip = links.agg(F.max(node).alias("_at")).withColumn("depth", F.lit(0).cast("long"))
    reached, jump, step = tip, links.select(F.col(node).alias("_from"), F.col(prev).alias("_to")).filter("_to is not null"), 1
    most = 2 * links.count()
    while step <= most:
        further = reached.join(jump, F.col("_at") == F.col("_from")).select(F.col("_to").alias("_at"), (F.col("depth") + step).alias("depth"))
        further = cut(further)
        if further.isEmpty():
            break
        reached = cut(reached.unionByName(further))
        onward = jump.select(F.col("_from").alias("_to"), F.col("_to").alias("_end"))
        jump, step = cut(jump.join(onward, "_to").select("_from", F.col("_end").alias("_to"))), 2 * step
    once = reached.groupBy("_at").agg(F.min("depth").alias("depth"), (F.count("*") > 1).alias("_cycle"))
    walked = links.join(once, F.col(node) == F.col("_at"), "left")
    orphan = F.col("_at").isNull() | F.col("_cycle")
    return walked.select(node, F.when(~orphan, F.col("depth")).alias("depth"), orphan.alias("orphan"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir that driver and executors share; only a local session without one gets its own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-memlake-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def typed(column: str, kind: str) -> Column:
    """An injective text form: tag of the type, length, value; null has a tag of its own."""
    text = F.col(column).cast("string")
    tag = "T" if kind == "string" else "B" if kind == "binary" else "R" if kind in ("double", "float") else "I"
    return F.coalesce(F.concat(F.lit(tag), F.length(text).cast("string"), F.lit(":"), text), F.lit("N"))


def ordered_digest(df: DataFrame, key: str, columns: list[str], rows: int) -> DataFrame:
    """Rows and a digest of all rows in order of a dense integer key.

    Blocks of `rows` keys are digested in parallel, then the blocks' digests in order, so no task holds the table; it is
    not the digest of the plain concatenation.
    """
    encoded = F.concat(*[typed(c, df.schema[c].dataType.simpleString()) for c in columns])
    parts = df.select(F.floor(F.col(key) / rows).alias("_part"), F.struct(F.col(key).alias("k"), encoded.alias("e")).alias("r"))
    each = parts.groupBy("_part").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["e"]), ""), 256).alias("d"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_part", "d"))), lambda x: x["d"]), "")
    return each.agg(F.sum("n").alias("n"), F.sha2(whole, 256).alias("digest"))


def schema_fingerprint(df: DataFrame) -> str:
    """SHA-256 of the sorted name/type pairs."""
    import hashlib

    return hashlib.sha256("\n".join(sorted(f"{f.name}/{f.dataType.simpleString()}" for f in df.schema)).encode()).hexdigest()
