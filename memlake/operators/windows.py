"""Ranking and ordered operators as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.folds import greedy_groups


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The winner of each key under a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k of each key with their rank from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def interleave(df: DataFrame, query: str, kind: str, rank: str, first: str, k: int) -> DataFrame:
    """Merge two ranked lists of each query, `first`'s entry before the other's at equal ranks, up to k in all."""
    order = [F.col(rank), F.when(F.col(kind) == first, 0).otherwise(1)]
    return top_per_key(df.filter(F.col(rank) <= k), [query], order, k, "merged_rank")  # the limit reaches the inner rank


def diversify(df: DataFrame, query: list[str], group: str, order: list[Column], cap: int, limit: int) -> DataFrame:
    """At most `cap` of a group in order, then the others in order, up to `limit` for each query."""
    own = Window.partitionBy(*query, group).orderBy(*order)
    ranked = df.withColumn("_own", F.row_number().over(own)).filter(F.col("_own") <= cap + limit)  # no later row can be among them
    ranked = ranked.withColumn("_over", (F.col("_own") > cap).cast("int")).drop("_own")
    return top_per_key(ranked, query, [F.col("_over"), *order], limit, "place").drop("_over")


def unique_times(df: DataFrame, keys: list[str], ts: str, order: list[Column], out: str = "unique_ts") -> DataFrame:
    """Strictly increasing times in order: each the later of its own and one after the one before; missing takes the next."""
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = df.withColumn("_i", F.row_number().over(w).cast("long"))
    lead = F.max(F.when(F.col(ts) > 0, F.col(ts) - F.col("_i"))).over(upto)
    return numbered.withColumn(out, F.col("_i") + F.greatest(F.lit(0), F.coalesce(lead, F.lit(0)))).drop("_i")


def batches(df: DataFrame, keys: list[str], order: list[Column], size: int, out: str = "batch") -> DataFrame:
    """Batches of a fixed size in order, numbered from 0 for each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def split_trailing(df: DataFrame, keys: list[str], position: str, held: Column, out: str = "held_back") -> DataFrame:
    """Mark the trailing run of rows for which `held` is true."""
    last = F.max(F.when(~held, F.col(position))).over(Window.partitionBy(*keys))
    return df.withColumn(out, F.col(position) > F.coalesce(last, F.lit(-1)))


def error_free_prefix(df: DataFrame, keys: list[str], order: list[Column], failed: Column, out: str = "advances") -> DataFrame:
    """Whether no row up to this one has failed: a cursor may advance to the last such row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.max(failed.cast("int")).over(w) == 0)


def longest_streak(df: DataFrame, keys: list[str], order: list[Column], success: Column, code: str) -> DataFrame:
    """For each key the longest run of one error code that no success interrupts; other codes don't interrupt it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    islands = df.withColumn("_island", F.sum(success.cast("int")).over(w))
    runs = islands.filter(~success).groupBy(*keys, "_island", code).agg(F.count("*").alias("_n"))
    return runs.groupBy(*keys).agg(F.max("_n").alias("streak"))


def hash_sample(df: DataFrame, strata: list[str], key: Column, quota: int) -> DataFrame:
    """The first `quota` rows of each stratum in order of the key's SHA-256."""
    return top_per_key(df.withColumn("_h", F.sha2(key.cast("string"), 256)), strata, [F.col("_h")], quota, "draw").drop("_h")


def folded_rows(df: DataFrame, keys: list[str], order: str, start: Column, step, finish=None) -> DataFrame:
    """A sequential fold of each key's rows in order, for budgets that reset: one array per key, folded on the JVM.

    Use it where a key's rows are bounded (turns of a conversation): they meet in one array.
    """
    rest = [c for c in df.columns if c not in keys]
    ordered = F.array_sort(F.collect_list(F.struct(order, *[c for c in rest if c != order])))
    return df.groupBy(*keys).agg(ordered.alias("_rows")).withColumn("_state", F.aggregate("_rows", start, step, finish) if finish else F.aggregate("_rows", start, step))


def chunked(rows: DataFrame, keys: list[str], order: str, text: str, size: int, overlap: int) -> DataFrame:
    """Each key's texts in order as chunks of at most `size` characters: keys, order, chunk, part, piece.

    A text longer than that is cut into pieces that overlap, in a chunk of its own. A key of any length: see folds.greedy_groups.
    """
    n = F.length("text")
    lean = rows.select(*keys, order, F.col(text).alias("text"))
    done = greedy_groups(lean, keys, [order, "text"], n, n, n > size, n > size, size, "chunk")
    step_size = max(1, size - overlap)
    parts = F.when(F.length("text") > size, F.transform(F.sequence(F.lit(0), F.ceil(F.length("text") / step_size).cast("int") - 1), lambda p: F.substring(F.col("text"), p * step_size + 1, F.lit(size)))).otherwise(F.array("text"))
    return done.select(*keys, order, "chunk", F.posexplode(parts).alias("part", "piece")).withColumn("part", F.col("part").cast("long"))


def interleaved_then(df: DataFrame, query: str, kind: str, rank: str, first: str, allowed: Column, k: int) -> DataFrame:
    """Both lists of each query interleaved whole, then filtered without changing their order, then the first k: place."""
    order = [F.col(rank), F.when(F.col(kind) == first, 0).otherwise(1)]
    return top_per_key(df.filter(allowed), [query], order, k, "place")  # a filter keeps the order that ranks and kinds give


def numbered_by_range(df: DataFrame, bucket: str, order: list[Column], place: str, total: str) -> DataFrame:
    """place (from 0 in order) and total, without sorting all rows in one task.

    `bucket` rises with the order: rows are ranked within it, and the counts of the buckets before are added. Only the
    counts, one row for each bucket, meet in one task.
    """
    sizes = df.groupBy(bucket).agg(F.count("*").alias("_n"))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias(total))
    own = F.row_number().over(Window.partitionBy(bucket).orderBy(*order)) - 1
    return df.withColumn("_own", own).join(offsets, bucket).withColumn(place, (F.col("_before") + F.col("_own")).cast("long")).drop("_own", "_before")


def within_budget(df: DataFrame, group: str, order: str, size: str, budget: int, width: int) -> DataFrame:
    """Rows of each group whose running total in order stays within the budget, with that total.

    Sums of blocks of `width` keys tell which rows can be within it; only the rows of those blocks are sorted.
    """
    block = F.floor(F.col(order) / width)
    blocks = df.groupBy(group, block.alias("_block")).agg(F.sum(size).alias("_s"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    near = blocks.withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0))).filter(F.col("_before") <= budget).select(group, "_block")
    rows = df.withColumn("_block", block).join(near, [group, "_block"], "left_semi").drop("_block")
    upto = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("total", F.sum(size).over(upto)).filter(F.col("total") <= budget)
