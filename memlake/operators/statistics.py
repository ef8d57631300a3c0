"""Rates, intervals, thresholds and metrics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators import joins
from memlake.operators.integrity import cut


def wilson(k: Column, n: Column, z: float) -> tuple[Column, Column]:
    """The Wilson interval of k successes in n; null where n is 0."""
    p = k / n
    zz = z * z
    mid = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.when(n > 0, mid - half), F.when(n > 0, mid + half)


def ratio(a: Column, b: Column, empty: float) -> Column:
    """a / b, and `empty` where b is 0: sites differ in what an empty denominator means."""
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)


def quotas(strata: DataFrame, stratum: str, population: str, target: int, floor: int) -> DataFrame:
    """Seats for each stratum: a floor (or all of a small stratum), then one by one to the largest remainder.

    The seat-by-seat loop is a ranking: seat j of a stratum has remainder ideal - j, and the best remainders win.
    """
    whole = Window.partitionBy()
    s = strata.select(stratum, F.col(population).cast("long").alias("_pop"))
    s = s.withColumn("_all", F.sum("_pop").over(whole)).withColumn("_base", F.least(F.lit(floor), "_pop").cast("long"))
    s = s.withColumn("_left", F.lit(target) - F.sum("_base").over(whole)).withColumn("_ideal", F.lit(target) * F.col("_pop") / F.col("_all"))
    seats = s.filter("_pop > _base").select(stratum, "_ideal", "_left", F.explode(F.sequence(F.col("_base"), F.least(F.col("_pop") - 1, F.col("_base") + F.greatest(F.col("_left"), F.lit(0))))).alias("_j"))
    order = Window.orderBy(F.desc(F.round(F.col("_ideal") - F.col("_j"), 9)), stratum)
    won = seats.withColumn("_r", F.row_number().over(order)).filter("_r <= _left").groupBy(stratum).agg(F.count("*").alias("_won"))
    return s.join(won, stratum, "left").select(stratum, (F.col("_base") + F.coalesce("_won", F.lit(0))).alias("quota"))


def sweep(scored: DataFrame, score: str, relevant: Column, thresholds: list[float]) -> DataFrame:
    """For each threshold tp, fp, fn, precision and recall (1.0 where the denominator is 0), in one pass."""
    each = F.explode(F.array(*[F.lit(t) for t in thresholds]))
    shown = F.col(score) >= F.col("threshold")
    out = scored.withColumn("_rel", relevant).withColumn("threshold", each).groupBy("threshold").agg(
        F.count_if(shown & F.col("_rel")).alias("tp"), F.count_if(shown & ~F.col("_rel")).alias("fp"), F.count_if(~shown & F.col("_rel")).alias("fn")
    )
    return out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0)})


def pick_threshold(swept: DataFrame, floor: float) -> DataFrame:
    """The threshold with the best recall among those of enough precision, the lower one of equals; else the most precise."""
    good = F.col("precision") >= floor
    return swept.orderBy(F.desc(good), F.desc(F.when(good, F.col("recall")).otherwise(F.col("precision"))), "threshold").limit(1)


def midpoints(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Candidate thresholds: midpoints of neighbouring distinct scores of each key, and one below and above all."""
    d = df.select(*keys, score).distinct()
    w = Window.partitionBy(*keys).orderBy(score)
    inner = d.withColumn("_next", F.lead(score).over(w)).filter("_next is not null").select(*keys, ((F.col(score) + F.col("_next")) / 2).alias("theta"))
    ends = d.groupBy(*keys).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi")).select(*keys, F.explode(F.array(F.col("_lo") - 1.0, F.col("_hi") + 1.0)).alias("theta"))
    return inner.unionByName(ends)


def strata_estimate(counts: DataFrame, k: str, n: str, weight: str, z: float = 1.96) -> DataFrame:
    """Weighted rate and clipped interval over strata that were observed, their weights rescaled to sum to 1."""
    seen = counts.filter(F.col(n) > 0).withColumn("_w", F.col(weight) / F.sum(weight).over(Window.partitionBy()))
    p = F.col(k) / F.col(n)
    one = seen.agg(F.sum(F.col("_w") * p).alias("rate"), F.sum(F.col("_w") * F.col("_w") * p * (1 - p) / F.col(n)).alias("_var"))
    half = z * F.sqrt("_var")
    return one.select("rate", F.greatest(F.lit(0.0), F.col("rate") - half).alias("low"), F.least(F.lit(1.0), F.col("rate") + half).alias("high"))


def binomials(n: int, k: int, uniforms: np.ndarray) -> np.ndarray:
    """The successes of resampling k in n, by inverting the binomial distribution function at the uniforms.

    The function is summed within 12 standard deviations and 60 of the mean: what lies outside is below the uniforms' resolution.
    """
    if k in (0, n):
        return np.full(len(uniforms), k)
    p = k / n
    reach = int(12 * math.sqrt(n * p * (1 - p))) + 60
    first, last = max(0, k - reach), min(n, k + reach)
    at = np.arange(first, last, dtype=float)
    steps = np.log((n - at) / (at + 1)) + math.log(p / (1 - p))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    below = np.cumsum(np.exp(logs - logs.max()))
    return first + np.searchsorted(below / below[-1], uniforms, side="left")


def _resampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n, k, weight, us in zip(*(batch.column(c).to_pylist() for c in ("n", "k", "weight", "us")), strict=True):
            parts = weight * (binomials(n, k, np.array(us)) / n)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(us)), pa.int64()), pa.array(parts, pa.float64())], names=["replicate", "part"])


def bootstrap(counts: DataFrame, stratum: str, k: str, n: str, weight: str, replicates: int) -> DataFrame:
    """Low and high of the resampled rate by index: each replicate draws every stratum's n outcomes with replacement, and its rate is the
    sum of the strata's weights times their resampled shares. The same on every run: the uniforms are 52 bits of the SHA-256 of
    replicate and stratum. Strata without outcomes take no part; their weight is for the caller to share out.

    The successes of n draws are an exact binomial, taken at one uniform, so that work is per stratum and not per outcome.
    """
    u = lambda i: (F.conv(F.substring(F.sha2(F.concat_ws(":", i.cast("string"), F.col(stratum).cast("string")), 256), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    us = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), u)
    seen = counts.filter(F.col(n) > 0).select(F.col(n).cast("long").alias("n"), F.col(k).cast("long").alias("k"), F.col(weight).cast("double").alias("weight"), us.alias("us"))
    drawn = seen.mapInArrow(_resampled, "replicate bigint, part double")
    rates = drawn.groupBy("replicate").agg(F.sum("part").alias("rate"))
    at = rates.withColumn("_i", F.row_number().over(Window.orderBy("rate", "replicate")) - 1)  # one row a replicate
    low, high = int(0.025 * replicates), min(int(0.975 * replicates), replicates - 1)
    return at.agg(F.max(F.when(F.col("_i") == low, F.col("rate"))).alias("low"), F.max(F.when(F.col("_i") == high, F.col("rate"))).alias("high"))


#: Ranges of a pass, and values of a range that one task sorts.
RANGES, SORTED = 1024, 4096


def at_ranks(rows: DataFrame, group: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """group, n (its values) and one column for each of `ranks`: the value at that rank. A rank is a column over n, from 0 in order.

    Each pass counts a group's values by RANGES ranges between the least and the greatest that are left, and goes on with the one that
    holds the rank; a range of one value, or of few enough to sort, ends it. So no task gets a group's values, and counts
    are at most RANGES for each group and rank. Null values don't count; NaN isn't taken.
    """
    values = rows.filter(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    sizes = values.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()]))
    left = cut(sizes.select("g", "n", "lo", "hi", each.alias("w")).select("g", "n", "w.name", "w.rank", "lo", "hi", F.col("n").alias("size")))
    small = (F.col("lo") == F.col("hi")) | (F.col("size") <= SORTED)
    found = left.filter(small)
    while not (left := left.filter(~small)).isEmpty():
        near = _within(values, left)
        at = F.least(F.lit(RANGES - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * RANGES))  # halves: no overflow
        counts = near.groupBy("g", "n", "name", "rank", at.alias("range")).agg(F.count("*").alias("size"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("size").over(Window.partitionBy("g", "name").orderBy("range"))
        inner = counts.withColumn("_upto", upto).filter((F.col("_upto") > F.col("rank")) & (F.col("_upto") - F.col("size") <= F.col("rank")))
        left = cut(inner.select("g", "n", "name", (F.col("rank") - F.col("_upto") + F.col("size")).alias("rank"), "lo", "hi", "size"))
        found = found.unionByName(left.filter(small))
    one = found.filter("lo = hi").select("g", "n", "name", F.col("lo").alias("v"))
    few = found.filter("lo < hi")
    order = Window.partitionBy("g", "name").orderBy("v")
    few = _within(values, few).withColumn("_r", F.row_number().over(order) - 1).filter("_r = rank").select("g", "n", "name", "v")
    wide = one.unionByName(few).groupBy("g", "n").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks])
    return wide.withColumnRenamed("g", group)


def _within(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """The values between lo and hi of each wanted row of their group."""
    per = wanted.groupBy(F.col("g").alias("_g")).agg(F.collect_list(F.struct("n", "name", "rank", "lo", "hi")).alias("_w"))  # a row a rank
    met = joins.joined_small(values, per, F.col("g").eqNullSafe(F.col("_g")), per.count() * 512)
    fits = F.filter("_w", lambda w: (F.col("v") >= w["lo"]) & (F.col("v") <= w["hi"]))
    return met.select("g", "v", F.explode(fits).alias("w")).select("g", "v", "w.*")


def percentiles(rows: DataFrame, group: str, value: str, p: float) -> DataFrame:
    """n, nearest (nearest rank) and by_index (the value at place n * p from 0) of each group."""
    n = F.col("n")
    return at_ranks(rows, group, value, {"nearest": F.greatest(F.ceil(n * p), F.lit(1)) - 1, "by_index": F.least(n - 1, F.floor(n * p))})
