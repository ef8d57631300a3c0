"""Append-only event streams: attempts, effective states, one row per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def effective_status(events: DataFrame, rid: str, abort: Column, aborted: Column, terminal: Column) -> DataFrame:
    """Status by priority: an abort outranks an aborted event, then a missing or repeated terminal; late rows just recount."""
    n = events.groupBy(rid).agg(F.count_if(abort).alias("_a"), F.count_if(aborted).alias("_b"), F.count_if(terminal).alias("_t"))
    status = F.when(F.col("_a") > 0, "aborted").when(F.col("_b") > 0, "aborted_event").when(F.col("_t") == 0, "missing_terminal").when(F.col("_t") > 1, "duplicate_terminal").otherwise("ok")
    return n.select(rid, status.alias("status"))


def materialized(events: DataFrame) -> DataFrame:
    """One row for each started request: the streams are aggregated in one pass over their union instead of joined."""
    kind = lambda k: F.col("event_type") == k
    each = events.groupBy("rid").agg(
        F.min(F.when(kind("view"), F.col("ms"))).alias("started"),
        F.count_if(kind("click")).alias("accepted"),
        F.max(F.when(kind("click"), F.struct("ms", "event_id"))).alias("_last"),
        F.count_if(kind("purchase")).alias("scored"),
        F.max(F.when(kind("purchase"), F.col("value"))).alias("best"),
        F.bool_or(kind("error")).alias("aborted"),
    )
    return each.filter("started is not null").select("rid", "started", "accepted", F.col("_last.event_id").alias("last_accepted"), "scored", "best", "aborted")


def numbered_attempts(events: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Attempts of each key numbered from 0."""
    return events.withColumn("attempt_no", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))


def best_attempt(attempts: DataFrame, key: str, tier: Column, attempt: str, columns: list[str]) -> DataFrame:
    """For each key the attempt of the best tier, the latest of equals."""
    best = attempts.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(tier, attempt)).alias("_b"))
    return best.select(key, *[F.col(f"_b.{c}") for c in columns])


def review_state(queries: DataFrame, ms: str, count: int, days: int, grace: int) -> DataFrame:
    """A review is due after `days` or at the `count`th query, overdue `grace` days later; now is the last query."""
    day = 86_400_000
    ends = queries.agg(F.min(ms).alias("launched"), F.max(ms).alias("now"))
    nth = queries.orderBy(ms, "event_id").limit(count).agg(F.count("*").alias("_n"), F.max(ms).alias("_nth"))
    late = queries.crossJoin(F.broadcast(ends)).filter(F.col(ms) - F.col("launched") >= days * day).agg(F.min(ms).alias("_late"))
    one = ends.crossJoin(nth).crossJoin(late)  # one row each
    one = one.withColumn("due", F.least(F.when(F.col("_n") >= count, F.col("_nth")), "_late"))
    state = F.when(F.col("due").isNull(), "open").when(F.col("now") - F.col("due") > grace * day, "overdue").otherwise("due")
    return one.select("launched", "due", state.alias("state"))


def length_distribution(df: DataFrame, command: str, size: Column, top: int) -> DataFrame:
    """Count, total, median, longest and share of each command, the largest totals first."""
    rows = df.select(F.col(command).alias("command"), size.cast("long").alias("size"))
    each = rows.groupBy("command").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.expr("percentile_disc(0.5) within group (order by size)").cast("long").alias("p50"), F.max("size").alias("longest"))
    return each.withColumn("share", F.col("total") / F.sum("total").over(Window.partitionBy())).orderBy(F.desc("total"), "command").limit(top)
