"""States, caches, restores, watermarks and answers of a search as small plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reset_deferred(journal: DataFrame) -> DataFrame:
    """id, status, deferred_days, starved: deferred rows are pending again and a day older."""
    deferred = F.col("status") == "deferred"
    days = F.when(deferred, F.col("deferred_days") + 1).otherwise(F.col("deferred_days"))
    return journal.select("id", F.when(deferred, "pending").otherwise(F.col("status")).alias("status"), days.alias("deferred_days"), (deferred & (days >= 2)).alias("starved"))


def transitions(rows: DataFrame, wanted: Column, to: Column) -> DataFrame:
    """Rows whose status is the wanted one get the next; the others stay and are violations."""
    met = F.col("status") == wanted
    return rows.withColumn("violation", ~met).withColumn("status", F.when(met, to).otherwise(F.col("status")))


def whole_batches(rows: DataFrame, batch: str, good: Column) -> DataFrame:
    """Rows of batches in which every row is good."""
    bad = rows.filter(~good).select(batch).distinct()
    return rows.join(bad, batch, "left_anti")


def with_block(text: Column, block: Column, begin: str = "# begin\n", end: str = "# end\n") -> Column:
    """The text without its marked blocks, the new one in front."""
    return F.concat(block, F.regexp_replace(text, f"(?s){begin}.*?{end}", ""))


def restored(winners: DataFrame, copies: DataFrame, key: str, digest: str, copy: str) -> DataFrame:
    """Winners with the state of their copy, and whether all copies are whole."""
    rows = winners.join(copies, key, "left")
    state = F.when(F.col(copy).isNull(), "missing").when(F.col(copy) != F.col(digest), "torn").otherwise("ok")
    all_ok = rows.agg((F.count_if(~F.coalesce(F.col(copy) == F.col(digest), F.lit(False))) == 0).alias("complete"))
    return rows.withColumn("state", state).crossJoin(F.broadcast(all_ok))  # one row


def advanced(rows: DataFrame, key: str, mark: str, stored: str) -> DataFrame:
    """For each key state, mark and rows taken, from its rows and its stored mark (text; null: none yet; no number: corrupt)."""
    upto = F.when(F.col(stored).rlike(r"^[0-9]{1,18}\z"), F.col(stored).cast("bigint"))
    corrupt = F.col(stored).isNotNull() & upto.isNull()
    one = rows.groupBy(key).agg(F.bool_or(corrupt).alias("_bad"), F.bool_or(F.col(stored).isNull()).alias("_new"), F.max(mark).alias("_last"), F.count_if(F.col(mark) > upto).alias("taken"))
    return one.select(key, F.when(F.col("_bad"), "corrupt").when(F.col("_new"), "seeded").otherwise("advanced").alias("state"), F.when(~F.col("_bad"), F.col("_last")).alias("mark"), "taken")


def extension(size: Column, digest: Column, text: Column) -> Column:
    """same, appended, or drift: whether the recorded prefix, by length and digest, is still there."""
    kept = F.sha2(F.substring(text, F.lit(1), size), 256) == digest
    return F.when(kept & (F.length(text) > size), "appended").when(kept & (F.length(text) == size), "same").otherwise("drift")


def answered(hits: DataFrame, want: int, most: int, per_path: int, clamp: int, budget: int) -> DataFrame:
    """q, place, doc_id, shown, n: each query's answer out of hits (q, doc_id, path, score, size).

    Only the best min(3 * want, most) hits of a query are looked at, so every window after the first is bounded.
    """
    best = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")
    fetched = hits.withColumn("pos", F.row_number().over(best)).filter(F.col("pos") <= min(3 * want, most))
    over = (F.row_number().over(Window.partitionBy("q", "path").orderBy("pos")) > per_path).cast("int")
    placed = fetched.withColumn("_over", over).withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("_over", "pos")).cast("long")).filter(F.col("place") <= want)
    shown = F.least("size", F.lit(clamp))
    upto = F.sum(shown).over(Window.partitionBy("q").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = placed.withColumn("_bytes", upto).filter(F.col("_bytes") <= budget)
    return cut.select("q", "place", "doc_id", shown.alias("shown"), F.count("*").over(Window.partitionBy("q")).alias("n"))


def bounds(spec: Column, today: Column) -> tuple[Column, Column]:
    """First and last day of a bound: today, yesterday, `7d`, or a date from which on."""
    days = F.when(spec.rlike(r"^[0-9]+d\z"), F.regexp_extract(spec, "^([0-9]+)d", 1)).cast("int")
    date = F.unix_date(F.when(spec.rlike(r"^\d{4}-\d{2}-\d{2}\z"), spec).cast("date"))
    begin = F.when(spec == "today", today).when(spec == "yesterday", today - 1).when(days.isNotNull(), today - days + 1).otherwise(date)
    return begin, F.when(spec == "yesterday", today - 1).otherwise(today)


def exactly_one(rows: DataFrame, wanted: dict) -> DataFrame:
    """Rows by exactly one of the ways to name them."""
    if len(wanted) != 1:
        raise ValueError("name what is wanted in exactly one way")
    return rows.filter(reduce(Column.__and__, [F.col(k) == v for k, v in wanted.items()]))


def chain_verdicts(c: DataFrame) -> DataFrame:
    """name, verdict, tip, next_generation of digests that point to the one before by name and hash."""
    before = c.select(F.col("name").alias("_name"), F.col("own_sha").alias("_sha"))
    last = c.agg(F.max("generation").alias("_last"))
    verdict = (
        F.when(F.col("prev_name").isNull() & F.col("rebaselined"), "rebaselined")
        .when(F.col("prev_name").isNull(), "first")
        .when(F.col("_name").isNull(), "no_predecessor")
        .when(F.col("_sha") != F.col("prev_sha"), "hash_differs")
        .otherwise("ok")
    )
    rows = c.join(before, F.col("prev_name") == F.col("_name"), "left").crossJoin(F.broadcast(last))  # one row
    return rows.select("name", verdict.alias("verdict"), (F.col("generation") == F.col("_last")).alias("tip"), (F.col("_last") + 1).alias("next_generation"))


def beyond(rows: DataFrame, recorded: DataFrame, key: str, at: str, without: list[str]) -> DataFrame:
    """Rows after what is recorded for their key (upto), but for excluded keys; keys without a record have none."""
    return rows.filter(~F.col(key).isin(*without)).join(recorded, key).filter(F.col(at) > F.col("upto"))
