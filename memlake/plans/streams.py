"""Queries whose rows come from files they wrote: real segments with torn lines, and streams that are drained and restarted."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from memlake.operators.integrity import shared_folder
from memlake.plans.registry import Registry
from memlake.sources import records as S
from memlake.streaming import events as E

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

_DAYS = "SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, epoch_us(ts) AS us FROM events"


def _folder(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/memlake-{name}-{uuid.uuid4().hex}"


@R.query(f"SELECT 'day=' || day AS segment, count(*) AS lines, count(*) FILTER (WHERE event_id % 97 = 5) AS torn, count(DISTINCT CASE WHEN event_id % 97 <> 5 THEN user_id END) AS requests, max(CASE WHEN event_id % 97 <> 5 THEN us END) AS last FROM ({_DAYS}) GROUP BY day")
def segment_files(t):
    """A ledger written as one folder of JSON lines a day, some lines torn, read back by byte ranges: lines, torn ones, requests and the last time of each segment."""
    path = _folder(t, "segments")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    whole = F.to_json(F.struct(F.concat(F.lit("u"), "user_id").alias("rid"), F.col("event_type").alias("kind"), us.alias("ts"), F.rpad(F.lit(""), F.col("event_id") % 500, F.lit("é")).alias("note")))
    line = F.when(F.col("event_id") % 97 == 5, F.substring(whole, F.lit(1), F.length(whole) - 1 - F.pmod("user_id", F.lit(9)).cast("int"))).otherwise(whole)
    t.events.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), line.alias("value")).write.partitionBy("day").text(path)
    rows = S.segments(t.spark, path, "rid string, kind string, ts bigint")
    good = F.when(~F.col("torn"), F.col("rid")), F.when(~F.col("torn"), F.col("ts"))
    return rows.groupBy("segment").agg(F.count("*").alias("lines"), F.count_if("torn").alias("torn"), F.countDistinct(good[0]).alias("requests"), F.max(good[1]).alias("last"))


#: How many times the stream is drained, each time after another share of the time.
DRAINS = 4


@R.query(
    """WITH e AS (SELECT user_id, epoch_ms(ts) AS ms, event_type = 'purchase' AND event_id % 9 = 0 AS done FROM events WHERE ts IS NOT NULL), n AS (SELECT max(ms) AS now FROM e),
u AS (SELECT user_id, min(ms) + 10 * 86400000 AS due, max(CASE WHEN done THEN ms END) AS last FROM e GROUP BY user_id)
SELECT user_id, CASE WHEN last >= due THEN 'ok' WHEN now >= due + 7 * 86400000 THEN 'overdue' WHEN now >= due THEN 'due' ELSE 'ok' END AS state FROM u, n"""
)
def review_timers_streamed(t):
    """Reviews due, overdue and done as a stream with timers leaves them: drained four times as rows come, each time from its checkpoint; the last state of each key."""
    return last_states(t, _folder(t, "timers"))


def last_states(t, path: str, write=None):
    """Shares of the events by time are written under `path`, each once, and the stream is drained after each. Run again on the same path it goes on
    where it failed. `write` makes a batch writer from a path (a test lets it fail)."""
    rows = t.events.filter("ts is not null").select("user_id", F.col("ts").cast("timestamp").alias("ts"), ((F.col("event_type") == "purchase") & (F.col("event_id") % 9 == 0)).alias("done"))
    ends = rows.agg(F.unix_micros(F.min("ts")).alias("lo"), F.unix_micros(F.max("ts")).alias("hi")).first()
    lo, hi = (x or 0 for x in ends)
    share = F.least(F.lit(DRAINS - 1), F.floor((F.unix_micros("ts") - lo) * DRAINS / (hi - lo + 1)))
    for k in range(DRAINS):
        done = t.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/in/share-{k}/_SUCCESS")
        if not done.getFileSystem(t.spark._jsc.hadoopConfiguration()).exists(done):
            rows.filter(share == k).write.mode("overwrite").parquet(f"{path}/in/share-{k}")
        stream = t.spark.readStream.schema(rows.schema).parquet(f"{path}/in/*")
        E.drain(E.review_timers(stream, "user_id", "ts", "done", 10), f"{path}/state", (write or E.append_once)(f"{path}/out")).awaitTermination()
    out = t.spark.read.schema("key bigint, step bigint, state string, at bigint").parquet(f"{path}/out/*")
    return out.groupBy(F.col("key").alias("user_id")).agg(F.max_by("state", "step").alias("state"))
