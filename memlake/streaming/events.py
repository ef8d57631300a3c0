"""Structured Streaming twins: exactly-once facts, cursors, effective states, windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_json_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def once_per_key(stream: DataFrame, key: str, ts: str, lateness: str) -> DataFrame:
    """Each key's first row within the lateness: state is dropped behind the watermark, so it stays bounded."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def status_counts(stream: DataFrame, rid: str, kind: str) -> DataFrame:
    """Counts of each kind for each request, for update mode: a late row only counts again, none is dropped."""
    return stream.groupBy(rid).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in ("started", "terminal", "aborted")])


def windowed_counts(stream: DataFrame, ts: str, kind: str, length: str, lateness: str) -> DataFrame:
    return stream.withWatermark(ts, lateness).groupBy(F.window(ts, length), kind).count()


def drain(stream: DataFrame, checkpoint: str, write, mode: str = "append") -> StreamingQuery:
    """Run over all there is and stop. write(batch, batch_id) must be idempotent by batch_id: a batch may be repeated."""
    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_once(path: str):
    """A batch writer that puts each batch in a folder named by its number: a repeated batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


#: A day and a week in milliseconds.
DAY, WEEK = 86_400_000, 7 * 86_400_000


def review_timers(stream: DataFrame, key: str, ts: str, reviewed: str, days: int) -> DataFrame:
    """key, step, state, at: what becomes of each key's review, which is due `days` after its first row and overdue a week after that.

    Keyed state with event-time timers: `ok` at the first row; `due` and `overdue` when the watermark passes their time without a review
    at or after the due time; `ok` again with such a review, for good. `reviewed` is a boolean column, `at` milliseconds. A key's state is
    three numbers and its stage. Rows behind the watermark are dropped, so deal them out in order of time or allow for lateness.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(group: tuple, batches, state: GroupState):
        first, last, stage, n = state.get if state.exists else (None, None, "new", 0)
        seen = [b for b in batches] if not state.hasTimedOut else []
        for b in seen:
            first = min(x for x in (first, int(b["_ms"].min())) if x is not None)
            done = b.loc[b["_done"], "_ms"]
            last = max((x for x in (last, int(done.max()) if len(done) else None) if x is not None), default=None)
        due, out = first + days * DAY, []
        now = state.getCurrentWatermarkMs()
        want = "ok" if last is not None and last >= due else "overdue" if now >= due + WEEK else "due" if now >= due else "ok"
        cleared = want == "ok" and last is not None and last >= due
        if want != stage:
            out.append((group[0], n, want, {"ok": last if cleared else first, "due": due, "overdue": due + WEEK}[want]))
            stage, n = want, n + 1
        state.update((first, last, stage, n))
        if not cleared and stage != "overdue":
            state.setTimeoutTimestamp(max((due if stage == "ok" else due + WEEK) - 1, now + 1))  # fires once the watermark is beyond it
        if out:
            yield pd.DataFrame(out, columns=["key", "step", "state", "at"])

    rows = stream.withWatermark(ts, "0 seconds").select(F.col(key).alias("key"), F.col(ts), F.unix_millis(ts).alias("_ms"), F.col(reviewed).alias("_done"))
    kind = stream.schema[key].dataType.simpleString()
    return rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, step bigint, state string, at bigint", "first bigint, last bigint, stage string, n bigint", "append", GroupStateTimeout.EventTimeTimeout)
