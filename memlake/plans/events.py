"""Queries over event ledgers: effective states, streaks, cursors, windows in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators import joins as J
from memlake.operators import ledger as L
from memlake.operators import windows as W
from memlake.plans.registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

#: A request: a user's events of one day.
RID = "CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d')"


def _events(t):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rid = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd"))
    return t.events.select("event_id", "user_id", "event_type", "value", "props", "ts", ms.alias("ms"), rid.alias("rid"))


@R.query(
    f"""WITH e AS (SELECT {RID} AS rid, count(*) FILTER (WHERE event_type = 'error') AS aborts, count(*) FILTER (WHERE event_type = 'purchase') AS ends, count(*) FILTER (WHERE event_type = 'signup') AS late FROM events GROUP BY 1)
SELECT rid, CASE WHEN aborts > 0 THEN 'aborted' WHEN late > 0 THEN 'aborted_event' WHEN ends = 0 THEN 'missing_terminal' WHEN ends > 1 THEN 'duplicate_terminal' ELSE 'ok' END AS status FROM e"""
)
def effective_status(t):
    return L.effective_status(_events(t), "rid", F.col("event_type") == "error", F.col("event_type") == "signup", F.col("event_type") == "purchase")


@R.query(
    f"""WITH e AS (SELECT *, {RID} AS rid FROM events),
s AS (SELECT rid, min((epoch_us(ts) // 1000)) AS started FROM e WHERE event_type = 'view' GROUP BY rid),
a AS (SELECT rid, count(*) AS accepted, arg_max(event_id, struct_pack(m := (epoch_us(ts) // 1000), i := event_id)) AS last_accepted FROM e WHERE event_type = 'click' GROUP BY rid),
d AS (SELECT rid, count(*) AS scored, max(value) AS best FROM e WHERE event_type = 'purchase' GROUP BY rid),
x AS (SELECT DISTINCT rid FROM e WHERE event_type = 'error')
SELECT s.rid, s.started, coalesce(a.accepted, 0) AS accepted, a.last_accepted, coalesce(d.scored, 0) AS scored, d.best, x.rid IS NOT NULL AS aborted
FROM s LEFT JOIN a USING (rid) LEFT JOIN d USING (rid) LEFT JOIN x ON s.rid = x.rid"""
)
def ledger_materialize(t):
    return L.materialized(_events(t))


@R.query(
    f"""WITH e AS (SELECT {RID} AS rid, event_type FROM events), v AS (SELECT rid, bool_or(event_type = 'click') AS accepted, bool_or(event_type = 'purchase') AS scored, bool_or(event_type = 'error') AS aborted FROM e GROUP BY rid)
SELECT count(*) AS requests, count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE scored) AS scored, count(*) FILTER (WHERE accepted AND NOT scored AND NOT aborted) AS orphans,
count(*) FILTER (WHERE scored) / count(*) AS scored_rate, CAST(ceil(0.05 * count(*)) AS BIGINT) AS gate FROM v"""
)
def ledger_dod_stats(t):
    each = _events(t).groupBy("rid").agg(*[F.bool_or(F.col("event_type") == k).alias(n) for n, k in (("accepted", "click"), ("scored", "purchase"), ("aborted", "error"))])
    orphan = F.col("accepted") & ~F.col("scored") & ~F.col("aborted")
    return each.agg(
        F.count("*").alias("requests"), F.count_if("accepted").alias("accepted"), F.count_if("scored").alias("scored"), F.count_if(orphan).alias("orphans"),
        (F.count_if("scored") / F.count("*")).alias("scored_rate"), F.ceil(F.lit(0.05) * F.count("*")).cast("long").alias("gate"),
    )


@R.query(
    f"""WITH e AS (SELECT *, {RID} AS rid FROM events), now AS (SELECT max((epoch_us(ts) // 1000)) AS t FROM events)
SELECT rid, min((epoch_us(ts) // 1000)) AS first_ms FROM e, now WHERE event_type = 'click' AND rid NOT IN (SELECT rid FROM e WHERE event_type IN ('purchase', 'error'))
GROUP BY rid, now.t HAVING now.t - min((epoch_us(ts) // 1000)) > 86400000"""
)
def orphan_requests(t):
    e = _events(t)
    done = e.filter(F.col("event_type").isin("purchase", "error")).select("rid").distinct()
    now = e.agg(F.max("ms").alias("now"))  # one row
    waiting = e.filter("event_type = 'click'").join(done, "rid", "left_anti").groupBy("rid").agg(F.min("ms").alias("first_ms"))
    return waiting.join(F.broadcast(now), F.col("now") - F.col("first_ms") > 86400000).select("rid", "first_ms")


@R.query(
    """WITH o AS (SELECT user_id, event_type, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
c AS (SELECT user_id, island, event_type, count(*) AS n FROM o WHERE event_type <> 'purchase' GROUP BY ALL) SELECT user_id, max(n) AS streak FROM c GROUP BY user_id"""
)
def streak_same_error(t):
    return W.longest_streak(_events(t), ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "purchase", "event_type")


@R.query(
    """SELECT user_id, event_type, event_id, attempt_no FROM (SELECT user_id, event_type, event_id, attempt_no, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END DESC, attempt_no DESC) AS r
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS attempt_no FROM events)) WHERE r = 1"""
)
def fold_best_attempt(t):
    numbered = L.numbered_attempts(_events(t), "user_id", [F.col("ts"), F.col("event_id")])
    tier = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 2).otherwise(1)
    return L.best_attempt(numbered, "user_id", tier, "attempt_no", ["event_type", "event_id", "attempt_no"])


@R.query(
    """WITH n AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 0 ELSE (epoch_us(ts) // 1000) // 86400000 END AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
SELECT user_id, event_id, i + greatest(0, coalesce(max(CASE WHEN t > 0 THEN t - i END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0)) AS unique_ts FROM n"""
)
def monotone_unique_ts(t):
    day = F.when(F.col("event_type") == "error", F.lit(0)).otherwise(F.floor(F.col("ms") / 86400000)).cast("long")
    rows = _events(t).withColumn("t", day)
    return W.unique_times(rows, ["user_id"], "t", [F.col("event_id")]).select("user_id", "event_id", "unique_ts")


@R.query(
    """WITH p AS (SELECT user_id, event_id, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) = 0 AS ok FROM events)
SELECT user_id, max(event_id) FILTER (WHERE ok) AS cursor, count(*) FILTER (WHERE NOT ok) AS left_behind FROM p GROUP BY user_id"""
)
def error_free_prefix(t):
    rows = W.error_free_prefix(_events(t), ["user_id"], [F.col("event_id")], F.col("event_type") == "error")
    return rows.groupBy("user_id").agg(F.max(F.when(F.col("advances"), F.col("event_id"))).alias("cursor"), F.count_if(~F.col("advances")).alias("left_behind"))


@R.query("SELECT user_id, max(event_id) AS position FROM events GROUP BY user_id")
def cursor_upsert(t):
    rows = t.events.select("user_id", F.col("event_id").alias("position"))
    return J.upsert_latest(rows.filter("position % 3 = 0"), rows.filter("position % 3 <> 0"), ["user_id"], "position")


@R.query(
    """WITH o AS (SELECT (epoch_us(ts) // 1000) AS ms, row_number() OVER (ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'view'), f AS (SELECT min(ms) AS launched FROM o),
d AS (SELECT min(ms) AS due FROM o, f WHERE n >= 200 OR ms - launched >= 30 * CAST(86400000 AS BIGINT)), l AS (SELECT max(ms) AS now FROM o)
SELECT launched, due, CASE WHEN due IS NULL THEN 'open' WHEN now - due > 7 * CAST(86400000 AS BIGINT) THEN 'overdue' ELSE 'due' END AS state FROM f, d, l"""
)
def review_checkpoint(t):
    return L.review_state(_events(t).filter("event_type = 'view'").select("ms", "event_id"), "ms", 200, 30, 7)


@R.query(
    """WITH o AS (SELECT user_id, event_id, event_type = 'error' AS bad, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
c AS (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id, island) AS n, bad FROM o WHERE bad) SELECT user_id, max(n) AS failures, max(n) >= 2 AS opens FROM c GROUP BY user_id"""
)
def circuit_breaker(t):
    flagged = _events(t).withColumn("code", F.lit("failure"))
    runs = W.longest_streak(flagged, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") != "error", "code")
    return runs.select("user_id", F.col("streak").alias("failures"), (F.col("streak") >= 2).alias("opens"))


@R.query(
    """SELECT event_type, count(*) AS n, min(value) AS lowest, max(value) AS highest, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, round(avg(value), 6) AS mean FROM events WHERE value IS NOT NULL GROUP BY event_type"""
)
def latency_report(t):
    p = {f"p{round(100 * q)}": F.expr(f"percentile_disc({q}) within group (order by value)") for q in (0.5, 0.95, 0.99)}
    rows = t.events.filter("value is not null").groupBy("event_type")
    return rows.agg(F.count("*").alias("n"), F.min("value").alias("lowest"), F.max("value").alias("highest"), *[c.alias(n) for n, c in p.items()], F.round(F.avg("value"), 6).alias("mean"))


@R.query("SELECT event_type, epoch_ms(time_bucket(INTERVAL 1 HOUR, ts)) AS begins, count(*) AS n FROM events GROUP BY ALL")
def tumbling(t):
    rows = t.events.groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("event_type", F.unix_millis("w.start").alias("begins"), "n")


@R.query(
    """SELECT event_type, begins, count(*) AS n FROM (SELECT event_type, ((epoch_us(ts) // 1000) // 1800000 - k) * 1800000 AS begins FROM events, (VALUES (0), (1)) v(k)) GROUP BY ALL"""
)
def sliding(t):
    rows = t.events.groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("event_type", F.unix_millis("w.start").alias("begins"), "n")


@R.query(
    """WITH g AS (SELECT user_id, (epoch_us(ts) // 1000) AS ms, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 3600000000 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS i FROM g) SELECT user_id, min(ms) AS begins, count(*) AS n FROM s GROUP BY user_id, i"""
)
def sessionize(t):
    rows = t.events.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.unix_millis("w.start").alias("begins"), "n")


@R.query("SELECT strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def timeline_groups(t):
    local = F.date_format(F.col("ts") + F.expr("INTERVAL 8 HOURS"), "yyyy-MM-dd")
    return t.events.groupBy(local.alias("day"), "event_type").agg(F.count("*").alias("n"))


@R.query(
    """WITH c AS (SELECT user_id, arg_max(event_id, event_id) AS call_id FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT e.event_id, c.call_id FROM events e LEFT JOIN c ON e.user_id = c.user_id WHERE e.event_type = 'error'"""
)
def call_result_lookup(t):
    calls = t.events.filter("event_type = 'signup'").groupBy("user_id").agg(F.max("event_id").alias("call_id"))
    return t.events.filter("event_type = 'error'").join(calls, "user_id", "left").select("event_id", "call_id")


@R.query(
    """SELECT command, count(*) AS n, sum(size) AS total, CAST(quantile_disc(size, 0.5) AS BIGINT) AS p50, max(size) AS longest, sum(size) / (SELECT sum(length(props)) FROM events) AS share FROM
(SELECT event_type AS command, length(props) AS size FROM events) GROUP BY command ORDER BY total DESC, command LIMIT 25"""
)
def command_distribution(t):
    return L.length_distribution(t.events, "event_type", F.length("props"), 25)


@R.query("SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 90 GROUP BY ALL")
def json_payload_read(t):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return t.events.select("user_id", k.alias("k")).filter("k >= 90").groupBy("user_id", "k").agg(F.count("*").alias("n"))
