"""Queries over sessions, samples, caches and accounting."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake.functions import rules as T
from memlake.operators import sessions as O
from memlake.operators import statistics as S
from memlake.operators import windows as W
from memlake.plans.registry import Registry
from memlake.plans.shaping import sql_rescue

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.query(
    """WITH RECURSIVE m AS (SELECT conv_id, turn, coalesce(text, '') AS body, role = 'assistant' AS orphan, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, ''), role = 'assistant') AS i FROM conversations),
f AS (SELECT conv_id, turn AS begins, body, CAST(0 AS BIGINT) AS merged, i, 1 AS g FROM m WHERE i = 1 UNION ALL
SELECT m.conv_id, CASE WHEN m.orphan AND length(f.body) + 1 + length(m.body) <= 2000 THEN f.begins ELSE m.turn END, CASE WHEN m.orphan AND length(f.body) + 1 + length(m.body) <= 2000 THEN f.body || chr(10) || m.body ELSE m.body END,
CASE WHEN m.orphan AND length(f.body) + 1 + length(m.body) <= 2000 THEN f.merged + 1 ELSE 0 END, m.i, CASE WHEN m.orphan AND length(f.body) + 1 + length(m.body) <= 2000 THEN f.g ELSE f.g + 1 END FROM f JOIN m ON m.conv_id = f.conv_id AND m.i = f.i + 1)
SELECT conv_id, begins, sha256(body) AS digest, merged FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, g ORDER BY i DESC) AS r FROM f) WHERE r = 1"""
)
def orphan_coalesce(t):
    rows = O.merged_orphans(t.conversations, ["conv_id"], "turn", F.col("role") == "assistant", "text", 2000)
    return rows.select("conv_id", F.col("at").alias("begins"), F.sha2("body", 256).alias("digest"), "merged")


@R.query(
    """SELECT conv_id, turn, CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'assistant' END AS role, CASE WHEN role IN ('user', 'assistant') THEN text ELSE '[' || role || '] ' || text END AS content FROM conversations"""
)
def role_mapping(t):
    return t.conversations.select("conv_id", "turn", O.role_shape(F.col("role"), F.col("text")).alias("m")).select("conv_id", "turn", "m.role", "m.content")


@R.query("SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN count(*) FILTER (WHERE role = 'assistant') < 3 THEN '<3' WHEN count(*) FILTER (WHERE role = 'assistant') <= 5 THEN '3-5' ELSE '6+' END AS bucket FROM conversations GROUP BY conv_id) GROUP BY bucket")
def tool_round_buckets(t):
    each = t.conversations.groupBy("conv_id").agg(O.round_bucket(F.count_if(F.col("role") == "assistant")).alias("bucket"))
    return each.groupBy("bucket").agg(F.count("*").alias("n"))


@R.query(sql_rescue("SELECT doc_id, text FROM documents", 600))
def clamp_rescue(t):
    return t.documents.select("doc_id", T.clamp_rescuing(F.col("text"), 600).alias("clamped"))


@R.query(
    """WITH o AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events WHERE event_type = 'signup'),
p AS (SELECT DISTINCT CAST(floor(k * (SELECT max(n) FROM o) / 50.0) AS BIGINT) AS i FROM range(50) r(k)) SELECT event_id FROM o JOIN p USING (i)"""
)
def systematic_sample(t):
    """Fifty evenly spaced rows of a stream in time order."""
    rows = t.events.filter("event_type = 'signup'").select("event_id", "ts", F.date_trunc("hour", "ts").alias("hour"))
    numbered = W.numbered_by_range(rows, "hour", [F.col("ts"), F.col("event_id")], "i", "n")
    turn = F.floor(F.ceil(F.col("i") * 50.0 / F.col("n")) * F.col("n") / 50.0)
    return numbered.filter((turn == F.col("i")) & (F.ceil(F.col("i") * 50.0 / F.col("n")) < 50)).select("event_id")


@R.query("SELECT item_id, length(text) AS n, from_base64(to_base64(encode(text))) = encode(text) AS same FROM benchmark")
def snapshot_round_trip(t):
    coded = F.base64(F.encode("text", "UTF-8"))
    return t.benchmark.select("item_id", F.length("text").cast("long").alias("n"), (F.unbase64(coded) == F.encode("text", "UTF-8")).alias("same"))


@R.query("SELECT regexp_replace(url, '^(https?://[^/]+)/.*$', '\\1') AS parent, count(*) AS n FROM pages GROUP BY 1")
def parent_session_key(t):
    return t.pages.groupBy(F.regexp_replace("url", "^(https?://[^/]+)/.*$", "$1").alias("parent")).agg(F.count("*").alias("n"))


@R.query("SELECT item_id, 'useful' AS kind, 'q' || item_id % 7 AS qid, 'card:' || item_id AS card FROM benchmark")
def job_id_split(t):
    job = F.concat_ws(":", F.lit("useful"), F.concat(F.lit("q"), F.col("item_id") % 7), F.lit("card"), "item_id")
    parts = F.split(job, ":", 3)  # Spark's limit counts parts: the rest keeps its colons
    return t.benchmark.select("item_id", parts[0].alias("kind"), parts[1].alias("qid"), parts[2].alias("card"))


@R.query("SELECT sha256(text) AS digest, min(doc_id) AS keep, count(*) - 1 AS others FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_text_groups(t):
    rows = t.documents.filter("text is not null").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("keep"), (F.count("*") - 1).alias("others"))
    return rows.filter("others > 0")


@R.query("SELECT count(DISTINCT user_id) AS users, count(*) AS n, round(sum(value) / nullif(count(DISTINCT user_id), 0), 6) AS unit_cost FROM events WHERE event_type = 'purchase'")
def distinct_ids_and_unit_cost(t):
    one = t.events.filter("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return one.agg(F.count("*").alias("users"), F.sum("n").alias("n"), F.round(F.sum("value") / F.nullif(F.count("*"), F.lit(0)), 6).alias("unit_cost"))


@R.query(
    """SELECT d.source, count(*) FILTER (WHERE coalesce(l.quality, 1) = 1) AS at_most, count(*) FILTER (WHERE coalesce(l.quality, 0) = 1) AS at_least FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source"""
)
def completeness_bounds(t):
    """What a count can be, with missing labels taken either way."""
    rows = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    return rows.groupBy("source").agg(F.count_if(F.coalesce("quality", F.lit(1)) == 1).alias("at_most"), F.count_if(F.coalesce("quality", F.lit(0)) == 1).alias("at_least"))


@R.query("SELECT count(*) AS paths, count(*) FILTER (WHERE n > 1) AS many, CAST(sum(n - 1) AS BIGINT) AS extra FROM (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_orderkey)")
def versions_per_path(t):
    n = t.lineitem.select("l_orderkey", "l_suppkey").distinct().groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("paths"), F.count_if(F.col("n") > 1).alias("many"), F.sum(F.col("n") - 1).alias("extra"))


@R.query(
    """SELECT lang, avg(CASE WHEN doc_id % 2 = 0 THEN CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END END) AS a, avg(CASE WHEN doc_id % 2 = 1 THEN CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END END) AS b,
abs(avg(CASE WHEN doc_id % 2 = 0 THEN CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END END) - avg(CASE WHEN doc_id % 2 = 1 THEN CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END END)) > 0.15 AS sensitive FROM documents JOIN labels USING (doc_id) GROUP BY lang"""
)
def variant_sensitivity(t):
    good = F.when(F.col("quality") == 1, 1.0).otherwise(0.0)
    rows = t.documents.select("doc_id", "lang").join(t.labels, "doc_id").groupBy("lang")
    both = rows.agg(F.avg(F.when(F.col("doc_id") % 2 == 0, good)).alias("a"), F.avg(F.when(F.col("doc_id") % 2 == 1, good)).alias("b"))
    return both.withColumn("sensitive", F.abs(F.col("a") - F.col("b")) > 0.15)


@R.query("SELECT lang, count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) FILTER (WHERE toxic = 0) AS clean, count(*) FILTER (WHERE quality = 0) / count(*) AS noise FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def category_counts(t):
    rows = t.documents.select("doc_id", "lang").join(t.labels, "doc_id").groupBy("lang")
    return rows.agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean"), (F.count_if(F.col("quality") == 0) / F.count("*")).alias("noise"))


@R.query("SELECT doc_id FROM documents WHERE sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE doc_id % 4 = 0)")
def vector_cache_misses(t):
    rows = t.documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    return rows.join(rows.filter("doc_id % 4 = 0").select("key").distinct(), "key", "left_anti").select("doc_id")


@R.query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS position FROM events GROUP BY user_id")
def last_write_wins(t):
    return t.events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("position"))


@R.query(
    """SELECT o_custkey, count(*) FILTER (WHERE total <= 500000) AS paid, count(*) FILTER (WHERE total > 500000) AS stopped FROM (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS total FROM orders) GROUP BY o_custkey"""
)
def spend_cap(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = t.orders.select("o_custkey", (F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(w) <= 500000).alias("ok"))
    return rows.groupBy("o_custkey").agg(F.count_if("ok").alias("paid"), F.count_if(~F.col("ok")).alias("stopped"))


@R.query("SELECT user_id, CAST(sum(n - 1) AS BIGINT) AS retries, count(*) AS rounds FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def retry_accounting(t):
    rounds = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return rounds.groupBy("user_id").agg(F.sum(F.col("n") - 1).alias("retries"), F.count("*").alias("rounds"))


@R.query(
    """SELECT event_type, n, nearest, CAST(list_extract(vs, CAST(least(n - 1, floor(n * 0.95)) AS BIGINT) + 1) AS DOUBLE) AS by_index FROM
(SELECT event_type, count(*) AS n, quantile_disc(value, 0.95) AS nearest, list(value ORDER BY value) AS vs FROM events WHERE value IS NOT NULL GROUP BY event_type)"""
)
def percentile_flavours(t):
    """Nearest rank, and the value at index n * p: the two definitions differ and are kept apart."""
    return S.percentiles(t.events.filter("value is not null").select("event_type", "value"), "event_type", "value", 0.95)


@R.query(
    """SELECT lang, count(*) FILTER (WHERE stage = 1) AS exact, count(*) FILTER (WHERE stage = 2) AS labelled, count(*) FILTER (WHERE stage = 3) AS other FROM
(SELECT lang, CASE WHEN source = 'src3' THEN 1 WHEN l.doc_id IS NOT NULL THEN 2 ELSE 3 END AS stage FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY lang"""
)
def lookup_order(t):
    """The first source that knows an entry answers."""
    rows = t.documents.select("doc_id", "lang", "source").join(t.labels.select("doc_id", F.lit(2).alias("labelled")), "doc_id", "left")
    stage = F.coalesce(F.when(F.col("source") == "src3", 1), "labelled", F.lit(3))
    return rows.groupBy("lang").agg(*[F.count_if(stage == i).alias(n) for i, n in ((1, "exact"), (2, "labelled"), (3, "other"))])


@R.query("SELECT source, max(n_chars) AS longest, count(*) AS generation, sha256(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS input_hash FROM documents WHERE doc_id % 50 = 0 GROUP BY source")
def input_manifest(t):
    rows = t.documents.filter("doc_id % 50 = 0").groupBy("source")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    return rows.agg(F.max("n_chars").alias("longest"), F.count("*").alias("generation"), F.sha2(ids, 256).alias("input_hash"))


@R.query(
    """WITH b AS (SELECT source, doc_id // 4096 AS block, max(n_chars) AS longest, count(*) AS n, sha256(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS digest FROM documents GROUP BY ALL)
SELECT source, max(longest) AS longest, CAST(sum(n) AS BIGINT) AS generation, sha256(string_agg(digest, ',' ORDER BY block)) AS input_hash FROM b GROUP BY source"""
)
def input_manifest_all(t):
    """Over all documents: ids are digested in blocks, then the blocks' digests, so that a hot source isn't one array."""
    joined = lambda c: F.sha2(F.array_join(c, ","), 256)
    ids = F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string"))
    blocks = t.documents.groupBy("source", F.floor(F.col("doc_id") / 4096).alias("block")).agg(F.max("n_chars").alias("longest"), F.count("*").alias("n"), joined(ids).alias("digest"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("block", "digest"))), lambda x: x["digest"])
    return blocks.groupBy("source").agg(F.max("longest").alias("longest"), F.sum("n").alias("generation"), joined(whole).alias("input_hash"))


@R.query(
    """WITH s AS (SELECT d.doc_id % 30 AS qid, d.source, (d.n_chars % 997) / 997.0 AS score FROM documents d WHERE d.n_chars IS NOT NULL), q AS (SELECT qid, max(CASE WHEN source <> 'src0' THEN score END) AS best FROM s GROUP BY qid),
o AS (SELECT DISTINCT source FROM documents WHERE source IN ('src0', 'src1', 'src2')), w AS (SELECT o.source AS removed, s.qid, max(s.score) AS top FROM o JOIN s ON s.source IN ('src0', 'src1', 'src2') AND s.source <> o.source GROUP BY ALL)
SELECT w.removed, count(*) AS n, count(*) FILTER (WHERE q.best > w.top) AS released FROM w JOIN q USING (qid) GROUP BY w.removed"""
)
def leave_one_decoy_out(t):
    """Released queries when each of a fixed set of decoys is left out in turn."""
    decoys = ("src0", "src1", "src2")
    rows = t.documents.filter("n_chars is not null").select((F.col("doc_id") % 30).alias("qid"), "source", ((F.col("n_chars") % 997) / 997.0).alias("score"))
    tops = [F.max(F.when(F.col("source").isin(*(d for d in decoys if d != out)), F.col("score"))).alias(f"without_{out}") for out in decoys]
    q = rows.groupBy("qid").agg(F.max(F.when(F.col("source") != "src0", F.col("score"))).alias("best"), *tops)
    each = q.select("best", F.explode(F.array(*[F.struct(F.lit(d).alias("removed"), F.col(f"without_{d}").alias("top")) for d in decoys])).alias("x")).filter("x.top is not null and best is not null")
    return each.groupBy("x.removed").agg(F.count("*").alias("n"), F.count_if(F.col("best") > F.col("x.top")).alias("released"))


@R.query(
    """SELECT source, doc_id, total FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS total FROM documents WHERE text LIKE '%the%' AND n_chars < 2000) WHERE total <= 6000"""
)
def evidence_pack(t):
    rows = t.documents.filter(F.col("text").contains("the") & (F.col("n_chars") < 2000)).select("source", "doc_id", "n_chars")
    return W.within_budget(rows, "source", "doc_id", "n_chars", 6000, 1024).select("source", "doc_id", "total")
