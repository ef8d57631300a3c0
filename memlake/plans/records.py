"""Queries over records as they come: JSON lines with torn rows, hashed tables, Markdown entries, split calls, guarded writes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake.operators import joins as J
from memlake.operators.joins import joined_small
from memlake.operators import records as O
from memlake.operators import windows as W
from memlake.plans.registry import Registry
from memlake.sources import records as S
from memlake.sources import sinks as K

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

#: Lines of segments: sealed ones and a current one, some torn at their end, some blank.
_LINES = """SELECT 'segment-' || CASE WHEN event_id % 4 = 3 THEN 'current' ELSE lpad(CAST(event_id % 4 AS VARCHAR), 3, '0') END AS file, event_id, CASE WHEN event_id % 50 = 0 THEN '  ' WHEN event_id % 33 = 1 THEN '{"rid":"u' || user_id || '","ki' ELSE '{"rid":"u' || user_id || '","kind":"' || event_type || '","ts":' || epoch_us(ts) || '}' END AS line FROM events"""


def _lines(t):
    e = F.col("event_id")
    file = F.concat(F.lit("segment-"), F.when(e % 4 == 3, "current").otherwise(F.lpad((e % 4).cast("string"), 3, "0")))
    head = F.concat(F.lit('{"rid":"u'), F.col("user_id").cast("string"))
    whole = F.concat(head, F.lit('","kind":"'), "event_type", F.lit('","ts":'), F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), F.lit("}"))
    return t.events.select(file.alias("file"), "event_id", F.when(e % 50 == 0, "  ").when(e % 33 == 1, F.concat(head, F.lit('","ki'))).otherwise(whole).alias("line"))


@R.query(f"SELECT file, count(*) AS lines, count(*) FILTER (WHERE NOT json_valid(line)) AS torn, count(DISTINCT whole ->> 'rid') AS requests, max(CAST(whole ->> 'ts' AS BIGINT)) AS last FROM (SELECT *, CASE WHEN json_valid(line) THEN line END AS whole FROM ({_LINES}) WHERE trim(line) <> '') GROUP BY file")
def segmented_lines(t):
    """Blank lines are skipped, torn ones skipped and counted, the others read by their schema."""
    rows = _lines(t).filter(F.trim("line") != "").select("file", F.try_parse_json("line").isNull().alias("torn"), F.from_json("line", "rid string, kind string, ts bigint").alias("x"))
    whole = ~F.col("torn")
    return rows.groupBy("file").agg(F.count("*").alias("lines"), F.count_if("torn").alias("torn"), F.countDistinct(F.when(whole, F.col("x.rid"))).alias("requests"), F.max(F.when(whole, F.col("x.ts"))).alias("last"))


@R.query(f"SELECT DISTINCT whole ->> 'rid' AS rid FROM (SELECT CASE WHEN json_valid(line) THEN line END AS whole FROM ({_LINES})) WHERE whole ->> 'kind' = 'error'")
def abort_set(t):
    """Requests that were aborted, each once."""
    x = F.from_json("line", "rid string, kind string, ts bigint")
    return _lines(t).filter(F.try_parse_json("line").isNotNull()).select(x.alias("x")).filter("x.kind = 'error'").select("x.rid").distinct()


_MANIFESTS = """SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN '{"path":' WHEN 1 THEN '[1]' WHEN 2 THEN '{"path":"p1","size":3}' ELSE '{"path":"p' || doc_id % 60 || '","blob":"' || sha256(text) || '","at":' || doc_id || ',"size":' || CASE WHEN doc_id % 8 = 3 THEN '"x"' ELSE CAST(n_chars AS VARCHAR) END || '}' END AS body FROM documents"""


def _manifests(t):
    d = F.col("doc_id")
    size = F.when(d % 8 == 3, '"x"').otherwise(F.col("n_chars").cast("string"))
    whole = F.concat(F.lit('{"path":"p'), (d % 60).cast("string"), F.lit('","blob":"'), F.sha2("text", 256), F.lit('","at":'), d.cast("string"), F.lit(',"size":'), size, F.lit("}"))
    return t.documents.select("doc_id", F.when(d % 9 == 0, '{"path":').when(d % 9 == 1, "[1]").when(d % 9 == 2, '{"path":"p1","size":3}').otherwise(whole).alias("body"))


_VERDICT = "CASE WHEN NOT json_valid(body) THEN 'unparseable' WHEN json_type(body) <> 'OBJECT' THEN 'not_an_object' WHEN json_type(body, '$.path') IS DISTINCT FROM 'VARCHAR' OR json_type(body, '$.blob') IS DISTINCT FROM 'VARCHAR' OR json_type(body, '$.at') IS NULL THEN 'missing_field' WHEN json_type(body, '$.size') NOT IN ('UBIGINT', 'BIGINT') THEN 'wrong_type' ELSE 'ok' END"


@R.query(f"SELECT {_VERDICT} AS verdict, count(*) AS n FROM ({_MANIFESTS}) GROUP BY 1")
def manifest_verdicts(t):
    """Each file's outcome: none is left out silently."""
    return O.manifests(_manifests(t), "body").groupBy("verdict").agg(F.count("*").alias("n"))


@R.query(f"SELECT path, doc_id, extra FROM (SELECT body ->> 'path' AS path, doc_id, row_number() OVER (PARTITION BY body ->> 'path' ORDER BY CAST(body ->> 'at' AS BIGINT) DESC, body ->> 'blob') AS r, count(*) OVER (PARTITION BY body ->> 'path') - 1 AS extra FROM ({_MANIFESTS}) WHERE CASE WHEN json_valid(body) THEN {_VERDICT} = 'ok' ELSE false END) WHERE r = 1")
def latest_manifests(t):
    """The latest good version of each path, and how many it replaces."""
    good = O.manifests(_manifests(t), "body").filter("verdict = 'ok'").select("doc_id", "path", "blob", "at")
    rows = good.withColumn("extra", F.count("*").over(Window.partitionBy("path")) - 1)
    return W.first_per_key(rows, ["path"], [F.desc("at"), F.col("blob")]).select("path", "doc_id", "extra")


@R.query("SELECT doc_id, head = '#sha256 ' || sha256(body) AS intact, CASE WHEN head = '#sha256 ' || sha256(body) THEN CAST(len(string_split(body, chr(10))) - 1 AS BIGINT) END AS rows FROM (SELECT doc_id, source || chr(9) || n_chars || chr(10) || lang || chr(9) || doc_id || chr(10) AS body, '#sha256 ' || CASE WHEN doc_id % 6 = 0 THEN sha256('torn') ELSE sha256(source || chr(9) || n_chars || chr(10) || lang || chr(9) || doc_id || chr(10)) END AS head FROM documents)")
def hashed_tables(t):
    """Tables with their digest in the first line, written and read again; a torn one gives no rows."""
    body = F.concat_ws("", "source", F.lit("\t"), F.col("n_chars").cast("string"), F.lit("\n"), "lang", F.lit("\t"), F.col("doc_id").cast("string"), F.lit("\n"))
    file = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("#sha256 "), F.sha2(F.lit("torn"), 256), F.lit("\n"), body)).otherwise(S.with_hash_header(body))
    return O.unsealed(t.documents.select("doc_id", file.alias("file")), "file").select("doc_id", "intact", F.when(F.col("intact"), F.size(F.split("body", "\n")) - 1).cast("long").alias("rows"))


@R.query("WITH m AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE '---' || chr(10) || 'id: s' || doc_id || chr(10) || 'name: ' || source || chr(10) || '---' || chr(10) END || substr(text, 1, 40) AS md FROM documents) SELECT doc_id, nullif(regexp_extract(md, '^---\\n(?s:.*?)id: ([^\\n]+)\\n', 1), '') AS id, NOT starts_with(md, '---' || chr(10)) AS fatal FROM m")
def skill_ids(t):
    """Ids out of frontmatter; a file without one is fatal to its run, so it is told."""
    d = F.col("doc_id").cast("string")
    head = F.concat(F.lit("---\nid: s"), d, F.lit("\nname: "), "source", F.lit("\n---\n"))
    md = F.concat(F.when(F.col("doc_id") % 4 == 0, "").otherwise(head), F.substring("text", 1, 40))
    files = t.documents.select("doc_id", md.alias("md"))
    ids = S.frontmatter(files, "md", "doc_id").filter("name = 'id'").select("doc_id", F.col("value").alias("id"))
    return files.select("doc_id").join(ids, "doc_id", "left").withColumn("fatal", F.col("id").isNull())


@R.query("SELECT doc_id, CAST(i AS INTEGER) AS position, CASE i WHEN 0 THEN 'a' || doc_id WHEN 1 THEN 'b' || doc_id ELSE 'end' END AS entry_id, CASE i WHEN 0 THEN source WHEN 1 THEN lang ELSE '' END AS body FROM documents, range(3) r(i) WHERE i < 2 OR doc_id % 2 = 0")
def anchored_entries(t):
    """A file cut at its anchors; one at its end is an entry without a body."""
    d = F.col("doc_id").cast("string")
    md = F.concat(F.lit("before <!-- entry:a"), d, F.lit(" -->"), "source", F.lit(" <!-- entry:b"), d, F.lit(" -->\n"), "lang", F.when(F.col("doc_id") % 2 == 0, "\n<!-- entry:end -->").otherwise(""))
    rows = S.anchored_entries(t.documents.select("doc_id", md.alias("md")), "md", "doc_id")
    return rows.select("doc_id", "position", "entry_id", F.regexp_replace("body", r"\A\s+|\s+\z", "").alias("body"))


@R.query("SELECT user_id AS pid, count(*) AS calls, count(*) FILTER (WHERE joined) AS joined FROM (SELECT user_id, event_id, half = 'resumed' AND coalesce(bool_or(half = 'open') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS joined, half FROM (SELECT user_id, event_id, CASE event_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'resumed' ELSE 'whole' END AS half FROM events)) WHERE half = 'whole' OR joined GROUP BY user_id")
def split_calls(t):
    """Calls whose halves stand on two lines, put together by process."""
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("open(x"), F.col("event_id").cast("string"), F.lit(" <unfinished ...>"))).when(F.col("event_id") % 3 == 1, "<... open resumed>) = 3").otherwise("stat(y) = 0")
    rows = S.joined_calls(t.events.select(F.col("user_id").alias("pid"), "event_id", line.alias("line")), "pid", "event_id", "line")
    return rows.groupBy("pid").agg(F.count("*").alias("calls"), F.count_if(F.col("call").startswith("open(x")).alias("joined"))


@R.query("WITH c AS (SELECT c_custkey AS k, c_mktsegment AS identity, c_name AS body FROM customer WHERE c_custkey % 3 <> 0) SELECT k, CASE WHEN k % 2 = 0 THEN 'new ' || k ELSE body END AS body FROM c UNION ALL SELECT c_custkey, 'new ' || c_custkey FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0")
def guarded_update(t):
    """New versions replace those of the same key, whose identity must not change."""
    rows = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("identity"), F.col("c_name").alias("body"))
    new = rows.filter("k % 2 = 0").withColumn("body", F.concat(F.lit("new "), F.col("k").cast("string")))
    return K.guarded_update(rows.filter("k % 3 <> 0"), new, "k", "identity").select("k", "body")


@R.query("WITH s AS (SELECT user_id AS rid, max(event_id % 3) AS top FROM events WHERE event_id < 500 GROUP BY user_id) SELECT e.event_id, coalesce(s.top + 1, 0) + row_number() OVER (PARTITION BY e.user_id ORDER BY e.event_id) - 1 AS attempt_no FROM events e LEFT JOIN s ON e.user_id = s.rid WHERE e.event_id >= 500")
def attempt_numbers(t):
    """Attempts numbered on from the highest stored one of their request."""
    rows = t.events.select("event_id", F.col("user_id").alias("rid"))
    stored = rows.filter("event_id < 500").select("rid", (F.col("event_id") % 3).alias("attempt_no"))
    return K.numbered(stored, rows.filter("event_id >= 500"), "rid", "event_id").select("event_id", "attempt_no")


@R.query("SELECT sha256(text) AS sha, min(length(text)) AS n_chars FROM documents WHERE doc_id % 2 = 1 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) GROUP BY 1")
def new_blobs(t):
    """Contents that the store lacks, each once under its hash."""
    docs = t.documents.select("doc_id", F.col("text").alias("content"))
    stored = docs.filter("doc_id % 2 = 0").select(F.sha2(F.col("content").cast("binary"), 256).alias("sha")).distinct()
    return K.new_blobs(stored, docs.filter("doc_id % 2 = 1").select("content")).select("sha", F.length("content").alias("n_chars"))


@R.query("SELECT key, count(*) - 1 AS repeats, min(event_id) AS first FROM (SELECT sha256(user_id || '|' || event_type || '|' || CAST(floor(value) AS BIGINT)) AS key, event_id FROM events WHERE value IS NOT NULL) GROUP BY key")
def facts_once(t):
    """Facts by a key from their content: however often one comes, it counts once."""
    key = F.sha2(F.concat_ws("|", "user_id", "event_type", F.floor("value")), 256)
    return t.events.filter("value is not null").select(key.alias("key"), "event_id").groupBy("key").agg((F.count("*") - 1).alias("repeats"), F.min("event_id").alias("first"))


@R.query("WITH e AS (SELECT *, epoch_us(ts) AS us FROM events), n AS (SELECT max(us) AS now FROM e), s AS (SELECT user_id, min(us) AS started, max(CASE WHEN event_type = 'purchase' THEN us END) AS ended FROM e GROUP BY user_id) SELECT user_id, ended IS NULL AS orphan, ended IS NULL AND now - started > 86400000000 AS stale FROM s, n")
def stale_orphans(t):
    """Requests without an end, and those of them that are older than a day by the last event."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    s = t.events.groupBy("user_id").agg(F.min(us).alias("started"), F.max(F.when(F.col("event_type") == "purchase", us)).alias("ended"))
    now = t.events.agg(F.max(us).alias("now"))
    return s.crossJoin(F.broadcast(now)).select("user_id", F.col("ended").isNull().alias("orphan"), (F.col("ended").isNull() & (F.col("now") - F.col("started") > 86_400_000_000)).alias("stale"))  # one row


@R.query("SELECT d.source, d.lang, count(*) AS messages, min(d.doc_id) AS first FROM documents d JOIN labels l ON d.doc_id = l.doc_id JOIN (SELECT DISTINCT lang FROM documents WHERE doc_id < 500) a ON d.lang = a.lang LEFT JOIN (SELECT DISTINCT source FROM documents WHERE doc_id % 2 = 0) w ON d.source = w.source GROUP BY d.source, d.lang HAVING count(*) >= 2")
def sources_with_messages(t):
    """Sources over inner joins with messages and agents and a left one with workspaces: those without a message drop out."""
    agents = t.documents.filter("doc_id < 500").select("lang").distinct()
    workspaces = t.documents.filter("doc_id % 2 = 0").select("source", F.lit(True).alias("known")).distinct()
    rows = t.documents.select("doc_id", "source", "lang").join(t.labels.select("doc_id"), "doc_id")
    rows = joined_small(rows, agents.withColumnRenamed("lang", "_lang"), F.col("lang") == F.col("_lang"), agents.count() * 64)
    rows = joined_small(rows, workspaces.withColumnRenamed("source", "_source"), F.col("source") == F.col("_source"), workspaces.count() * 64, how="left")
    return rows.groupBy("source", "lang").agg(F.count("*").alias("messages"), F.min("doc_id").alias("first")).filter("messages >= 2")


@R.query("WITH a AS (SELECT doc_id, quality FROM labels WHERE doc_id % 20 <> 7), b AS (SELECT doc_id, toxic FROM labels WHERE doc_id % 25 <> 3) SELECT (SELECT count(*) FROM a JOIN b USING (doc_id)) AS judged, (SELECT count(*) FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)) AS missing_first, (SELECT count(*) FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)) AS missing_second, (SELECT count(*) FROM a JOIN b USING (doc_id) WHERE (quality = 1) <> (toxic = 0)) AS conflicts")
def two_judges(t):
    """Two judges' labels: what both have, what either lacks (fatal where the first one does), where they disagree."""
    a = t.labels.filter("doc_id % 20 <> 7").select("doc_id", "quality")
    b = t.labels.filter("doc_id % 25 <> 3").select("doc_id", "toxic")
    both = a.join(b, "doc_id", "full_outer")
    first, second = F.col("quality").isNull(), F.col("toxic").isNull()
    return both.agg(F.count_if(~first & ~second).alias("judged"), F.count_if(first).alias("missing_first"), F.count_if(second).alias("missing_second"), F.count_if((F.col("quality") == 1) != (F.col("toxic") == 0)).alias("conflicts"))


@R.query("WITH q AS (SELECT item_id AS qid, text AS query FROM benchmark), c AS (SELECT doc_id % 40 AS qid, doc_id, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY n_chars DESC, doc_id) AS rank FROM documents) SELECT 'sj:' || q.qid || ':' || c.doc_id AS job_id, c.rank, length(q.query) AS query_chars FROM q JOIN c ON q.qid = c.qid WHERE c.rank <= 5")
def candidate_jobs(t):
    """A job for each of a query's best candidates, with its rank from 1."""
    c = W.top_per_key(t.documents.select((F.col("doc_id") % 40).alias("qid"), "doc_id", "n_chars"), ["qid"], [F.desc("n_chars"), F.col("doc_id")], 5, "rank")
    q = t.benchmark.select(F.col("item_id").alias("qid"), F.length("text").cast("long").alias("query_chars"))
    return c.join(q, "qid").select(F.concat_ws(":", F.lit("sj"), "qid", "doc_id").alias("job_id"), F.col("rank").cast("long").alias("rank"), "query_chars")


@R.query(
    """WITH s AS (SELECT c_custkey AS path, c_nationkey AS size, c_mktsegment AS h FROM customer WHERE c_custkey % 7 <> 0), d AS (SELECT c_custkey AS path, c_nationkey + CASE WHEN c_custkey % 11 = 0 THEN 1 WHEN c_custkey % 13 = 0 THEN -1 ELSE 0 END AS size, CASE WHEN c_custkey % 17 = 0 THEN 'other' ELSE c_mktsegment END AS h, c_custkey % 4 = 0 AS sent FROM customer WHERE c_custkey % 5 <> 0)
SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN d.path IS NULL THEN 'fail' WHEN s.path IS NULL AND sent THEN 'adopt' WHEN s.path IS NULL THEN 'rogue' WHEN s.size = d.size AND s.h = d.h THEN 'keep' WHEN sent AND d.size > s.size THEN 'self_heal' WHEN d.size < s.size THEN 'shrunk' ELSE 'drift' END AS verdict FROM s FULL JOIN d ON s.path = d.path) GROUP BY verdict"""
)
def inventory_with_transfers(t):
    """State against disk: what was just sent may grow or be new; unknown files that nobody sent are rogue."""
    k = F.col("path")
    base = t.customer.select(F.col("c_custkey").alias("path"), F.col("c_nationkey").alias("size"), F.col("c_mktsegment").alias("h"))
    disk = base.filter("path % 5 <> 0").select("path", (F.col("size") + F.when(k % 11 == 0, 1).when(k % 13 == 0, -1).otherwise(0)).alias("size"), F.when(k % 17 == 0, "other").otherwise(F.col("h")).alias("h"), (k % 4 == 0).alias("sent"))
    return O.inventory(base.filter("path % 7 <> 0"), disk).groupBy("verdict").agg(F.count("*").alias("n"))


@R.query("SELECT CASE WHEN status IN ('o', 'f') THEN status ELSE 'unknown' END AS status, count(*) AS n, count(*) FILTER (WHERE status NOT IN ('o', 'f')) AS fatal FROM (SELECT lower(o_orderstatus) AS status FROM orders) GROUP BY 1")
def status_domain(t):
    """Counts by status; a status out of the domain is fatal and told apart, never dropped."""
    status = F.lower("o_orderstatus")
    known = status.isin("o", "f")
    return t.orders.groupBy(F.when(known, status).otherwise("unknown").alias("status")).agg(F.count("*").alias("n"), F.count_if(~known).alias("fatal"))


@R.query("WITH s AS (SELECT unnest([0.5, 0.6, 0.7, 0.8]) AS theta, unnest([0.4, 0.92, 0.91, 0.95]) AS p, unnest([0.9, 0.6, 0.6, 0.2]) AS r), g AS (SELECT lang, count(*) FILTER (WHERE quality = 1) AS positives FROM documents JOIN labels USING (doc_id) GROUP BY lang UNION ALL SELECT 'none', 0) SELECT lang, CASE WHEN positives = 0 THEN NULL ELSE (SELECT CAST(theta AS DOUBLE) FROM s ORDER BY p >= 0.9 DESC, CASE WHEN p >= 0.9 THEN r ELSE p END DESC, theta LIMIT 1) END AS theta FROM g")
def guarded_threshold(t):
    """The threshold of best recall at enough precision, the lower one at a tie; none where nothing was labelled."""
    sweep = t.spark.createDataFrame([(0.5, 0.4, 0.9), (0.6, 0.92, 0.6), (0.7, 0.91, 0.6), (0.8, 0.95, 0.2)], "theta double, precision double, recall double")
    best = O.best_threshold(sweep, 0.9)
    g = t.documents.select("doc_id", "lang").join(t.labels, "doc_id").groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("positives"))
    g = g.unionByName(t.spark.range(1).select(F.lit("none").alias("lang"), F.lit(0).cast("long").alias("positives")))
    return g.crossJoin(F.broadcast(best)).select("lang", F.when(F.col("positives") > 0, F.col("theta")).alias("theta"))  # one row


@R.query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE upper(n_name) END ELSE n_name END AS n_name FROM nation")
def override_with_nulls(t):
    """A layer's field wins wherever the layer has the row, a null as well."""
    over = t.nation.filter("n_nationkey % 2 = 0").select("n_nationkey", F.when(F.col("n_nationkey") % 4 != 0, F.upper("n_name")).alias("own"), F.lit(True).alias("there"))
    return t.nation.select("n_nationkey", "n_name").join(over, "n_nationkey", "left").select("n_nationkey", F.when(F.col("there"), F.col("own")).otherwise(F.col("n_name")).alias("n_name"))


@R.query("SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_orderkey) AS n FROM orders WHERE o_orderdate >= DATE '1998-06-01') WHERE n = 1")
def frozen_selection(t):
    """A selection to be frozen; a key that it holds twice fails the read."""
    rows = t.orders.filter(F.col("o_orderdate") >= F.lit("1998-06-01").cast("timestamp_ntz")).select("o_orderkey", "o_custkey")
    return J.unique_or_fail(rows, "o_orderkey").select("o_orderkey", "o_custkey")
