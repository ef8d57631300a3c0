"""Queries over versioned and related tables: closures, censuses, reconciliations, chains, digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators import integrity as I
from memlake.operators import joins as J
from memlake.operators import windows as W
from memlake.plans.registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def snapshot_anti_join(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@R.query("SELECT count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')")
def semi_join_two_keys(t):
    seen = t.lineitem.filter("l_returnflag = 'R'").select("l_partkey", "l_suppkey").distinct()
    return t.lineitem.join(seen, ["l_partkey", "l_suppkey"], "left_semi").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@R.query("SELECT count(*) AS missing FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_orderkey = a.o_orderkey)")
def scan_seek_anti(t):
    return t.orders.select("o_orderkey").join(t.orders.select("o_orderkey"), "o_orderkey", "left_anti").agg(F.count("*").alias("missing"))


_VERSIONS = """prev AS (SELECT o_orderpriority AS name, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1), cur AS (SELECT o_orderpriority AS name, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 AND o_orderpriority <> '1-URGENT' GROUP BY 1)"""


@R.query(
    f"""WITH {_VERSIONS} SELECT p.name, p.n AS before, c.n AS after, CASE WHEN c.n IS NULL THEN 'disappeared' WHEN c.n < p.n THEN 'shrunk' ELSE 'ok' END AS verdict FROM prev p LEFT JOIN cur c ON p.name = c.name"""
)
def census_compare(t):
    name = F.col("o_orderpriority").alias("name")
    prev = t.orders.filter("o_orderkey % 3 <> 0").groupBy(name).agg(F.count("*").alias("before"))
    cur = t.orders.filter("o_orderkey % 2 = 0 and o_orderpriority <> '1-URGENT'").groupBy(name).agg(F.count("*").alias("after"))
    return I.census_verdicts(prev, cur, "name", "before", "after")


@R.query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def closure_missing_refs(t):
    parts = t.part.filter("p_size > 5").select(F.col("p_partkey").alias("l_partkey"))
    return t.lineitem.select("l_partkey").distinct().join(parts, "l_partkey", "left_anti")


@R.query(
    """SELECT doc_id, CASE WHEN w IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing' ELSE 'duplicate' END AS problem FROM
(SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id AS w, l.n FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 5 <> 0) d
FULL JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id) WHERE w IS NULL OR n IS NULL OR n > 1"""
)
def expected_id_closure(t):
    return J.closure(t.documents.filter("doc_id % 5 <> 0"), t.labels, "doc_id")


@R.query(
    """WITH a AS (SELECT c_custkey AS k, CAST(floor(c_acctbal) AS BIGINT) AS s, c_mktsegment AS d FROM customer WHERE c_custkey % 7 <> 0),
b AS (SELECT c_custkey AS k, CAST(floor(c_acctbal) AS BIGINT) + CASE WHEN c_custkey % 11 = 0 THEN 5 WHEN c_custkey % 13 = 0 THEN -5 ELSE 0 END AS s, CASE WHEN c_custkey % 17 = 0 THEN 'changed' ELSE c_mktsegment END AS d FROM customer WHERE c_custkey % 5 <> 0)
SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN a.s IS NULL THEN 'adopt' WHEN b.s IS NULL THEN 'gone' WHEN a.s = b.s AND a.d = b.d THEN 'keep' WHEN b.s < a.s THEN 'shrunk' WHEN b.s > a.s THEN 'grown' ELSE 'drift' END AS verdict FROM a FULL JOIN b ON a.k = b.k) GROUP BY verdict"""
)
def inventory_reconcile(t):
    base = t.customer.select("c_custkey", F.floor("c_acctbal").alias("size"), F.col("c_mktsegment").alias("digest"))
    moved = F.when(F.col("c_custkey") % 11 == 0, 5).when(F.col("c_custkey") % 13 == 0, -5).otherwise(0)
    found = base.filter("c_custkey % 5 <> 0").withColumns({"size": F.col("size") + moved, "digest": F.when(F.col("c_custkey") % 17 == 0, "changed").otherwise(F.col("digest"))})
    return J.reconcile(base.filter("c_custkey % 7 <> 0"), found, "c_custkey", "size", "digest").groupBy("verdict").agg(F.count("*").alias("n"))


@R.query(
    """WITH RECURSIVE link AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey >= 3 THEN n_nationkey - 3 END AS prev FROM nation),
walk AS (SELECT id, 0 AS depth FROM link WHERE id = (SELECT max(id) FROM link) UNION ALL SELECT l.prev, w.depth + 1 FROM walk w JOIN link l ON l.id = w.id WHERE l.prev IS NOT NULL)
SELECT CAST(l.id AS BIGINT) AS id, CAST(w.depth AS BIGINT) AS depth, w.id IS NULL AS orphan FROM link l LEFT JOIN walk w ON l.id = w.id"""
)
def chain_walk(t):
    links = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.when(F.col("n_nationkey") >= 3, F.col("n_nationkey") - 3).cast("long").alias("prev"))
    return I.walk_chain(links, "id", "prev")


@R.query(
    """SELECT l_orderkey, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_quantity DESC, l_suppkey, l_linenumber) AS r FROM lineitem) WHERE r = 1"""
)
def latest_version_per_key(t):
    order = [F.desc("l_shipdate"), F.desc("l_quantity"), F.col("l_suppkey"), F.col("l_linenumber")]
    return W.first_per_key(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity"), ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_suppkey")


@R.query(
    """SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r > 10"""
)
def keep_n_victims(t):
    return I.victims(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 10).select("o_custkey", "o_orderkey")


@R.query(
    """SELECT source, count(*) AS n, count(DISTINCT sha256(text)) AS blobs, count(*) - count(DISTINCT sha256(text)) AS duplicate_refs, count(*) FILTER (WHERE length(text) < 50) AS tiny FROM documents WHERE text IS NOT NULL GROUP BY source"""
)
def manifest_census(t):
    rows = t.documents.filter("text is not null").select("source", F.sha2("text", 256).alias("blob"), (F.length("text") < 50).alias("tiny"))
    # Copies are counted together first, so that one hot blob is one row before the second grouping.
    per = rows.groupBy("source", "blob").agg(F.count("*").alias("n"), F.count_if("tiny").alias("tiny"))
    return per.groupBy("source").agg(F.sum("n").alias("n"), F.count("*").alias("blobs"), (F.sum("n") - F.count("*")).alias("duplicate_refs"), F.sum("tiny").alias("tiny"))


@R.query("SELECT count(*) AS n, max(o_orderkey) AS top, count(*) = max(o_orderkey) AS gapless, max(o_orderkey) >= (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 2 = 0) AS monotone FROM orders")
def gap_and_monotone_check(t):
    before = F.max(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")))
    one = t.orders.agg(F.count("*").alias("n"), F.max("o_orderkey").alias("top"), before.alias("_before"))
    return one.select("n", "top", (F.col("n") == F.col("top")).alias("gapless"), (F.col("top") >= F.col("_before")).alias("monotone"))


@R.query(
    """WITH r AS (SELECT o_orderkey // 1000 AS part, o_orderkey AS k, 'I' || length(CAST(o_orderkey AS VARCHAR)) || ':' || o_orderkey || 'T' || length(o_orderpriority) || ':' || o_orderpriority AS enc FROM orders),
p AS (SELECT part, count(*) AS n, sha256(string_agg(enc, '' ORDER BY k)) AS d FROM r GROUP BY part)
SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(d, '' ORDER BY part)) AS digest FROM p"""
)
def prefix_digest(t):
    return I.ordered_digest(t.orders, "o_orderkey", ["o_orderkey", "o_orderpriority"], 1000)


@R.query("SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (WHERE days >= 2) AS starving FROM (SELECT o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN o_orderkey % 4 ELSE 0 END AS days FROM orders) GROUP BY 1")
def status_machine_backlog(t):
    days = F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey") % 4).otherwise(0)
    return t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_if(days >= 2).alias("starving"))


@R.query(
    """WITH t AS (SELECT DISTINCT sha256(text) AS k FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL)
SELECT k AS key, min(doc_id) AS doc_id FROM (SELECT sha256(text) AS k, doc_id FROM documents WHERE doc_id % 3 <> 0 AND text IS NOT NULL) WHERE k NOT IN (SELECT k FROM t) GROUP BY k"""
)
def idempotent_insert(t):
    rows = t.documents.filter("text is not null").select(F.sha2("text", 256).alias("key"), "doc_id")
    return J.insert_new(rows.filter("doc_id % 3 = 0"), rows.filter("doc_id % 3 <> 0"), ["key"], [F.col("doc_id")])


@R.query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents")
def table_census(t):
    return I.census({n: getattr(t, n) for n in ("orders", "lineitem", "events", "documents")})


@R.query(
    """SELECT n_nationkey, coalesce(o.n_name, b.n_name) AS n_name FROM nation b LEFT JOIN (SELECT n_nationkey AS k, upper(n_name) AS n_name FROM nation WHERE n_nationkey % 2 = 0) o ON b.n_nationkey = o.k"""
)
def layered_override(t):
    over = t.nation.filter("n_nationkey % 2 = 0").select("n_nationkey", F.upper("n_name").alias("n_name"))
    return J.layered(t.nation, over, ["n_nationkey"], ["n_name"])
