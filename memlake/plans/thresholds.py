"""Queries over all thresholds at once."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake.operators import thresholds as O
from memlake.plans.registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

#: Searches of twenty neighbouring documents each: two kinds of card, ranked within their kind by a second score and shown in turn, skills first.
SEARCHED = """SELECT *, row_number() OVER (PARTITION BY qid, kind ORDER BY ce DESC, doc_id) * 2 + CASE WHEN kind = 'skill' THEN 0 ELSE 1 END AS place FROM (
SELECT d.doc_id, d.doc_id // 20 AS qid, CASE WHEN d.doc_id % 2 = 0 THEN 'case' ELSE 'skill' END AS kind, floor((d.n_chars % 997) / 997.0 * 40) / 40 AS score, (d.n_chars * 31 % 101) / 101.0 AS ce,
l.quality = 1 AND l.toxic = 0 AND d.n_chars % 2 = 0 AS relevant, l.quality = 1 AND l.toxic = 0 AND d.n_chars % 6 = 0 AS useful, d.n_chars % 11 = 0 AS excluded FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def searched(t):
    d = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id")
    n, good = F.col("n_chars"), (F.col("quality") == 1) & (F.col("toxic") == 0)
    rows = d.select(
        "doc_id", F.floor(F.col("doc_id") / 20).alias("qid"), F.when(F.col("doc_id") % 2 == 0, "case").otherwise("skill").alias("kind"), (F.floor((n % 997) / 997.0 * 40) / 40).alias("score"),
        ((n * 31 % 101) / 101.0).alias("ce"), (good & (n % 2 == 0)).alias("relevant"), (good & (n % 6 == 0)).alias("useful"), (n % 11 == 0).alias("excluded"),
    )
    rank = F.row_number().over(Window.partitionBy("qid", "kind").orderBy(F.desc("ce"), "doc_id"))
    return rows.withColumn("place", (rank * 2 + F.when(F.col("kind") == "skill", 0).otherwise(1)).cast("long"))


@R.query(
    f"""WITH c AS ({SEARCHED}), d AS (SELECT DISTINCT kind, score AS v FROM c), g AS (SELECT kind, v, (v + lead(v) OVER (PARTITION BY kind ORDER BY v)) / 2 AS mid, min(v) OVER (PARTITION BY kind) - 1 AS lo, max(v) OVER (PARTITION BY kind) + 1 AS hi FROM d),
e AS (SELECT kind, mid AS theta FROM g WHERE mid IS NOT NULL UNION SELECT kind, lo FROM g UNION SELECT kind, hi FROM g), p AS (SELECT a.theta AS tc, b.theta AS ts FROM e a, e b WHERE a.kind = 'case' AND b.kind = 'skill'),
q AS (SELECT qid, bool_or(relevant) AS covered, bool_or(useful) AS uses FROM c GROUP BY qid),
r AS (SELECT tc, ts, c.*, row_number() OVER (PARTITION BY tc, ts, qid ORDER BY place) AS r FROM c, p WHERE score >= CASE WHEN kind = 'case' THEN tc ELSE ts END),
s AS (SELECT tc, ts, qid, count(*) AS n, count(*) FILTER (WHERE excluded OR NOT relevant) AS bad, bool_and(excluded) AS only, bool_or(useful) AS hit FROM r WHERE r <= 5 GROUP BY tc, ts, qid),
o AS (SELECT p.tc, p.ts, q.covered, q.uses, coalesce(s.n, 0) AS n, coalesce(s.hit, false) AS hit, CASE WHEN s.n IS NULL THEN 0 WHEN s.only THEN 1 ELSE s.bad / s.n END AS fdr FROM p CROSS JOIN q LEFT JOIN s ON p.tc = s.tc AND p.ts = s.ts AND q.qid = s.qid),
a AS (SELECT tc AS theta_case, ts AS theta_skill, round(coalesce(count(*) FILTER (WHERE NOT covered AND n = 0) / nullif(count(*) FILTER (WHERE NOT covered), 0), 1.0) - 0.0, 9) AS abstain_slack, round(coalesce(count(*) FILTER (WHERE uses AND hit) / nullif(count(*) FILTER (WHERE uses), 0), 1.0) - 0.5, 9) AS useful_slack,
round(0.95 - coalesce(sum(fdr) FILTER (WHERE covered) / nullif(count(*) FILTER (WHERE covered), 0), 0.0), 9) AS fdr_slack, round(0.95 - coalesce(sum(fdr) FILTER (WHERE covered) / nullif(count(*) FILTER (WHERE covered AND n > 0), 0), 0.0), 9) AS shown_fdr_slack FROM o GROUP BY tc, ts),
b AS (SELECT *, least(abstain_slack, useful_slack, fdr_slack, shown_fdr_slack) AS slack FROM a),
w AS (SELECT theta_case AS wc, theta_skill AS ws FROM b WHERE slack >= 0 ORDER BY slack DESC, theta_case DESC, theta_skill DESC LIMIT 1)
SELECT b.*, EXISTS (SELECT 1 FROM w WHERE wc = theta_case AND ws = theta_skill) AS chosen FROM b"""
)
def threshold_pairs_fitted(t):
    """Every pair of thresholds of two kinds with its four slacks, and the pair to take, from one summed-area table."""
    return O.pair_slacks(searched(t), "case")


#: As SEARCHED, with a score of its own for almost every card.
_FINE = f"SELECT * REPLACE (((doc_id * 7919 + 13) % 1000003) / 1000003.0 AS score) FROM ({SEARCHED})"


def _fine(t):
    return searched(t).withColumn("score", ((F.col("doc_id") * 7919 + 13) % 1000003) / 1000003.0)


@R.query(
    f"""WITH p AS (SELECT score AS threshold, count(*) FILTER (WHERE relevant) AS good, count(*) FILTER (WHERE NOT relevant) AS bad FROM ({_FINE}) GROUP BY score),
r AS (SELECT threshold, sum(good) OVER (ORDER BY threshold DESC) AS tp, sum(bad) OVER (ORDER BY threshold DESC) AS fp, sum(good) OVER () AS good FROM p)
SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(good - tp AS BIGINT) AS fn, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN good = 0 THEN 1.0 ELSE tp / good END AS recall FROM r"""
)
def sweep_every_score(t):
    """Precision and recall with every distinct score as a threshold."""
    return O.sweep_all(_fine(t), "score", F.col("relevant"))


@R.query(
    f"""WITH c AS ({_FINE}), h AS (SELECT DISTINCT score AS theta FROM c), q AS (SELECT qid, bool_or(relevant) AS covered FROM c GROUP BY qid),
r AS (SELECT theta, c.*, row_number() OVER (PARTITION BY theta, qid ORDER BY place) AS r FROM c, h WHERE score >= theta),
s AS (SELECT theta, qid, count(*) AS n, count(*) FILTER (WHERE excluded OR NOT relevant) AS bad, bool_and(excluded) AS only, bool_or(useful) AS hit FROM r WHERE r <= 5 GROUP BY theta, qid),
o AS (SELECT h.theta, q.covered, coalesce(s.n, 0) AS n, coalesce(s.hit, false) AS hit, CASE WHEN s.n IS NULL THEN 0 WHEN s.only THEN 1 ELSE s.bad / s.n END AS fdr FROM h CROSS JOIN q LEFT JOIN s ON s.theta = h.theta AND s.qid = q.qid)
SELECT theta, count(*) FILTER (WHERE NOT covered AND n = 0) AS abstained, count(*) FILTER (WHERE hit) AS kept, count(*) FILTER (WHERE covered AND n > 0) AS shown, round(coalesce(sum(fdr) FILTER (WHERE covered), 0), 9) AS false_discovery FROM o GROUP BY theta"""
)
def floors_every_score(t):
    """What the floors are made of with every distinct score as a threshold."""
    return O.floors_all(_fine(t))
