"""Queries over judgements and scores: arbitration, metrics, thresholds, cross-validation, sampling statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake.operators import statistics as S
from memlake.operators import windows as W
from memlake.plans.registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

#: Judged candidates: 30 queries, the score a fixed function of the document.
SCORED = "SELECT d.doc_id, d.doc_id % 30 AS qid, d.source, d.lang, (d.n_chars % 997) / 997.0 AS score, l.quality = 1 AS relevant, l.quality = 1 AND l.toxic = 0 AS useful FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
RANKED = f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM ({SCORED})"


def _scored(t):
    rows = t.documents.select("doc_id", "source", "lang", "n_chars").join(t.labels, "doc_id")
    good = F.col("quality") == 1
    return rows.select("doc_id", (F.col("doc_id") % 30).alias("qid"), "source", "lang", ((F.col("n_chars") % 997) / 997.0).alias("score"), good.alias("relevant"), (good & (F.col("toxic") == 0)).alias("useful"))


def _ranked(t):
    return _scored(t).withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")))


@R.query("SELECT b.item_id || ':' || d.doc_id || ':useful' AS job_id, b.item_id, d.doc_id FROM benchmark b, documents d WHERE b.item_id < 10 AND d.doc_id < 50")
def judge_job_cross(t):
    jobs = t.benchmark.filter("item_id < 10").select("item_id").crossJoin(F.broadcast(t.documents.filter("doc_id < 50").select("doc_id")))
    return jobs.select(F.concat_ws(":", "item_id", "doc_id", F.lit("useful")).alias("job_id"), "item_id", "doc_id")


@R.query("SELECT b.item_id || ':' || d.doc_id || ':useful' AS job_id, b.item_id, d.doc_id FROM benchmark b JOIN documents d ON b.item_id = d.doc_id % 30")
def judge_jobs(t):
    """A job for each candidate of each query, over all rows: a document is a candidate of one query."""
    candidates = t.documents.select("doc_id", (F.col("doc_id") % 30).alias("item_id"))
    jobs = candidates.join(F.broadcast(t.benchmark.filter("item_id between -29 and 29").select("item_id")), "item_id")
    return jobs.select(F.concat_ws(":", "item_id", "doc_id", F.lit("useful")).alias("job_id"), "item_id", "doc_id")


_GOLD = "SELECT l.doc_id, l.doc_id % 30 AS qid, l.quality = 1 AS a, d.n_chars % 5 <> 0 AS b FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


def _gold(t):
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return rows.select("doc_id", (F.col("doc_id") % 30).alias("qid"), (F.col("quality") == 1).alias("a"), (F.col("n_chars") % 5 != 0).alias("b"))


@R.query(
    f"""WITH g AS ({_GOLD}) SELECT 'primary' AS variant, doc_id, a AS useful FROM g WHERE a = b UNION ALL SELECT 'optimistic', doc_id, a OR b FROM g UNION ALL SELECT 'pessimistic', doc_id, a AND b FROM g"""
)
def gold_arbitration_variants(t):
    v = F.array(
        F.struct(F.lit("primary").alias("variant"), F.when(F.col("a") == F.col("b"), F.col("a")).alias("useful")),
        F.struct(F.lit("optimistic").alias("variant"), (F.col("a") | F.col("b")).alias("useful")),
        F.struct(F.lit("pessimistic").alias("variant"), (F.col("a") & F.col("b")).alias("useful")),
    )
    return _gold(t).select("doc_id", F.explode(v).alias("v")).select("v.variant", "doc_id", "v.useful").filter("useful is not null")


@R.query(
    f"""WITH g AS ({_GOLD}) SELECT qid, CASE WHEN bool_or(a AND b) THEN 'covered' ELSE 'uncovered' END AS cover, count(*) FILTER (WHERE a <> b) AS excluded, count(*) AS n FROM g GROUP BY qid"""
)
def gold_coverage_sets(t):
    cover = F.when(F.bool_or(F.col("a") & F.col("b")), "covered").otherwise("uncovered")
    return _gold(t).groupBy("qid").agg(cover.alias("cover"), F.count_if(F.col("a") != F.col("b")).alias("excluded"), F.count("*").alias("n"))


@R.query(
    """WITH c AS (SELECT source, doc_id, lang = 'en' AS first, row_number() OVER (PARTITION BY source, lang = 'en' ORDER BY n_chars DESC, doc_id) AS r FROM documents)
SELECT source, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY r, CASE WHEN first THEN 0 ELSE 1 END) AS place FROM c) WHERE place <= 6"""
)
def interleave_topk(t):
    kind = F.when(F.col("lang") == "en", "skill").otherwise("case")
    rows = t.documents.select("source", "doc_id", kind.alias("kind"), "n_chars")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("source", "kind").orderBy(F.desc("n_chars"), "doc_id")))
    return W.interleave(rows, "source", "kind", "r", "skill", 6).select("source", "doc_id", F.col("merged_rank").cast("long").alias("place"))


@R.query(f"SELECT qid, doc_id, score > m AS released FROM (SELECT *, max(CASE WHEN source = 'src0' THEN score END) OVER (PARTITION BY qid) AS m FROM ({SCORED})) WHERE m IS NOT NULL")
def decoy_margin(t):
    top = F.max(F.when(F.col("source") == "src0", F.col("score"))).over(Window.partitionBy("qid"))
    return _scored(t).withColumn("m", top).filter("m is not null").select("qid", "doc_id", (F.col("score") > F.col("m")).alias("released"))


@R.query(
    f"SELECT qid, count(*) AS n, count(*) FILTER (WHERE s > 0 AND (score - a) / s >= 1) AS released FROM (SELECT *, avg(score) OVER (PARTITION BY qid) AS a, stddev_pop(score) OVER (PARTITION BY qid) AS s FROM ({SCORED})) GROUP BY qid"
)
def znorm_release(t):
    w = Window.partitionBy("qid")
    rows = _scored(t).withColumns({"a": F.avg("score").over(w), "s": F.stddev_pop("score").over(w)})
    return rows.groupBy("qid").agg(F.count("*").alias("n"), F.count_if((F.col("s") > 0) & ((F.col("score") - F.col("a")) >= F.col("s"))).alias("released"))


@R.query(
    """WITH p AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings c WHERE q.vec_id < 5 AND c.vec_id <> q.vec_id)
SELECT query_id, vec_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM p) WHERE place <= 10"""
)
def cosine_topk(t):
    """A handful of stated queries against all vectors; only the queries are broadcast."""
    q = t.embeddings.filter("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.transform("embedding", lambda x: x.cast("double")).alias("q"))
    c = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    add = lambda a, x: a + x
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), add)
    score = dot("q", "e") / F.sqrt(dot("q", "q") * dot("e", "e"))
    pairs = c.join(F.broadcast(q), F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", F.round(score, 6).alias("score"))
    return W.top_per_key(pairs, ["query_id"], [F.desc("score"), F.col("vec_id")], 10, "place").withColumn("place", F.col("place").cast("long"))


@R.query("SELECT source, lang, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM documents GROUP BY source, lang")
def stratum_shares(t):
    n = t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


@R.query(
    """WITH s AS (SELECT o_orderpriority || '|' || o_orderstatus AS stratum, count(*) AS pop FROM orders GROUP BY 1), a AS (SELECT *, sum(pop) OVER () AS total, least(2, pop) AS base FROM s),
b AS (SELECT *, 100 - sum(base) OVER () AS left_, 100 * pop / total AS ideal FROM a), j AS (SELECT stratum, ideal, left_, unnest(range(base, least(pop, base + CAST(left_ AS BIGINT) + 1))) AS seat FROM b WHERE pop > base),
w AS (SELECT stratum, count(*) AS won FROM (SELECT *, row_number() OVER (ORDER BY round(ideal - seat, 9) DESC, stratum) AS r FROM j) WHERE r <= left_ GROUP BY stratum)
SELECT b.stratum, CAST(base + coalesce(won, 0) AS BIGINT) AS quota FROM b LEFT JOIN w ON b.stratum = w.stratum"""
)
def quota_allocation(t):
    strata = t.orders.groupBy(F.concat_ws("|", "o_orderpriority", "o_orderstatus").alias("stratum")).agg(F.count("*").alias("pop"))
    return S.quotas(strata, "stratum", "pop", 100, 2)


_STRATA = f"SELECT source AS stratum, count(*) AS n, count(*) FILTER (WHERE useful) AS k FROM ({SCORED}) GROUP BY source"


def _strata(t):
    return _scored(t).groupBy(F.col("source").alias("stratum")).agg(F.count("*").alias("n"), F.count_if("useful").alias("k"))


@R.query(
    f"""WITH s AS ({_STRATA}), w AS (SELECT *, n / sum(n) OVER () AS w, k / n AS p FROM s), o AS (SELECT sum(w * p) AS rate, sqrt(sum(w * w * p * (1 - p) / n)) AS sd FROM w)
SELECT round(rate, 9) AS rate, round(greatest(0, rate - 1.96 * sd), 9) AS low, round(least(1, rate + 1.96 * sd), 9) AS high FROM o"""
)
def weighted_rate_ci(t):
    one = S.strata_estimate(_strata(t), "k", "n", "n")
    return one.select(*[F.round(c, 9).alias(c) for c in ("rate", "low", "high")])


_WILSON = "(k / n + {zz} / (2 * n)) / (1 + {zz} / n) {sign} {z} * sqrt((k / n) * (1 - k / n) / n + {zz} / (4 * n * n)) / (1 + {zz} / n)"


@R.query(f"SELECT stratum, round({_WILSON.format(z=1.96, zz=1.96 * 1.96, sign='-')}, 9) AS low, round({_WILSON.format(z=1.96, zz=1.96 * 1.96, sign='+')}, 9) AS high FROM ({_STRATA})")
def wilson_by_stratum(t):
    low, high = S.wilson(F.col("k"), F.col("n"), 1.96)
    return _strata(t).select("stratum", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@R.query(
    f"""WITH o AS (SELECT sum(n) AS n, sum(k) AS k FROM ({_STRATA})), l AS (SELECT n, k, {_WILSON.format(z=1.6449, zz=1.6449 * 1.6449, sign='-')} AS low FROM o)
SELECT CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, CASE WHEN n < 100 THEN 'insufficient' WHEN low >= 0.7 THEN 'go' WHEN low >= 0.5 THEN 'review' ELSE 'no_go' END AS decision FROM l"""
)
def decision_gate(t):
    one = _strata(t).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    low, _ = S.wilson(F.col("k"), F.col("n"), 1.6449)
    return one.select("n", "k", F.when(F.col("n") < 100, "insufficient").when(low >= 0.7, "go").when(low >= 0.5, "review").otherwise("no_go").alias("decision"))


@R.query(
    f"""WITH r AS ({RANKED}), q AS (SELECT qid, min(CASE WHEN relevant THEN r END) AS first, count(*) FILTER (WHERE relevant AND r <= 5) AS top5, bool_or(useful) AS cover FROM r GROUP BY qid)
SELECT count(*) AS queries, count(*) FILTER (WHERE cover) / count(*) AS coverage, avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END) AS hit1, avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END) AS hit5, round(avg(coalesce(1.0 / first, 0)), 9) AS mrr, round(avg(top5 / 5), 9) AS p5 FROM q"""
)
def retrieval_metrics(t):
    # The first relevant rank is one more than how many stand before the best relevant one: nothing is sorted as a whole.
    rows = _scored(t).select("qid", "relevant", "useful", F.struct("score", (-F.col("doc_id")).alias("d")).alias("key"))
    best = rows.groupBy("qid").agg(F.max(F.when(F.col("relevant"), F.col("key"))).alias("best"), F.bool_or("useful").alias("cover"))
    before = rows.join(F.broadcast(best), "qid").groupBy("qid").agg(F.first("cover").alias("cover"), F.when(F.first("best").isNotNull(), F.count_if(F.col("key") > F.col("best")) + 1).alias("first"))
    top5 = _ranked(t).filter("r <= 5").groupBy("qid").agg(F.count_if("relevant").alias("top5"))
    q = before.join(top5, "qid")
    hit = lambda k: F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0))
    return q.agg(F.count("*").alias("queries"), (F.count_if("cover") / F.count("*")).alias("coverage"), hit(1).alias("hit1"), hit(5).alias("hit5"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 9).alias("mrr"), F.round(F.avg(F.col("top5") / 5), 9).alias("p5"))


THETAS = [round(0.5 + 0.05 * i, 2) for i in range(10)]
_SWEEP = f"""SELECT threshold, count(*) FILTER (WHERE score >= threshold AND relevant) AS tp, count(*) FILTER (WHERE score >= threshold AND NOT relevant) AS fp, count(*) FILTER (WHERE score < threshold AND relevant) AS fn
FROM ({SCORED}), (SELECT CAST(unnest({THETAS}) AS DOUBLE) AS threshold) GROUP BY threshold"""
_RATES = "CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END AS recall"


@R.query(f"SELECT threshold, tp, fp, fn, {_RATES} FROM ({_SWEEP})")
def threshold_sweep(t):
    return S.sweep(_scored(t), "score", F.col("relevant"), THETAS)


@R.query(f"SELECT threshold, precision, recall FROM (SELECT threshold, {_RATES} FROM ({_SWEEP})) ORDER BY precision >= 0.9 DESC, CASE WHEN precision >= 0.9 THEN recall ELSE precision END DESC, threshold LIMIT 1")
def threshold_pick(t):
    return S.pick_threshold(S.sweep(_scored(t), "score", F.col("relevant"), THETAS), 0.9).select("threshold", "precision", "recall")


@R.query(
    f"""WITH d AS (SELECT DISTINCT lang, score FROM ({SCORED})) SELECT lang, round(theta, 9) AS theta FROM (SELECT lang, (score + lead(score) OVER (PARTITION BY lang ORDER BY score)) / 2 AS theta FROM d
UNION ALL SELECT lang, min(score) - 1 FROM d GROUP BY lang UNION ALL SELECT lang, max(score) + 1 FROM d GROUP BY lang) WHERE theta IS NOT NULL"""
)
def theta_grid_midpoints(t):
    return S.midpoints(_scored(t), ["lang"], "score").select("lang", F.round("theta", 9).alias("theta"))


_FLOORS = f"""SELECT threshold, qid, count(*) FILTER (WHERE score >= threshold) AS shown, count(*) FILTER (WHERE score >= threshold AND NOT useful) AS bad, bool_or(useful) AS covered, bool_or(useful AND score >= threshold) AS kept
FROM ({SCORED}), (SELECT CAST(unnest({THETAS}) AS DOUBLE) AS threshold) GROUP BY threshold, qid"""
_FLOOR_RATES = f"""SELECT threshold, coalesce(avg(CASE WHEN NOT covered THEN CASE WHEN shown = 0 THEN 1.0 ELSE 0.0 END END), 1.0) AS abstain, coalesce(avg(CASE WHEN covered THEN CASE WHEN kept THEN 1.0 ELSE 0.0 END END), 1.0) AS useful,
round(coalesce(avg(CASE WHEN shown = 0 THEN 0.0 ELSE bad / shown END), 0.0), 9) AS macro_fdr, round(coalesce(avg(CASE WHEN shown > 0 THEN bad / shown END), 0.0), 9) AS conditional_fdr FROM ({_FLOORS}) GROUP BY threshold"""


def _floors(t):
    shown = F.col("score") >= F.col("threshold")
    rows = _scored(t).withColumn("threshold", F.explode(F.array(*map(F.lit, THETAS))))
    q = rows.groupBy("threshold", "qid").agg(F.count_if(shown).alias("shown"), F.count_if(shown & ~F.col("useful")).alias("bad"), F.bool_or("useful").alias("covered"), F.bool_or(F.col("useful") & shown).alias("kept"))
    fdr = F.when(F.col("shown") > 0, F.col("bad") / F.col("shown"))
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    return q.groupBy("threshold").agg(
        F.coalesce(F.avg(F.when(~F.col("covered"), one(F.col("shown") == 0))), F.lit(1.0)).alias("abstain"),
        F.coalesce(F.avg(F.when(F.col("covered"), one(F.col("kept")))), F.lit(1.0)).alias("useful"),
        F.round(F.coalesce(F.avg(F.coalesce(fdr, F.lit(0.0))), F.lit(0.0)), 9).alias("macro_fdr"),
        F.round(F.coalesce(F.avg(fdr), F.lit(0.0)), 9).alias("conditional_fdr"),
    )


@R.query(_FLOOR_RATES)
def fdr_floors(t):
    return _floors(t)


@R.query(f"SELECT threshold, round(least(useful - 0.5, 0.9 - macro_fdr), 9) AS slack FROM ({_FLOOR_RATES}) ORDER BY slack DESC, threshold DESC LIMIT 1")
def maximin_fit(t):
    slack = F.round(F.least(F.col("useful") - 0.5, 0.9 - F.col("macro_fdr")), 9)
    return _floors(t).select("threshold", slack.alias("slack")).orderBy(F.desc("slack"), F.desc("threshold")).limit(1)


_LOO = f"""WITH s AS (SELECT source, threshold, count(*) FILTER (WHERE score >= threshold AND relevant) AS tp, count(*) FILTER (WHERE score >= threshold AND NOT relevant) AS fp, count(*) FILTER (WHERE score < threshold AND relevant) AS fn
FROM ({SCORED}), (SELECT CAST(unnest({THETAS}) AS DOUBLE) AS threshold) GROUP BY source, threshold),
f AS (SELECT source, threshold, tp AS otp, fp AS ofp, fn AS ofn, sum(tp) OVER w - tp AS tp, sum(fp) OVER w - fp AS fp, sum(fn) OVER w - fn AS fn FROM s WINDOW w AS (PARTITION BY threshold)),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 9) DESC, threshold DESC) AS r FROM f)"""


@R.query(f"{_LOO} SELECT source, threshold, otp AS tp, ofp AS fp, ofn AS fn FROM p WHERE r = 1")
def grouped_loo_cv(t):
    """Leave one source out: a fold's counts are all counts less its own, so every fold comes from one grouping."""
    shown = F.col("score") >= F.col("threshold")
    rows = _scored(t).withColumn("threshold", F.explode(F.array(*map(F.lit, THETAS))))
    by = rows.groupBy("source", "threshold").agg(F.count_if(shown & F.col("relevant")).alias("tp"), F.count_if(shown & ~F.col("relevant")).alias("fp"), F.count_if(~shown & F.col("relevant")).alias("fn"))
    w = Window.partitionBy("threshold")
    rest = {f"_{c}": F.sum(c).over(w) - F.col(c) for c in ("tp", "fp", "fn")}
    f1 = F.round(S.ratio(2 * F.col("_tp"), 2 * F.col("_tp") + F.col("_fp") + F.col("_fn"), 0.0), 9)
    return W.first_per_key(by.withColumns(rest), ["source"], [F.desc(f1), F.desc("threshold")]).select("source", "threshold", "tp", "fp", "fn")


@R.query(
    f"""WITH r AS ({RANKED}) SELECT lang, count(*) AS n, round(avg(score), 9) AS mean_score, count(*) FILTER (WHERE relevant) AS good FROM r WHERE r <= 10 GROUP BY lang ORDER BY good DESC, n, mean_score DESC, lang LIMIT 3"""
)
def layer2_rank(t):
    arms = _ranked(t).filter("r <= 10").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("score"), 9).alias("mean_score"), F.count_if("relevant").alias("good"))
    return arms.orderBy(F.desc("good"), "n", F.desc("mean_score"), "lang").limit(3)


@R.query("SELECT label, max(d) AS drift, count(*) FILTER (WHERE d > 0.5) AS wide FROM (SELECT vec_id, label, list_max(embedding) - list_min(embedding) AS d FROM embeddings) GROUP BY label")
def score_drift(t):
    d = F.array_max("embedding") - F.array_min("embedding")
    return t.embeddings.select("label", d.alias("d")).groupBy("label").agg(F.max("d").alias("drift"), F.count_if(F.col("d") > 0.5).alias("wide"))


@R.query(
    f"""WITH c AS (SELECT qid, count(*) FILTER (WHERE useful) AS gold, count(*) FILTER (WHERE score >= 0.4) AS found, count(*) FILTER (WHERE useful AND score >= 0.4) AS hit FROM ({SCORED}) GROUP BY qid),
o AS (SELECT sum(gold) AS gold, sum(found) AS found, sum(least(hit, least(gold, found))) AS hit FROM c)
SELECT CASE WHEN found = 0 THEN 0 ELSE hit / found END AS precision, CASE WHEN gold = 0 THEN 0 ELSE hit / gold END AS recall, CASE WHEN hit = 0 THEN 0 ELSE 2 * hit / (found + gold) END AS f1 FROM o"""
)
def prf_micro(t):
    shown = F.col("score") >= 0.4
    c = _scored(t).groupBy("qid").agg(F.count_if("useful").alias("gold"), F.count_if(shown).alias("found"), F.count_if(F.col("useful") & shown).alias("hit"))
    o = c.agg(F.sum("gold").alias("gold"), F.sum("found").alias("found"), F.sum(F.least("hit", "gold", "found")).alias("hit"))
    return o.select(S.ratio(F.col("hit"), F.col("found"), 0.0).alias("precision"), S.ratio(F.col("hit"), F.col("gold"), 0.0).alias("recall"), S.ratio(2 * F.col("hit"), F.col("found") + F.col("gold"), 0.0).alias("f1"))
