"""Queries over scored candidates: estimates, full metrics, floors, arms, folds, drift, latency, health of scored rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake.operators import scoring as O
from memlake.operators import statistics as S
from memlake.operators import windows as W
from memlake.plans.registry import Registry
from memlake.plans.thresholds import SEARCHED, searched

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

#: Judged candidates of 30 queries: two kinds of card, scores from the document, a second opinion, conflicts excluded.
CARDS = """SELECT d.doc_id, d.doc_id % 30 AS qid, d.source, d.lang, CASE WHEN d.doc_id % 2 = 0 THEN 'case' ELSE 'skill' END AS kind, (d.n_chars % 997) / 997.0 AS score, (d.n_chars * 31 % 101) / 101.0 AS ce,
l.quality = 1 AS relevant, l.quality = 1 AND l.toxic = 0 AND d.n_chars % 3 = 0 AS useful, d.n_chars % 11 = 0 AS excluded FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""
#: The five that a query shows, best first.
SHOWN = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM ({CARDS})) WHERE r <= 5"


def _cards(t):
    d = t.documents.select("doc_id", "source", "lang", "n_chars").join(t.labels, "doc_id")
    good = F.col("quality") == 1
    return d.select(
        "doc_id", (F.col("doc_id") % 30).alias("qid"), "source", "lang", F.when(F.col("doc_id") % 2 == 0, "case").otherwise("skill").alias("kind"), ((F.col("n_chars") % 997) / 997.0).alias("score"), ((F.col("n_chars") * 31 % 101) / 101.0).alias("ce"),
        good.alias("relevant"), (good & (F.col("toxic") == 0) & (F.col("n_chars") % 3 == 0)).alias("useful"), (F.col("n_chars") % 11 == 0).alias("excluded"),
    )


def _shown(t):
    return W.top_per_key(_cards(t), ["qid"], [F.desc("score"), F.col("doc_id")], 5, "r")


_OBSERVED = """SELECT d.source AS stratum, count(*) AS pop, count(*) FILTER (WHERE l.doc_id IS NOT NULL AND d.source NOT IN ('src1', 'src2')) AS n, count(*) FILTER (WHERE l.quality = 1 AND l.toxic = 0 AND d.n_chars % 2 = 0 AND d.source NOT IN ('src1', 'src2')) AS k FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source"""


def _observed(t):
    """Strata of the whole corpus, two of them never observed."""
    seen = ~F.col("source").isin("src1", "src2")
    rows = t.documents.select("doc_id", "source", "n_chars").join(t.labels, "doc_id", "left")
    passed = seen & (F.col("quality") == 1) & (F.col("toxic") == 0) & (F.col("n_chars") % 2 == 0)
    return rows.groupBy(F.col("source").alias("stratum")).agg(F.count("*").alias("pop"), F.count_if(seen & F.col("quality").isNotNull()).alias("n"), F.count_if(passed).alias("k"))


@R.query(f"WITH s AS (SELECT *, pop / sum(pop) OVER () AS w FROM ({_OBSERVED})) SELECT stratum, round(CASE WHEN n > 0 THEN w / sum(CASE WHEN n > 0 THEN w END) OVER () ELSE 0 END, 9) AS weight, n = 0 AND w > 0 AS gap FROM s")
def weights_renormalised(t):
    """Weights of strata without observations go to the others in proportion; such strata are gaps."""
    return O.renormalised(_observed(t), "pop", "n").select("stratum", F.round("weight", 9).alias("weight"), "gap")


@R.query(
    f"""WITH s AS (SELECT *, pop / sum(pop) OVER () AS w0 FROM ({_OBSERVED})), w AS (SELECT *, CASE WHEN n > 0 THEN w0 / sum(CASE WHEN n > 0 THEN w0 END) OVER () ELSE 0 END AS w FROM s),
o AS (SELECT sum(CASE WHEN n > 0 THEN w * k / n END) AS rate, sqrt(sum(CASE WHEN n > 0 THEN w * w * (k / n) * (1 - k / n) / n END)) AS sd, count(*) FILTER (WHERE n = 0 AND w0 > 0) AS gaps, count(*) FILTER (WHERE n > 0) AS seen, count(*) FILTER (WHERE n BETWEEN 1 AND 4) AS small FROM w)
SELECT round(rate, 9) AS rate, round(greatest(0, rate - 1.96 * sd), 9) AS low, round(least(1, rate + 1.96 * sd), 9) AS high, gaps, CASE WHEN seen = 0 THEN 'undefined' WHEN small > 0 THEN 'bootstrap' ELSE 'analytic' END AS method FROM o"""
)
def overall_estimate(t):
    """The weighted rate with its analytic interval, and which method the strata's sizes ask for."""
    one = O.overall(O.renormalised(_observed(t), "pop", "n"), "k", "n", 5)
    return one.select(*[F.round(c, 9).alias(c) for c in ("rate", "low", "high")], "gaps", "method")


@R.query(
    f"""WITH s AS (SELECT *, pop / sum(pop) OVER () AS w0 FROM ({_OBSERVED})), w AS (SELECT stratum, n, k, w0 / sum(w0) OVER () AS w FROM s WHERE n > 0),
c AS (SELECT stratum, j, sum(CASE WHEN k IN (0, n) THEN (j = k)::INT ELSE exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(k / n) + (n - j) * ln(1 - k / n)) END) OVER (PARTITION BY stratum ORDER BY j) AS below FROM (SELECT *, unnest(range(0, n + 1)) AS j FROM w)),
u AS (SELECT stratum, r, (('0x' || substr(sha256(r || ':' || stratum), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM w, range(2000) t(r)),
d AS (SELECT u.stratum, r, min(j) AS drawn FROM u JOIN c ON u.stratum = c.stratum AND c.below >= u.u GROUP BY u.stratum, r),
b AS (SELECT r, sum(w * drawn / n) AS rate FROM d JOIN w USING (stratum) GROUP BY r), o AS (SELECT rate, row_number() OVER (ORDER BY rate, r) - 1 AS i FROM b)
SELECT round(max(CASE WHEN i = 50 THEN rate END), 9) AS low, round(max(CASE WHEN i = 1950 THEN rate END), 9) AS high FROM o"""
)
def bootstrap_ci(t):
    """The interval of 2,000 replicates by index: each stratum resampled and weighed by its share of the corpus, shared out among those observed."""
    one = S.bootstrap(O.renormalised(_observed(t), "pop", "n"), "stratum", "k", "n", "weight", 2000)
    return one.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


_WILSON = "((k / n + {z} * {z} / (2 * n)) {sign} {z} * sqrt((k / n) * (1 - k / n) / n + {z} * {z} / (4 * n * n))) / (1 + {z} * {z} / n)"


@R.query(
    f"""WITH s AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE useful) AS k, count(*) FILTER (WHERE NOT relevant) AS fabricated, sum(CASE WHEN excluded THEN 1 ELSE 0 END) / nullif(count(*) FILTER (WHERE useful), 0) AS cost FROM ({CARDS}) GROUP BY source),
c AS (SELECT *, CASE WHEN n >= 10 THEN {_WILSON.format(z=1.96, sign="-")} END AS low, CASE WHEN n >= 10 THEN {_WILSON.format(z=1.96, sign="+")} END AS high FROM s)
SELECT source, CASE WHEN low IS NULL OR high IS NULL THEN 'HOLD' WHEN low >= 0.15 AND fabricated <= 3 AND coalesce(cost <= 0.5, false) THEN 'clear GO' WHEN high < 0.15 OR fabricated > 3 OR NOT coalesce(cost <= 0.5, false) THEN 'clear NO-GO' ELSE 'marginal' END AS verdict FROM c"""
)
def go_decision(t):
    """An undefined interval holds; else lower bound, red flag and unit cost decide, in this order."""
    s = _cards(t).groupBy("source").agg(F.count("*").alias("n"), F.count_if("useful").alias("k"), F.count_if(~F.col("relevant")).alias("fabricated"), F.count_if("excluded").alias("spent"))
    low, high = S.wilson(F.col("k"), F.col("n"), 1.96)
    known = F.col("n") >= 10
    cheap = F.coalesce(F.try_divide(F.col("spent"), F.col("k")) <= 0.5, F.lit(False))
    return s.select("source", O.decision(F.when(known, low), F.when(known, high), F.col("fabricated") > 3, cheap, 0.15).alias("verdict"))


def _metrics_sql(cards: str, shown: str) -> str:
    return f"""WITH q AS (SELECT qid, bool_or(relevant) AS covered, bool_or(useful) AS uses FROM ({cards}) GROUP BY qid),
t AS (SELECT qid, count(*) AS shown, count(*) FILTER (WHERE relevant) AS rel, bool_or(useful) AS hit_useful, min(CASE WHEN relevant THEN r END) AS first FROM ({shown}) GROUP BY qid), o AS (SELECT q.*, coalesce(shown, 0) AS shown, coalesce(rel, 0) AS rel, coalesce(hit_useful, false) AS hit_useful, first FROM q LEFT JOIN t USING (qid)),
a AS (SELECT count(*) AS n_total, count(*) FILTER (WHERE covered) AS n_covered, count(*) FILTER (WHERE NOT covered) AS n_uncovered, count(*) FILTER (WHERE covered AND uses) AS useful_exists, count(*) FILTER (WHERE covered AND hit_useful) AS cov_useful, count(*) FILTER (WHERE hit_useful) AS any_useful,
count(*) FILTER (WHERE covered AND first IS NOT NULL) AS hits, count(*) FILTER (WHERE covered AND first IS NOT NULL AND hit_useful) AS hits_useful, count(*) FILTER (WHERE covered AND first <= 1) AS h1, count(*) FILTER (WHERE covered AND first <= 3) AS h3, count(*) FILTER (WHERE covered AND first <= 5) AS h5,
coalesce(sum(CASE WHEN covered THEN 1.0 / first END), 0) AS rr, sum(rel / greatest(shown, 1)) AS prec, coalesce(sum(CASE WHEN NOT covered THEN rel / greatest(shown, 1) END), 0) AS u_rel, coalesce(sum(CASE WHEN NOT covered THEN (shown - rel) / greatest(shown, 1) END), 0) AS u_irr FROM o)
SELECT n_total, n_covered, n_uncovered, round(coalesce(n_covered / nullif(n_total, 0), 0), 9) AS coverage, round(coalesce(useful_exists / nullif(n_total, 0), 0), 9) AS useful_coverage, round(coalesce(cov_useful / nullif(n_covered, 0), 0), 9) AS covered_useful_hit_at_5,
round(CASE WHEN n_covered = 0 THEN 0 ELSE ((cov_useful / n_covered + 1.6449 * 1.6449 / (2 * n_covered)) - 1.6449 * sqrt((cov_useful / n_covered) * (1 - cov_useful / n_covered) / n_covered + 1.6449 * 1.6449 / (4 * n_covered * n_covered))) / (1 + 1.6449 * 1.6449 / n_covered) END, 9) AS covered_useful_hit_wilson_lo,
round(coalesce(any_useful / nullif(n_total, 0), 0), 9) AS global_useful_hit_at_5, round(coalesce(hits / nullif(n_covered, 0), 0), 9) AS conditional_hit, round(coalesce(hits_useful / nullif(hits, 0), 0), 9) AS conditional_useful, round(coalesce(useful_exists / nullif(n_covered, 0), 0), 9) AS useful_exists_rate,
round(coalesce(h1 / nullif(n_covered, 0), 0), 9) AS hit_at_1, round(coalesce(h3 / nullif(n_covered, 0), 0), 9) AS hit_at_3, round(coalesce(h5 / nullif(n_covered, 0), 0), 9) AS hit_at_5, round(coalesce(rr / nullif(n_covered, 0), 0), 9) AS mrr, round(coalesce(prec / nullif(n_total, 0), 0), 9) AS precision_at_5,
round(coalesce(u_rel / nullif(n_uncovered, 0), 0), 9) AS uncovered_pseudo_relevant_rate, round(coalesce(u_irr / nullif(n_uncovered, 0), 0), 9) AS uncovered_irrelevant_rate, n_uncovered > 0 AND coalesce(u_irr / nullif(n_uncovered, 0), 0) >= 0.6 AS go_with_guard FROM a"""


@R.query(_metrics_sql(CARDS, SHOWN))
def retrieval_metrics_full(t):
    """All of a retrieval report: coverage, hits at ranks, reciprocal rank, precision, conditional rates, the guard."""
    covered = _cards(t).groupBy("qid").agg(F.bool_or("relevant").alias("covered"), F.bool_or("useful").alias("uses"))
    return O.retrieval_report(covered, _shown(t))


@R.query(_metrics_sql(SEARCHED, f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place) AS r FROM ({SEARCHED}) WHERE score >= 0.8 QUALIFY r <= 5"))
def retrieval_metrics_abstaining(t):
    """The same report over searches of which many show nothing: those count in every denominator."""
    cards = searched(t)
    covered = cards.groupBy("qid").agg(F.bool_or("relevant").alias("covered"), F.bool_or("useful").alias("uses"))
    return O.retrieval_report(covered, W.top_per_key(cards.filter("score >= 0.8"), ["qid"], [F.col("place")], 5, "r"))


@R.query(
    f"""WITH s AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE useful) AS k FROM ({CARDS}) GROUP BY lang UNION ALL SELECT source, count(*), count(*) FILTER (WHERE useful) FROM ({CARDS}) WHERE doc_id < 60 GROUP BY source), w AS (SELECT *, k / n AS p, {_WILSON.format(z=1.6449, sign="-")} AS lo FROM s)
SELECT lang AS name, CASE WHEN n < 10 THEN 'invalid_n' WHEN p >= 0.5 THEN 'strong_pass' || CASE WHEN lo < 0.25 THEN '_exploratory' ELSE '' END WHEN p >= 0.4 THEN 'borderline_pass' || CASE WHEN lo < 0.25 THEN '_exploratory' ELSE '' END WHEN p >= 0.3 THEN 'weak_signal' ELSE 'clear_fail' END AS verdict FROM w"""
)
def band_verdicts(t):
    agg = [F.count("*").alias("n"), F.count_if("useful").alias("k")]
    rows = _cards(t).groupBy(F.col("lang").alias("name")).agg(*agg).unionByName(_cards(t).filter("doc_id < 60").groupBy(F.col("source").alias("name")).agg(*agg))
    return rows.select("name", O.band(F.col("k"), F.col("n")).alias("verdict"))


_FDR = f"""SELECT qid, count(*) FILTER (WHERE score >= 0.9) AS returned, CASE WHEN count(*) FILTER (WHERE score >= 0.9) = 0 THEN 0.0 WHEN bool_and(excluded) FILTER (WHERE score >= 0.9) THEN 1.0 ELSE count(*) FILTER (WHERE score >= 0.9 AND (excluded OR NOT relevant)) / count(*) FILTER (WHERE score >= 0.9) END AS fdr
FROM ({SHOWN}) GROUP BY qid"""


@R.query(f"SELECT qid, returned, round(fdr, 9) AS fdr FROM ({_FDR})")
def query_fdr(t):
    """Nothing shown: 0; only excluded cards: 1; else what isn't known to be relevant, excluded cards among it."""
    return O.false_discovery(_shown(t), F.col("score") >= 0.9).select("qid", "returned", F.round("fdr", 9).alias("fdr"))


@R.query(f"SELECT round_even(avg(CASE WHEN excluded_all THEN 1.0 ELSE bad / shown END) / 2, 2) AS floor FROM (SELECT qid, count(*) AS shown, bool_and(excluded) AS excluded_all, count(*) FILTER (WHERE excluded OR NOT relevant) AS bad FROM ({SHOWN}) GROUP BY qid) WHERE qid IN (SELECT qid FROM ({CARDS}) GROUP BY qid HAVING bool_or(relevant))")
def contamination_floor(t):
    """Half the mean false-discovery rate of covered queries, rounded to even."""
    covered = _cards(t).groupBy("qid").agg(F.bool_or("relevant").alias("c")).filter("c").select("qid")
    return O.false_discovery(_shown(t), F.lit(True)).join(covered, "qid", "left_semi").agg(F.bround(F.avg("fdr") / 2, 2).alias("floor"))


_COARSE = f"SELECT kind, floor(score * 8) / 8 AS v FROM ({CARDS})"
_GRID = f"SELECT kind, v, (v + lead(v) OVER (PARTITION BY kind ORDER BY v)) / 2 AS mid, min(v) OVER (PARTITION BY kind) - 1 AS lo, max(v) OVER (PARTITION BY kind) + 1 AS hi FROM (SELECT DISTINCT * FROM ({_COARSE}))"


@R.query(f"WITH g AS ({_GRID}), e AS (SELECT kind, mid AS theta FROM g WHERE mid IS NOT NULL UNION SELECT kind, lo FROM g UNION SELECT kind, hi FROM g) SELECT c.theta AS theta_case, s.theta AS theta_skill FROM e c, e s WHERE c.kind = 'case' AND s.kind = 'skill'")
def theta_pairs(t):
    """The grid of two thresholds: midpoints of adjacent distinct scores and a sentinel at either end, for each kind."""
    grid = S.midpoints(_cards(t).select("kind", (F.floor(F.col("score") * 8) / 8).alias("v")), ["kind"], "v").distinct()
    each = [grid.filter(F.col("kind") == k).select(F.col("theta").alias(f"theta_{k}")) for k in ("case", "skill")]
    return each[0].crossJoin(F.broadcast(each[1]))  # a grid by a grid, at most eleven steps each


_TH = "[0.1, 0.3, 0.5, 0.7, 0.8, 0.9, 0.95]"
_THETAS = [0.1, 0.3, 0.5, 0.7, 0.8, 0.9, 0.95]
_PER = f"""SELECT qid, qid % 6 AS fold, theta, bool_or(relevant) AS covered, bool_or(useful) AS uses, count(*) FILTER (WHERE score >= theta) AS shown, count(*) FILTER (WHERE score >= theta AND (excluded OR NOT relevant)) AS bad, coalesce(bool_and(excluded) FILTER (WHERE score >= theta), false) AS all_out, coalesce(bool_or(useful) FILTER (WHERE score >= theta), false) AS hit,
count(*) FILTER (WHERE score >= theta AND NOT relevant) AS wrong FROM ({CARDS}), (SELECT CAST(unnest({_TH}) AS DOUBLE) AS theta) GROUP BY qid, theta"""
_CELLS = f"""SELECT fold, theta, count(*) FILTER (WHERE NOT covered) AS unc, count(*) FILTER (WHERE NOT covered AND shown = 0) AS abst, count(*) FILTER (WHERE uses) AS base, count(*) FILTER (WHERE uses AND hit) AS kept, count(*) FILTER (WHERE covered) AS cov, count(*) FILTER (WHERE covered AND shown > 0) AS ne,
coalesce(sum(CASE WHEN covered THEN CASE WHEN shown = 0 THEN 0 WHEN all_out THEN 1 ELSE bad / shown END END), 0.0) AS fdr FROM ({_PER}) GROUP BY fold, theta"""
_SLACK = "round(least(coalesce(abst / nullif(unc, 0), 1.0) - 0.0, coalesce(kept / nullif(base, 0), 1.0) - 0.5, 0.95 - coalesce(fdr / nullif(cov, 0), 0.0), 0.95 - coalesce(fdr / nullif(ne, 0), 0.0)), 9)"


@R.query(f"WITH a AS (SELECT theta, sum(unc) AS unc, sum(abst) AS abst, sum(base) AS base, sum(kept) AS kept, sum(cov) AS cov, sum(ne) AS ne, sum(fdr) AS fdr FROM ({_CELLS}) GROUP BY theta) SELECT theta, {_SLACK} AS slack, {_SLACK} >= 0 AS feasible FROM a")
def floor_slacks(t):
    """For each threshold the least of four slacks; feasible where it isn't negative."""
    cells = O.floor_cells(_cards(t), _THETAS, F.col("qid") % 6)
    whole = cells.groupBy("theta").agg(*[F.sum(c).alias(c) for c in O.CELLS])
    return whole.select("theta", O.slack().alias("slack"), (O.slack() >= 0).alias("feasible"))


@R.query(
    f"""WITH c AS ({_CELLS}), f AS (SELECT fold, theta, sum(unc) OVER w - unc AS unc, sum(abst) OVER w - abst AS abst, sum(base) OVER w - base AS base, sum(kept) OVER w - kept AS kept, sum(cov) OVER w - cov AS cov, sum(ne) OVER w - ne AS ne, sum(fdr) OVER w - fdr AS fdr FROM c WINDOW w AS (PARTITION BY theta)),
p AS (SELECT fold, theta FROM (SELECT fold, theta, slack, row_number() OVER (PARTITION BY fold ORDER BY slack DESC, theta DESC) AS r FROM (SELECT fold, theta, {_SLACK} AS slack FROM f) WHERE slack >= 0) WHERE r = 1)
SELECT x.fold, p.theta, c.unc, CASE WHEN p.theta IS NULL THEN c.unc ELSE c.abst END AS abstained, c.base, CASE WHEN p.theta IS NULL THEN 0 ELSE c.kept END AS kept, round(CASE WHEN p.theta IS NULL THEN 0 ELSE c.fdr END, 9) AS fdr FROM (SELECT DISTINCT fold FROM c) x LEFT JOIN p ON x.fold = p.fold JOIN c ON c.fold = x.fold AND c.theta = coalesce(p.theta, 0.1)"""
)
def held_out_folds(t):
    """Groups left out in turn: a threshold is fitted on the others by the largest least slack, larger thresholds first at a
    tie; a fold without a feasible one abstains. Outcomes are those of the group left out."""
    return O.held_out(O.floor_cells(_cards(t), _THETAS, F.col("qid") % 6), min(_THETAS))


_ARMS = f"""SELECT *, max(CASE WHEN source = 'src0' THEN ce END) OVER (PARTITION BY qid, kind) AS decoy, avg(ce) OVER (PARTITION BY qid) AS mu, stddev_pop(ce) OVER (PARTITION BY qid) AS sd FROM ({CARDS})"""


@R.query(
    f"""SELECT arm, count(*) FILTER (WHERE ok) AS released, count(*) AS n FROM (SELECT unnest(['native_pertype', 'cos_unified', 'cos_pertype', 'ce_fixed', 'ce_znorm', 'null_ref']) AS arm, unnest([score >= CASE WHEN kind = 'case' THEN 0.5 ELSE 0.7 END, 1 - score >= 0.6, 1 - score >= CASE WHEN kind = 'case' THEN 0.4 ELSE 0.6 END,
ce >= 0.5, coalesce(sd > 0 AND round((ce - mu) / nullif(sd, 0), 9) >= 0.25, false), coalesce(ce >= decoy + 0.1, false)]) AS ok FROM ({_ARMS})) GROUP BY arm"""
)
def arm_releases(t):
    """Six ways to release a candidate: thresholds for each kind or for all, a score against its query's spread, a margin
    over the best decoy of its kind. An arm is a column; without spread or decoy it releases nothing."""
    w = Window.partitionBy("qid")
    decoy = F.max(F.when(F.col("source") == "src0", F.col("ce"))).over(Window.partitionBy("qid", "kind"))
    rows = _cards(t).withColumns({"decoy": decoy, "mu": F.avg("ce").over(w), "sd": F.stddev_pop("ce").over(w), "cos": 1 - F.col("score")})
    arms = O.arms(native=(0.5, 0.7), cos=0.6, cos_pair=(0.4, 0.6), ce=0.5, z=0.25, margin=0.1)
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("arm"), F.coalesce(c, F.lit(False)).alias("ok")) for n, c in arms.items()])).alias("x"))
    return each.groupBy("x.arm").agg(F.count_if("x.ok").alias("released"), F.count("*").alias("n"))


_VARIANTS = f"SELECT v AS variant, qid, doc_id, score, CASE v WHEN 'primary' THEN relevant AND NOT excluded WHEN 'optimistic' THEN relevant OR excluded ELSE relevant AND NOT excluded END AS rel, CASE v WHEN 'optimistic' THEN useful OR excluded ELSE useful AND NOT excluded END AS use FROM ({CARDS}), (SELECT unnest(['primary', 'optimistic', 'pessimistic']) AS v)"
_ERRORS = f"""SELECT variant, count(*) FILTER (WHERE NOT covered AND shown > 0) AS leaks, count(*) FILTER (WHERE uses AND NOT hit) AS kills, CAST(coalesce(sum(CASE WHEN covered THEN wrong END), 0) AS BIGINT) AS covered_wrong, CAST(coalesce(sum(CASE WHEN covered THEN useless END), 0) AS BIGINT) AS relevant_not_useful FROM
(SELECT variant, qid, bool_or(rel) AS covered, bool_or(use) AS uses, count(*) FILTER (WHERE score >= 0.9) AS shown, coalesce(bool_or(use) FILTER (WHERE score >= 0.9), false) AS hit, count(*) FILTER (WHERE score >= 0.9 AND NOT rel) AS wrong, count(*) FILTER (WHERE score >= 0.9 AND rel AND NOT use) AS useless FROM ({_VARIANTS}) GROUP BY variant, qid) GROUP BY variant"""


@R.query(f"SELECT *, CASE WHEN kills > leaks THEN 'kill-heavy' WHEN kills < leaks THEN 'leak-heavy' ELSE 'balanced' END AS direction, count(DISTINCT CASE WHEN kills > leaks THEN 'k' WHEN kills < leaks THEN 'l' ELSE 'b' END) OVER () = 1 AS stable FROM ({_ERRORS})")
def error_directions(t):
    """What an arm leaks and kills under each reading of the labels, and whether the readings agree on the direction."""
    v = F.explode(F.array(*map(F.lit, ("primary", "optimistic", "pessimistic"))))
    rows = _cards(t).withColumn("variant", v)
    widest = F.col("variant") == "optimistic"
    rows = rows.withColumns({"rel": F.when(widest, F.col("relevant") | F.col("excluded")).otherwise(F.col("relevant") & ~F.col("excluded")), "use": F.when(widest, F.col("useful") | F.col("excluded")).otherwise(F.col("useful") & ~F.col("excluded"))})
    return O.directions(rows, F.col("score") >= 0.9)


@R.query(f"SELECT arm, row_number() OVER (ORDER BY uncovered_allowed, useful_lost, wrong, simplicity) AS place FROM (SELECT source AS arm, count(*) FILTER (WHERE NOT relevant) AS uncovered_allowed, count(*) FILTER (WHERE useful) AS useful_lost, count(*) FILTER (WHERE excluded) AS wrong, CAST(substr(source, 4) AS BIGINT) AS simplicity FROM ({CARDS}) GROUP BY source)")
def survivor_ranking(t):
    """Survivors by four keys in turn; the first is the leader. One row for each arm, a handful."""
    arms = _cards(t).groupBy(F.col("source").alias("arm")).agg(F.count_if(~F.col("relevant")).alias("a"), F.count_if("useful").alias("b"), F.count_if("excluded").alias("c"))
    order = Window.orderBy("a", "b", "c", F.expr("cast(substr(arm, 4) as bigint)"))
    return arms.select("arm", F.row_number().over(order).cast("long").alias("place"))


@R.query(f"WITH k AS (SELECT lang, doc_id, any_value(score) AS score, max(s) - min(s) AS spread FROM (SELECT lang, doc_id, score, score + ((doc_id * 7 + i * 13) % 5) / 1000.0 AS s FROM ({CARDS}), range(5) r(i)) GROUP BY lang, doc_id) SELECT lang, round(max(spread), 9) AS drift, round(min(abs(score - 0.5)), 9) AS nearest, round(min(abs(score - 0.5)), 9) > round(max(spread), 9) AS margin_ok FROM k GROUP BY lang")
def round_drift(t):
    """How far a key's score moves over rounds, at most, beside a threshold's distance from the nearest score."""
    rounds = _cards(t).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return O.drift(rounds.withColumn("s", F.col("score") + ((F.col("doc_id") * 7 + F.col("i") * 13) % 5) / 1000.0), ["lang"], ["doc_id"], "score", "s", 0.5)


_LAT = "SELECT event_type, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS cold FROM events WHERE value IS NOT NULL"


@R.query(
    f"""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE cold) AS cold, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, round(avg(value) FILTER (WHERE cold), 6) AS cold_mean, round(avg(value) FILTER (WHERE NOT cold), 6) AS warm_mean,
quantile_disc(value, 0.95) <= 60 AND max(value) <= 1000 AND count(*) >= 100 AS ok FROM ({_LAT}) GROUP BY event_type"""
)
def latency_split(t):
    """Percentiles by nearest rank, first calls of a user apart from the others, and a gate of three tests."""
    cold = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) == 1
    rows = t.events.filter("value is not null").select("event_type", "value", cold.alias("cold"))
    return O.latencies(rows, "event_type", "value", p95=60, most=1000, least_rows=100)


@R.query(
    """WITH s AS (SELECT event_type AS command, length(props) AS chars FROM events WHERE props IS NOT NULL), a AS (SELECT command, count(*) AS n, sum(chars) AS total, floor(quantile_cont(chars, 0.5)) AS p50, max(chars) AS most, list(chars ORDER BY chars) AS v FROM s GROUP BY command)
SELECT command, n, CAST(total AS BIGINT) AS total, CAST(p50 AS BIGINT) AS p50, CAST(v[CAST(least(floor(n * 0.95), n - 1) AS BIGINT) + 1] AS BIGINT) AS p95, CAST(most AS BIGINT) AS most, round(100.0 * total / sum(total) OVER (), 6) AS share FROM a ORDER BY total DESC, command LIMIT 25"""
)
def command_lengths(t):
    """Lengths by command from counts of each length: median cut down, the value at index 0.95 n, share of all characters."""
    return O.length_report(t.events.filter("props is not null").select(F.col("event_type").alias("command"), F.length("props").cast("long").alias("chars")), 25)


@R.query("SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) FILTER (WHERE event_type = 'error') >= 5 AS permanent, count(*) FILTER (WHERE event_type <> 'signup') AS real FROM events GROUP BY user_id")
def permanent_failures(t):
    return t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("failures"), (F.count_if(F.col("event_type") == "error") >= 5).alias("permanent"), F.count_if(F.col("event_type") != "signup").alias("real"))


@R.query("SELECT source, CAST(sum(coalesce(TRY_CAST(nullif(regexp_extract(head, '(?m)^entry_count: ([0-9]+)$', 1), '') AS BIGINT), 0)) AS BIGINT) AS entries, count(*) AS files FROM (SELECT source, 'title: x' || chr(10) || CASE WHEN doc_id % 5 = 0 THEN 'entry_count: many' ELSE 'entry_count: ' || doc_id % 7 END AS head FROM documents) GROUP BY source")
def library_counts(t):
    """What the files say they hold, not how many files there are; a count that is no number is none."""
    head = F.concat(F.lit("title: x\n"), F.when(F.col("doc_id") % 5 == 0, "entry_count: many").otherwise(F.concat(F.lit("entry_count: "), (F.col("doc_id") % 7).cast("string"))))
    n = F.coalesce(F.nullif(F.regexp_extract(head, "(?m)^entry_count: ([0-9]+)$", 1), F.lit("")).cast("long"), F.lit(0))
    return t.documents.groupBy("source").agg(F.sum(n).alias("entries"), F.count("*").alias("files"))


@R.query(
    f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY qid, kind ORDER BY score DESC, doc_id) AS r FROM ({CARDS})), m AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY r, CASE WHEN kind = 'skill' THEN 0 ELSE 1 END) AS o FROM k)
SELECT qid, doc_id, place FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY o) AS place FROM m WHERE ce >= 0.5) WHERE place <= 5"""
)
def filtered_interleave(t):
    """Both lists are interleaved whole before the filter, so that what it drops leaves no gap; then the first five."""
    rows = _cards(t).withColumn("r", F.row_number().over(Window.partitionBy("qid", "kind").orderBy(F.desc("score"), "doc_id")))
    return W.interleaved_then(rows, "qid", "kind", "r", "skill", F.col("ce") >= 0.5, 5).select("qid", "doc_id", F.col("place").cast("long").alias("place"))


@R.query(f"SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY coalesce(CASE WHEN NOT excluded THEN score END, -1e308) DESC, sha256('7:' || doc_id)) AS place FROM ({CARDS})")
def diagnostic_order(t):
    """Best score first, missing ones last, ties by a seeded hash."""
    score = F.coalesce(F.when(~F.col("excluded"), F.col("score")), F.lit(-1e308))
    order = Window.partitionBy("qid").orderBy(F.desc(score), F.sha2(F.concat(F.lit("7:"), F.col("doc_id").cast("string")), 256))
    return _cards(t).select("qid", "doc_id", F.row_number().over(order).cast("long").alias("place"))


@R.query("SELECT doc_id FROM documents WHERE lang = 'fr' ORDER BY sha256('20260713:' || doc_id), doc_id LIMIT 40")
def seeded_shuffle(t):
    """The head of a shuffle that a seed and the ids decide."""
    return t.documents.filter("lang = 'fr'").select("doc_id").orderBy(F.sha2(F.concat(F.lit("20260713:"), F.col("doc_id").cast("string")), 256), "doc_id").limit(40)


#: Attempts to score a request: statuses, card scores and pins as JSON, some broken in one way or another.
_ATTEMPTS = """SELECT event_id, user_id AS rid, event_id % 3 AS attempt_no, CASE event_type WHEN 'error' THEN 'retryable_error' WHEN 'signup' THEN 'permanent_failure' ELSE 'ok' END AS status,
CASE WHEN event_id % 7 = 0 THEN '{"case:1":{"cos":0.5}}' WHEN event_id % 7 = 1 THEN '{"case:1":{"cos":0.5,"ce":null},"skill:2":{"cos":1,"ce":2}}' WHEN event_id % 7 = 2 THEN '{"case:1":{"cos":0.5,"ce":1}}' ELSE '{"case:1":{"cos":0.5,"ce":1.5},"skill:2":{"cos":1,"ce":' || value || '}}' END AS per_card,
CASE WHEN event_id % 5 = 0 THEN '{"model":"m","cap":"unknown"}' WHEN event_id % 5 = 1 THEN '{"model":"m"}' ELSE '{"model":"m","cap":"512"}' END AS pins FROM events WHERE value IS NOT NULL"""
_HEALTHY = """status = 'ok' AND list_sort(json_keys(per_card)) = ['case:1', 'skill:2'] AND TRY_CAST(per_card -> 'case:1' ->> 'cos' AS DOUBLE) IS NOT NULL AND TRY_CAST(per_card -> 'case:1' ->> 'ce' AS DOUBLE) IS NOT NULL AND TRY_CAST(per_card -> 'skill:2' ->> 'cos' AS DOUBLE) IS NOT NULL AND TRY_CAST(per_card -> 'skill:2' ->> 'ce' AS DOUBLE) IS NOT NULL
AND coalesce(pins ->> 'model', 'unknown') <> 'unknown' AND coalesce(pins ->> 'cap', 'unknown') <> 'unknown'"""


def _attempts(t):
    e, value = F.col("event_id"), F.col("value").cast("string")
    card = F.when(e % 7 == 0, '{"case:1":{"cos":0.5}}').when(e % 7 == 1, '{"case:1":{"cos":0.5,"ce":null},"skill:2":{"cos":1,"ce":2}}').when(e % 7 == 2, '{"case:1":{"cos":0.5,"ce":1}}').otherwise(F.concat(F.lit('{"case:1":{"cos":0.5,"ce":1.5},"skill:2":{"cos":1,"ce":'), value, F.lit("}}")))
    pins = F.when(e % 5 == 0, '{"model":"m","cap":"unknown"}').when(e % 5 == 1, '{"model":"m"}').otherwise('{"model":"m","cap":"512"}')
    status = F.when(F.col("event_type") == "error", "retryable_error").when(F.col("event_type") == "signup", "permanent_failure").otherwise("ok")
    return t.events.filter("value is not null").select("event_id", F.col("user_id").alias("rid"), (e % 3).alias("attempt_no"), status.alias("status"), card.alias("per_card"), pins.alias("pins"))


def _healthy():
    return O.healthy(F.col("status"), F.from_json("per_card", "map<string, struct<cos: double, ce: double>>"), F.array(F.lit("case:1"), F.lit("skill:2")), F.from_json("pins", "map<string, string>"), ("model", "cap"))


@R.query(f"SELECT event_id, CASE WHEN status = 'ok' AND NOT ({_HEALTHY}) THEN 'retryable_error' ELSE status END AS status, {_HEALTHY} AS healthy FROM ({_ATTEMPTS})")
def scored_health(t):
    """A scored row is healthy if its cards are those accepted, all their numbers finite and all pins known; one that says ok
    and isn't is written as an error, not dropped."""
    return _attempts(t).select("event_id", "status", _healthy().alias("healthy")).withColumn("status", F.when((F.col("status") == "ok") & ~F.col("healthy"), "retryable_error").otherwise(F.col("status")))


@R.query(
    f"""WITH h AS (SELECT *, CASE WHEN {_HEALTHY} THEN 3 WHEN status = 'permanent_failure' THEN 2 WHEN status = 'retryable_error' THEN 1 END AS tier FROM ({_ATTEMPTS}))
SELECT rid, event_id, tier, 'case:1,skill:2' AS cards FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY tier DESC, attempt_no DESC, event_id) AS r FROM h WHERE tier IS NOT NULL) WHERE r = 1"""
)
def folded_attempts(t):
    """For each request the best attempt: healthy, else permanent, else retryable; the last of its kind."""
    tier = F.when(_healthy(), 3).when(F.col("status") == "permanent_failure", 2).when(F.col("status") == "retryable_error", 1)
    rows = _attempts(t).withColumn("tier", tier).filter("tier is not null")
    keys = F.concat_ws(",", F.concat_ws(":", F.lit("case"), F.lit(1)), F.concat_ws(":", F.lit("skill"), F.lit(2)))
    return W.first_per_key(rows, ["rid"], [F.desc("tier"), F.desc("attempt_no"), F.col("event_id")]).select("rid", "event_id", "tier", keys.alias("cards"))


@R.query(f"WITH a AS (SELECT rid, count(*) FILTER (WHERE {_HEALTHY}) AS healthy, max(attempt_no) AS last FROM ({_ATTEMPTS}) GROUP BY rid), q AS (SELECT user_id AS rid, count(*) FILTER (WHERE event_type = 'click') AS candidates, bool_or(event_type = 'purchase') AS hit FROM events GROUP BY user_id) SELECT q.rid, q.hit AND q.candidates > 0 AS eligible, q.candidates, a.healthy, a.last FROM q LEFT JOIN a USING (rid)")
def view_enrichment(t):
    """A row for each request with what its attempts add; what isn't there stays null."""
    q = t.events.groupBy(F.col("user_id").alias("rid")).agg(F.count_if(F.col("event_type") == "click").alias("candidates"), F.bool_or(F.col("event_type") == "purchase").alias("hit"))
    a = _attempts(t).groupBy("rid").agg(F.count_if(_healthy()).alias("healthy"), F.max("attempt_no").alias("last"))
    return q.join(a, "rid", "left").select("rid", (F.col("hit") & (F.col("candidates") > 0)).alias("eligible"), "candidates", "healthy", "last")


@R.query("SELECT kind, http, CASE WHEN kind IN ('error', 'signup') THEN 'bad_response' WHEN kind = 'click' THEN 'http_error' WHEN kind = 'view' THEN 'timeout' ELSE 'internal' END AS code, CASE WHEN kind = 'click' THEN http BETWEEN 500 AND 599 ELSE kind = 'view' END AS retryable, count(*) AS n FROM (SELECT event_type AS kind, 200 + event_id % 5 * 100 AS http FROM events) GROUP BY ALL")
def failure_matrix(t):
    """A bad or redirected answer isn't tried again, a server's error and a timeout are, anything else is ours."""
    kind, http = F.col("kind"), F.col("http")
    rows = t.events.select(F.col("event_type").alias("kind"), (200 + F.col("event_id") % 5 * 100).alias("http"))
    code = F.when(kind.isin("error", "signup"), "bad_response").when(kind == "click", "http_error").when(kind == "view", "timeout").otherwise("internal")
    return rows.groupBy("kind", "http").agg(F.count("*").alias("n")).select("kind", "http", code.alias("code"), F.when(kind == "click", http.between(500, 599)).otherwise(kind == "view").alias("retryable"), "n")


_SPEC = "'prod:case=task_intent+\\n+approach|cap=' || least(512, 600 - 100, 8192) || '|tokenizer=words@1'"


@R.query(
    f"""SELECT doc_id, sha256({_SPEC}) AS spec, sha256(concat_ws(chr(31), substr(text, 1, 200), source, lang)) AS payload_sha, sha256(array_to_string(string_split(source || ' ' || regexp_replace(trim(text), '\\s+', ' ', 'g'), ' ')[1:40], ' ')) AS passage_sha, length(string_split(source || ' ' || regexp_replace(trim(text), '\\s+', ' ', 'g'), ' ')) > 40 AS cut,
regexp_full_match(sha256(source), '[0-9a-f]{{64}}') AND NOT regexp_full_match(source, '[0-9a-f]{{64}}') AS formed FROM documents WHERE text IS NOT NULL"""
)
def dual_snapshot(t):
    """A candidate twice: its payload and the passage that is scored, cut at a number of tokens, each with its digest."""
    words = F.split(F.concat_ws(" ", "source", F.regexp_replace(F.trim("text"), r"\s+", " ")), " ")
    cap = F.least(F.lit(512), F.lit(600) - F.lit(100), F.lit(8192))
    spec = F.concat(F.lit("prod:case=task_intent+\\n+approach|cap="), cap.cast("string"), F.lit("|tokenizer=words@1"))
    formed = F.sha2("source", 256).rlike("^[0-9a-f]{64}$") & ~F.col("source").rlike("^[0-9a-f]{64}$")
    payload = F.concat_ws("\x1f", F.substring("text", 1, 200), "source", "lang")
    return t.documents.filter("text is not null").select("doc_id", F.sha2(spec, 256).alias("spec"), F.sha2(payload, 256).alias("payload_sha"), F.sha2(F.array_join(F.slice(words, 1, 40), " "), 256).alias("passage_sha"), (F.size(words) > 40).alias("cut"), formed.alias("formed"))


@R.query(
    f"""WITH b AS (SELECT qid, min(doc_id) FILTER (WHERE relevant) AS good, min(doc_id) FILTER (WHERE NOT relevant) AS bad FROM ({CARDS}) GROUP BY qid), p AS (SELECT b.qid, g.score AS g, x.score AS x, g.score + CASE WHEN b.qid % 4 = 0 THEN 0.01 ELSE 1e-7 END AS again FROM b JOIN ({CARDS}) g ON g.doc_id = b.good LEFT JOIN ({CARDS}) x ON x.doc_id = b.bad)
SELECT qid, x IS NULL AS no_pair, abs(again - g) <= 1e-6 AS consistent, coalesce(g > x, false) AS ordered FROM p"""
)
def known_controls(t):
    """For each query its first relevant card and first other one: scored alone as in a batch within a tolerance, and in order."""
    cards = _cards(t)
    pair = cards.groupBy("qid").agg(F.min_by("score", F.when(F.col("relevant"), F.col("doc_id"))).alias("g"), F.min_by("score", F.when(~F.col("relevant"), F.col("doc_id"))).alias("x"), F.bool_or("relevant").alias("any"))
    again = F.col("g") + F.when(F.col("qid") % 4 == 0, 0.01).otherwise(1e-7)
    return pair.filter("any").select("qid", F.col("x").isNull().alias("no_pair"), (F.abs(again - F.col("g")) <= 1e-6).alias("consistent"), F.coalesce(F.col("g") > F.col("x"), F.lit(False)).alias("ordered"))


@R.query(f"SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS without_gold, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 10 <> 0)) AS without_card, (SELECT count(*) FROM (SELECT DISTINCT qid FROM ({CARDS}) EXCEPT SELECT qid FROM ({CARDS}) WHERE useful)) AS outside")
def candidate_closure(t):
    """What is on one side only: cards without a judgement, judgements without a card, queries outside of a subset."""
    docs, labels = t.documents.select("doc_id"), t.labels.select("doc_id")
    cards = _cards(t)
    outside = cards.select("qid").distinct().join(cards.filter("useful").select("qid"), "qid", "left_anti")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    one = count(docs.join(labels, "doc_id", "left_anti"), "without_gold").crossJoin(count(labels.join(docs.filter("doc_id % 10 <> 0"), "doc_id", "left_anti"), "without_card"))
    return one.crossJoin(count(outside, "outside"))  # one row by one row


@R.query(f"SELECT qid, list_sort(list(DISTINCT doc_id)) = list_sort(list(DISTINCT CASE WHEN excluded AND qid % 3 = 0 THEN -1 ELSE doc_id END)) AS same, count(*) FILTER (WHERE excluded) AS excluded FROM ({CARDS}) GROUP BY qid")
def key_sets(t):
    """Equality of two sets of keys without gathering them: each key's sides are compared, then counted."""
    rows = _cards(t).withColumn("other", F.when(F.col("excluded") & (F.col("qid") % 3 == 0), F.lit(-1)).otherwise(F.col("doc_id")))
    sides = rows.select("qid", F.explode(F.array(F.struct(F.col("doc_id").alias("k"), F.lit(1).alias("s")), F.struct(F.col("other").alias("k"), F.lit(2).alias("s")))).alias("x")).groupBy("qid", "x.k").agg(F.countDistinct("x.s").alias("s"))
    same = sides.groupBy("qid").agg(F.bool_and(F.col("s") == 2).alias("same"))
    return same.join(_cards(t).groupBy("qid").agg(F.count_if("excluded").alias("excluded")), "qid").select("qid", "same", "excluded")


@R.query(
    """WITH s AS (SELECT lang, count(*) AS pop FROM documents GROUP BY lang), q AS (SELECT lang, least(pop, 3 + CAST(floor(40.0 * pop / sum(pop) OVER ()) AS BIGINT)) AS quota FROM s),
r AS (SELECT d.lang, d.doc_id, q.quota, row_number() OVER (PARTITION BY d.lang ORDER BY sha256(d.lang || '|' || d.doc_id)) AS draw FROM documents d JOIN q USING (lang)) SELECT lang || '|' || CASE WHEN n < 5 THEN '<5' WHEN n < 50 THEN '5-49' ELSE '50+' END AS stratum, count(*) AS drawn, CAST(sum(n) AS BIGINT) AS entries FROM
(SELECT r.lang, r.doc_id, (SELECT count(*) FROM labels l WHERE l.doc_id <= r.doc_id AND l.doc_id > r.doc_id - 10) AS n FROM r WHERE draw <= quota) GROUP BY 1"""
)
def sampling_pipeline(t):
    """Strata, quotas, a draw by hash, and what stands around each drawn row, in one plan."""
    pop = t.documents.groupBy("lang").agg(F.count("*").alias("pop"))
    quota = pop.select("lang", F.least("pop", 3 + F.floor(40.0 * F.col("pop") / F.sum("pop").over(Window.partitionBy()))).alias("quota"))
    draw = F.row_number().over(Window.partitionBy("lang").orderBy(F.sha2(F.concat_ws("|", "lang", "doc_id"), 256)))
    drawn = t.documents.select("lang", "doc_id").join(F.broadcast(quota), "lang").withColumn("draw", draw).filter("draw <= quota")
    near = drawn.withColumn("l", F.explode(F.sequence(F.col("doc_id") - 9, F.col("doc_id")))).join(t.labels.select(F.col("doc_id").alias("l")), "l", "left_semi")
    n = drawn.join(near.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    stratum = F.concat_ws("|", "lang", F.when(F.col("n") < 5, "<5").when(F.col("n") < 50, "5-49").otherwise("50+"))
    return n.groupBy(stratum.alias("stratum")).agg(F.count("*").alias("drawn"), F.sum("n").alias("entries"))


@R.query(f"SELECT source, '| ' || source || ' | ' || n || ' | ' || CASE WHEN k = 0 THEN 'n/a' ELSE CAST(CAST(100 * k // n AS BIGINT) AS VARCHAR) || '%' END || ' |' AS line FROM (SELECT source, count(*) AS n, count(*) FILTER (WHERE useful) AS k FROM ({CARDS}) GROUP BY source)")
def report_lines(t):
    """A report's rows as Markdown, with n/a where there is nothing to say."""
    s = _cards(t).groupBy("source").agg(F.count("*").alias("n"), F.count_if("useful").alias("k"))
    share = F.concat(F.floor(100 * F.col("k") / F.col("n")).cast("string"), F.lit("%"))
    return s.select("source", F.concat(F.lit("| "), "source", F.lit(" | "), F.col("n").cast("string"), F.lit(" | "), F.when(F.col("k") > 0, share).otherwise("n/a"), F.lit(" |")).alias("line"))


@R.query("WITH e AS (SELECT user_id, min(epoch_us(ts)) AS first, max(epoch_us(ts)) AS last, count(*) FILTER (WHERE event_type = 'click') AS reads, CASE WHEN user_id % 4 = 0 THEN NULL ELSE min(epoch_us(ts)) + CASE WHEN user_id % 4 = 1 THEN 1000000 ELSE -86400000000 * (user_id % 40) END END AS launched FROM events GROUP BY user_id) SELECT user_id, CASE WHEN launched IS NULL THEN 'corrupt' WHEN launched > first THEN 'corrupt' WHEN last - launched >= 2592000000000 OR reads >= 20 THEN 'due' ELSE 'ok' END AS state FROM e")
def checkpoint_guard(t):
    """A launch that is missing or later than the first row is corrupt; else time or queries make a review due."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = t.events.groupBy("user_id").agg(F.min(us).alias("first"), F.max(us).alias("last"), F.count_if(F.col("event_type") == "click").alias("reads"))
    launched = F.when(F.col("user_id") % 4 == 1, F.col("first") + 1000000).when(F.col("user_id") % 4 != 0, F.col("first") - 86400000000 * (F.col("user_id") % 40))
    return e.select("user_id", F.when(launched.isNull() | (launched > F.col("first")), "corrupt").when((F.col("last") - launched >= 2592000000000) | (F.col("reads") >= 20), "due").otherwise("ok").alias("state"))


@R.query("SELECT decision, count(*) AS n, count(*) FILTER (WHERE decision IN ('continue', 'calibrate', 'stop') AND trim(author) <> '') AS accepted FROM (SELECT CASE event_type WHEN 'click' THEN 'continue' WHEN 'view' THEN 'calibrate' WHEN 'error' THEN 'stop' ELSE 'maybe' END AS decision, CASE WHEN user_id % 6 = 0 THEN '  ' ELSE 'u' || user_id END AS author FROM events) GROUP BY decision")
def review_domain(t):
    """A review counts with a decision out of three and an author."""
    decision = F.when(F.col("event_type") == "click", "continue").when(F.col("event_type") == "view", "calibrate").when(F.col("event_type") == "error", "stop").otherwise("maybe")
    author = F.when(F.col("user_id") % 6 == 0, "  ").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string")))
    rows = t.events.select(decision.alias("decision"), author.alias("author"))
    return rows.groupBy("decision").agg(F.count("*").alias("n"), F.count_if(F.col("decision").isin("continue", "calibrate", "stop") & (F.trim("author") != "")).alias("accepted"))
