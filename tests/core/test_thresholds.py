"""Pairs of thresholds beside a walk over every pair."""

import random
from fractions import Fraction

from pyspark.sql import functions as F

from memlake.operators import thresholds as O

SCHEMA = "qid int, kind string, score double, place bigint, relevant boolean, useful boolean, excluded boolean"


def walked(cards, limit):
    grid = {}
    for kind in ("a", "b"):
        v = sorted({c[2] for c in cards if c[1] == kind})
        grid[kind] = [v[0] - 1, *((x + y) / 2 for x, y in zip(v, v[1:], strict=False)), v[-1] + 1]
    queries = {q: sorted((c for c in cards if c[0] == q), key=lambda c: c[3]) for q in {c[0] for c in cards}}
    covered = {q for q, cs in queries.items() if any(c[4] for c in cs)}
    uses = {q for q, cs in queries.items() if any(c[5] for c in cs)}
    rate = lambda a, b, none: float(Fraction(a) / b) if b else none
    out = {}
    for ta in grid["a"]:
        for tb in grid["b"]:
            shown = {q: [c for c in cs if c[2] >= (ta if c[1] == "a" else tb)][:limit] for q, cs in queries.items()}
            fdr = {q: Fraction(0) if not s else Fraction(1) if all(c[6] for c in s) else Fraction(sum(c[6] or not c[4] for c in s), len(s)) for q, s in shown.items()}
            total, some = sum(fdr[q] for q in covered), sum(bool(shown[q]) for q in covered)
            four = (
                rate(sum(not shown[q] for q in queries.keys() - covered), len(queries) - len(covered), 1.0), rate(sum(any(c[5] for c in shown[q]) for q in uses), len(uses), 1.0) - 0.5,
                0.95 - rate(total, len(covered), 0.0), 0.95 - rate(total, some, 0.0),
            )
            out[ta, tb] = tuple(round(x, 9) for x in four)
    good = [(min(v), *k) for k, v in out.items() if min(v) >= 0]
    return out, max(good)[1:] if good else None


def test_pairs_equal_a_walk(spark):
    for seed, limit in ((1, 5), (2, 2), (3, 3)):
        rng = random.Random(seed)
        cards = [(q, rng.choice("ab"), rng.randrange(12) / 12, p, rng.random() < 0.8, rng.random() < 0.5, rng.random() < 0.1) for q in range(25) for p in range(rng.randrange(1, 9))]
        cards += [(99, "a", 0.5, 0, False, False, True), (98, "b", 0.25, 0, False, False, False)]
        want, best = walked(cards, limit)
        got = O.pair_slacks(spark.createDataFrame(cards, SCHEMA), "a", limit).collect()
        assert {(r.theta_case, r.theta_skill): (r.abstain_slack, r.useful_slack, r.fdr_slack, r.shown_fdr_slack) for r in got} == want
        assert [(r.theta_case, r.theta_skill) for r in got if r.chosen] == ([best] if best else [])


def test_no_cards(spark):
    assert O.pair_slacks(spark.createDataFrame([], SCHEMA), "a").collect() == []


def test_all_scores_as_thresholds(spark):
    rng = random.Random(7)
    cards = [(q, rng.choice("ab"), rng.random() if q % 2 else rng.randrange(6) / 6, p, rng.random() < 0.6, rng.random() < 0.4, rng.random() < 0.2) for q in range(40) for p in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(cards, SCHEMA)
    thetas = sorted({c[2] for c in cards})
    curve = {r.threshold: (r.tp, r.fp, r.fn) for r in O.sweep_all(df, "score", F.col("relevant")).collect()}
    assert curve == {t: (sum(c[4] and c[2] >= t for c in cards), sum(not c[4] and c[2] >= t for c in cards), sum(c[4] and c[2] < t for c in cards)) for t in thetas}
    queries = {q: sorted((c for c in cards if c[0] == q), key=lambda c: c[3]) for q in {c[0] for c in cards}}
    want = {}
    for t in thetas:
        shown = {q: [c for c in cs if c[2] >= t][:3] for q, cs in queries.items()}
        covered = {q for q, cs in queries.items() if any(c[4] for c in cs)}
        fdr = sum(Fraction(0) if not s else Fraction(1) if all(c[6] for c in s) else Fraction(sum(c[6] or not c[4] for c in s), len(s)) for q, s in shown.items() if q in covered)
        want[t] = (sum(not s for q, s in shown.items() if q not in covered), sum(any(c[5] for c in s) for s in shown.values()), sum(bool(shown[q]) for q in covered), round(float(fdr), 9))
    assert {r.theta: (r.abstained, r.kept, r.shown, r.false_discovery) for r in O.floors_all(df, 3).collect()} == want
    assert O.floors_all(spark.createDataFrame([], SCHEMA)).collect() == [] and O.sweep_all(spark.createDataFrame([], SCHEMA), "score", F.col("relevant")).collect() == []
