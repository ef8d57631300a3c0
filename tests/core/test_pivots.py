"""Exact nearest rows beside a full comparison, and how many blocks were read."""

import random

import numpy as np
from pyspark.sql import functions as F

from memlake.operators import pivots as P


def compared(rows, asked, k):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    out = set()
    for q in filter(asked, unit):
        near = sorted((-round(float(unit[q] @ u), 9), i) for i, u in unit.items() if i != q and len(u) == len(unit[q]))[:k]
        out |= {(q, i, place) for place, (_, i) in enumerate(near, 1)}
    return out


def test_equals_a_full_comparison(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS", 40)
    monkeypatch.setattr(P, "QUERIES", 7)
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in centres[i % 12]]) for i in range(500)] + [(1000 + i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(100)]
    rows += [(2000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(60)]  # equal vectors: ties by key
    rows += [(3000, None), (3001, []), (3002, [0.0] * 6), (3003, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (3004, [float("nan")] * 6), (None, [1.0] * 6), (3006, [1.0, 2.0]), (3007, [2.0, 1.0]), (3012, [3.0])]
    df = spark.createDataFrame(rows, "id bigint, e array<double>").withColumnRenamed("id", "vec_id")
    for pivots in (1, 16):
        found, visits = P.nearest_rows(df, "vec_id", "e", F.col("id") % 3 == 0, 5, pivots)
        assert {tuple(r) for r in found.collect()} == compared(rows, lambda i: i % 3 == 0, 5)
        assert all(1 <= r.read <= r.blocks for r in visits.collect())


def test_blocks_that_hold_no_neighbour_are_skipped(spark):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(30)]
    rows = [(i, [c + rng.gauss(0, 0.01) for c in centres[i % 30]]) for i in range(1500)]
    found, visits = P.nearest_rows(spark.createDataFrame(rows, "k bigint, e array<double>"), "k", "e", F.col("id") % 10 == 0, 5)
    assert {tuple(r) for r in found.collect()} == compared(rows, lambda i: i % 10 == 0, 5)
    read, blocks = visits.agg(F.sum("read"), F.sum("blocks")).first()
    assert read * 4 < blocks


def test_no_rows(spark):
    found, visits = P.nearest_rows(spark.createDataFrame([], "k bigint, e array<double>"), "k", "e", F.col("id") % 10 == 0, 5)
    assert found.collect() == [] and visits.collect() == []
