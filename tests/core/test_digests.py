"""The tree of digests beside one made anew, and how it is cut and descended."""

import hashlib
import random

from pyspark.sql import functions as F

from memlake.operators import digests as D


def small(monkeypatch):
    monkeypatch.setattr(D, "LEAF", 4)
    monkeypatch.setattr(D, "FAN", 3)


def frame(spark, rows):
    return spark.createDataFrame(rows, "k bigint, s string")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_cut_at_every_boundary(spark, monkeypatch):
    small(monkeypatch)
    rows = [(k, None if k % 7 == 0 else f"v{k}") for k in range(100) if k % 11 != 5]
    df, levels = frame(spark, rows), D.levels_for(99)
    tree = D.digest_tree(df, "k", ["k", "s"], levels).cache()
    got = {r.boundary: (r.n, r.digest) for r in D.prefix_digests(tree, df, "k", ["k", "s"], list(range(1, 110))).collect()}
    assert all(got[b][0] == sum(k < b for k, _ in rows) for b in got)
    digests = {}
    for b, (_, d) in got.items():
        digests.setdefault(tuple(r for r in rows if r[0] < b), set()).add(d)
    assert len({d for s in digests.values() for d in s}) >= len(digests)  # other rows, another digest
    leaf = lambda lo: sha("".join(sha(f"I{len(str(k))}:{k}" + ("N" if s is None else f"T{len(s)}:{s}")) for k, s in rows if lo <= k < lo + 4))
    assert got[8][1] == sha(f"0:{leaf(0)},4:{leaf(4)}") and got[12][1] == sha(f"0:{sha(f'0:{leaf(0)},1:{leaf(4)},2:{leaf(8)}')}")


def test_update_equals_a_new_tree(spark, monkeypatch):
    small(monkeypatch)
    rng = random.Random(1)
    rows = {k: f"v{k}" for k in range(200) if rng.random() < 0.9}
    levels = D.levels_for(220)
    before = D.digest_tree(frame(spark, list(rows.items())), "k", ["k", "s"], levels)
    after = dict(rows)
    changed = [3, 50, 51, 52, 53, 54, 55, 199, 210]
    for k in changed:
        after.pop(k, None) if 50 <= k <= 55 else after.update({k: "new"})
    df = frame(spark, list(after.items()))
    got = D.updated_tree(before, df, "k", ["k", "s"], frame(spark, [(k, "") for k in changed]), levels)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, D.digest_tree(df, "k", ["k", "s"], levels).collect()))


def test_descent_to_the_first_difference(spark, monkeypatch):
    small(monkeypatch)
    rows = {k: f"v{k}" for k in range(150)}
    ours, levels = frame(spark, list(rows.items())), D.levels_for(160)
    a = D.digest_tree(ours, "k", ["k", "s"], levels).cache()
    for change, k in (({77: "x", 140: "y"}, 77), ({0: "x"}, 0), ({155: "new"}, 155), ({}, None)):
        theirs = frame(spark, list((rows | change).items()))
        block = D.first_difference(a, D.digest_tree(theirs, "k", ["k", "s"], levels), levels)
        assert block == (None if k is None else (k // 4 * 4, k // 4 * 4 + 4))
        if block:
            row = D.first_differing_key(ours, theirs, "k", ["k", "s"], block).first()
            assert (row.k, row.change) == (k, "changed" if k in rows else "added")
    gone = ours.filter(F.col("k") != 10)
    assert D.first_differing_key(ours, gone, "k", ["k", "s"], D.first_difference(a, D.digest_tree(gone, "k", ["k", "s"], levels), levels)).first().change == "removed"


def test_only_the_cut_leaf_is_read(spark, tmp_path):
    spark.range(5000).select(F.col("id").alias("k"), F.lit("x").alias("s")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    tree = D.digest_tree(df, "k", ["k", "s"], D.levels_for(5000)).cache()
    out = D.prefix_digests(tree, df, "k", ["k", "s"], [1000])
    assert out.first().n == 1000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,768), LessThan(k,1000)" in plan.replace("PushedFilters: [IsNotNull(k), ", "")
