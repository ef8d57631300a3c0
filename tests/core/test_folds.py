"""Folds over blocks beside the loop they stand for."""

import random

import numpy as np
from pyspark.sql import functions as F

from memlake.operators import folds
from memlake.operators import sessions as O
from memlake.operators import windows as W
from memlake.operators.folds import CLOSED, Block, passed


def loop(rows, cap, used=CLOSED):
    """Groups opened up to each row, and what is used at the end."""
    out, opened = [], 0
    for start, add, must, closes in rows:
        begins = must or used >= CLOSED or used + add > cap
        opened, used = opened + begins, start if begins else used + add
        used = CLOSED if closes else used
        out.append(opened)
    return out, used


def test_a_block_is_a_step_function():
    rng = random.Random(1)
    for _ in range(1500):
        cap, n = rng.randrange(1, 30), rng.randrange(1, 25)
        rows = [(rng.randrange(cap + 5), rng.randrange(cap + 3), rng.random() < 0.1, rng.random() < 0.1) for _ in range(n)]
        block = Block(*(np.array(c) for c in zip(*rows, strict=True)), cap)
        steps = block.steps()
        for used in [CLOSED, *range(cap + 8)]:
            groups, after = loop(rows, cap, used)
            assert list(block.groups(used)) == groups and passed(used, steps) == (groups[-1], after)


def test_groups_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(folds, "BLOCK", 16)
    rng = random.Random(2)
    rows = [(k, i, rng.randrange(30), rng.random() < 0.05, rng.random() < 0.05) for k in (None, 1, 2) for i in range(rng.choice([1, 40, 700]))] + [(7, i, 0, False, False) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, i int, n int, m boolean, c boolean")
    got = {(r.k, r.i): r.group for r in folds.greedy_groups(df, ["k"], ["i"], F.col("n"), F.col("n") + 1, F.col("m"), F.col("c"), 100).collect()}
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        groups, _ = loop([(n, n + 1, m, c) for _, _, n, m, c in own], 100)
        assert [got[k, r[1]] for r in own] == [g - 1 for g in groups]


def test_long_session_equals_the_loop(spark):
    """One session of 200,000 rows: chunks, preparation and merged orphans over many tasks."""
    n = 200_000
    rows = spark.range(0, n, 1, 8).selectExpr(
        "1L as conv_id", "id as turn", "case when hash(id) % 5 = 0 then 'user' when hash(id) % 5 = 1 then 'tool_result' else 'reasoning' end as role", "cast(null as string) as call_id",
        "repeat('x', cast(abs(hash(id, 7)) % 120 as int)) as content", "case when hash(id) % 7 = 0 then id * 3 else 0L end as ts",
    )
    held = rows.orderBy("turn").collect()
    chunks = {}
    used, chunk, big = 0, -1, True
    for r in held:
        size = len(r.content)
        new = size > 100 or big or used + size > 100
        chunk, used, big = chunk + new, (size if new else used + size), size > 100
        chunks[r.turn] = chunk
    got = W.chunked(rows, ["conv_id"], "turn", "content", 100, 10).select("turn", "chunk").distinct().collect()
    assert dict(map(tuple, got)) == chunks

    shaped = O.shaped(rows, F.lit("run")).join(rows.select("conv_id", "turn", "ts"), ["conv_id", "turn"])
    want, last = [], None
    for r in held:
        text = r.content if r.role == "user" else f"[{r.role}] {r.content}"
        if r.role != "user" and last and last[0] == "assistant" and len(last[1]) + 1 + len(text) <= 300:
            last[1] += "\n" + text
        else:
            last = ["user" if r.role == "user" else "assistant", text, r.role != "user", r.ts]
            want.append(last)
    keep = max(i for i, w in enumerate(want) if not w[2])
    now, times = 0, []
    for i, w in enumerate(want):
        now = max(now + 1, w[3] or 0)
        times.append(now if i <= keep else None)
    out = O.prepared(shaped, 300).orderBy("place").collect()
    assert [(r.place, r.role, r.content, r.held, r.unique_ts) for r in out] == [(i, w[0], w[1], i > keep, times[i]) for i, w in enumerate(want)]


def test_running_values_by_block(spark, monkeypatch):
    monkeypatch.setattr(folds, "BLOCK", 8)
    rng = random.Random(5)
    rows = [(k, i, rng.choice([None, rng.randrange(1000)])) for k in (None, 3) for i in range(90)] + [(4, 0, None)]
    df = spark.createDataFrame(rows, "k int, i int, v int")
    most = {(r.k, r.i): r.m for r in folds.with_running_max(df, ["k"], "i", F.col("v"), "m").collect()}
    last = {(r.k, r.i): r.m for r in folds.with_last(df, ["k"], "i", F.col("v"), "m").collect()}
    for k, i, _ in rows:
        own = [v for a, b, v in rows if a == k and b <= i and v is not None]
        assert most[k, i] == max(own, default=None)
        assert last[k, i] == max((v for a, _, v in rows if a == k and v is not None), default=None)
