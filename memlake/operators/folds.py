"""Folds over a key's rows in order without one task for a key: blocks are summed up as what they make of a state, the sums are folded."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from memlake.operators.integrity import cut

#: Rows of a block.
BLOCK = 4096
#: A state that nothing may join.
CLOSED = 1 << 62


def in_blocks(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with `_at`, which rises with (keys, order), and `_block`: at most BLOCK rows that follow one another.

    Dealt out by range, so a long key lies in many tasks; cut off, so that `_at` stays what it is.
    """
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    return cut(dealt.withColumn("_block", F.floor(F.col("_at") / BLOCK)))  # a task's numbers begin at a multiple of 2**33


class Block:
    """What a block of rows makes of the room used before it, for groups filled greedily up to a capacity.

    A row is (start, add, must, closes): what it uses as the first of a group and what it adds to one, whether it must begin a
    group, and whether nothing may follow it there. The less is used before the block, the later its first group begins; from
    there on all is settled. So the block is a step function: where the first group may begin, what comes of it.
    """

    def __init__(self, start: np.ndarray, add: np.ndarray, must: np.ndarray, closes: np.ndarray, cap: int):
        n = len(start)
        self.added = np.cumsum(add)
        forced = np.full(n + 1, n)  # the first row from i on that begins a group whatever was before, if the group began before i
        after = np.concatenate([[False], closes[:-1]]) if n else closes
        for i in range(n - 1, -1, -1):
            forced[i] = i if must[i] or after[i] else forced[i + 1]
        full = np.searchsorted(self.added, cap - start + self.added, "right") if n else np.zeros(0, int)
        self.next = np.minimum(np.maximum(full, np.arange(1, n + 1)), forced[1:]) if n else full  # where the group after the one that begins at i begins
        self.opened, self.used = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i in range(n - 1, -1, -1):
            j = self.next[i]
            if j < n:
                self.opened[i], self.used[i] = 1 + self.opened[j], self.used[j]
            else:
                self.opened[i] = 1
                self.used[i] = CLOSED if closes[i:].any() else start[i] + self.added[-1] - self.added[i]
        own = np.flatnonzero(must)
        shut = np.flatnonzero(closes)
        self.first = int(min(own[0] if len(own) else n, shut[0] + 1 if len(shut) else n))  # the latest place of the first group's beginning
        self.cap, self.n, self.shut = cap, n, bool(len(shut))

    def begins(self, used: int) -> int:
        """Where the first group begins if so much is used before."""
        if used >= CLOSED:
            return 0
        return min(int(np.searchsorted(self.added, self.cap - used, "right")), self.first)

    def steps(self) -> dict:
        """limits (rising) of what is used before, with the groups opened and what is used after; beyond the last limit the first row begins.

        `total` is what a block without beginnings adds; `passes` the most that may be used before it for that.
        """
        limits, opened, after = [], [], []
        for j in range(min(self.first, self.n), -1, -1):
            if j == self.n:
                continue  # no beginning: passes
            most = self.cap - (self.added[j - 1] if j else -CLOSED)  # up to here the rows before j still fit
            least = self.cap - self.added[j] if j < self.first else -1  # and from here on row j doesn't
            if most <= least:
                continue
            if opened and (opened[-1], after[-1]) == (int(self.opened[j]), int(self.used[j])):
                limits[-1] = int(min(most, CLOSED))
            else:
                limits.append(int(min(most, CLOSED)))
                opened.append(int(self.opened[j]))
                after.append(int(self.used[j]))
        whole = self.first == self.n
        return {"limits": limits, "opened": opened, "after": after, "passes": int(self.cap - self.added[-1]) if whole and self.n else -1, "total": CLOSED if self.shut else int(self.added[-1]) if self.n else 0}

    def groups(self, used: int) -> np.ndarray:
        """For each row how many groups have begun in the block up to it."""
        out = np.zeros(self.n, np.int64)
        i = self.begins(used)
        while i < self.n:
            out[i] = 1
            i = int(self.next[i])
        return np.cumsum(out)


def passed(used: int, step: dict) -> tuple[int, int]:
    """Groups opened and what is used after a block, by its steps."""
    if used <= step["passes"]:
        return 0, min(used + step["total"], CLOSED)
    k = bisect_right(step["limits"], used - 1)
    return step["opened"][k], step["after"][k]


def _runs(t: pa.Table, names: list[str], cap: int) -> Iterator[tuple[pa.Table, Block]]:
    """A block's rows in order, each key's apart: they stand together."""
    t = t.sort_by("_at")
    keys = list(zip(*(t[c].to_pylist() for c in names), strict=True))
    at = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
    for i, j in zip(at, at[1:], strict=False):
        part = t.slice(i, j - i)
        yield part, Block(*(part[c].to_numpy() for c in ("_start", "_add", "_must", "_closes")), cap)


def greedy_groups(rows: DataFrame, keys: list[str], order: list[str], start: Column, add: Column, must: Column, closes: Column, cap: int, out: str = "group") -> DataFrame:
    """rows with each one's group, numbered from 0 within its key: a row joins the group before it unless it must begin one, that
    group is closed, or what is used and what it adds exceed `cap`. `_at` rises with keys and order.

    A key's rows in a block are summed up by Block.steps; the sums of a key that reaches over several blocks are folded in one task and give each
    block the state before it; then blocks are numbered apart. Python gets numbers only, a block of rows at a time.
    """
    whole = rows.withColumns({"_start": start.cast("long"), "_add": add.cast("long"), "_must": must, "_closes": closes})
    blocks = in_blocks(whole, keys, order)
    names = [f"_k{i}" for i in range(len(keys))]
    lean = blocks.select(*[F.col(k).alias(n) for n, k in zip(names, keys, strict=True)], "_at", "_block", "_start", "_add", "_must", "_closes")
    kinds = [lean.schema[c] for c in (*names, "_block")]
    sums = StructType([*kinds, *StructType.fromDDL("limits array<bigint>, opened array<bigint>, after array<bigint>, passes bigint, total bigint").fields])
    states = StructType([*kinds, *StructType.fromDDL("_used bigint, _before bigint").fields])
    lists, number = pa.list_(pa.int64()), pa.int64()

    def summed(t: pa.Table) -> pa.Table:
        found = [(part.slice(0, 1).select([*names, "_block"]), block.steps()) for part, block in _runs(t, names, cap)]
        made = pa.concat_tables([head for head, _ in found])
        for name, kind in (("limits", lists), ("opened", lists), ("after", lists), ("passes", number), ("total", number)):
            made = made.append_column(name, pa.array([step[name] for _, step in found], kind))
        return made

    def folded(t: pa.Table) -> pa.Table:
        t = t.sort_by("_block")
        used, before, seen = CLOSED, 0, ([], [])
        for step in t.select(["limits", "opened", "after", "passes", "total"]).to_pylist():
            seen[0].append(used)
            seen[1].append(before)
            opened, used = passed(used, step)
            before += opened
        return t.select([*names, "_block"]).append_column("_used", pa.array(seen[0], number)).append_column("_before", pa.array(seen[1], number))

    def numbered(t: pa.Table) -> pa.Table:
        found = [(part["_at"], block.groups(part["_used"][0].as_py()) + part["_before"][0].as_py() - 1) for part, block in _runs(t, names, cap)]
        return pa.table({"_at": pa.chunked_array([c for at, _ in found for c in at.chunks], number), out: pa.array(np.concatenate([g for _, g in found]), number)})

    steps = cut(lean.groupBy("_block").applyInArrow(summed, sums))
    many = steps.groupBy(*[F.col(n).alias(f"_m{n}") for n in names]).agg(F.count("*").alias("_blocks")).filter("_blocks > 1")
    of_many = steps.join(many, reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"_m{n}")) for n in names]), "left_semi")
    entries = cut(of_many.groupBy(*names).applyInArrow(folded, states)).select(*[F.col(k).alias(f"_e{k}") for k in names], F.col("_block").alias("_e_block"), "_used", "_before")
    same = [F.col(k).eqNullSafe(F.col(f"_e{k}")) for k in names] + [F.col("_block") == F.col("_e_block")]
    begun = lean.join(entries, on=same, how="left").select(*lean.columns, F.coalesce("_used", F.lit(CLOSED)).alias("_used"), F.coalesce("_before", F.lit(0).cast("long")).alias("_before"))
    groups = begun.groupBy("_block").applyInArrow(numbered, f"_at bigint, `{out}` bigint")
    return blocks.drop("_start", "_add", "_must", "_closes", "_block").join(groups, "_at")


def with_running_max(rows: DataFrame, keys: list[str], place: str, value: Column, out: str) -> DataFrame:
    """The greatest value up to each row, in order of a place that counts from 0 within each key: blocks first, then within them."""
    block = F.floor(F.col(place) / BLOCK)
    rows = rows.withColumns({"_block": block, "_value": value})
    sums = rows.groupBy(*keys, "_block").agg(F.max("_value").alias("_most"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_b"), F.max("_most").over(earlier).alias("_before"))
    upto = Window.partitionBy(*keys, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_block") == F.col("_b")]
    joined = rows.join(sums, on=same, how="inner").withColumn(out, F.greatest(F.max("_value").over(upto), F.col("_before")))  # greatest passes over nulls
    return joined.drop("_block", "_value", "_b", "_before", *[f"_k_{k}" for k in keys])


def with_last(rows: DataFrame, keys: list[str], place: str, value: Column, out: str) -> DataFrame:
    """The greatest value of each row's key, joined back block by block, so that a long key isn't one task."""
    rows = rows.withColumns({"_block": F.floor(F.col(place) / BLOCK), "_value": value})
    sums = rows.groupBy(*keys, "_block").agg(F.max("_value").alias("_most"))
    sums = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_b"), F.max("_most").over(Window.partitionBy(*keys)).alias(out))  # a row a block
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_block") == F.col("_b")]
    return rows.join(sums, on=same, how="inner").drop("_block", "_value", "_b", *[f"_k_{k}" for k in keys])
