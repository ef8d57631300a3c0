"""Digests of a table in order of a whole-number key as a tree that is kept as a table: updated by block, cut at any boundary, descended to a difference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.operators.integrity import typed

#: Keys of a leaf and children of a node.
LEAF, FAN = 256, 16


def _rows_digest(rows: DataFrame, key: str, columns: list[str], by: list[str]) -> DataFrame:
    encoded = F.concat(*[typed(c, rows.schema[c].dataType.simpleString()) for c in columns])
    one = F.struct(F.col(key).alias("k"), F.sha2(encoded, 256).alias("e"))
    ordered = F.array_sort(F.collect_list(one))  # at most LEAF keys
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(ordered, lambda r: r["e"]), ""), 256).alias("digest"))


def _leaves(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return _rows_digest(rows.withColumn("node", F.floor(F.col(key) / LEAF)), key, columns, ["node"]).select(F.lit(0).alias("level"), "node", "n", "digest")


def _parents(nodes: DataFrame, level: int) -> DataFrame:
    """The nodes above: at most FAN children each, in order, with their places."""
    child = F.array_sort(F.collect_list(F.struct("node", "digest")))
    joined = F.array_join(F.transform(child, lambda c: F.concat(c["node"].cast("string"), F.lit(":"), c["digest"])), ",")
    return nodes.groupBy(F.floor(F.col("node") / FAN).alias("_up")).agg(F.sum("n").alias("n"), F.sha2(joined, 256).alias("digest")).select(F.lit(level).alias("level"), F.col("_up").alias("node"), "n", "digest")


def levels_for(last_key: int) -> int:
    """How many levels above the leaves it takes for one node to hold all keys from 0 on."""
    level, width = 0, LEAF
    while width <= last_key:
        level, width = level + 1, width * FAN
    return level


def digest_tree(rows: DataFrame, key: str, columns: list[str], levels: int) -> DataFrame:
    """level, node, n (rows), digest of rows with keys from 0 on, unique. Leaves hold LEAF keys each, a node above FAN nodes; empty ones have no row."""
    nodes = _leaves(rows, key, columns)
    each = [nodes]
    for level in range(1, levels + 1):
        each.append(_parents(each[-1], level))
    return reduce(DataFrame.unionByName, each)


def updated_tree(tree: DataFrame, rows: DataFrame, key: str, columns: list[str], changed: DataFrame, levels: int) -> DataFrame:
    """The tree after rows with the keys of `changed` were written: only their leaves are read again, and only nodes above these are made anew."""
    touched = changed.select(F.floor(F.col(key) / LEAF).alias("node")).distinct()
    near = rows.withColumn("_leaf", F.floor(F.col(key) / LEAF)).join(touched.select(F.col("node").alias("_leaf")), "_leaf", "left_semi").drop("_leaf")
    new, out = _leaves(near, key, columns), []
    for level in range(levels + 1):
        kept = tree.filter(F.col("level") == level).join(touched, "node", "left_anti").select("level", "node", "n", "digest")
        out += [kept, new]
        up = touched.select(F.floor(F.col("node") / FAN).alias("node")).distinct()
        siblings = kept.withColumn("_up", F.floor(F.col("node") / FAN)).join(up.select(F.col("node").alias("_up")), "_up", "left_semi").select("level", "node", "n", "digest")
        new, touched = _parents(siblings.unionByName(new), level + 1), up
    return reduce(DataFrame.unionByName, out)


def prefix_digests(tree: DataFrame, rows: DataFrame, key: str, columns: list[str], boundaries: list[int]) -> DataFrame:
    """boundary, n, digest of the rows with keys below each boundary: the widest nodes that lie below it, and the rows of the one leaf it cuts.

    Of the rows only those leaves are read; the filters on the key reach the scan.
    """
    width = F.lit(LEAF) * F.pow(F.lit(FAN), F.col("level")).cast("long")
    top = tree.agg(F.max("level")).first()[0] or 0
    at = F.explode(F.array(*[F.lit(b).cast("long") for b in boundaries])).alias("boundary")
    inside = (F.col("node") + 1) * width <= F.col("boundary")
    wider = (F.floor(F.col("node") / FAN) + 1) * width * FAN <= F.col("boundary")
    whole = tree.select("*", at).filter(inside & (~wider | (F.col("level") == top))).select("boundary", (F.col("node") * width).alias("start"), "n", "digest")
    ranges = [(b // LEAF * LEAF, b) for b in boundaries if b % LEAF]
    if ranges:
        near = rows.filter(reduce(Column.__or__, [(F.col(key) >= lo) & (F.col(key) < hi) for lo, hi in ranges]))
        cuts = F.explode(F.array(*[F.struct(F.lit(lo).cast("long").alias("start"), F.lit(hi).cast("long").alias("boundary")) for lo, hi in ranges]))
        near = near.select("*", cuts.alias("_c")).filter((F.col(key) >= F.col("_c.start")) & (F.col(key) < F.col("_c.boundary"))).select("*", F.col("_c.start").alias("start"), F.col("_c.boundary").alias("boundary"))
        whole = whole.unionByName(_rows_digest(near, key, columns, ["boundary", "start"]))
    parts = F.array_sort(F.collect_list(F.struct("start", "digest")))  # at most FAN nodes a level
    return whole.groupBy("boundary").agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(parts, lambda p: F.concat(p["start"].cast("string"), F.lit(":"), p["digest"])), ","), 256).alias("digest"))


def first_difference(ours: DataFrame, theirs: DataFrame, levels: int) -> tuple[int, int] | None:
    """The range of keys of the first leaf in which two trees differ, found from the top down: of each level only the children of one node are compared."""
    node = 0
    for level in range(levels, -1, -1):
        lo, hi = (0, 0) if level == levels else (node * FAN, node * FAN + FAN - 1)
        a, b = (t.filter((F.col("level") == level) & F.col("node").between(lo, hi)).select("node", F.col("digest").alias(name)) for t, name in ((ours, "a"), (theirs, "b")))
        found = a.join(b, "node", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).agg(F.min("node")).first()[0]
        if found is None:
            return None
        node = found
    return node * LEAF, (node + 1) * LEAF


def first_differing_key(ours: DataFrame, theirs: DataFrame, key: str, columns: list[str], block: tuple[int, int]) -> DataFrame:
    """key, change (added, removed, changed) of the first row that differs within a block of keys; only that block of either table is read."""
    encoded = lambda df: F.concat(*[typed(c, df.schema[c].dataType.simpleString()) for c in columns])
    a, b = (df.filter((F.col(key) >= block[0]) & (F.col(key) < block[1])).select(key, encoded(df).alias(name)) for df, name in ((ours, "_a"), (theirs, "_b")))
    differ = a.join(b, key, "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b")))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return differ.select(key, change.alias("change")).orderBy(key).limit(1)
