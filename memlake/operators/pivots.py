"""Exact nearest rows by cosine with pivots: blocks around pivots are skipped where the triangle inequality rules a neighbour out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.integrity import cut
from memlake.operators.joins import joined_small

#: Pivots at most (they go through the driver), rows of a part of a block, queries that meet it at once.
PIVOTS, ROWS, QUERIES = 64, 20_000, 2048
#: Scores are compared to nine places; what that means for a squared distance, and for rounding.
SLACK, ROUNDING = 4e-9, 1e-7


def _matrix(t: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    """Unit vectors of equal length from a list column, without a Python list."""
    column = t[name].combine_chunks() if isinstance(t, pa.Table) else t.column(name)
    m = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _assigned(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """id, n, v, `far` (distances to the pivots of that length), pivot (the nearest one; -1 if there is none) and near (its distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("n").to_numpy()
            for n in np.unique(lengths):
                part = batch.filter(pa.array(lengths == n))
                if int(n) in centres:
                    far = np.sqrt(np.maximum(0.0, 2 - 2 * _matrix(part, "v") @ centres[int(n)].T))
                    pivot = far.argmin(axis=1)
                    near = far[np.arange(len(far)), pivot]
                else:
                    far, pivot, near = np.zeros((part.num_rows, 0)), np.full(part.num_rows, -1), np.zeros(part.num_rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(far) + 1) * far.shape[1], pa.int32()), pa.array(far.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n"), part.column("v"), lists, pa.array(pivot, pa.int32()), pa.array(near)], names=["id", "n", "v", "far", "pivot", "near"])

    return rows.select("id", "n", "v").mapInArrow(run, "id bigint, n int, v array<double>, far array<double>, pivot int, near double")


def _met(pairs: DataFrame, queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """query_id, id, score of the k best rows of each part of a block for each query that is paired with the block.

    A block's rows move once for each QUERIES queries that visit it.
    """
    asks = pairs.join(queries.select("id", "v"), "id").select("n", "pivot", "parts", "turns", "id", "v")
    asks = asks.withColumn("turn", F.pmod(F.xxhash64("id"), "turns").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    visits = pairs.select("n", "pivot", "turns").distinct()
    cards = blocks.join(visits, ["n", "pivot"]).select("n", "pivot", "part", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "id", "v")

    def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "id": [], "score": []}
        if mine.num_rows and theirs.num_rows:
            ids, asked = theirs["c_id"].to_numpy(), mine["q_id"].to_numpy()
            score = np.round(_matrix(mine, "q_v") @ _matrix(theirs, "c_v").T, 9)
            for q, row in zip(asked, score, strict=True):
                row[ids == q] = -np.inf
                few = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
                best = few[np.lexsort((ids[few], -row[few]))][:k]
                best = best[row[best] > -np.inf]
                out["query_id"].append(np.full(len(best), q))
                out["id"].append(ids[best])
                out["score"].append(row[best])
        kinds = {"query_id": pa.int64(), "id": pa.int64(), "score": pa.float64()}
        return pa.table({c: pa.array(np.concatenate(v) if v else [], kinds[c]) for c, v in out.items()})

    keys = ("n", "pivot", "part", "turn")
    left, right = (df.select(*[F.col(c).alias(f"{side}_{c}") for c in (*keys, "id", "v")]).groupBy(*[f"{side}_{c}" for c in keys]) for df, side in ((asks, "q"), (cards, "c")))
    return left.cogroup(right).applyInArrow(meet, "query_id bigint, id bigint, score double")


def nearest_rows(vectors: DataFrame, key: str, vec: str, asked: Column, k: int, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """(query_id, key, place) of the k nearest rows by cosine of each asked row, exactly, ties to the smaller key; and (query_id, read, blocks):
    how many blocks each query read, of how many.

    Each row belongs to the block of its nearest pivot, of `pivots` rows drawn by hash; a block knows how near and how far its rows
    are. A query reads its nearest blocks that hold more than k rows; the k-th distance found there bounds what any other block must
    be able to hold, and only those that may are read. `asked` is a condition on id. Rows without an id and vectors that are null,
    zero or not finite take no part; vectors of different lengths never meet, a length without a pivot is one block. Ids are unique.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.transform(vec, lambda x: x.cast("double")).alias("v")).filter("id is not null and size(v) > 0")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)).withColumn("n", F.size("v"))
    drawn: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id").limit(pivots).collect():
        drawn.setdefault(r.n, []).append(np.array(r.v) / np.linalg.norm(r.v))
    placed = cut(_assigned(rows, {n: np.array(v) for n, v in drawn.items()}))
    queries = placed.filter(asked)
    blocks = cut(placed.groupBy("n", "pivot").agg(F.count("*").alias("rows"), F.min("near").alias("lo"), F.max("near").alias("hi")).withColumn("parts", F.ceil(F.col("rows") / ROWS).cast("int")))
    small = blocks.select(F.col("n").alias("_n"), F.col("pivot").alias("_pivot"), "parts")
    cards = joined_small(placed.select("id", "n", "v", "pivot"), small, (F.col("n") == F.col("_n")) & (F.col("pivot") == F.col("_pivot")), blocks.count() * 64)
    cards = cards.withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).select("n", "pivot", "part", "id", "v")

    of_length = blocks.groupBy(F.col("n").alias("_n")).agg(F.collect_list(F.struct("pivot", "rows", "lo", "hi", "parts")).alias("_b"))  # at most `pivots` to a length
    pairs = joined_small(queries.select("id", "n", "far"), of_length, F.col("n") == F.col("_n"), blocks.count() * 128).select("id", "n", "far", F.explode("_b").alias("b")).select("id", "n", "far", "b.*")
    to_pivot = F.when(F.col("pivot") >= 0, F.get("far", F.col("pivot")))
    pairs = pairs.withColumn("least", F.when(F.col("pivot") < 0, 0.0).otherwise(F.greatest(F.lit(0.0), to_pivot - F.col("hi"), F.col("lo") - to_pivot))).drop("far", "lo", "hi")
    before = Window.partitionBy("id").orderBy("least", "pivot").rowsBetween(Window.unboundedPreceding, -1)
    pairs = cut(pairs.withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0)) <= k))  # more than k rows: one may be the query itself

    def turned(p: DataFrame) -> DataFrame:
        turns = p.groupBy("n", "pivot").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("turns"))
        return p.join(turns, ["n", "pivot"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    top = lambda found: found.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= k)
    near = cut(top(_met(turned(pairs.filter("first")), queries, cards, k)))
    bound = near.filter(F.col("place") == k).select(F.col("query_id").alias("id"), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score")) + SLACK).alias("most"))
    rest = cut(pairs.filter(~F.col("first")).join(bound, "id", "left").filter(F.col("most").isNull() | (F.col("least") <= F.col("most") + ROUNDING)).drop("most"))
    found = top(near.drop("place").unionByName(_met(turned(rest), queries, cards, k))).select("query_id", F.col("id").alias(key), "place")
    read = pairs.filter("first").select("id").unionByName(rest.select("id")).groupBy("id").agg(F.count("*").alias("read"))
    visits = pairs.groupBy("id").agg(F.count("*").alias("blocks")).join(read, "id").select(F.col("id").alias("query_id"), "read", "blocks")
    return found, visits
