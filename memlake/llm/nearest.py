"""Approximate nearest neighbours by cross-polytope hashing.

Three rounds of random signs and a fast Hadamard transform rotate a unit vector; its hash is the nearest signed axis. A table
joins two such hashes: of the whole rotated vector, and of the first LAST coordinates of another rotation. A query probes,
in each table, the pairs of axes that cost least (squared distance lost), and every candidate found is scored exactly with
the original vectors in double precision. How many pairs is fitted on a bounded sample of the queries, whose true neighbours
come from comparing them with all rows. Equal vectors are one class and meet queries once.

Entries and probes meet by the first axis in numpy, in groups of bounded size: a bucket is cut by its measured numbers of
entries and of queries, and a group returns only its best few for each query, so no list of candidate pairs is ever made.
A query for which fewer than k are found is compared with all vectors in blocks, so small tables give all there is.

Vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a null id; vectors of
different lengths never meet. Rows that repeat an id are one row if the vectors are equal, else two candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.common import joined_small, over_texts, sliced, small_batches, written

TABLES, LAST = 8, 32
#: Entries, and queries, of a bucket that stand in one group, about.
GROUP_ROWS, GROUP_QUERIES = 8192, 4096
#: The number of probes is fitted on so many queries at most: their true neighbours are found by comparing them with all rows,
#: and this part of them must be reached.
SAMPLE, RECALL = 128, 0.97


def _fast_hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


@lru_cache(maxsize=64)
def _signs(table: int, part: int, size: int) -> np.ndarray:
    return np.random.default_rng((17, table, part, size)).choice([-1.0, 1.0], (3, size))


def rotated(x: np.ndarray, table: int, part: int) -> np.ndarray:
    """A pseudo-random rotation of unit vectors, padded to a power of two."""
    size = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    for signs in _signs(table, part, size):
        x = _fast_hadamard(x * signs)
    return x


def _axis(x: np.ndarray) -> np.ndarray:
    """The nearest signed axis: 2 i for axis i, 2 i + 1 for its opposite."""
    at = np.abs(x).argmax(1)
    return 2 * at + (x[np.arange(len(x)), at] < 0)


def codes(x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return _axis(rotated(unit, table, 0)), _axis(rotated(unit, table, 1)[:, :LAST])


def probes(x: np.ndarray, table: int, many: int) -> list[list[tuple[int, list[int]]]]:
    """For each vector the first axes to look at, each with the second axes wanted there."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    lost = []
    for part, r in ((0, rotated(unit, table, 0)), (1, rotated(unit, table, 1)[:, :LAST])):
        signed = np.stack([r, -r], 2).reshape(len(r), -1)  # value along axis 2 i and 2 i + 1
        lost.append((signed.max(1, keepdims=True) - signed) ** 2)
    out = []
    for a, b in zip(*lost, strict=True):
        first, second = np.argsort(a, kind="stable")[:many], np.argsort(b, kind="stable")[:many]
        cost = (a[first][:, None] + b[second][None]).ravel()
        chosen = np.argsort(cost, kind="stable")[:many]
        by: dict[int, list[int]] = {}
        for c in chosen:
            by.setdefault(int(first[c // len(second)]), []).append(int(second[c % len(second)]))
        out.append(list(by.items()))
    return out


def _vectors(values: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind).astype(np.float64).reshape(len(values), -1)


def _by_length(values: list[bytes]) -> Iterator[list[int]]:
    by: dict[int, list[int]] = {}
    for i, v in enumerate(values):
        by.setdefault(len(v), []).append(i)
    yield from by.values()


def _checked(kind: str):
    def make():
        def run(x: dict) -> dict:
            out: dict = {"_key": [], "vec": []}
            for key, v in zip(x["_key"], x["_vec"], strict=True):
                if key is None or not v or None in v:
                    continue
                a = np.array(v, kind)
                if np.isfinite(a).all() and a.any():
                    out["_key"].append(key)
                    out["vec"].append((a + 0.0).tobytes())  # -0.0 and 0.0 are one value
            return out

        return run

    return make


def _entries(kind: str):
    def make():
        def run(x: dict) -> dict:
            out: dict = {k: [] for k in ("bucket", "cid", "code", "vec")}
            for own in _by_length(x["vec"]):
                vectors = _vectors([x["vec"][i] for i in own], kind)
                for t in range(TABLES):
                    first, second = codes(vectors, t)
                    out["bucket"] += (t + TABLES * first).tolist()
                    out["cid"] += [x["cid"][i] for i in own]
                    out["code"] += second.tolist()
                    out["vec"] += [x["vec"][i] for i in own]
            return out

        return run

    return make


def _probing(kind: str, many: int):
    def make():
        def run(x: dict) -> dict:
            out: dict = {k: [] for k in ("bucket", "qid", "codes")}
            for own in _by_length(x["vec"]):
                vectors = _vectors([x["vec"][i] for i in own], kind)
                for t in range(TABLES):
                    for i, wanted in zip(own, probes(vectors, t, many), strict=True):
                        for first, second in wanted:
                            out["bucket"].append(t + TABLES * first)
                            out["qid"].append(x["cid"][i])
                            out["codes"].append(second)
            return out

        return run

    return make


def _meet(kind: str, k: int):
    """The best k + 1 classes for each query of a group, exactly scored."""

    def run(entries: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict = {"qid": [], "cid": [], "score": []}
        by: dict[int, list[int]] = {}
        for i, v in enumerate(entries["vec"].to_pylist()):
            by.setdefault(len(v), []).append(i)
        vecs, cids, code = entries["vec"].to_pylist(), entries["cid"].to_numpy(), entries["code"].to_numpy()
        sets = {n: (_vectors([vecs[i] for i in own], kind), cids[own], code[own]) for n, own in by.items()}
        for qid, wanted, q in zip(asked["qid"].to_pylist(), asked["codes"].to_pylist(), asked["qvec"].to_pylist(), strict=True):
            if len(q) not in sets:
                continue
            x, ids, second = sets[len(q)]
            near = np.flatnonzero(np.isin(second, wanted)) if wanted is not None else np.arange(len(ids))
            if len(near):
                y = _vectors([q], kind)[0]
                found = x[near]
                score = (found * y).sum(1) / (np.sqrt((found * found).sum(1)) * np.sqrt((y * y).sum()))
                best = np.lexsort((ids[near], -score))[: k + 1]
                out["qid"] += [qid] * len(best)
                out["cid"] += ids[near][best].tolist()
                out["score"] += score[best].tolist()
        return pa.table({"qid": pa.array(out["qid"], pa.int64()), "cid": pa.array(out["cid"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    return run


def _closest(kind: str, k: int, asked: dict[int, tuple[list[int], np.ndarray]]):
    """For each task the k best classes of each asked query among all of its batches, by length: at most SAMPLE * k rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int, bytes]]] = {}
        for batch in (piece for whole in batches for piece in sliced(whole)):
            cids, vecs = batch.column("cid").to_pylist(), batch.column("vec").to_pylist()
            for own in _by_length(vecs):
                ids, queries = asked.get(len(vecs[own[0]]), ([], None))
                if ids:
                    vectors = _vectors([vecs[i] for i in own], kind)
                    score = queries @ (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).T
                    score[np.array(ids)[:, None] == np.array([cids[i] for i in own])[None]] = -np.inf
                    for q, row in zip(ids, score, strict=True):
                        held = best.setdefault(q, [])
                        floor = held[-1][0] if len(held) >= k else -np.inf
                        better = [(float(row[i]), cids[own[i]], vecs[own[i]]) for i in np.argsort(-row, kind="stable")[:k].tolist() if row[i] > floor]
                        if better:
                            best[q] = sorted(held + better, key=lambda x: (-x[0], x[1]))[:k]
        rows = [(q, c, s, v) for q, held in best.items() for s, c, v in held]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["qid", "cid", "score", "vec"])

    return run


def turn_found(query: np.ndarray, neighbour: np.ndarray) -> int:
    """With how many probes the query finds the neighbour, in its best table."""
    turns = []
    for t in range(TABLES):
        costs = []
        for part, last in ((0, None), (1, LAST)):
            r = rotated(query[None] / np.linalg.norm(query), t, part)[0, :last]
            signed = np.stack([r, -r], 1).ravel()
            costs.append((signed.max() - signed) ** 2)
        first, second = (int(c[0]) for c in codes(neighbour[None], t))
        turns.append(int(((costs[0][:, None] + costs[1][None]) <= costs[0][first] + costs[1][second]).sum()))
    return min(turns)


def fitted_probes(classes: DataFrame, query_classes: DataFrame, kind: str, k: int) -> int:
    """The least number of probes that reaches RECALL of the true neighbours of up to SAMPLE queries."""
    sample = query_classes.orderBy(F.xxhash64("cid", F.lit(3)), "cid").limit(SAMPLE).collect()
    asked: dict[int, tuple[list[int], np.ndarray]] = {}
    for own in _by_length([r["vec"] for r in sample]):
        vectors = _vectors([sample[i]["vec"] for i in own], kind)
        asked[len(sample[own[0]]["vec"])] = [sample[i]["cid"] for i in own], vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    small_batches(classes.sparkSession)
    best = classes.select("cid", "vec").mapInArrow(_closest(kind, k, asked), "qid bigint, cid bigint, score double, vec binary")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    true = best.withColumn("_turn", F.row_number().over(order)).filter(F.col("_turn") <= k).select("qid", "vec").collect()  # at most SAMPLE * k
    of = {r["cid"]: _vectors([r["vec"]], kind)[0] for r in sample}
    turns = sorted(turn_found(of[r["qid"]], _vectors([r["vec"]], kind)[0]) for r in true)
    return turns[max(0, int(np.ceil(RECALL * len(turns))) - 1)] if turns else 1


_FOUND = "qid bigint, cid bigint, score double"


def _best(found: DataFrame, classes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """From class scores to each query's nearest rows."""
    once = found.groupBy("qid", "cid").agg(F.max("score").alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")  # a class is named by its smallest id
    few = once.withColumn("_turn", F.row_number().over(order)).filter(F.col("_turn") <= k + 1).drop("_turn")
    rows = few.join(classes.select("cid", F.explode("ids").alias("vec_id")), "cid").join(queries, "qid").filter("vec_id != query_id")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query, k: int = 5, many: int | None = None, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that the column is_query picks its k nearest of all other rows."""
    kind = "<f4" if "float" in vectors.schema[vec].dataType.simpleString() else "<f8"
    rows = vectors.select(F.col(key).cast("long").alias("_key"), F.col(vec).alias("_vec"), is_query.alias("_asks"))
    asking = rows.filter("_asks").select("_key").distinct()
    rows = written(over_texts(rows.select("_key", "_vec"), _checked(kind), "_key bigint, vec binary"), "vectors").distinct()
    same = Window.partitionBy("vec").orderBy("_key")
    few = rows.withColumn("_turn", F.row_number().over(same)).filter(F.col("_turn") <= k + 1)
    members = few.groupBy("vec").agg(F.sort_array(F.collect_list("_key")).alias("ids"))  # at most k + 1
    classes = written(members.withColumn("cid", F.col("ids")[0]), "vector-classes")
    asked = rows.join(asking, "_key", "left_semi").join(classes.select("vec", "cid"), "vec")
    queries = written(asked.select(F.col("cid").alias("qid"), F.col("_key").alias("query_id")), "queries")
    query_classes = classes.join(queries.select(F.col("qid").alias("cid")).distinct(), "cid", "left_semi").select("vec", "cid")

    many = many or fitted_probes(classes, query_classes, kind, k)
    entries = over_texts(classes.select("cid", "vec"), _entries(kind), "bucket int, cid bigint, code int, vec binary")
    probing = written(over_texts(query_classes, _probing(kind, many), "bucket int, qid bigint, codes array<int>"), "probes")
    # A row for each table and axis: how many parts its entries and its queries make.
    parts = entries.groupBy("bucket").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("_parts"))
    shares = probing.groupBy("bucket").agg(F.ceil(F.count("*") / GROUP_QUERIES).alias("_shares"))
    plan = F.broadcast(written(parts.join(shares, "bucket"), "buckets"))
    cut = lambda c, n: F.pmod(F.xxhash64(c, F.lit(5)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    entries = entries.join(plan, "bucket").withColumn("part", cut("cid", F.col("_parts"))).withColumn("share", each(F.col("_shares"))).drop("_parts", "_shares")
    probing = probing.join(plan, "bucket").withColumn("share", cut("qid", F.col("_shares"))).withColumn("part", each(F.col("_parts"))).drop("_parts", "_shares")
    measured = query_classes.agg(F.sum(F.length("vec") + 16)).first()[0] or 0
    probing = joined_small(probing, query_classes.select(F.col("cid").alias("qid"), F.col("vec").alias("qvec")), ["qid"], "inner", measured, salts=1)
    met = entries.groupBy("bucket", "part", "share").cogroup(probing.groupBy("bucket", "part", "share")).applyInArrow(_meet(kind, k), _FOUND)
    met = written(met, "met")
    found = written(_best(met, classes, queries, k), "found")

    # Those for which too few were found meet all vectors, block by block.
    short = queries.select("query_id", "qid").distinct().join(found.groupBy("query_id").count().filter(F.col("count") >= k), "query_id", "left_anti")
    short = written(short, "short")
    if short.isEmpty():
        return found
    blocks = max(1, -(-classes.count() // GROUP_ROWS))
    lone = query_classes.join(short.select(F.col("qid").alias("cid")).distinct(), "cid", "left_semi")
    lone = lone.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"), F.col("cid").alias("qid"), F.lit(None).cast("array<int>").alias("codes"), F.col("vec").alias("qvec"))
    every = classes.select(F.pmod("cid", F.lit(blocks)).cast("int").alias("part"), "cid", F.lit(0).alias("code"), "vec")
    all_met = every.groupBy("part").cogroup(lone.groupBy("part")).applyInArrow(_meet(kind, k), _FOUND)
    rest = _best(all_met, classes, short.select("qid", "query_id"), k)
    return found.join(short, "query_id", "left_anti").unionByName(rest)
