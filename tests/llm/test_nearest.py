import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.llm import nearest as N

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string"


def brute(ids, x, k=5, step=50):
    x = np.asarray(x, np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(np.asarray(ids) % step == 0):
        score = unit @ unit[q]
        order = sorted((i for i in range(len(ids)) if i != q), key=lambda i: (-round(score[i], 12), ids[i]))[:k]
        out[int(ids[q])] = [int(ids[i]) for i in order]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    x[1000:1300] = x[0]  # a hot vector
    x[100:150] = x[50:100] + 0.05 * rng.normal(size=(50, 64))
    return x


def test_recall_and_hot_vector(spark, vectors):
    df = spark.createDataFrame([(i, v.tolist(), 0, "") for i, v in enumerate(vectors)], SCHEMA)
    got, want = result(N.nearest(df, F.col("vec_id") % 50 == 0)), brute(np.arange(3000), vectors)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9
    assert got[0] == want[0] and got[1000] == want[1000]


def test_groups_are_cut(spark, vectors, monkeypatch):
    df = spark.createDataFrame([(i, v.tolist(), 0, "") for i, v in enumerate(vectors[:900])], SCHEMA)
    whole = result(N.nearest(df, F.col("vec_id") % 50 == 0))
    monkeypatch.setattr(N, "GROUP_ROWS", 3)
    monkeypatch.setattr(N, "GROUP_QUERIES", 2)
    assert result(N.nearest(df, F.col("vec_id") % 50 == 0)) == whole


def test_scores_are_cosines(spark, vectors):
    df = spark.createDataFrame([(i, v.tolist(), 0, "") for i, v in enumerate(vectors[:200])], SCHEMA)
    for r in N.nearest(df, F.col("vec_id") % 50 == 0).collect():
        a, b = vectors[r.query_id].astype(float), vectors[r.vec_id].astype(float)
        assert r.score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)


def test_small_and_odd_tables(spark):
    rows = [(0, [1.0, 0.0], 0, ""), (1, [1.0, 0.0], 0, ""), (2, [0.0, 1.0], 0, ""), (3, [0.0, 0.0], 0, ""), (4, None, 0, ""), (5, [float("nan"), 1.0], 0, ""), (6, [None, 1.0], 0, ""), (7, [], 0, ""), (None, [1.0, 1.0], 0, ""), (8, [1.0], 0, ""), (50, [-1.0, 0.0], 0, "")]
    got = result(N.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0))
    assert got == {0: [1, 2, 50], 50: [2, 0, 1]}
    assert N.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0


def test_probes_are_fitted_to_the_recall(spark, vectors):
    """Clustered vectors need few probes, isotropic ones many; either way the query itself reaches the recall."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 64))
    near = (centres[rng.integers(60, size=1500)] + 0.15 * rng.normal(size=(1500, 64))).astype(np.float32)
    asked = lambda x: [N._vectors([v.tobytes()], "<f4")[0] for v in x]
    few = np.median([N.turn_found(a, b) for a, b in zip(asked(near[:40]), asked(near[:40] + 0.05), strict=True)])
    many = np.median([N.turn_found(a, b) for a, b in zip(asked(vectors[:40]), asked(vectors[40:80]), strict=True)])
    assert few < many
    df = spark.createDataFrame([(i, v.tolist(), 0, "") for i, v in enumerate(near)], SCHEMA)
    got, want = result(N.nearest(df, F.col("vec_id") % 50 == 0)), brute(np.arange(1500), near)
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9


def test_turn_found_is_the_place_among_the_probes(vectors):
    for q, v in ((vectors[1], vectors[2]), (vectors[60], vectors[110]), (vectors[5], vectors[9])):
        q, v = q.astype(float), v.astype(float)
        turn = N.turn_found(q, v)
        found = lambda many: any(int(N.codes(v[None], t)[1][0]) in dict(N.probes(q[None], t, many)[0]).get(int(N.codes(v[None], t)[0][0]), ()) for t in range(N.TABLES))
        assert found(turn) and (turn == 1 or not found(turn - 1))
