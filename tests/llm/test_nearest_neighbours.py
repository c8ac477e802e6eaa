import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatlens.llm import nearest_neighbours as N
from threatlens.llm.queries import QUERIES

from .conftest import documents


def brute(rows, k=5, every=50):
    out = {}
    rows = [(i, np.array(v, float)) for i, v in rows]
    for i, q in rows:
        if i % every == 0:
            s = [(-float(q @ v) / math.sqrt((q @ q) * (v @ v)), j) for j, v in rows if j != i]
            out[i] = sorted((round(a, 12), j) for a, j in s)[:k]
    return out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_and_scores(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in documents(spark, "embeddings", sf).collect()]
    want = brute(rows)
    got = {}
    for r in QUERIES["op5_nearest_neighbours"](spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((round(-r.score, 12), r.vec_id))
    assert set(got) == set(want)
    hit = sum(len({j for _, j in want[q]} & {j for _, j in got[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    exact = dict(rows)
    for q, found in list(got.items())[:5]:
        a = np.array(exact[q], float)
        for s, j in found:
            b = np.array(exact[j], float)
            assert -s == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-11)


def test_hazards(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (8, []), (9, [3.0, 0.0]), (9, [3.0, 0.0]), (None, [1.0, 0.0]), (10, [1.0, 2.0, 3.0]), (50, [0.0, 5.0]), (100, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, rank string, score string")
    got = N.search(N.build_index(df), F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert by == {0: [1, 9, 2, 50, 100], 50: [2, 0, 1, 9, 100], 100: [50, 2, 0, 1, 9]}     # ties to the smaller id
    assert N.search(N.build_index(df.where("vec_id < 0")), F.col("vec_id") % 50 == 0).collect() == []
    assert len(N.search(N.build_index(df.where("vec_id < 2")), F.col("vec_id") == 0).collect()) == 1


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(i, [1.0, 2.0, float(i)]) for i in range(300, 320)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = N.search(N.build_index(df), F.col("vec_id") == 100, 5, block_rows=64).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4] and all(r.score == got[0].score for r in got)


def test_bounds_hold_for_most_vectors():
    rng = np.random.default_rng(0)
    v, q = rng.standard_normal((2000, 64)), rng.standard_normal((20, 64))
    bits, corr = N.encode(v)
    about, half = N.estimate(bits, corr, q)
    true = (q @ v.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(v, axis=1)
    assert (np.abs(about - true) <= half).mean() > 0.97 and bits.shape == (2000, 8)


def test_many_vector_lengths(spark, monkeypatch):
    monkeypatch.setattr(N, "ROTATION_BYTES", 1000)
    rng = np.random.default_rng(4)
    rows = [(1000 * d + i, rng.standard_normal(d).tolist()) for d in range(2, 82) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in N.search(N.build_index(df), F.col("vec_id") % 1000 == 0, 5, block_rows=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [j for _, j in brute([x for x in rows if x[0] // 1000 == q // 1000], every=1000)[q]]
                   for q in range(2000, 82000, 1000)}


def test_repeated_queries_are_not_broadcast(spark):
    """each group of queries is repeated for every block, so its join is no broadcast however small the estimate."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(400)] + [(100, rng.standard_normal(8).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = N.search(N.build_index(df), F.col("vec_id") % 50 == 0, 3, block_rows=20, query_rows=4)
    got = sorted((r.query_id, r["rank"]) for r in found.collect())
    assert got == sorted((q, k) for q in [*range(0, 400, 50), 100] for k in (1, 2, 3))     # an id with two vectors asks twice
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [dim" in plan and not [x for x in plan.splitlines() if "BroadcastHashJoin [dim" in x and "block" in x.split("]")[0]]
