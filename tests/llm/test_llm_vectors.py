"""Vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybook.llm import neighbours, topk

SCHEMA = "vec_id long, embedding array<float>, rank int"


def table(spark, vectors, extra=()):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in enumerate(vectors)]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


def brute(ids, vectors, queries, k, kind=float):
    out = []
    for q in queries:
        scores = [(-kind(np.dot(vectors[c], vectors[q])), c) for c in ids if c != q and len(vectors[c]) == len(vectors[q])]
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(sorted(scores)[:k])]
    return out


def odd_rows():
    nan, inf = float("nan"), float("inf")
    return [(9000, None, 0), (9100, [nan] * 8, 0), (9200, [inf] + [0.0] * 7, 0), (9300, [None] + [1.0] * 7, 0),
            (None, [1.0] * 8, 0), (0, [9.0] * 8, 0), (9400, [1.0, 2.0], 0), (9500, [0.5, 1.0], 0)]


@pytest.mark.parametrize("k", [3, 500])
def test_top_k_equals_brute_force(spark, k):
    made = np.random.default_rng(4)
    vectors = np.round(made.standard_normal((220, 8)), 1).astype(np.float32)
    vectors[40:90] = vectors[7]  # ties
    vectors[3] = 0
    found = topk.top_k(table(spark, vectors, odd_rows()), F.col("vec_id") % 100 == 0, k=k)
    whole = {i: np.floor(1024 * v.astype(float)).astype(np.int64).tolist() for i, v in enumerate(vectors)}
    whole[9400], whole[9500] = [1024, 2048], [512, 1024]
    # of the two rows 0 the smaller vector counts
    assert vectors[0].tolist() < [9.0] * 8
    wanted = brute(list(whole), whole, [0, 100, 200, 9400, 9500], k, int)
    assert sorted(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect())) == sorted(wanted)


def test_scores_beyond_doubles_are_exact():
    rows = np.array([[2.0**40, 3.0], [2.0**40 + 1, -5.0]])
    query = np.array([2.0**21 + 1, 7.0])
    assert topk.exact_scores(rows, query).tolist() == [2**40 * (2**21 + 1) + 21, (2**40 + 1) * (2**21 + 1) - 35]


def test_neighbours_find_nearly_all(spark):
    made = np.random.default_rng(5)
    vectors = made.standard_normal((900, 24)).astype(np.float32)
    vectors[10:30] = vectors[5]
    vectors[31] = 0
    vectors[100:200] *= 3  # lengths differ: the largest inner product counts
    found = neighbours.nearest(table(spark, vectors, odd_rows()[:5]), F.col("vec_id") % 20 == 0, k=20)
    rows = found.collect()
    queries = [q for q in range(0, 900, 20) if q != 31]
    usable = [i for i in range(900) if i != 31]
    wanted = brute(usable, vectors.astype(float), queries, 20)
    assert len(rows) == len(wanted)
    hits = {(r.query_id, r.vec_id) for r in rows} & {(q, c) for q, _, c, _ in wanted}
    assert len(hits) >= 0.9 * len(wanted)
    for r in rows:
        assert r.score == pytest.approx(np.dot(vectors[r.query_id].astype(float), vectors[r.vec_id].astype(float)), abs=1e-12)


def test_few_candidates_are_all_returned(spark):
    vectors = np.eye(6, dtype=np.float32) - 0.5
    found = neighbours.nearest(table(spark, vectors), F.col("vec_id") % 5 == 0, k=20, tables=1, width=8, probes=1, bucket=0.05)
    assert sorted((r.query_id, r.vec_id) for r in found.collect()) == sorted(
        (q, c) for q in (0, 5) for c in range(6) if c != q
    )


@pytest.mark.parametrize("search", [topk.top_k, neighbours.nearest])
def test_no_usable_vectors(spark, search):
    assert search(table(spark, [None, [None]]), F.col("vec_id") % 1 == 0, k=2).count() == 0


def test_probe_order_is_by_expected_success():
    order = neighbours.probe_order(3, 20)
    assert order[:2] == [(), (0,)] and len(set(order)) == len(order)
    assert all(5 - r not in ranks for ranks in order for r in ranks)


def test_equal_vectors_tie_by_id_wherever_they_lie(spark, monkeypatch):
    made = np.random.default_rng(6)
    vectors = made.standard_normal((700, 24)).astype(np.float32)
    for i in range(0, 700, 3):  # a third of all rows is one vector, a seventh another one
        vectors[i] = vectors[0]
    for i in range(1, 700, 7):
        vectors[i] = vectors[0] * np.float32(0.5)
    rows = table(spark, vectors).repartition(5)
    wanted = neighbours.nearest(rows, F.col("vec_id") % 20 == 0, k=20).collect()
    # buckets cut small: heavy ones go to many tasks, and nothing changes
    monkeypatch.setattr(neighbours, "CHUNK", 16)
    monkeypatch.setattr(neighbours, "TASK_ROWS", 256)
    found = neighbours.nearest(rows, F.col("vec_id") % 20 == 0, k=20).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, wanted))
    same = [i for i in range(700) if (vectors[i] == vectors[0]).all()]
    by_query: dict = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        by_query.setdefault(r.query_id, []).append(r)
    assert len(by_query) == 35
    for q, held in by_query.items():
        assert [r.rank for r in held] == list(range(1, 21))
        assert held == sorted(held, key=lambda r: (-r.score, r.vec_id)) and len({r.vec_id for r in held}) == 20
        assert len({r.score for r in held if r.vec_id in same}) <= 1
        if q in same:
            assert [r.vec_id for r in held if r.vec_id in same] == [i for i in same if i != q][:20]


def test_a_score_depends_on_its_pair_only():
    made = np.random.default_rng(7)
    vectors = made.standard_normal((64, 64))
    vectors[made.integers(0, 64, 30)] = vectors[9]
    queries = made.standard_normal((5, 64))
    everyone = (np.arange(5), np.zeros(5, np.int64))
    longest = float(np.sqrt((vectors**2).sum(axis=1)).max())
    scores: dict = {}
    for trial in range(50):
        order = made.permutation(64)[: made.integers(30, 65)]
        out = neighbours.best_of(np.arange(100, 105), queries, everyone, order, vectors[order], np.zeros(len(order), np.int64), 64, longest)
        for q, c, s in zip(*out):
            assert scores.setdefault((q, vectors[c].tobytes()), s) == s
        assert len(out[0]) == 5 * len(order)
