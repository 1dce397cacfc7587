import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, segment int, block int"


def table(spark, ids, vectors):
    rows = [(i, v, None, 1, 2) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def exact(ids, x, k):
    out = {}
    for q in np.flatnonzero(np.array(ids) % 20 == 0):
        score = x @ x[q]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("spread", ["uniform", "clustered", "norms"])
def test_recall_against_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(neighbours, "SEGMENT_ROWS", 900)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 60)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 24))
    if spread == "clustered":
        x += 6 * rng.normal(size=(12, 24))[rng.integers(0, 12, 2000)]
    if spread == "norms":
        x *= rng.lognormal(size=(2000, 1))
    x = x.astype(np.float32).astype(float)
    ids = np.arange(2000)
    out = found(neighbours.nearest(table(spark, ids.tolist(), x.tolist()), F.col("vec_id") % 20 == 0))
    truth = exact(ids, x, 20)
    assert out.keys() == truth.keys() and all(len(v) == 20 for v in out.values())
    hit = sum(len({i for i, _ in out[q]} & {i for i, _ in truth[q]}) for q in truth)
    assert hit / (20 * len(truth)) >= 0.9
    for q, pairs in out.items():
        for i, score in pairs:
            assert score == pytest.approx(float(x[q] @ x[i]), rel=1e-12)


def test_ties_and_useless_vectors(spark):
    vectors = [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], None, [0.0, 0.0], [float("nan"), 1.0],
               [float("inf"), 0.0], [None, 1.0], [], [1.0], [1.0, 0.0], [2.0, 2.0]]
    ids = [0, 7, 3, 20, 40, 60, 80, 100, 120, 140, 5, 160]
    out = found(neighbours.nearest(table(spark, ids, vectors), F.col("vec_id") % 20 == 0))
    assert out == {
        0: [(160, 2.0), (5, 1.0), (7, 1.0), (3, 0.0)],
        160: [(0, 2.0), (3, 2.0), (5, 2.0), (7, 2.0)],
    }


def test_repeated_rows_and_null_ids(spark):
    vectors = [[1.0, 2.0]] * 300 + [[2.0, 1.0]] * 3
    ids = [20] * 300 + [1, 2, None]
    out = found(neighbours.nearest(table(spark, ids, vectors), F.col("vec_id") % 20 == 0))
    assert set(out) == {20} and {i for i, _ in out[20]} == {1, 2}


def test_empty_table(spark):
    assert neighbours.nearest(table(spark, [], []), F.col("vec_id") % 20 == 0).collect() == []
    only = table(spark, [1], [[1.0]])
    assert neighbours.nearest(only, F.col("vec_id") % 20 == 0).collect() == []


@pytest.mark.parametrize("size", [32, 64, 100, 384])
@pytest.mark.parametrize("rows", [400, 5000])
def test_equal_vectors_go_by_the_smaller_id(spark, monkeypatch, size, rows):
    """A third of the rows repeat vectors; every query's equal neighbours are in order of id."""
    monkeypatch.setattr(neighbours, "SEGMENT_ROWS", rows)
    rng = np.random.default_rng(size)
    x = rng.normal(size=(400, size)).astype(np.float32).astype(float)
    x[250:] = x[rng.integers(0, 60, 150)]
    ids = rng.permutation(400)
    out = found(neighbours.nearest(table(spark, ids.tolist(), x.tolist()), F.col("vec_id") % 20 == 0))
    at = {int(i): v for i, v in zip(ids, x)}
    ties = 0
    for pairs in out.values():
        for (i, a), (j, b) in zip(pairs, pairs[1:]):
            if (at[i] == at[j]).all():
                ties += 1
                assert a == b and i < j
            assert a > b or i < j
    assert ties > 20


def test_scores_do_not_depend_on_the_place():
    rng = np.random.default_rng(0)
    for size in (32, 64, 100, 384):
        rows, query = rng.normal(size=(700, size)), rng.normal(size=size)
        rows[300:] = rows[0]
        score = neighbours.inner_products(rows, query)
        assert len(set(score[300:].tolist()) | {score[0]}) == 1


def test_very_many_equal_vectors(spark, monkeypatch):
    """More copies than a segment has rows; the least ids of them are the neighbours."""
    monkeypatch.setattr(neighbours, "SEGMENT_ROWS", 300)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 16)).astype(np.float32).astype(float)
    x[::3] = x[0]
    ids = np.arange(2000) + 5
    out = found(neighbours.nearest(table(spark, ids.tolist(), x.tolist()), F.col("vec_id") % 20 == 0))
    truth = exact(ids, x, 20)
    copies = [int(i) for i in ids[::3]]
    for q, pairs in out.items():
        score = float(np.cumsum(x[q - 5] * x[0])[-1])
        same = [i for i, s in pairs if s == score]
        want = [i for i in copies if i != q][:len(same)]
        assert same == want and len(pairs) == 20
    hit = sum(len({i for i, _ in out[q]} & {i for i, _ in truth[q]}) for q in truth)
    assert hit / (20 * len(truth)) >= 0.9


def test_few_vectors_in_several_segments(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SEGMENT_ROWS", 3)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 2)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(70, 8)).round(1)
    out = found(neighbours.nearest(table(spark, list(range(70)), x.tolist()), F.col("vec_id") % 7 == 0))
    for q in range(0, 70, 7):
        score = np.cumsum(x * x[q], axis=1)[:, -1]
        want = [int(j) for j in np.lexsort((np.arange(70), -score)) if j != q][:20]
        assert [i for i, _ in out[q]] == want
