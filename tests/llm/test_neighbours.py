import numpy as np
import pytest
from tieline.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, vectors, ids=None):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in zip(ids or range(len(vectors)), vectors)], SCHEMA)


def exact(vectors, k, step):
    v = np.array(vectors, np.float32).astype(float)
    ids = np.arange(len(v))
    out = {}
    for q in range(0, len(v), step):
        score = sum(v[q, d] * v[:, d] for d in range(v.shape[1]))
        score[q] = -np.inf
        best = [i for i in np.lexsort((ids, -score)) if i != q][:k]
        out[q] = [(int(i), score[i]) for i in best]
    return out


def found(df, **settings):
    out = {}
    for r in sorted(neighbours.nearest(df, lambda c: c % 20 == 0, **settings).collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_over_many_lists_and_lengths(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(20, 16)).repeat(150, 0) + 0.6 * rng.normal(size=(3000, 16))
    v *= rng.uniform(0.5, 2, (3000, 1))
    got, want = found(table(spark, v), list_rows=50, sample_rows=1000), exact(v, 20, 20)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    scores = {(q, i): s for q in want for i, s in want[q]}
    assert all(scores[q, i] == s for q in got for i, s in got[q] if (q, i) in scores)


def test_one_list_is_exact_with_ties_and_blocks(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 8))
    v[100:300] = v[100]  # one vector very often
    assert found(table(spark, v), list_rows=1000, block=64) == exact(v, 20, 20)


def test_awkward_rows(spark):
    good = [[1.0, 0.0], [0.5, 0.5], [0.0, 2.0]]
    bad = [None, [], [0.0, 0.0], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0, 3.0]]
    df = table(spark, good + bad, [0, 1, 2, 20, 40, 60, 80, 100, 120, 140])
    df = df.union(table(spark, [[9.0, 9.0]], [None]))
    assert found(df) == {0: [(1, 0.5), (2, 0.0)]}
    assert found(df.limit(0)) == {}


def test_rows_that_share_an_id_are_rows_of_their_own(spark):
    df = table(spark, [[1.0, 0.0], [0.0, 3.0], [0.5, 0.5], [2.0, 2.0], [0.5, 0.5]], [0, 0, 1, 1, 1])
    got = sorted(tuple(r) for r in neighbours.nearest(df, lambda c: c % 20 == 0, k=3).collect())
    assert got == sorted([(0, 1, 1, 2.0), (0, 2, 1, 0.5), (0, 3, 1, 0.5), (0, 1, 1, 6.0), (0, 2, 1, 1.5), (0, 3, 1, 1.5)])


def test_graph_search_finds_the_nearest_centroids():
    rng = np.random.default_rng(3)
    lists = neighbours.Lists(rng.normal(size=(3000, 8)), 6.0, 300)
    x = lists.lift_queries(rng.normal(size=(50, 8)))
    ids, gaps = lists.search(x, 64)
    true = np.linalg.norm(x[:, None] - lists.centroids[None], axis=2)
    assert np.allclose(gaps[:, 0], np.take_along_axis(true, ids, 1)[:, 0])
    near = np.argsort(true, axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b[:20])) for a, b in zip(near, ids)]) >= 9.5
    sizes = np.bincount(lists.postings(rng.normal(size=(3000, 8)), 0.1, 4)[1], minlength=300)
    assert sizes.max() < 12 * sizes.mean()


def test_recall_without_clusters_over_hundreds_of_lists(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(12_000, 32))
    v /= np.linalg.norm(v, axis=1)[:, None]
    got, want = found(table(spark, v), list_rows=40), exact(v, 20, 20)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.93 * 20 * len(want)


def test_all_lists_within_the_ratio_are_probed():
    rng = np.random.default_rng(5)
    lists, x = neighbours.Lists(rng.normal(size=(3000, 8)), 6.0, 300), rng.normal(size=(50, 8))
    gaps = lists.gaps(lists.lift_queries(x))
    row, at = lists.probes(x, 1.2, 16, np.ones(300, int), 1)
    assert len(row) > 16 * 50
    missed = set(zip(*np.nonzero(gaps <= 1.2 * gaps.min(1)[:, None]))) ^ set(zip(row, at))
    assert len(missed) <= 0.01 * len(row)
