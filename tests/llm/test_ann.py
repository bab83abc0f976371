"""Recall against brute force, pruning, and odd rows."""

import numpy as np
import pytest

from tidemill.llm import ann


def brute(rows, query, k):
    """rows: {id: vector}; the exact answer for one query id."""
    mine = np.array(rows[query])
    scored = sorted((float(np.sqrt(((np.array(v) - mine) ** 2).sum())), i) for i, v in rows.items() if i != query and len(v) == len(mine))
    return [(i, d) for d, i in scored[:k]]


def test_pruned_edges_are_diverse():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(300, 8))
    norms = (points**2).sum(axis=1)
    kept = ann.robust_prune(points, norms, np.array([0]), np.arange(300)[None, :], 20, 1.2)[0]
    kept = kept[kept >= 0]
    assert 0 not in kept and len(set(kept)) == len(kept)
    to_point = np.sqrt(((points[kept] - points[0]) ** 2).sum(axis=1))
    assert (np.diff(to_point) >= 0).all()
    for j, q in enumerate(kept):
        assert all(1.2 * np.linalg.norm(points[p] - points[q]) > to_point[j] - 1e-9 for p in kept[:j])


@pytest.mark.parametrize("shard_rows", [5000, 400])
def test_recall(spark, shard_rows):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r.vec_id: r.embedding for r in table.collect()}
    queries = table.where("vec_id % 100 = 0")
    found = ann.nearest(table, queries, settings=ann.Settings(shard_rows=shard_rows)).collect()
    hits = 0
    for query in [i for i in rows if i % 100 == 0]:
        mine = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == query)
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert [s for _, _, s in mine] == sorted(s for _, _, s in mine)
        truth = dict(brute(rows, query, 10))
        hits += len(truth.keys() & {v for _, v, _ in mine})
        assert all(abs(s - np.linalg.norm(np.array(rows[v]) - np.array(rows[query]))) < 1e-12 for _, v, s in mine)
    assert hits >= 0.95 * len({r.query_id for r in found}) * 10


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    same = [1.0, 2.0, 3.0]
    rows = [(i, [float(x) for x in rng.normal(size=3)], 1) for i in range(40)] + [(100 + i, same, 2) for i in range(60)]
    odd = [(None, same, 1), (200, None, 1), (300, [0.0, 0.0, 0.0], 1), (400, [1.0, None, 2.0], 1), (500, [float("nan"), 1.0, 1.0], 1),
           (600, [float("inf"), 1.0, 1.0], 1), (700, [], 1), (800, [1.0, 1.0], 1), (900, [2.0, 1.0], 1)]
    schema = "vec_id long, embedding array<float>, rank int"
    table = spark.createDataFrame(rows + rows[:7] + odd, schema)
    queries = table.where("vec_id % 100 = 0 OR vec_id IS NULL")
    found = ann.nearest(table, queries, settings=ann.Settings(shard_rows=30)).collect()
    usable = {i: list(np.array(v, np.float32).astype(float)) for i, v, _ in [*rows, *odd[-2:]]}
    answers = {q: [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] for q in {r.query_id for r in found}}
    assert answers.keys() == {0, 100, 800, 900}
    for query, got in answers.items():
        expected = brute(usable, query, 10)
        assert [i for i, _ in got] == [i for i, _ in expected]
        assert np.allclose([d for _, d in got], [d for _, d in expected], atol=1e-12)
    assert answers[100] == [(101 + i, 0.0) for i in range(10)] and [i for i, _ in answers[800]] == [900]
    assert ann.nearest(table.limit(0), queries).count() == 0 and ann.nearest(table, queries.limit(0)).count() == 0
