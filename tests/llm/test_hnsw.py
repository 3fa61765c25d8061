import math

import numpy as np
import pytest

from costlens.llm import hnsw as H

SCHEMA = "vec_id long, embedding array<float>, dim int, shard string, vector int, ids int"


def brute(rows, queries, k):
    """Ranked ids and distances by comparing every pair; an id is as near as its nearest vector."""
    fine = {(i, tuple(np.float64(np.float32(x)) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    near = {}
    for q, x in fine:
        if q in queries:
            own = near.setdefault(q, {})
            for i, y in fine:
                if i != q and len(y) == len(x):
                    own[i] = min(own.get(i, math.inf), math.dist(x, y))
    out = []
    for q, own in sorted(near.items()):
        out += [(q, n, i, d) for n, (d, i) in enumerate(sorted((d, i) for i, d in own.items())[:k], 1)]
    return out


def ours(df, queries, k=10):
    asked = df.filter(df.vec_id.isin(list(queries)))
    return sorted(tuple(r) for r in H.nearest(df, asked, k).collect())


def test_recall_over_several_shards(spark, table, monkeypatch):
    monkeypatch.setattr(H, "SHARD_ROWS", 150)
    monkeypatch.setattr(H, "BLOCK_QUERIES", 3)
    rows = [(r.vec_id, r.embedding) for r in table("embeddings").collect()]
    queries = {i for i, _ in rows if i % 20 == 0}
    truth, got = brute(rows, queries, 10), ours(table("embeddings"), queries)
    assert [r[:2] for r in got] == [r[:2] for r in truth]
    assert len({(a, c) for a, _, c, _ in truth} & {(a, c) for a, _, c, _ in got}) / len(truth) > 0.95
    vector = dict(rows)
    assert all(math.isclose(d, math.dist(vector[q], vector[i]), rel_tol=1e-12) for q, _, i, d in got)


def test_recall_in_one_large_graph():
    rng = np.random.default_rng(0)
    centers = rng.normal(0, 3, (30, 32))
    vectors = centers[rng.integers(0, 30, 4000)] + rng.normal(0, 1, (4000, 32))
    layers = H.build(vectors)
    assert len(layers) > 1 and all(x.shape[0] == len(n) for n, x in layers)
    found = H.search(vectors, layers, vectors[:200], H.SEARCH_BEAM)
    apart = ((vectors[:200, None] - vectors[None]) ** 2).sum(2)
    truth = np.argsort(apart, axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b[:10])) / 10 for a, b in zip(truth.tolist(), found.tolist(), strict=True)]) > 0.95


@pytest.mark.parametrize("k", [1, 3])
def test_odd_rows(spark, k):
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None), (5, []),
        (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]),
        (10, [1.0, 2.0, 3.0]), (11, [1.0, 2.0, 4.0]), (12, [-1.0]), (13, [1.0, 0.0]), (13, [0.9, 0.1]),
    ]
    frame = spark.createDataFrame([(i, v, 1, "s", 2, 3) for i, v in rows], SCHEMA)
    everyone = set(range(14))
    got = ours(frame, everyone, k)
    assert got == [pytest.approx(r) for r in brute(rows, everyone, k)]
    assert len({r[:2] for r in got}) == len({(r[0], r[2]) for r in got}) == len(got)
    assert ours(frame.limit(0), everyone, k) == []
    assert not [r for r in got if r[0] in {4, 5, 6, 7, 8, 9, 12}]


def test_many_copies_of_a_vector(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [0.25, 0.5, 0.75]) for i in range(300)] + [(300 + i, rng.normal(0, 1, 3).tolist()) for i in range(200)]
    frame = spark.createDataFrame([(i, v, 1, "s", 2, 3) for i, v in rows], SCHEMA)
    queries = {0, 5, 299, 310}
    assert ours(frame, queries) == [pytest.approx(r) for r in brute(rows, queries, 10)]
