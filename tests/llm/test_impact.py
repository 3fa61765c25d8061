import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from costlens.llm import impact

SCHEMA = "vec_id long, embedding array<double>, label int, shard int, ids string"


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA)


def brute(rows, asked, k):
    fine = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for query in sorted({i for i, _ in fine if asked(i)}):
        best = defaultdict(lambda: -math.inf)
        for i, v in fine:
            for j, w in fine:
                if i == query != j and len(v) == len(w):
                    best[j] = max(best[j], sum(x * y for x, y in zip(v, w, strict=True)))
        ranked = sorted((-s, j) for j, s in best.items())[:k]
        out += [(query, r, j, -s) for r, (s, j) in enumerate(ranked, 1)]
    return out


def found(df, asked="vec_id % 5 = 0", k=5):
    return sorted(tuple(r) for r in impact.largest_products(df, df.filter(asked), k).collect())


def vectors(seed, count, dim, spread=0.3, groups=7):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    made = centres[rng.integers(groups, size=count)] + spread * rng.normal(size=(count, dim))
    return made / np.linalg.norm(made, axis=1, keepdims=True)


def test_random_vectors_against_brute_force(frame, monkeypatch):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(1, 300, 12))]
    assert found(frame(rows)) == brute(rows, lambda i: i % 5 == 0, 5)
    monkeypatch.setattr(impact, "SHARD_ROWS", 40)
    monkeypatch.setattr(impact, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(impact, "TASK_BLOCKS", 2)
    assert found(frame(rows).repartition(3)) == brute(rows, lambda i: i % 5 == 0, 5)


def test_ties_repeats_and_odd_vectors(frame, none, spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [0.5, -0.25, 0.125]) for i in range(12)] + [(3, [0.5, -0.25, 0.125])] * 3
    rows += [(20, None), (25, [1.0, None, 2.0]), (30, [nan, 1.0, 1.0]), (35, [1.0, inf, 1.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(40, [0.0, 0.0, 0.0]), (45, [1.0, 2.0]), (50, [-3.0, 0.001]), (55, []), (60, []), (65, [9.0] * 4)]
    rows += [(10, [2.0, 2.0, 2.0]), (5, [-1.0, 0.0, 3.0]), (5, [1.0, 0.0, -3.0])]
    assert found(frame(rows)) == brute(rows, lambda i: i % 5 == 0, 5)
    assert found(frame(rows), k=1) == brute(rows, lambda i: i % 5 == 0, 1)
    empty = frame([])
    result = impact.largest_products(empty, empty)
    assert result.collect() == []
    assert " ".join(f"{c} {t}" for c, t in result.dtypes) == "query_id bigint rank int vec_id bigint score bigint"


def test_single_precision_is_read_as_double(spark):
    rows = [(i, np.float32(v).tolist()) for i, v in enumerate(vectors(3, 60, 5))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found(df) == brute(rows, lambda i: i % 5 == 0, 5)


def test_too_large_components_raise(frame):
    with pytest.raises(Exception, match="too large"):
        found(frame([(0, [1e30, 1.0]), (1, [1.0, 1.0])]))


@pytest.mark.parametrize("k", [1, 5, 400])
def test_the_proof_holds_at_any_stop(k):
    numbers = np.floor(256 * vectors(5, 400, 16)).astype(np.int64)
    ids = np.arange(400) // 2  # two rows an id
    shard = impact.Shard.build(ids, numbers)
    for i in range(0, 200, 9):
        query = numbers[2 * i]
        got, scores, read = shard.search(i, query, k)
        best = {}
        for j, s in zip(ids.tolist(), (numbers @ query).tolist(), strict=True):
            best[j] = max(s, best.get(j, s))
        best.pop(i)
        want = sorted((-s, j) for j, s in best.items())[:k]
        assert [(-s, j) for j, s in zip(got.tolist(), scores.tolist(), strict=True)] == want
        assert read <= numbers.size


def test_segments_are_read_in_part_only():
    """Near neighbours give a limit that most rows cannot reach, long before the last segment."""
    numbers = np.floor(256 * vectors(6, 4000, 64, spread=0.1, groups=40)).astype(np.int64)
    shard = impact.Shard.build(np.arange(4000), numbers)
    read = [shard.search(i, numbers[i], 5)[2] for i in range(0, 4000, 100)]
    assert np.mean(read) < 0.6 * numbers.size


def test_segments_hold_each_row_once_in_each_dimension():
    numbers = np.floor(256 * vectors(7, 100, 6)).astype(np.int64)
    numbers[:, 2] = 5
    shard = impact.Shard.build(np.arange(100), numbers)
    for d in range(6):
        assert sorted(shard.postings[d * 100 : d * 100 + 100]) == list(range(100))
    assert (shard.high >= shard.low).all() and (np.diff(shard.starts) > 0).all()
    assert (shard.of_dim == 2).sum() == 1


def test_what_is_moved_are_single_vectors(frame, monkeypatch):
    """Packed shards, copied for every 256 queries, took the executors' memory."""
    written, stored = [], impact.stored
    monkeypatch.setattr(impact, "stored", lambda df, path: written.append(stored(df, path)) or written[-1])
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(8, 600, 6))]
    assert found(frame(rows)) == brute(rows, lambda i: i % 5 == 0, 5)
    for df in written:
        for name in (c for c, kind in df.dtypes if kind == "binary"):
            assert df.selectExpr(f"max(octet_length({name}))").first()[0] == 4 * 6


def test_a_task_holds_one_shard_and_a_batch_of_rows():
    numbers = {d: np.floor(256 * vectors(9 + d, 120, d)).astype(np.int32) for d in (3, 5)}

    def batch(task, dim, asked, ids):
        packed = numbers[dim].view(np.uint8).reshape(-1, dim, 4).transpose(0, 2, 1)
        columns = [[i for i in ids], [dim] * len(ids), [packed[i].tobytes() for i in ids]]
        columns += [[asked] * len(ids), [task] * len(ids)]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32()]
        names = ["vec_id", "dim", "vector", "asked", "task"]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    taken = []

    def batches():
        yield batch(0, 3, 1, range(20))  # queries that no row meets
        for task, dim in ((1, 3), (1, 5), (2, 3)):
            parts = [batch(task, dim, 0, range(a, a + 30)) for a in (0, 30, 60, 90)]
            parts += [batch(task, dim, 1, range(a, a + 10)) for a in (0, 10, 20)]
            yield from (pa.Table.from_batches(parts[:5]).combine_chunks().to_batches() if task == 2 else parts[:5])
            for part in parts[5:]:
                taken.append((task, dim))
                yield part

    got, ahead = [], []
    for answer in impact._search(4, block=7)(batches()):
        got += zip(*(answer[c].to_pylist() for c in ("query_id", "vec_id", "score")), strict=True)
        ahead.append((len(got), len(taken)))
    assert len(taken) == 6 and all(at >= 4 * (20 + 10 * n - 20) for at, n in ahead)
    want = []
    for dim in (3, 5, 3):
        scores = numbers[dim].astype(np.int64) @ numbers[dim].T.astype(np.int64)
        for i in range(30):
            want += [(i, j, s) for s, j in sorted((-int(scores[i, j]), j) for j in range(120) if j != i)[:4]]
    assert got == [(i, j, -s) for i, j, s in want]


def test_copies_do_not_grow_with_the_queries_and_long_vectors_make_small_shards():
    assert impact._layout(1000, 64_000, 20, 6) == (1, 1)
    for rows in (10**5, 10**6, 10**7, 10**8):
        shards, parts = impact._layout(rows, 64 * rows, rows // 50, 6)
        assert rows / shards <= impact.SHARD_ROWS
        assert rows * parts <= 24 * impact.SHARD_ROWS + rows
        assert shards * parts >= 24 or parts == rows // 50 // 256 + 1
    shards, _ = impact._layout(10**6, 1536 * 10**6, 20_000, 6)
    assert 1536 * 10**6 / shards <= impact.SHARD_ROWS * impact.SHARD_DIM


def test_queries_are_spread_over_tasks(frame, monkeypatch):
    monkeypatch.setattr(impact, "SHARD_ROWS", 90)
    monkeypatch.setattr(impact, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(impact, "TASK_BLOCKS", 1)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(13, 200, 7))] + [(i, [1.0, i / 9]) for i in range(40)]
    assert impact._layout(240, 1480, 48, 4) == (3, 6)
    assert found(frame(rows)) == brute(rows, lambda i: i % 5 == 0, 5)
