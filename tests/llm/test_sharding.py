import collections
import hashlib
import random
import zlib

import pytest

from costlens.llm import sharding as S


def brute(rows, shards, load=None):
    """Key by key: rounds in which shards take keys in ring order, the others walk on."""
    order = lambda r: (
        hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest(),
        (r[0] is not None, r[0]),
        len((r[1] or "").encode()),
        zlib.crc32((r[1] or "").encode()),
    )
    nodes = S.ring(shards)
    free, taken, out = S.bounds(len(rows), shards, load), [0] * shards, []
    waiting = []
    for row in sorted(rows, key=order):
        cell = int(order(row)[0][:4], 16)
        at = next((i for i, n in enumerate(nodes) if n[0] >= cell), 0)
        waiting.append((row, at))
    while waiting:
        over = []
        for row, at in waiting:
            shard = nodes[at][1]
            if free[shard]:
                free[shard] -= 1
                out.append((row[0], len((row[1] or "").encode()) + 1, zlib.crc32((row[1] or "").encode()), shard, taken[shard]))
                taken[shard] += 1
            else:
                over.append((row, at))
        waiting = []
        for row, at in over:
            while not free[nodes[at][1]]:
                at = (at + 1) % len(nodes)
            waiting.append((row, at))
    return collections.Counter(out)


def ours(df, **kwargs):
    return collections.Counter(tuple(r) for r in S.assign(df, **kwargs).collect())


def test_random_keys_against_brute_force(docs):
    rng = random.Random(0)
    rows = [(rng.randrange(500), rng.choice(["a", "bb", "ü", None])) for _ in range(700)] + [(9, "hot")] * 300
    for kwargs in ({"shards": 16}, {"shards": 3}, {"shards": 7, "load": 1.1}):
        found = ours(docs(*rows).repartition(3), **kwargs)
        assert found == brute(rows, kwargs["shards"], kwargs.get("load"))
        by_shard = collections.Counter(s for *_, s, _ in found.elements())
        assert set(by_shard) <= set(range(kwargs["shards"]))
        for shard, n in by_shard.items():
            assert sorted(slot for *_, s, slot in found.elements() if s == shard) == list(range(n))
        if "load" not in kwargs:
            assert max(by_shard.values()) - min(by_shard.values()) <= 1


def test_few_keys_move_when_a_shard_comes():
    counts = {int(hashlib.md5(str(i).encode()).hexdigest()[:4], 16): 1 for i in range(5000)}
    place = lambda n: {c: s for c, _, _, s, _ in S.plan(counts, n, load=1.25)}
    before, after = place(16), place(17)
    moved = sum(before[c] != after[c] for c in before)
    assert moved < len(before) * 0.2
    with pytest.raises(ValueError):
        S.plan(counts, 4, load=0.5)


def test_documents(table, texts):
    assert ours(table("documents")) == brute(list(texts.items()), 16)


def test_odd_rows(odd, odd_rows, none):
    assert ours(odd) == brute([r[:2] for r in odd_rows], 16)
    assert not ours(none)


def test_no_python_on_executors(table):
    plan = S.assign(table("documents"))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "InArrow"))
