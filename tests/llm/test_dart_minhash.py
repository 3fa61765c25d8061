import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from costlens.llm import dart_minhash as D
from costlens.llm.components import components
from costlens.llm.words import U64, blocks, mix


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    size = min(5, len(words))
    return collections.Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else None


class Classes:
    def __init__(self, n):
        self.of = list(range(n))

    def find(self, x):
        while self.of[x] != x:
            x = self.of[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.of[max(a, b)] = min(a, b)


def brute(rows):
    """Smallest id of each row's class, by comparing all pairs that share a shingle."""
    rows = sorted(rows, key=lambda r: 2**63 - 1 if r[0] is None else r[0])
    sets, classes, holders, same = [shingles(t) for _, t in rows], Classes(len(rows)), collections.defaultdict(list), {}
    for i, (_, t) in enumerate(rows):
        classes.join(i, same.setdefault(t or "", i))
        for s in sets[i] or ():
            holders[s].append(i)
    pairs = {(a, b) for own in holders.values() for a in own for b in own if a < b}
    for a, b in pairs:
        if sum((sets[a] & sets[b]).values()) >= 0.8 * sum((sets[a] | sets[b]).values()):
            classes.join(a, b)
    return collections.Counter((rows[i][0], rows[classes.find(i)][0]) for i in range(len(rows)))


def ours(df):
    classes, links = D.near_duplicates(df)
    return collections.Counter((r.doc_id, r.class_id) for r in classes.collect()), links


def test_documents_against_brute_force(table, texts):
    found, links = ours(table("documents"))
    assert found == brute(list(texts.items()))
    assert links.filter("similarity < 0.8").isEmpty()


def test_chains_and_a_large_group(docs):
    rng = random.Random(5)
    rows, text = [], [f"w{i}" for i in range(120)]
    for i in range(60):  # each is near the one before, the ends are far apart
        text = text[:]
        text[rng.randrange(120)] = f"n{i}"
        rows.append((i, " ".join(text)))
    base = [f"b{i}" for i in range(150)]
    for i in range(250):
        own = base[:]
        for _ in range(rng.randint(0, 12)):
            own[rng.randrange(150)] = f"e{rng.random()}"
        rows.append((1000 + i, " ".join(own)))
    assert ours(docs(*rows))[0] == brute(rows)


def test_look_alikes_of_one_boilerplate(docs, monkeypatch):
    """Pairs just under 0.8 all around hide the few that are just above it."""
    monkeypatch.setattr(D, "NEXT", 1)  # as few neighbours as a far larger group would leave
    base = []
    for x, y, z in itertools.product(range(7), repeat=3):  # two texts leave out two sections in common at most
        out = [(x * g * g + y * g + z) % 7 for g in range(7)]
        kept = [(g, k) for g in range(7) for k in range(7) if k != out[g]]
        base.append([f"s{g}-{k}-{i}" for g, k in kept for i in range(20)])
    rows = [(2 * i, " ".join(words)) for i, words in enumerate(base)]
    for i in range(len(base)):  # planted partners, at 0.81
        words = base[i][:]
        for at in range(20, 820, 48):
            words[at] = f"p{i}-{at}"
        rows.append((2 * i + 1, " ".join(words)))
    assert ours(docs(*rows))[0] == collections.Counter((i, i // 2 * 2) for i, _ in rows)


def test_look_alikes_apart_do_not_go_on_in_pairs(docs, tmp_path, monkeypatch):
    """Texts of one boilerplate under 0.8 meet in all pairs; few of them go on to be counted, none that is similar is lost."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(400)]
    rows = []
    for i in range(120):
        words = base[:]
        for at in rng.sample(range(400), 9):
            words[at] = f"o{i}-{at}"
        rows.append((i, " ".join(words)))
        near = words[:]
        near[200] = f"n{i}"
        rows.append((1000 + i, " ".join(near)))
    df = docs(*rows)
    texts = df.select(F.col("doc_id").alias(D.ID), "text")
    members = df.select(F.lit(1).alias("key"), F.lit(0).alias("band"), F.col("doc_id").alias(D.ID), F.lit(1).alias("size"))
    none = df.sparkSession.createDataFrame([], "node long, root long")
    joined = []
    monkeypatch.setattr(D, "_met", lambda *args, met=D._met: joined.append(met(*args)) or joined[0])
    found = {tuple(r) for r in D._look_alikes(members, texts, none, 0.8, str(tmp_path)).collect()}
    grams = {i: shingles(t) for i, t in rows}

    def alike(a, b):
        return (grams[a] & grams[b]).total() >= 0.8 * (grams[a] | grams[b]).total()

    similar = {(a, b) for a, b in itertools.combinations(sorted(grams), 2) if alike(a, b)}
    assert len(similar) >= 120 and similar <= found
    pairs = joined[0].select(F.least(D.ID, f"{D.ID}_2"), F.greatest(D.ID, f"{D.ID}_2")).distinct().count()
    assert pairs < 2 * len(similar) < len(rows) * (len(rows) - 1) // 20


def test_odd_rows(odd, odd_rows, none):
    assert ours(odd)[0] == brute([r[:2] for r in odd_rows])
    assert not ours(none)[0]
    # Null and empty texts, blanks, "one", "two words", two passages, the long one, two more.
    assert D.near_duplicates(odd)[0].filter("keeps").distinct().count() == 8


def test_signatures_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(2)
    elements = mix(np.arange(300, dtype=U64))
    a, b = rng.gamma(1.0, 2.0, 300), rng.gamma(1.0, 2.0, 300)
    b[:200] = a[:200]
    rows = np.repeat([0, 1], 300)
    got = D.signatures(rows, np.concatenate([elements, elements]), np.concatenate([a, b]), 2, 4096)
    expected = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((got[0] == got[1]).mean() - expected) < 0.03


def test_signatures_do_not_depend_on_the_block():
    texts = ["a b c d e f g", "x", None, "a b c d e f h " * 50, "a b c d e f g"]
    alone, together = [], []
    for size, out in ((1, alone), (1 << 20, together)):
        for _, block in blocks(pa.array(texts), size):
            rows, found, counts = D.weighted(*D.shingles(block))
            out.append(D.signatures(rows, found, counts, block.rows, 64))
    assert (np.concatenate(alone) == np.concatenate(together)).all()
    assert (together[0][0] == together[0][4]).all() and not together[0][2].any()


def test_components(spark, tmp_path):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)]
    links += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)] + [(7, 7), (None, 3)]
    classes = Classes(400)
    for a, b in links:
        if a is not None:
            classes.join(a, b)
    found = components(spark.createDataFrame(links, "a long, b long"), str(tmp_path / "c"))
    got = {r.node: r.root for r in found.collect()}
    assert got == {i: classes.find(i) for i in range(400) if classes.find(i) != i}
    assert components(spark.createDataFrame([], "a long, b long"), str(tmp_path / "n")).count() == 0
