import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from costlens.llm import collocations as c

LOWER = str.maketrans({chr(x): chr(x + 32) for x in range(65, 91)})


def brute(rows, max_words=3, min_count=10, top=2000, inside_pct=50):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        gone = set()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * a >= inside_pct * counts[p[i : i + k]]:
                        gone.add(p[i : i + k])
        ranked = []
        for p in found.keys() - gone:
            a = counts[p]
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(ranked)[:top], 1):  # noqa: E741
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, "lang string, text string")


def found(df, **kwargs):
    return sorted(tuple(r) for r in c.collocations(df, **kwargs).collect())


def texts(seed, count, letters="abcdef"):
    rng = random.Random(seed)
    for _ in range(count):
        words = [rng.choice(letters) + rng.choice(["", "", "Ä", "É"]) for _ in range(rng.randint(0, 30))]
        yield rng.choice(["en", "en", "de", None, ""]), "".join(w + rng.choice([" ", "  ", "\t", ". ", ",", "\n"]) for w in words)


def test_random_texts_against_brute_force(frame):
    rows = list(texts(1, 300))
    for limits in ({"min_count": 3, "top": 50}, {"min_count": 2, "max_words": 5, "inside_pct": 80}, {"max_words": 2}):
        assert found(frame(rows).repartition(5), **limits) == brute(rows, **limits)


def test_small_chunks_and_many_buckets_change_nothing(frame, monkeypatch):
    rows = list(texts(2, 200))
    monkeypatch.setattr(c, "CHUNK_BYTES", 256)
    monkeypatch.setattr(c, "BUCKET_ENTRIES", 20)
    assert found(frame(rows), min_count=2) == brute(rows, min_count=2)


def test_pieces_end_phrases_and_overlaps_count(frame):
    rows = [("en", "A b. a;b a\nb a\x0bb ! a\tB")] * 10 + [("en", "x x x x")] * 4
    assert found(frame(rows)) == brute(rows)
    phrases = {r[2]: r[3] for r in found(frame(rows))}
    assert phrases["x x"] == 12 and phrases["a b"] == 20 and "b a b" not in phrases


def test_phrases_inside_longer_ones_go(frame):
    rows = [("en", "new york city")] * 12 + [("en", "new york")] * 12 + [("en", "york city hall")] * 11
    got = [r[2] for r in found(frame(rows))]
    assert "new york" not in got and "york city" not in got and "new york city" in got
    assert found(frame(rows)) == brute(rows)


def test_hot_phrase_and_long_text(frame):
    rows = [("en", "the same words " * 20)] * 300 + [(None, " ".join(f"w{i % 97}" for i in range(100_000)))]
    assert found(frame(rows).repartition(8)) == brute(rows)


def test_odd_rows(odd, odd_rows, none):
    df = odd.withColumnsRenamed({"row": "lang"})
    rows = [(r[3], r[1]) for r in odd_rows]
    assert found(df, min_count=2) == brute(rows, min_count=2)
    empty = c.collocations(none.withColumnsRenamed({"row": "lang"}))
    assert empty.collect() == []
    kinds = "lang string rank bigint phrase string a bigint l bigint r bigint n bigint score bigint"
    assert " ".join(f"{x} {t}" for x, t in empty.dtypes) == kinds
    with pytest.raises(ValueError):
        c.collocations(none.withColumnsRenamed({"row": "lang"}), max_words=1)


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000_000
    df = spark.createDataFrame([(big, [big + 1, big], [big + 7, big])], "n long, heads array<long>, tails array<long>")
    cut = df.select(c._lowest_cut(2, c.F.col("n")).alias("cut")).first().cut
    assert tuple(cut) == (10**6 * big * big // ((big + 1) * (big + 7)), 1, big + 1, big + 7)


def test_merge_join_meets_adjacent_places_only():
    places, ids = np.array([1, 2, 3, 5, 6, 9]), np.array([7, 8, 7, 7, 8, 8])
    at, keys = c.merge_join(places, ids)
    assert at.tolist() == [1, 2, 5] and keys.tolist() == [7 << 32 | 8, 8 << 32 | 7, 7 << 32 | 8]
