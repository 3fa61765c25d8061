import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from costlens.llm import divergence as d
from costlens.llm.packed import unpack, unpack_sorted
from costlens.llm.transducer import Transducer

LOWER = str.maketrans({chr(x): chr(x + 32) for x in range(65, 91)})


def brute(rows, min_docs=3, top=200):
    groups, docs = set(), defaultdict(Counter)
    counts, total = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups.add((lang, source))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        total[lang].update(terms)
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def share(own, t):
            return 1 + 10**9 * (own[t] + 1) // (sum(own[x] for x in kept) + len(kept))  # noqa: B023

        sources = [s for x, s in groups if x == lang]
        p = {s: {t: share(counts[lang, s], t) for t in kept} for s in sources}
        q = {t: share(total[lang], t) for t in kept}
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in sources if o != s]
            more = [t for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in more]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, x.decode(), -v, i) for i, (v, x) in enumerate(found, 1)]
    return sorted(out)


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, "lang string, source string, text string")


def found(df, **kwargs):
    return sorted(tuple(r) for r in d.divergence(df, **kwargs).collect())


def texts(seed, count, words=60):
    rng = random.Random(seed)
    names = ["".join(rng.choice("abcÄéß日z") for _ in range(rng.randint(1, 5))) for _ in range(words)]
    for _ in range(count):
        text = "".join(rng.choice(names) + rng.choice([" ", "1", "-", "\x00", "[]", "\n"]) for _ in range(rng.randint(0, 30)))
        yield rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", None, "a"]), text.upper() if rng.random() < 0.3 else text


def test_random_texts_against_brute_force(frame):
    rows = [*texts(1, 250), ("xx", "a", "1 2 3"), ("xx", "b", None), ("yy", "alone", "a a a")]
    assert found(frame(rows).repartition(4)) == brute(rows)
    assert found(frame(rows), min_docs=1, top=5) == brute(rows, 1, 5)


def test_ranges_blocks_and_dealt_terms_change_nothing(frame, monkeypatch, spark):
    rows = list(texts(2, 250, words=300))
    monkeypatch.setattr(d, "RANGE_TERMS", 7)
    monkeypatch.setattr(d, "MAX_RANGES", 20)
    monkeypatch.setattr(d, "BLOCK_BYTES", 200)
    monkeypatch.setattr(d, "PAIR_TERMS", 5)
    assert found(frame(rows)) == brute(rows)
    monkeypatch.setattr(d, "MAX_BROADCAST", 0)
    monkeypatch.setattr(d, "_GROUP_ROWS", 3)
    assert found(frame(rows)) == brute(rows)


def test_terms_with_one_long_start_stay_in_one_range(frame, monkeypatch):
    monkeypatch.setattr(d, "RANGE_TERMS", 2)
    monkeypatch.setattr(d, "MAX_BROADCAST", 0)
    rows = [("en", s, " ".join("q" * 70 + x for x in "abcdefgh") + " a z") for s in "abc"]
    assert found(frame(rows)) == brute(rows)


@pytest.mark.parametrize("max_broadcast", [None, 0])
def test_counts_travel_as_one_packed_row_for_each_block_of_ordinals(frame, monkeypatch, spark, max_broadcast):
    monkeypatch.setattr(d, "BLOCK_BYTES", 300)
    monkeypatch.setattr(d, "PAIR_TERMS", 50)
    rows = [(x or "", y or "", t) for x, y, t in texts(5, 250, words=300)]
    folder = d.scratch_dir(spark)
    docs = frame(rows).repartition(4)
    ranges = d.vocabulary(docs, 3, folder).cache()
    cells = d.recount(docs, ranges, folder, max_broadcast).collect()
    sizes = {r.lang: r.size for r in ranges.groupBy("lang").agg(d.F.sum("n_terms").alias("size")).collect()}
    blocks = [(lang, b) for lang, size in sizes.items() for b in range(-(-size // 50))]
    assert sorted((r.lang, r.block) for r in cells) == sorted(blocks)
    counts = defaultdict(Counter)
    for lang, source, text in rows:
        counts[lang, source].update(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER)))
    names = {(r.lang, r.base + i): t for r in ranges.collect() for i, t in enumerate(r.terms)}
    found = {}
    for r in cells:
        code, count = unpack_sorted(pa.scalar(bytes(r.cells))), unpack(pa.scalar(bytes(r.counts)))
        for c, n in zip(code.tolist(), count.tolist(), strict=True):
            found[r.lang, r.sources[c // 50], names[r.lang, r.block * 50 + c % 50]] = n
        assert sum(r.totals) == count.sum()
    kept = {(lang, term) for (lang, _), term in names.items()}
    assert found == {(x, y, t): n for (x, y), own in counts.items() for t, n in own.items() if (x, t) in kept}


def test_a_block_deals_one_packed_row_to_each_range(frame, monkeypatch, spark):
    monkeypatch.setattr(d, "RANGE_TERMS", 40)
    rows = [(x or "", y or "", t) for x, y, t in texts(6, 250, words=300)]
    folder = d.scratch_dir(spark)
    docs = frame(rows).coalesce(1)
    ranges = d.vocabulary(docs, 3, folder)
    d.recount(docs, ranges, folder, 0).collect()
    dealt = [r.range for r in spark.read.parquet(f"{folder}/dealt").collect()]
    assert sorted(dealt) == sorted(r.range for r in ranges.collect())
    assert len(dealt) > 3


def test_packs_of_several_texts_and_sources_add_up():
    def packs(*cells):
        source, ordinal, count = (np.array(x) for x in zip(*cells, strict=True))
        return d._packs("en", pa.array(["a", "b", "c"]), source, ordinal, count, 4)

    one = packs((0, 1, 2**40), (2, 3, 5), (2, 9, 1))
    two = packs((1, 1, 7), (0, 1, 3), (1, 0, 2))
    batches = [one.slice(0, 1), two, one.slice(1)]  # by block, in several batches
    first, second = [b.to_pylist()[0] for b in d._add_packs(4)(batches)]
    assert (first["block"], first["sources"], first["totals"]) == (0, ["a", "c", "b"], [2**40 + 3, 5, 9])
    assert unpack_sorted(pa.scalar(first["cells"])).tolist() == [1, 7, 8, 9]
    assert unpack(pa.scalar(first["counts"])).tolist() == [2**40 + 3, 5, 2, 7]
    assert (second["block"], second["sources"], second["totals"]) == (2, ["a", "c"], [0, 1])
    assert list(d._add_packs(4)([])) == []


def test_shares_of_arrays_are_exact_beyond_64_bits():
    count, total, size = np.array([123_456_789_012_345, 0]), np.array([987_654_321_098_765, 2**62]), 55_555
    exact = [1 + 10**9 * (c + 1) // (n + size) for c, n in zip(count.tolist(), total.tolist(), strict=True)]
    assert d._shares(count, total, size).tolist() == exact
    least = np.array([d._EXACT - 1])
    assert d._shares(least, least, 1).tolist() == [1 + 10**9]


def test_hot_source_and_long_text(frame):
    rows = [("en", "hot", "the same few words")] * 400 + [("en", "b", " ".join("abcdefghij"[i % 10] * (i % 7 + 1) for i in range(50_000)))] * 3
    rows += [("en", "c", "x" * 300_000)] * 3
    assert found(frame(rows).repartition(8)) == brute(rows)


def test_odd_rows(odd, odd_rows, none):
    df = odd.withColumnsRenamed({"row": "lang", "starts": "source"})
    rows = [("x" if r[3] == "x" else r[3], r[6], r[1]) for r in odd_rows]
    assert found(df) == brute(rows)
    empty = d.divergence(none.withColumnsRenamed({"row": "lang", "starts": "source"}))
    assert empty.collect() == []
    assert " ".join(f"{c} {t}" for c, t in empty.dtypes) == "lang string source string part string item string value bigint rank int"


def test_share_is_exact_beyond_64_bits(spark):
    count, total, size = 123_456_789_012_345, 987_654_321_098_765, 55_555
    df = spark.createDataFrame([(count, total, size)], "c long, t long, s long")
    got = df.select(d.probability(d.F.col("c"), d.F.col("t"), d.F.col("s")).alias("p")).first().p
    assert got == 1 + 10**9 * (count + 1) // (total + size)


def spans(terms):
    ends = np.cumsum([len(t) for t in terms])
    return np.frombuffer(b"".join(terms), np.uint8), ends - [len(t) for t in terms], ends


def test_transducer_gives_ordinals_and_is_minimal():
    rng = random.Random(4)
    terms = sorted({bytes(rng.choice(b"ab\xc3") for _ in range(rng.randint(0, 7))) for _ in range(400)})
    made = Transducer.load(Transducer.build(terms).dump())
    assert made.ordinals(*spans(terms)).tolist() == list(range(len(terms)))
    known, probes = set(terms), [bytes(rng.choice(b"ab\xc3z") for _ in range(rng.randint(0, 9))) for _ in range(500)]
    assert [x >= 0 for x in made.ordinals(*spans(probes))] == [p in known for p in probes]
    # as many states as there are different sets of rests
    rests = defaultdict(set)
    for t in terms:
        for i in range(len(t) + 1):
            rests[t[:i]].add(t[i:])
    assert len(made.final) == len({frozenset(x) for x in rests.values()})
    with pytest.raises(ValueError):
        Transducer.build([b"b", b"a"])
    assert Transducer.build([]).ordinals(*spans([b"a", b""])).tolist() == [-1, -1]
