import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from costlens.llm import pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return P.Vocabulary.read(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def check(vocabulary, library, texts):
    ids, exact = P._encoded(vocabulary, pa.array(texts, pa.string()))
    assert ids.to_pylist() == library.encode([t or "" for t in texts])
    assert all(exact.to_pylist())


def test_documents_like_the_library(vocabulary, library, texts):
    check(vocabulary, library, list(texts.values()))


def test_odd_texts_like_the_library(vocabulary, library):
    odd = ["a    b", "   x", " " * 500 + "y", "a▁▁b", "x\x00y", "\t a", "é", "", None, " ", "\n", "\n\n a\n"]
    check(vocabulary, library, [*odd, "ab" * 3000, "日本語 テキスト🎉 ok", "".join(random.Random(2).choices("ainet", k=4000))])


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=40))
def test_any_text_like_the_library(text):
    vocabulary = test_any_text_like_the_library.__dict__.setdefault("v", P.Vocabulary.read(PATH))
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    check(vocabulary, library, [text])


def test_unigram_paths_against_all_paths():
    rng = random.Random(4)
    names = sorted({"".join(rng.choices("ab▁", k=rng.randint(1, 4))) for _ in range(60)} | {"a", "b", "▁"})
    names = [n for n in names if P.MARK not in n.lstrip(P.MARK)]
    scores = [-rng.random() * 8 for _ in names]
    vocabulary = P.Vocabulary(["<unk>", *names], [0.0, *scores], [2, *[1] * len(names)], P.UNIGRAM)
    score = dict(zip(names, scores, strict=True))

    def best(unit):
        top = [0.0] + [-np.inf] * len(unit)
        for e in range(1, len(unit) + 1):
            for b in range(e):
                gain = score.get(unit[b:e], min(scores) - 10 if e == b + 1 else -np.inf)
                top[e] = max(top[e], top[b] + gain)
        return top[-1]

    units = ["".join(rng.choices("abc", k=rng.randint(1, 12))) for _ in range(300)]
    data = np.frombuffer("".join(units).encode(), np.uint8)
    ends = np.cumsum([len(u) for u in units])
    flat, count = vocabulary.unit_ids(data, ends - np.diff(ends, prepend=0), ends)
    for unit, own in zip(units, np.split(flat, np.cumsum(count)[:-1]), strict=True):
        got = sum(min(scores) - 10 if i == 0 else scores[i - 1] for i in own.tolist())
        assert np.isclose(got, best(unit)), unit


def test_the_store_of_units_is_bounded(vocabulary, library, monkeypatch):
    monkeypatch.setattr(P, "KEPT_UNITS", 10)
    fresh = P.Encoder(vocabulary)
    for part in ("a b c d e f g h i j k l m", "n o p a b", "a b c"):
        ids, _ = fresh.encode(pa.array([part]))
        assert ids.tolist() == library.encode(part)
        assert len(fresh.known) <= 10 + 13


def test_round_trip_on_spark(spark, vocabulary, odd, odd_rows, none):
    found = odd.withColumn("found", P.encode(spark, vocabulary, F.col("text")))
    back = found.select("text", "found.ids", "found.exact", P.decode(spark, vocabulary, F.col("found.ids")).alias("back"))
    rows = back.collect()
    assert len(rows) == len(odd_rows) and all(r.exact and r.back == (r.text or "") for r in rows)
    assert all(r.ids == [] for r in rows if not r.text)
    assert none.select(P.encode(spark, vocabulary, F.col("text"))).count() == 0
    nothing = spark.createDataFrame([(None,)], "ids array<int>")
    assert nothing.select(P.decode(spark, vocabulary, F.col("ids"))).first()[0] is None


def test_unsupported_vocabularies():
    with pytest.raises(ValueError, match="boundary"):
        P.Vocabulary(["<unk>", "a▁b"], [0, -1], [2, 1], P.BPE)
    with pytest.raises(ValueError, match="supported"):
        P.Vocabulary(["<unk>", "a"], [0, -1], [2, 1], 3)


def long_texts(seed):
    """Texts without blanks: letters at random, words of texts run together, repeated parts, strange letters."""
    rng = random.Random(seed)
    words = "the of and informational processing de la straße können über niño 日本 語 x 12 , . -".split()
    for size in (1, 2, 127, 128, 129, 255, 256, 257, 1000):
        yield "".join(rng.choices("ainetroslh", k=size))
        yield "".join(rng.choices(words, k=size))[:size]
        yield "".join(map(chr, rng.choices(range(0x4E00, 0x9000), k=size)))
        yield rng.choice(["a", "ab", "aab", "=", "-=", "0", "ß", "日"]) * size
    yield "".join(rng.choices(["the", " ", "ing", "\n", "tion", "  "], k=3000)) + "z" * 500 + " " + "y" * 700


@pytest.mark.parametrize("around", [(4, 16), (1,), (0,), ()])
@pytest.mark.parametrize("part", [2, 17, 128])
def test_long_units_like_the_library(vocabulary, library, monkeypatch, part, around):
    """Cut at any place, repaired around the cuts or merged."""
    monkeypatch.setattr(P, "PART", part)
    monkeypatch.setattr(P, "AROUND", around)
    monkeypatch.setattr(vocabulary, "encoder", P.Encoder(vocabulary))
    check(vocabulary, library, list(long_texts(part)))


def test_texts_without_blanks_take_a_few_times_as_long_as_others(texts, library):
    """Not hundreds of times, as when each length is a matrix of its own."""
    rng = random.Random(1)
    plain = [t for t in texts.values() if t and t.isascii()][:150]
    joined = [t.replace(" ", "") for t in plain]
    chinese = ["".join(map(chr, rng.choices(range(0x4E00, 0x6000), k=700))) for _ in range(150)]
    one = ["".join(rng.choices("ainetroslhd", k=40_000))]
    seconds = []
    for some in (plain, joined, chinese, one):
        vocabulary = P.Vocabulary.read(PATH)
        start = time.process_time()
        ids, _ = P._encoded(vocabulary, pa.array(some))
        seconds.append((time.process_time() - start) / sum(len(t.encode()) for t in some) * 1e9)
        assert ids.to_pylist() == library.encode(some)
    assert max(seconds[1:]) < 12 * seconds[0], seconds
