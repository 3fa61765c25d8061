import json
import random

import public_tokenizers
from tokenizers import Tokenizer

from costlens.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


def counted(df, cache):
    found = T.count_tokens(df, T.Tokenizer(PATH), cache)
    return sorted((tuple(r) for r in found.collect()), key=repr)


def expected(rows):
    library = Tokenizer.from_file(PATH)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False))
    return sorted(((i, len((t or "").encode()), count(t)) for i, t in rows), key=repr)


def test_documents_like_the_library(table, texts, tmp_path):
    assert counted(table("documents"), str(tmp_path)) == expected(list(texts.items()))


def test_only_missing_texts_are_encoded(spark, docs, tmp_path, monkeypatch):
    cache = str(tmp_path)
    rows = [(1, "one text"), (2, "one text"), (3, "<|endoftext|> two"), (4, None), (5, "")]
    assert counted(docs(*rows), cache) == expected(rows)
    tokenizer = T.Tokenizer(PATH)
    assert T.read_cache(spark, cache, tokenizer.version).count() == 3
    stored = lambda: spark.read.schema(T._COUNTS).parquet(f"{cache}/version={tokenizer.version}").count()
    more = [*rows, (6, "a third one"), (7, "one text")]
    assert counted(docs(*more), cache) == expected(more)
    assert stored() == 4
    counted(docs(*more), cache)
    assert stored() == 4
    # Another version has counts of its own.
    other = T.Tokenizer(PATH)
    other.version = "other"
    assert T.read_cache(spark, cache, "other").count() == 0
    T.fill_cache(docs((1, "one text")), other, cache)
    assert T.read_cache(spark, cache, "other").count() == 1 and stored() == 4


def test_stored_counts_are_used(spark, docs, tmp_path):
    tokenizer = T.Tokenizer(PATH)
    text = docs((1, "a b c"))
    known = text.select(T._digest("text").alias(T.DIGEST)).selectExpr(f"{T.DIGEST}", "99L as n_tokens")
    known.write.parquet(f"{tmp_path}/version={tokenizer.version}")
    assert counted(text, str(tmp_path)) == [(1, 5, 99)]


def test_odd_rows(odd, odd_rows, none, tmp_path):
    assert counted(odd, str(tmp_path / "a")) == expected([r[:2] for r in odd_rows])
    assert counted(none, str(tmp_path / "b")) == []


def test_units_count_like_whole_texts(texts, monkeypatch):
    """Also where white space, added tokens and letters outside of Latin meet, and with a full memory."""
    library = T.Tokenizer(PATH).load()
    units, whole = T.UnitCounts(library), T.WholeCounts(library)
    rng = random.Random(2)
    parts = [*" \t\n  aé'sß日٣²1,.!<|>", "\u00a0", "\u0085", "\u2003", "\u200b", "\x1c", "<|endoftext|>", "'ll", " don't", "a" * 90]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    assert units.count(odd) == whole.count(odd)
    assert units.known and all(len(u) <= units.LONGEST for u in units.known)
    monkeypatch.setattr(T.UnitCounts, "MOST", 50)
    some = [t or "" for t in list(texts.values())[:50]]
    for at in range(0, 50, 7):
        assert units.count(some[at : at + 7]) == whole.count(some[at : at + 7])
    assert len(units.known) <= 50


def test_units_are_for_byte_level_tokenizers_only():
    content = T.Tokenizer(PATH).content
    assert T.UnitCounts.fits(content)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": None}):
        assert not T.UnitCounts.fits(json.dumps(json.loads(content) | change))


def test_other_tokenizers_count_whole_texts(spark, docs, tmp_path):
    made = json.loads(T.Tokenizer(PATH).content)
    made["normalizer"] = {"type": "Lowercase"}
    path = tmp_path / "lower.json"
    path.write_text(json.dumps(made))
    found = T.count_tokens(docs((1, "SOME Text HERE")), T.Tokenizer(str(path)), str(tmp_path / "c")).collect()
    expected = len(Tokenizer.from_file(str(path)).encode("SOME Text HERE", add_special_tokens=False))
    assert [tuple(r) for r in found] == [(1, 14, expected)]
