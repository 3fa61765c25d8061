import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from costlens.llm import toxicity as X
from costlens.llm.labels import training_rows
from costlens.llm.words import blocks


def enumerate_paths(evidence, moves):
    """Marginals and expected moves by adding up all paths."""
    total, toxic, expected = 0.0, np.zeros(len(evidence)), np.zeros((2, 2))
    for path in itertools.product((0, 1), repeat=len(evidence)):
        weight, last, used = 1.0, 0, np.zeros((2, 2))
        for state, e in zip(path, evidence, strict=True):
            weight *= np.exp(moves[last, state] + state * e)
            used[last, state] += 1
            last = state
        total += weight
        toxic += weight * np.array(path)
        expected += weight * used
    return toxic / total, expected / total


def test_marginals_against_all_paths():
    rng = np.random.default_rng(0)
    moves, parts = rng.normal(0, 1, (2, 2)), [rng.normal(0, 2, n) for n in (3, 1, 9, 0, 5)]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    p, moved = X.marginals(np.concatenate(parts), first, moves)
    each = [enumerate_paths(part, moves) for part in parts if len(part)]
    assert np.allclose(p, np.concatenate([x for x, _ in each]))
    assert np.allclose(moved, sum(x for _, x in each))


def test_segments_make_no_difference(monkeypatch):
    rng = np.random.default_rng(1)
    evidence, first, moves = rng.normal(-1, 3, 1000), np.array([0, 700, 701, 1000]), rng.normal(0, 2, (2, 2))
    found = [(monkeypatch.setattr(X, "SEGMENT", s), X.marginals(evidence, first, moves))[1] for s in (2, 7, 64, 2000)]
    for p, moved in found[1:]:
        assert np.allclose(p, found[0][0]) and np.allclose(moved, found[0][1])


def corpus(n, seed, bad=("idiot", "moron", "lowei")):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abdefghiknorstu"), rng.integers(2, 9))) for _ in range(400)]
    texts, toxic = [], []
    for i in range(n):
        own = list(rng.choice(words, rng.integers(1, 60)))
        if i % 3 == 0:
            stem = bad[rng.integers(len(bad))]
            own.insert(rng.integers(len(own) + 1), stem + (rng.choice(words) if stem == "lowei" else rng.choice(["", ",", "!"])))
        texts.append(" ".join(own))
        toxic.append(i % 3 == 0)
    return texts, toxic


def test_spans_of_words_and_of_unseen_endings():
    texts, toxic = corpus(600, 0)
    model = X.fit(texts[:400], toxic[:400])
    block = next(blocks(pa.array([*texts[400:], "Ünd so. IDIOT! loweizzz", "fine", "", None])))[1]
    score, spans = X.score_block(model, block)
    truth = np.array(toxic[400:])
    assert ((score[:200] >= X.REJECT) == truth).mean() > 0.97
    marked = block.text(200)
    assert [marked[s["start"] : s["end"]].decode() for s in spans[200]] in (["IDIOT", "loweizzz"], ["IDIOT! loweizzz"])
    assert score[201] < X.REJECT and score[202] == score[203] == 0 and spans[202] == []


def test_held_out_documents(table):
    docs, labels = table("documents"), table("labels")
    model = X.fit_on(docs, labels)
    found = docs.select("doc_id", X.toxicity(docs, model)["score"].alias("score"))
    rows = found.join(labels, "doc_id").filter("crc32(cast(doc_id as string)) % 4 = 2").collect()
    right = [(r.score >= X.REJECT) == bool(r.toxic) for r in rows]
    assert len(rows) > 80 and np.mean(right) > 0.9


def test_odd_rows_and_missing_labels(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0), labels.filter("toxic = 0")):
        model = X.fit_on(odd, known)
        rows = odd.select("doc_id", X.toxicity(odd, model).alias("t")).collect()
        assert len(rows) == odd.count() and all(0 <= r.t.score <= 1 for r in rows)
        assert all(r.t.score == 0 and r.t.spans == [] for r in rows if r.doc_id in (0, 1, 2))
    assert none.select(X.toxicity(none, X.Model())["score"]).count() == 0
    assert X.fit_on(none, labels).known.size == 0


def test_marks_that_clean_texts_quote(spark):
    """Clean texts that quote some or all of the marks do not hide them."""
    texts, toxic = corpus(400, 1)
    bad = "idiot moron lowei".split()
    held_texts, held_toxic = corpus(200, 9)
    for quotes in (1, 10):
        every = " ".join(sorted({w for t, x in zip(texts, toxic, strict=True) if x for w in t.split() if any(b in w.lower() for b in bad)}))
        for quote in ("they said idiot moron lowei", every):
            model = X.fit(texts + [f"{quote} and {i}" for i in range(quotes)], toxic + [False] * quotes)
            score = np.concatenate([X.score_block(model, b)[0] for _, b in blocks(pa.array(held_texts))])
            found = (score >= X.REJECT)[np.array(held_toxic)]
            assert found.mean() >= 0.9, (quotes, quote[:30], found.mean())


def test_a_sample_without_marks_is_an_error():
    same = [f"the same words {i % 3}" for i in range(60)]
    with pytest.raises(ValueError, match="nothing tells"):
        X.fit(same * 2, [True] * 60 + [False] * 60)
    assert not len(X.fit(same[:4], [True, True, False, False]).known)  # too few to say


def test_an_id_with_very_many_rows_hides_no_other(spark, table):
    docs, labels = table("documents").select("doc_id", "text"), table("labels")
    hot = labels.filter("toxic = 0 and crc32(cast(doc_id as string)) % 4 <> 2").first().doc_id
    many = spark.range(20_000).select(F.lit(hot).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    sizes = {1: 100, 0: 100}
    plain, with_hot = (training_rows(d, labels, "toxic", sizes) for d in (docs, docs.unionByName(many)))
    assert sum(x for _, x in plain) == sum(x for _, x in with_hot) > 0
    assert len(with_hot) in (len(plain), len(plain) + 1)
    assert with_hot == training_rows(docs.unionByName(many).repartition(7), labels, "toxic", sizes)


def test_the_sample_stays_off_the_driver(table, monkeypatch):
    """The texts are fitted in a task and the model is that of the same texts."""
    docs, labels = table("documents"), table("labels")
    texts = training_rows(docs, labels, "toxic", {1: X.TOXIC_SAMPLE, 0: X.CLEAN_SAMPLE})
    plain = X.fit([t for t, _ in texts], [x for _, x in texts])

    def not_here(*_):
        raise AssertionError("fitted on the driver")

    monkeypatch.setattr(X, "_marks", not_here)
    model = X.fit_on(docs, labels)
    assert len(plain.known) and (model.known == plain.known).all() and (model.weights == plain.weights).all()
    assert (model.moves == plain.moves).all() and model.bias == plain.bias


def test_a_sample_without_marks_is_an_error_on_tables_too(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("the same words "), F.col("id") % 3).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    texts = docs.withColumn("text", F.concat("text", F.repeat(F.lit(" "), F.col("doc_id").cast("int"))))
    with pytest.raises(ValueError, match="nothing tells"):
        X.fit_on(texts, labels)
