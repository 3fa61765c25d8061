import numpy as np
import pyarrow as pa

from costlens.llm import quality as Q
from costlens.llm.words import blocks


def test_slopes_against_differences():
    rng = np.random.default_rng(0)
    x, first, y = rng.normal(0, 1, (9, 4)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])
    model = Q.Model(np.zeros(4), np.ones(4))
    model.parts = {
        "encode": rng.normal(0, 1, (4, 5)), "encode_bias": rng.normal(0, 1, 5), "look": rng.normal(0, 1, (5, 3)),
        "gate": rng.normal(0, 1, (5, 3)), "attend": rng.normal(0, 1, 3), "score": rng.normal(0, 1, 5), "score_bias": np.array(0.3),
    }

    def loss():
        s = model.forward(x, first)["score"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for name, slope in Q._slopes(model, x, first, y).items():
        part = model.parts[name]
        measured = np.zeros(part.shape)
        for at in np.ndindex(part.shape):
            kept = part[at]
            part[at] = kept + 1e-6
            up = loss()
            part[at] = kept - 1e-6
            measured[at] = (up - loss()) / 2e-6
            part[at] = kept
        assert np.allclose(slope, measured, atol=1e-6), name


def test_passages_of_a_text():
    text = " ".join(["word"] * 200)
    ((_, block),) = blocks(pa.array([text, "", None, "a b"]))
    row, x = Q.passages(block)
    assert row.tolist() == [0, 0, 0, 0, 1, 2, 3] and np.isfinite(x).all()
    assert x[1, 3] == 1 and x[0, 1] == 4 and x[4, 1] == 0  # repeated words, mean length
    alone = Q.passages(next(blocks(pa.array(["a b"])))[1])[1]
    assert np.allclose(alone[0], x[6])


def test_held_out_documents(table):
    docs, labels = table("documents"), table("labels")
    model = Q.fit_on(docs, labels)
    rows = docs.select("doc_id", Q.quality(docs, model).alias("score")).join(labels, "doc_id")
    rows = rows.filter("crc32(cast(doc_id as string)) % 4 = 2").collect()
    right = [(r.score >= Q.GOOD) == bool(r.quality) for r in rows]
    assert len(rows) > 80 and np.mean(right) > 0.95


def test_odd_rows_and_missing_labels(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (4, 0), (8, 1), (None, 1), (5, None)], "doc_id long, quality int")
    for known in (labels, labels.limit(0), labels.filter("quality = 1")):
        model = Q.fit_on(odd, known)
        scores = [r[0] for r in odd.select(Q.quality(odd, model)).collect()]
        assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    assert none.select(Q.quality(none, model)).count() == 0
