"""Text quality by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` words. A passage is described by shares of
kinds of bytes, word lengths, and repetition inside it and in the text before it; an
encoder turns that into a vector. Gated attention gives each passage a weight, learned
from the labels of whole documents, and the weighted sum of the vectors is scored.

The model is fitted on a bounded sample, at most ``SAMPLE`` labelled documents of each
class, those with the smallest hashes of their ids; its bias is then set to the share of
the classes among all labelled documents that are not held out. Scoring reads whole
texts and nothing but texts.

Defined results: a null or empty text is a bag of one passage without words; if the
sample lacks a class every score is the share of label 1 (0.5 without labels). Several
labels of one id: the largest counts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens.llm.labels import not_held_out, training_rows
from costlens.llm.words import U64, Block, blocks, mix

PASSAGE = 64
SAMPLE = 2000
GOOD = 0.7
ENCODED, GATED = 24, 12
ROUNDS = 300

_KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"\n", b".?;:", b",", b"!", b"|", b"*#$%&@^~=+<>{}[]\\_", b"-'\"()/"]


def _kind_table() -> np.ndarray:
    out = np.full(256, len(_KINDS), np.int64)
    for i, own in enumerate(_KINDS):
        out[list(own)] = i
    return out


_TABLE = _kind_table()


def passages(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The row of each passage of a block, in order, and its description."""
    words = block.words()
    count = np.maximum(-(-words.counts // PASSAGE), 1)
    row = np.repeat(np.arange(block.rows), count)
    ordinal = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    first = words.first[row] + ordinal * PASSAGE
    size = np.minimum(words.first[row + 1] - first, PASSAGE)
    kinds = np.zeros((len(row), len(_KINDS) + 1))
    length, spread, again, fresh, early = (np.zeros(len(row)) for _ in range(5))
    if len(words.hashes):
        owner = np.repeat(np.arange(len(row)), size)
        # Bytes belong to the passage of the word before them.
        edge = words.starts[first[size > 0]]
        home = np.cumsum(np.bincount(edge, minlength=len(block.data) + 1)[:-1]) - 1
        home = np.flatnonzero(size > 0)[np.maximum(home, 0)]
        place = home * kinds.shape[1] + _TABLE[block.data]
        kinds = np.bincount(place, minlength=kinds.size).reshape(kinds.shape).astype(float)
        sizes = (words.ends - words.starts).astype(float)
        length = np.bincount(owner, sizes, len(row))
        spread = np.bincount(owner, sizes**2, len(row))
        same = np.zeros(len(owner))
        same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (words.row[1:] == words.row[:-1])
        again = np.bincount(owner, same, len(row))
        for keep, by in ((fresh, owner), (early, words.row)):
            new = np.unique(mix(words.hashes ^ mix(by.astype(U64))), return_index=True)[1]
            keep += np.bincount(owner[new], minlength=len(row))
    n = np.maximum(size, 1)
    total = np.maximum(kinds.sum(1), 1)[:, None]
    mean = length / n
    deviation = np.sqrt(np.maximum(spread / n - mean**2, 0))
    shares = [np.log1p(size) / np.log(PASSAGE + 1), mean, deviation, again / n, fresh / n, early / n]
    return row, np.hstack([np.stack(shares, axis=1), np.sqrt(kinds / total)])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    parts: dict = field(default_factory=dict)
    constant: float | None = None

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        """All steps from passages to scores; ``first``: the first passage of each bag."""
        p = self.parts
        h = np.tanh(x @ p["encode"] + p["encode_bias"])
        t, s = np.tanh(h @ p["look"]), 1 / (1 + np.exp(-(h @ p["gate"])))
        strength = (t * s) @ p["attend"]
        count = np.diff(np.append(first, len(x)))
        weight = np.exp(strength - np.repeat(np.maximum.reduceat(strength, first), count))
        weight /= np.repeat(np.add.reduceat(weight, first), count)
        bag = np.add.reduceat(h * weight[:, None], first, axis=0)
        logit = np.clip(bag @ p["score"] + p["score_bias"], -30, 30)
        return {"h": h, "t": t, "s": s, "weight": weight, "count": count, "bag": bag, "score": 1 / (1 + np.exp(-logit))}

    def prepared(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def score(self, block: Block) -> np.ndarray:
        if self.constant is not None:
            return np.full(block.rows, self.constant)
        row, x = passages(block)
        return self.forward(self.prepared(x), np.searchsorted(row, np.arange(block.rows)))["score"]


def _slopes(model: Model, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict:
    """Slopes of the mean log loss by each part, from the last step back to the first."""
    p, f = model.parts, model.forward(x, first)
    error = (f["score"] - y) / len(y)
    d_bag = np.repeat(error[:, None] * p["score"], f["count"], axis=0)
    d_weight = (f["h"] * d_bag).sum(1)
    pull = np.repeat(np.add.reduceat(f["weight"] * d_weight, first), f["count"])
    d_strength = f["weight"] * (d_weight - pull)
    d_look = np.outer(d_strength, p["attend"]) * f["s"] * (1 - f["t"] ** 2)
    d_gate = np.outer(d_strength, p["attend"]) * f["t"] * f["s"] * (1 - f["s"])
    d_h = f["weight"][:, None] * d_bag + d_look @ p["look"].T + d_gate @ p["gate"].T
    d_in = d_h * (1 - f["h"] ** 2)
    return {
        "score": f["bag"].T @ error,
        "score_bias": error.sum(),
        "attend": (f["t"] * f["s"]).T @ d_strength,
        "look": f["h"].T @ d_look,
        "gate": f["h"].T @ d_gate,
        "encode": x.T @ d_in,
        "encode_bias": d_in.sum(0),
    }


def fit(texts: list[str], good: list[bool], share: float = 0.5) -> Model:
    """Fit on labelled texts; ``share`` of label 1 among the documents to be scored."""
    y = np.array(good, float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0), np.ones(0), constant=share)
    rows, parts = [], []
    for at, block in blocks(pa.array(texts, pa.large_string())):
        row, x = passages(block)
        rows.append(row + at.start)
        parts.append(x)
    row, x = np.concatenate(rows), np.concatenate(parts)
    model = Model(x.mean(0), x.std(0) + 1e-3)
    x, first = model.prepared(x), np.searchsorted(row, np.arange(len(y)))
    draw = np.random.default_rng(1)
    shape = {"encode": (x.shape[1], ENCODED), "look": (ENCODED, GATED), "gate": (ENCODED, GATED)}
    model.parts = {k: draw.normal(0, s[0] ** -0.5, s) for k, s in shape.items()}
    model.parts |= {
        "encode_bias": np.zeros(ENCODED),
        "attend": draw.normal(0, GATED**-0.5, GATED),
        "score": draw.normal(0, ENCODED**-0.5, ENCODED),
        "score_bias": np.zeros(()),
    }
    step = {k: np.zeros_like(v) for k, v in model.parts.items()}
    speed = {k: np.zeros_like(v) for k, v in model.parts.items()}
    for turn in range(1, ROUNDS + 1):
        for k, slope in _slopes(model, x, first, y).items():
            slope = slope + 1e-4 * model.parts[k]
            step[k] = 0.9 * step[k] + 0.1 * slope
            speed[k] = 0.99 * speed[k] + 0.01 * slope**2
            pace = np.sqrt(speed[k] / (1 - 0.99**turn)) + 1e-8
            model.parts[k] = model.parts[k] - 0.02 * (step[k] / (1 - 0.9**turn)) / pace
    odds = lambda q: np.log(q / (1 - q))
    model.parts["score_bias"] = model.parts["score_bias"] + odds(np.clip(share, 0.01, 0.99)) - odds(y.mean())
    return model


def fit_on(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled documents whose id is not held out, as far as the bound goes."""
    use = not_held_out() & F.col("quality").isNotNull()
    share = labels.filter(use).agg(F.avg((F.col("quality") > 0).cast("double"))).first()[0]
    texts = training_rows(docs, labels.filter(use), "quality", {1: SAMPLE, 0: SAMPLE})
    return fit([t for t, _ in texts], [x for _, x in texts], 0.5 if share is None else float(share))


def quality(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The score of each whole text, between 0 and 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(shared.value.score(block) for _, block in blocks(column))]))

    return scored(F.col(text))
