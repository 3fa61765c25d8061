"""Toxic spans by a linear-chain conditional random field.

*Labelled tokens.* Labels exist per document. A word form or a prefix of one marks
toxicity if a far larger share of toxic than of clean documents hold it (some clean ones
may quote it; the fitted weights settle what it then says), and if it is needed to explain
the toxic ones: a document shares one vote among all its candidates, so what only a
group of near copies has in common gets next to none. Tokens of toxic documents
that carry a mark are labelled toxic, all others clean.

*Model.* Two states (clean, toxic); a token's evidence is the sum of the weights of
its lower-case form and of its prefixes; two by two transitions. It is fitted by
maximum likelihood on a bounded sample: at most ``TOXIC_SAMPLE`` and ``CLEAN_SAMPLE``
labelled documents, those with the smallest hashes of their ids, in one task.

*Scoring.* Forward-backward marginals of every token of every whole text, in blocks. A
document's score is the largest marginal of its tokens, its spans are the runs of
tokens whose marginal is at least one half, as byte offsets in UTF-8.

Defined results: a null or empty text, and any text if the sample lacks a class, has
score 0 and no spans. Several labels of one id: toxic if one says so. A sample with enough
toxic texts and no mark is an error, as no text could be rejected then.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens.llm.labels import in_order, sample
from costlens.llm.words import LETTER, U64, Block, blocks, lower_latin, signed, span_hash

TOXIC_SAMPLE = 1200
CLEAN_SAMPLE = 2400
PREFIXES = (4, 5, 6, 8)
SEGMENT = 64
ROUNDS = 30
REJECT = 0.3
MARK_VOTES, MARK_SHARE = 0.75, 0.001
PURE_RATIO = 0.002  # clean texts for each toxic one that hold a mark
MARK_RATIO = 0.2  # the same of shares, smoothed, for marks of toxic texts without a purer one
MOST_QUOTES = 5  # marked tokens of a clean text that is learnt from
FEWEST = 20  # toxic texts from which on a sample without any mark is an error
FIT_BYTES = 1 << 18


# --- tokens and features --------------------------------------------------------


def features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the letter runs of a block, and the feature hashes of each.

    The first feature is the word; 0 stands for a prefix that the token is too short for.
    """
    starts, ends, row = block.tokens(~LETTER)
    sums = block.prefix_sums(lower_latin(block.data))
    hashes = np.zeros((len(PREFIXES) + 1, len(starts)), U64)
    hashes[0] = span_hash(sums, starts, ends)
    hashes[0] ^= U64(1)
    for i, n in enumerate(PREFIXES, 1):
        long = np.flatnonzero(ends - starts >= n)
        hashes[i, long] = span_hash(sums, starts[long], starts[long] + n)
    return starts, ends, row, hashes


# --- the chain --------------------------------------------------------------------


def _segments(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and length of each segment, and its ordinal within its row."""
    lengths = np.diff(first)
    per_row = -(-lengths // SEGMENT)
    ordinal = np.arange(per_row.sum()) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    begin = np.repeat(first[:-1], per_row) + ordinal * SEGMENT
    return begin, np.minimum(np.repeat(first[1:], per_row) - begin, SEGMENT), ordinal


def marginals(evidence: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of the toxic state at each token, and the expected moves between states.

    ``evidence`` is the log odds from a token's own features, ``first`` where each row
    begins (and the last ends), ``moves`` the log potentials of the moves. Rows are cut
    into segments whose products of matrices are made for all segments together, so the
    number of steps follows the segment length and the longest row's segments, not words.
    """
    n = len(evidence)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    a, e = np.exp(moves), np.exp(np.clip(evidence, -30, 30))
    begin, length, ordinal = _segments(first)
    count = len(begin)
    at = np.minimum(begin[None, :] + np.arange(SEGMENT)[:, None], n - 1)
    inside = np.arange(SEGMENT)[:, None] < length[None, :]
    grid = e[at]

    product = np.zeros((2, 2, count))
    product[0, 0] = product[1, 1] = 1
    for t in range(SEGMENT):
        p0 = product[:, 0] * a[0, 0] + product[:, 1] * a[1, 0]
        p1 = (product[:, 0] * a[0, 1] + product[:, 1] * a[1, 1]) * grid[t]
        scale = 1 / (p0.max(0) + p1.max(0))
        product[:, 0] = np.where(inside[t], p0 * scale, product[:, 0])
        product[:, 1] = np.where(inside[t], p1 * scale, product[:, 1])

    enter, leave = np.zeros((2, count)), np.ones((2, count))
    enter[0] = 1  # before the first word the state is clean
    levels = _by_level(ordinal)
    for own in levels[1:]:
        before = own - 1
        v = enter[0, before] * product[0][:, before] + enter[1, before] * product[1][:, before]
        enter[:, own] = v / v.sum(0)
    for own in reversed(levels[1:]):
        v = product[:, 0][:, own] * leave[0, own] + product[:, 1][:, own] * leave[1, own]
        leave[:, own - 1] = v / v.sum(0)

    ahead = np.empty((2, SEGMENT, count))
    f0, f1 = enter
    for t in range(SEGMENT):
        g0 = f0 * a[0, 0] + f1 * a[1, 0]
        g1 = (f0 * a[0, 1] + f1 * a[1, 1]) * grid[t]
        total = g0 + g1
        f0, f1 = np.where(inside[t], g0 / total, f0), np.where(inside[t], g1 / total, f1)
        ahead[0, t], ahead[1, t] = f0, f1
    back = np.empty((2, SEGMENT, count))
    b0, b1 = leave
    for t in reversed(range(SEGMENT)):
        back[0, t], back[1, t] = b0, b1
        c0 = a[0, 0] * b0 + a[0, 1] * grid[t] * b1
        c1 = a[1, 0] * b0 + a[1, 1] * grid[t] * b1
        total = c0 + c1
        b0, b1 = np.where(inside[t], c0 / total, b0), np.where(inside[t], c1 / total, b1)

    toxic = ahead[1] * back[1]
    toxic /= toxic + ahead[0] * back[0]
    out = np.empty(n)
    out[at[inside]] = toxic[inside]

    before0 = np.concatenate([enter[0][None], ahead[0, :-1]])
    before1 = np.concatenate([enter[1][None], ahead[1, :-1]])
    joint = np.stack(
        [
            before0 * a[0, 0] * back[0],
            before0 * a[0, 1] * grid * back[1],
            before1 * a[1, 0] * back[0],
            before1 * a[1, 1] * grid * back[1],
        ]
    )
    joint = np.where(inside, joint / joint.sum(0), 0)
    return out, joint.sum((1, 2)).reshape(2, 2)


def _by_level(ordinal: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(ordinal, kind="stable")
    return np.split(order, np.cumsum(np.bincount(ordinal))[:-1])


# --- fitting ----------------------------------------------------------------------


@dataclass
class Model:
    """Weights of the features that labelled toxic tokens have; all others weigh nothing."""

    known: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))  # sorted hashes
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    bias: float = 0.0

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are known, and their places."""
        maybe = np.flatnonzero(self._sieve[hashes >> U64(44)])
        place = np.minimum(np.searchsorted(self.known, hashes[maybe]), len(self.known) - 1)
        hit = self.known[place] == hashes[maybe]
        return maybe[hit], place[hit]

    @cached_property
    def _sieve(self) -> np.ndarray:
        out = np.zeros(1 << 20, bool)
        out[self.known >> U64(44)] = True
        return out

    def evidence(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(hashes.shape[1], self.bias)
        for own in hashes:
            token, place = self.places(own)
            out[token] += self.weights[place]
        return out


def _blocks(texts: list[str]):
    return blocks(pa.array(texts, pa.large_string()), FIT_BYTES)


def _pairs(known: Model, texts: list[str]):
    """For each block: different pairs of text and place of a known feature."""
    for at, block in _blocks(texts):
        _, _, row, hashes = features(block)
        found = [np.zeros(0, np.int64)]
        for own in hashes:
            token, place = known.places(own)
            found.append((row[token] + at.start) * len(known.known) + place)
        pairs = np.unique(np.concatenate(found))
        yield pairs // len(known.known), pairs % len(known.known)


def _marks(toxic: list[str], clean: list[str]) -> np.ndarray:
    """Hashes of the features that mark toxicity, sorted."""
    parts = [np.zeros(0, U64)]
    for _, block in _blocks(toxic):
        _, _, row, hashes = features(block)
        order = np.lexsort((hashes.ravel(), np.tile(row, len(hashes))))
        h, r = hashes.ravel()[order], np.tile(row, len(hashes))[order]
        parts.append(h[np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])] if len(h) else h)
    every, in_toxic = np.unique(np.concatenate(parts), return_counts=True)
    often = Model(known=every[(in_toxic >= 2) & (every != 0)])
    if not len(often.known):
        return often.known
    in_toxic = in_toxic[np.searchsorted(every, often.known)]
    in_clean = sum(np.bincount(place, minlength=len(often.known)) for _, place in _pairs(often, clean))
    # First the features that clean texts lack. What those leave without a mark may also be
    # explained by features that a few clean texts quote.
    least = max(MARK_VOTES, MARK_SHARE * len(toxic))
    marks = _voted(often.known[in_clean <= PURE_RATIO * in_toxic], toxic, least)
    toxic_share, clean_share = (in_toxic + 0.5) / (len(toxic) + 1), (in_clean + 0.5) / (len(clean) + 1)
    quoted = often.known[clean_share <= MARK_RATIO * toxic_share]
    return np.union1d(marks, _voted(quoted, _without(marks, toxic), least))


def _voted(known: np.ndarray, texts: list[str], least: float) -> np.ndarray:
    """The features with enough votes: a text has one, shared by its words that hold a candidate."""
    candidate = Model(known=known)
    if not len(known) or not texts:
        return known[:0]
    words = np.zeros(len(texts))
    for at, block in _blocks(texts):
        _, _, row, hashes = features(block)
        token = np.unique(np.concatenate([candidate.places(own)[0] for own in hashes]))
        order = np.lexsort((hashes[0, token], row[token]))
        r, h = row[token][order], hashes[0, token][order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])[: len(h)]
        words[at] += np.bincount(r[new], minlength=block.rows)
    votes = np.zeros(len(known))
    for text, place in _pairs(candidate, texts):
        votes += np.bincount(place, 1 / np.maximum(words[text], 1), minlength=len(votes))
    return known[votes >= least]


def _without(marks: np.ndarray, texts: list[str]) -> list[str]:
    """The texts that hold none of the marks."""
    if not len(marks):
        return texts
    held = {i for text, _ in _pairs(Model(known=marks), texts) for i in text.tolist()}
    return [t for i, t in enumerate(texts) if i not in held]


def _labelled(texts: list[str], toxic: bool, marks: Model):
    """For each block: token labels, first token of each text, features and their hashes."""
    for _, block in _blocks(texts):
        _, _, row, hashes = features(block)
        y = np.zeros(len(row))
        for own in hashes:
            y[marks.places(own)[0]] = 1
        marked = np.bincount(row[y > 0], minlength=block.rows)
        # A toxic text without a labelled token says nothing about which token it is, nor does
        # a clean one that lists many marks about any of them.
        use = (marked > 0 if toxic else marked <= MOST_QUOTES)[row]
        row, hashes, y = row[use], hashes[:, use], y[use] if toxic else np.zeros(use.sum())
        if len(row):
            yield y, np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]])), hashes


def fit(texts: list[str], toxic: list[bool]) -> Model:
    """Fit the chain on labelled texts; see the module's text."""
    bad, good = ([t for t, x in zip(texts, toxic, strict=True) if bool(x) == own] for own in (True, False))
    if not bad or not good:
        return Model()
    marks = Model(known=_marks(bad, good))
    if not len(marks.known):
        if len(bad) >= FEWEST:
            raise ValueError(f"nothing tells {len(bad)} toxic texts from {len(good)} clean ones")
        return Model()
    known = np.unique(np.concatenate([np.unique(hashes[:, y > 0]) for y, _, hashes in _labelled(bad, True, marks)]))
    model = Model(known=known[known != 0])
    size, parts, total, positive = len(model.known), [], 0, 0.0
    seen = np.zeros((2, 2))
    for own, flag in ((bad, True), (good, False)):
        for y, first, hashes in _labelled(own, flag, marks):
            found = [model.places(h) for h in hashes]
            token, place = (np.concatenate(x) for x in zip(*found, strict=True))
            parts.append((y, first, token, place))
            was = np.concatenate([[0], y[:-1]])
            was[first[:-1]] = 0
            seen += np.bincount((was * 2 + y).astype(int), minlength=4).reshape(2, 2)
            total, positive = total + len(y), positive + y.sum()
    values = np.concatenate([np.zeros(size + 4), [np.log(positive / (total - positive + 1))]])
    speed, step = np.zeros(len(values)), np.zeros(len(values))
    for turn in range(1, ROUNDS + 1):
        model.weights, model.moves, model.bias = values[:size], values[size:-1].reshape(2, 2), values[-1]
        slope = -0.02 * values
        slope[size:-1] += seen.ravel()
        for y, first, token, place in parts:
            evidence = model.bias + np.bincount(token, model.weights[place], minlength=len(y))
            p, expected = marginals(evidence, first, model.moves)
            error = y - p
            slope[:size] += np.bincount(place, error[token], minlength=size)
            slope[size:-1] -= expected.ravel()
            slope[-1] += error.sum()
        step = 0.9 * step + 0.1 * slope
        speed = 0.95 * speed + 0.05 * slope**2
        values = values + 0.3 * (step / (1 - 0.9**turn)) / (np.sqrt(speed / (1 - 0.95**turn)) + 1e-3)
    return model


_MODEL = "known array<long>, weights array<double>, moves array<double>, bias double, error string"
_ROW = pa.schema(
    [(c, pa.list_(kind)) for c, kind in (("known", pa.int64()), ("weights", pa.float64()), ("moves", pa.float64()))]
    + [("bias", pa.float64()), ("error", pa.string())]
)


def _fitted(batches):
    """One row with the model of all rows of a sample, or with what is wrong with the sample."""
    rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    texts, model, error = in_order(rows), Model(), None
    try:
        model = fit([t for t, _ in texts], [x for _, x in texts])
    except ValueError as wrong:
        error = str(wrong)
    found = {"known": signed(model.known), "weights": model.weights, "moves": model.moves.ravel(), "bias": model.bias}
    yield pa.RecordBatch.from_pylist([{**found, "error": error}], _ROW)


def fit_on(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled documents whose id is not held out, as far as the bounds go.

    The bounded sample is fitted in one task; the driver gets the weights, no texts.
    """
    rows = sample(docs, labels, "toxic", {1: TOXIC_SAMPLE, 0: CLEAN_SAMPLE}).repartition(1)
    found = rows.mapInArrow(_fitted, _MODEL).first()
    if found is None:
        return Model()
    if found.error:
        raise ValueError(found.error)
    known = np.array(found.known, np.int64).view(U64)
    return Model(known, np.array(found.weights, float), np.array(found.moves, float).reshape(2, 2), found.bias)


# --- scoring ----------------------------------------------------------------------

_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_RESULT = pa.struct([("score", pa.float64()), ("spans", _SPANS)])


def score_block(model: Model, block: Block) -> tuple[np.ndarray, list[list[dict]]]:
    spans: list[list[dict]] = [[] for _ in range(block.rows)]
    if not len(model.known):
        return np.zeros(block.rows), spans
    starts, ends, row, hashes = features(block)
    first = np.searchsorted(row, np.arange(block.rows + 1))
    p, _ = marginals(model.evidence(hashes), first, model.moves)
    score = np.zeros(block.rows)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        score[full] = np.maximum.reduceat(p, first[full])
    last = (-1, -2)  # row and token
    for i in np.flatnonzero(p >= 0.5).tolist():
        r, offset = int(row[i]), int(block.bounds[row[i]])
        if last == (r, i - 1):
            spans[r][-1]["end"] = int(ends[i]) - offset
        else:
            spans[r].append({"start": int(starts[i]) - offset, "end": int(ends[i]) - offset})
        last = (r, i)
    return score, spans


def toxicity(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A column with ``score`` (0 to 1) and ``spans`` of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few features of each mark

    @F.arrow_udf("struct<score:double,spans:array<struct<start:int,end:int>>>")
    def scored(column: pa.Array) -> pa.Array:
        scores, spans = [np.zeros(0)], []
        for _, block in blocks(column):
            score, found = score_block(shared.value, block)
            scores.append(score)
            spans += found
        return pa.StructArray.from_arrays([pa.array(np.concatenate(scores)), pa.array(spans, _SPANS)], fields=list(_RESULT))

    return scored(F.col(text))
