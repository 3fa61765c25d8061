"""Remove passages that occurred earlier in the corpus, by level-wise doubling.

A window is ``window`` consecutive words of one text. Words covered by a window
whose word sequence also starts earlier go. Windows are compared in two levels:

1. *Half windows.* Every window holds one chosen half window, the one with the
   smallest hash (the leftmost, if several). Equal windows choose equal halves,
   so only the chosen halves, about a sixth of all positions, are compared.
2. *Whole windows.* Half windows that repeat are the only ones extended to twice
   their length: a window whose chosen half does not repeat cannot repeat.

Doubling ends at ``window``: words covered by a longer repeat are covered by its
windows of that length, so no later level could add a word.

Hot passages: rows are first compared inside a block of texts. What is settled
there (the half repeats; the window has an earlier copy) takes no further part in
the comparison but is spread by a hash of its row, so one passage sends at most
one row from each block to the task that compares it, whatever share of the
corpus holds it. Copies of a whole text are settled by their digest alone.

Defined results: a null or empty text has no words; null ids count as the largest
id; rows of one id are one position in the order, each row is searched by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costlens.llm.rows import ID, KEY, NO_ID, distinct_rows, first_copies, keyed
from costlens.llm.words import U64, Words, blocks, mix, signed, windows

_HALF = "meet long, half long, _id long, _twin long, settled boolean"
_WHOLE = "meet long, hash long, check long, _id long, _twin long, start int, settled boolean"


def _chosen_halves(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of half windows, the start of each whole window and its chosen half."""
    half = window // 2
    hashes, _ = words.windows(half)
    count = len(words.hashes) - window + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return hashes, none, none
    best, chosen = hashes[:count].copy(), np.zeros(count, np.int16)
    for shift in range(1, window - half + 1):
        other = hashes[shift : shift + count]
        smaller = other < best
        np.copyto(best, other, where=smaller)
        chosen[smaller] = shift
    starts = np.flatnonzero(words.row[:count] == words.row[window - 1 :])
    return hashes, starts, starts + chosen[starts]


def _distinct_in_row(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each (row, hash), and how often each occurs in its row."""
    _, first, counts = np.unique(mix(hashes ^ mix(row.astype(U64))), return_index=True, return_counts=True)
    order = np.argsort(first)
    return first[order], counts[order]


def _met_before(hashes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which places have an equal hash with a smaller ``order`` in the same block."""
    by = np.lexsort((order, hashes))
    h, o = hashes[by], order[by]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    smallest = o[np.flatnonzero(new)][np.cumsum(new) - 1] if len(h) else o
    out = np.zeros(len(h), bool)
    out[by] = o > smallest
    return out


def _spread(hashes: np.ndarray, settled: np.ndarray, row_key: np.ndarray) -> np.ndarray:
    return np.where(settled, mix(hashes ^ mix(row_key.astype(U64))), hashes)


def _half_windows(window: int):
    def run(batches):
        for batch in map(distinct_rows, batches):
            ids, twins = batch["_id"].to_numpy(), batch["_twin"].to_numpy()
            for at, block in blocks(batch["text"]):
                words = block.words()
                hashes, _, chosen = _chosen_halves(words, window)
                chosen = np.unique(chosen)
                row, picked = words.row[chosen], hashes[chosen]
                place, counts = _distinct_in_row(row, picked)
                row, picked = row[place], picked[place]
                ident = ids[at][row]
                # It repeats if it is twice in this text or in another text of this block.
                met = _met_before(picked, ident)
                settled = (counts > 1) | np.isin(picked, picked[met])
                meet = _spread(picked, met, row + ident)
                yield pa.RecordBatch.from_arrays(
                    [signed(meet), signed(picked), ident, twins[at][row], settled],
                    names=["meet", "half", "_id", "_twin", "settled"],
                )

    return run


def _whole_windows(window: int):
    def run(batches):
        for batch in map(distinct_rows, batches):
            ids, twins, halves = batch["_id"].to_numpy(), batch["_twin"].to_numpy(), batch["halves"]
            for at, block in blocks(batch["text"]):
                words = block.words()
                hashes, starts, chosen = _chosen_halves(words, window)
                mine = halves[at]
                known = mine.flatten().to_numpy().view(U64)
                owner = np.repeat(np.arange(len(mine)), mine.value_lengths().to_numpy(zero_copy_only=False))
                known = np.sort(mix(known ^ mix(owner.astype(U64))))
                probe = mix(hashes[chosen] ^ mix(words.row[chosen].astype(U64)))
                found = np.zeros(len(probe), bool)
                if len(known):
                    found = known[np.minimum(np.searchsorted(known, probe), len(known) - 1)] == probe
                whole, _ = words.windows(window)
                check, _ = words.windows(window, seed=1)
                start = starts[found]
                row = words.row[start]
                place, _ = _distinct_in_row(row, whole[start])
                start, row = start[place], row[place]
                ident = ids[at][row]
                settled = _met_before(whole[start], ident)
                meet = _spread(whole[start], settled, row + ident)
                yield pa.RecordBatch.from_arrays(
                    [
                        signed(meet),
                        signed(whole[start]),
                        (check[start] >> U64(32)).astype(np.int64),
                        ident,
                        twins[at][row],
                        (start - words.first[row]).astype(np.int32),
                        settled,
                    ],
                    names=["meet", "hash", "check", "_id", "_twin", "start", "settled"],
                )

    return run


def _covered(words: Words, window: int, repeated: np.ndarray) -> np.ndarray:
    """Words covered by the windows that start at ``repeated``."""
    edge = np.zeros(len(words.hashes) + 1, np.int64)
    edge += np.bincount(repeated, minlength=len(edge))
    edge -= np.bincount(repeated + window, minlength=len(edge))
    return np.cumsum(edge)[:-1] > 0


def _repeated_starts(words: Words, window: int, marks) -> np.ndarray:
    """Starts of windows with an earlier copy: those marked, and repeats inside a row."""
    whole, inside = words.windows(window)
    starts = np.flatnonzero(inside)
    if not len(starts):
        return starts
    row = words.row[starts]
    keys = mix(whole[starts] ^ mix(row.astype(U64)))
    place = np.full(len(words.hashes), -1)
    place[starts] = np.arange(len(starts))
    owner = np.repeat(np.arange(words.block.rows), marks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    marked = marks.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + words.first[owner]
    first = np.zeros(len(starts), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    gone = ~first
    if len(marked):
        listed = np.unique(keys[place[marked]])
        gone |= listed[np.minimum(np.searchsorted(listed, keys), len(listed) - 1)] == keys
    return starts[gone]


def _cut(text: bytes, starts, ends, kept, joined: bool) -> str:
    """The kept words, joined by one space or with the white space that followed them."""
    if joined:
        words = zip(starts[kept].tolist(), ends[kept].tolist(), strict=True)
        return b" ".join([text[a:b] for a, b in words]).decode("utf-8", "replace")
    if not kept.any():
        return ""
    nexts = np.append(starts[1:], len(text))
    lead = text[: starts[0]] if kept[0] else b""
    parts = zip(starts[kept].tolist(), nexts[kept].tolist(), strict=True)
    return (lead + b"".join([text[a:b] for a, b in parts])).decode("utf-8", "replace")


_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))


def _cut_texts(window: int, joined: bool):
    def run(batches):
        for batch in batches:
            for at, block in blocks(batch["text"]):
                words = block.words()
                part = batch.slice(at.start, at.stop - at.start)
                gone = _covered(words, window, _repeated_starts(words, window, part["starts"]))
                copy = part["copy"].to_numpy(zero_copy_only=False) & (words.counts >= window)
                gone |= copy[words.row]
                removed = np.bincount(words.row[gone], minlength=block.rows)
                texts, spans = [], []
                for i in range(block.rows):
                    a, b, offset = words.first[i], words.first[i + 1], block.bounds[i]
                    kept = ~gone[a:b]
                    if not removed[i] and joined:
                        texts.append(b" ".join(block.text(i).split()).decode("utf-8", "replace"))
                    elif not removed[i]:
                        texts.append(block.text(i).decode("utf-8", "replace"))
                    else:
                        cut = _cut(block.text(i), words.starts[a:b] - offset, words.ends[a:b] - offset, kept, joined)
                        texts.append(cut)
                    edges = np.flatnonzero(np.diff(gone[a:b].view(np.int8), prepend=0, append=0))
                    spans.append([{"first": int(x), "end": int(y)} for x, y in zip(edges[::2], edges[1::2], strict=True)])
                counts = [words.counts.astype(np.int64), removed.astype(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [part["row"], *counts, pa.array(texts, pa.string()), pa.array(spans, _SPANS)],
                    names=["row", "n_words", "n_removed", "kept_text", "removed"],
                )

    return run


def remove_repeats(
    docs: DataFrame, window: int = 20, joined: bool = True, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row for each row of ``docs``: its other columns in a struct ``row``, ``n_words``,
    ``n_removed``, ``kept_text`` and ``removed`` (word ranges ``first`` to before ``end``).

    ``joined``: kept words are joined by one space, else they keep the white space
    that followed them. White space is blank, tab and line ends; nothing is normalised.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    texts = keyed(docs, doc_id, text)
    firsts = first_copies(docs, doc_id, text).select(*KEY, F.lit(True).alias("_first"))
    marks = _marks(texts, firsts, window)
    others = [c for c in docs.columns if c != text]
    if others == [doc_id] and dict(docs.dtypes)[doc_id] == "bigint":
        # The very columns that the marks are made from, so the texts are shuffled once.
        full, row = texts, F.struct(F.nullif(F.col(ID), F.lit(NO_ID)).alias(doc_id))
    else:
        full, row = keyed(docs, doc_id, text, F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")), F.col("row")
    ready = (
        full.join(firsts, KEY, "left")
        .join(marks, KEY, "left")
        .select(row.alias("row"), "text", F.col("_first").isNull().alias("copy"), "starts")
    )
    span = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType(
        [
            ready.schema["row"],
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept_text", T.StringType()),
            T.StructField("removed", T.ArrayType(span)),
        ]
    )
    return ready.mapInArrow(_cut_texts(window, joined), schema)


def _marks(texts: DataFrame, firsts: DataFrame, window: int) -> DataFrame:
    """For each text, the starts of windows that an earlier text holds too."""
    lone = texts.join(firsts, KEY).select(*KEY, "text")
    halves = lone.mapInArrow(_half_windows(window), _HALF)
    meeting = Window.partitionBy("meet")
    repeated = (
        halves.withColumn("_n", F.count(F.lit(1)).over(meeting))
        .filter(F.col("settled") | (F.col("_n") > 1))
        .groupBy(*KEY)
        .agg(F.collect_list("half").alias("halves"))
    )
    wholes = texts.join(repeated, KEY).select(*KEY, "text", "halves").mapInArrow(_whole_windows(window), _WHOLE)
    earliest = F.min(F.when(~F.col("settled"), F.col(ID))).over(Window.partitionBy("meet", "check"))
    return (
        wholes.withColumn("_earliest", earliest)
        .filter(F.col("settled") | (F.col("_earliest") < F.col(ID)))
        .groupBy(*KEY)
        .agg(F.collect_list("start").alias("starts"))
    )

