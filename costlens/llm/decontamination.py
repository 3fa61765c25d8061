"""Benchmark items in documents, also with other numbers, names and units.

*Templates.* A text becomes its tokens in lower case; numbers, names (capitalised words
inside a sentence) and units become typed placeholders and their values are kept.
Windows of ``WINDOW`` template tokens, at least half of them literal words, are hashed
and joined with the windows of the benchmark. An item shorter than a window is one
window of its own length, from ``SHORTEST`` tokens on.

*Slots.* Matches of one document and item with the same distance between their places
are one alignment. It counts if the slots are consistent: each value of the item stands
for one value of the document and the other way round, so "3 boxes and 3 bags" matches
"7 boxes and 7 bags" but not "7 boxes and 9 bags".

*Decision.* A document leaks an item if windows of consistent alignments cover at least
``COVER`` of the item's tokens; it is verbatim if all values are the item's own
in the windows that count of an alignment.

*Word for word.* With ``exact`` (as the registered queries and the pipeline call it) the
lower-cased tokens themselves are windows too, whatever their types, of an item with any
token. They need no slots, so numbers and names in every place, another case, and another
sign before a name lose nothing; an item of fewer than ``WINDOW`` tokens is found
wherever its tokens follow each other, even if it is a single one. These windows also
count where the slots of their alignment are not consistent, as after a typing error.

The windows of the documents pass a bit array of a fixed size, made from the
benchmark's hashes, before they are joined, so their shuffle holds likely matches only;
the join is exact however large the benchmark is, and no side is broadcast by hint.

Defined results: null and empty texts leak nothing; items with fewer than ``SHORTEST``
tokens or mostly placeholders have no template windows; equal items are all reported; rows of one
id and one text are one document; null ids count as the largest id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.llm.rows import ID, KEY, TWIN, distinct_rows, keyed
from costlens.llm.words import LETTER, U64, Block, blocks, lower_latin, signed, span_hash, windows

WINDOW = 8
SHORTEST = 4
COVER = 0.5
SIEVE_BITS = 23

# Number words and units.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty hundred thousand million".split()
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles g kg mg lb lbs pound pounds ounce ounces ton tons "
    "ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks "
    "month months year years dollar dollars cent cents euro euros usd eur gbp percent degree degrees mph kmh "
    "meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms"
).split()

_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_POINT = np.zeros(256, bool)
_POINT[[ord("."), ord(",")]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:\n"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_TYPES = np.array([0, 0x6E756D, 0x6E616D65, 0x756E6974], U64)  # literal, number, name, unit


def _hashes_of(words: list[str]) -> np.ndarray:
    found = [block.words().hashes for _, block in blocks(pa.array([" ".join(words)]))]
    return np.sort(np.concatenate(found))


def _within(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


class Template:
    """The tokens of a block: row, literal hash, type and template hash of each."""

    def __init__(self, block: Block, units: np.ndarray, number_words: np.ndarray):
        data = block.data
        digit = _DIGIT[data]
        inside = LETTER[data] | digit
        if len(data) > 2:
            inside[1:-1] |= _POINT[data[1:-1]] & digit[:-2] & digit[2:]
        starts, ends, self.row = block.runs(inside)
        self.values = span_hash(block.prefix_sums(lower_latin(data)), starts, ends)
        self.first = np.searchsorted(self.row, np.arange(block.rows + 1))
        self.counts = np.diff(self.first)
        kind = np.zeros(len(starts), np.int8)
        if len(starts):
            capital = _UPPER[data]
            capital[:-1] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
            capitals = np.concatenate([[0], np.cumsum(capital, dtype=np.int32)])
            stops = np.concatenate([[0], np.cumsum(_STOP[data], dtype=np.int32)])
            fresh = np.ones(len(starts), bool)
            fresh[1:] = (self.row[1:] != self.row[:-1]) | (stops[starts[1:]] > stops[ends[:-1]])
            alone = capitals[ends] - capitals[starts] == 1
            kind[capital[starts] & alone & ~fresh & (ends - starts > 1)] = 2
            kind[_within(self.values, units)] = 3
            kind[digit[starts] | _within(self.values, number_words)] = 1
        self.kind = kind
        self.template = np.where(kind == 0, self.values, _TYPES[kind])
        self.literals = np.concatenate([[0], np.cumsum(kind == 0)])

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Place and hash of each window of ``n`` tokens that is literal enough."""
        hashes, inside = windows(self.template, self.row, n, seed=n)
        at = np.flatnonzero(inside)
        at = at[2 * (self.literals[at + n] - self.literals[at]) >= n]
        return at, hashes[at]

    def exact_windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Place and hash of each window of ``n`` tokens as they are, in lower case."""
        hashes, inside = windows(self.values, self.row, n, seed=n + WINDOW)
        at = np.flatnonzero(inside)
        return at, hashes[at]

    def slots(self, at: int, n: int) -> list[int]:
        """Values of the placeholders in a window, in order."""
        part = slice(at, at + n)
        return signed(self.values[part][self.kind[part] > 0]).tolist()


_FOUND = "_id long, _twin long, n_tokens int, place int, width int, hash long, slots array<long>"
_SLOTS = pa.list_(pa.int64())


def _windows(widths: tuple[int, ...] | None, sieve, exact: bool):
    """Windows of each text: those that pass the sieve, or all of the width that suits the text.

    Windows of tokens as they are have no slots.
    """
    templates = [(n, False) for n in widths or range(1, WINDOW + 1) if n >= SHORTEST]
    kinds = templates + [(n, True) for n in widths or range(1, WINDOW + 1) if exact]

    def run(batches):
        units, number_words = _hashes_of(UNITS), _hashes_of(NUMBER_WORDS)
        for batch in map(distinct_rows, batches):
            ids, twins = batch["_id"].to_numpy(), batch["_twin"].to_numpy()
            for part, block in blocks(batch["text"]):
                text = Template(block, units, number_words)
                for n, as_is in kinds:
                    at, hashes = text.exact_windows(n) if as_is else text.windows(n)
                    if sieve is None:  # the benchmark: short items by their own length
                        keep = np.minimum(text.counts[text.row[at]], WINDOW) == n
                    else:
                        bit = hashes >> U64(64 - SIEVE_BITS)
                        keep = (sieve.value[bit >> U64(3)] >> (bit & U64(7)).astype(np.uint8)) & 1 > 0
                    at, hashes = at[keep], hashes[keep]
                    row = text.row[at]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[part][row]),
                            pa.array(twins[part][row]),
                            pa.array(text.counts[row].astype(np.int32)),
                            pa.array((at - text.first[row]).astype(np.int32)),
                            pa.array(np.full(len(at), n, np.int32)),
                            pa.array(signed(hashes)),
                            pa.array([None if as_is else text.slots(i, n) for i in at.tolist()], _SLOTS),
                        ],
                        names=["_id", "_twin", "n_tokens", "place", "width", "hash", "slots"],
                    )

    return run


def _sieve(found: DataFrame) -> np.ndarray:
    """A bit array of ``2**SIEVE_BITS`` bits with the hashes' upper bits set; its size is fixed."""
    bit = F.shiftrightunsigned("hash", 64 - SIEVE_BITS)
    cells = found.select(F.shiftright(bit, 3).alias("cell"), F.pow(F.lit(2), bit % 8).cast("int").alias("bit"))
    out = np.zeros(1 << (SIEVE_BITS - 3), np.uint8)
    for cell, bits in cells.groupBy("cell").agg(F.bit_or("bit")).toLocalIterator():
        out[cell] = bits
    return out


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    cover: float = COVER,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    exact: bool = False,
) -> DataFrame:
    """One row for each document and item it leaks: ``_id`` and ``_twin`` of the document,
    ``item_id``, ``n_tokens`` of the item, ``covered`` tokens and ``verbatim``."""
    spark = docs.sparkSession
    items = keyed(benchmark, item_id, item_text).mapInArrow(_windows(None, None, exact), _FOUND)
    widths = tuple(sorted(r[0] for r in items.select("width").distinct().collect()))
    if not widths:
        widths = (WINDOW,)
    sieve = spark.sparkContext.broadcast(_sieve(items))  # a fixed 1 MB
    hits = keyed(docs, doc_id, text).mapInArrow(_windows(widths, sieve, exact), _FOUND)
    items = items.select(
        "hash",
        "width",
        F.col(ID).alias("item"),
        F.col(TWIN).alias("item_twin"),
        "n_tokens",
        F.col("place").alias("at"),
        F.col("slots").alias("own"),
    )
    matches = hits.drop("n_tokens").join(items, ["hash", "width"])
    pair = [*KEY, "item", "item_twin", "n_tokens", "width"]
    aligned = matches.groupBy(*pair, (F.col("place") - F.col("at")).alias("shift")).agg(
        F.collect_set("at").alias("at"),
        F.collect_set(F.when(F.col("slots").isNull(), F.col("at"))).alias("as_is"),
        F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("own", "slots")))).alias("pairs"),
    )
    one_to_one = [F.size("pairs") == F.size(F.array_distinct(f"pairs.{c}")) for c in ("own", "slots")]
    consistent = one_to_one[0] & one_to_one[1]
    same = F.forall("pairs", lambda p: p["own"] == p["slots"])
    # Windows that are the item's own word for word count in any case.
    counted = aligned.withColumn("at", F.when(consistent, F.col("at")).otherwise(F.col("as_is")))
    counted = counted.withColumn("same", ~consistent | same).filter(F.size("at") > 0)
    found = counted.groupBy(*pair).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"), F.max("same").alias("verbatim")
    )
    # A window adds its width, less what the window before it covers already.
    behind, ahead = F.slice("at", 2, F.size("at")), F.slice("at", 1, F.size("at") - 1)
    steps = F.zip_with(behind, ahead, lambda b, a: F.least(b - a, F.col("width")))
    covered = F.col("width") + F.aggregate(steps, F.lit(0), lambda s, x: s + x)
    return (
        found.withColumn("covered", covered)
        .filter(F.col("covered") >= cover * F.col("n_tokens"))
        .select(*KEY, F.col("item").alias("item_id"), "n_tokens", "covered", "verbatim")
        .distinct()
    )
