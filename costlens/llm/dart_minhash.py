"""Near duplicates by DartMinHash signatures and banded joining.

A text is the weighted set of its shingles of five words, a shingle weighing as often
as it occurs. Each unit of weight of a shingle is thrown at by a Poisson process of
hashed darts; a dart has a rank (the hashed gaps before it, added up) and a coordinate.
The signature keeps the earliest dart of each coordinate. Two texts agree in a
coordinate with the probability of their weighted Jaccard similarity, and a text of
``n`` shingles needs about ``n + k log k`` darts for ``k`` coordinates, not ``n * k``.

From signatures to classes:

1. Copies of a text go on as one row, met on the map side.
2. ``ROWS`` coordinates make a band; texts that share a band's hash meet in a bucket.
   A pair of similarity 0.8 misses every bucket with a probability of 5e-6.
3. *Stars.* In each bucket every text is compared with the one of the smallest id: as
   many pairs as texts, however large the bucket. Similarities are exact, from the
   whole shingle sets.
4. *The rest.* A bucket whose texts are in one class by now can hide no other class. In
   the other buckets texts stand in the order of the signature from that band on, so
   that the most similar are next to each other (as in a forest of prefix trees), and
   each is compared with those of other classes among the ``NEXT`` that follow: all of
   them in buckets of up to ``NEXT`` + 1 texts, a number in proportion to the texts in
   larger ones. Every text is in ``BANDS`` such orders. Sizes that rule a pair out save it.
   The orders of all buckets are one sorted table, cut by range; a bucket of more than
   ``NEXT`` + 1 texts may stretch over many tasks, a smaller one is never cut.
5. *Look-alikes.* The texts of larger buckets that hold several classes even now are
   joined exactly. All shingles have one order, those of a single class first, then the
   rarest; two texts of similarity ``s`` share one of the first ``size - s * size + 1`` of
   each. Pairs of different classes meet there, and sizes and places rule some out. So do
   bitmaps: each of a text's shingles swaps one of ``64 * WORDS`` bits, so two texts differ
   in at least as many shingles as bits. That bound rules out look-alikes under the threshold
   where they meet, so that pairs go on in the number of those that are similar or very near
   to it; it is weaker for texts of more shingles than bits.
   The texts of a frequent shingle are dealt to blocks of about ``CELL``, each two of which
   meet in a cell of their own, so no task holds all of them. Within cells the bitmaps are
   still compared pair by pair.
6. Classes are the connected components, found by large-star and small-star rounds.

Pairs are verified from a table of the texts that share a bucket with another one.

Defined results: words are as written, without the white space between them; a text of
one to four words is one shingle of all its words; a null text or one without words
has no shingles and is a class of its own, unless copies of it exist.
Null ids count as the largest id; rows of one id and one text are one document.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costlens.llm.components import components, stored
from costlens.llm.rows import ID, KEY, NO_ID, TWIN, distinct_rows, first_copies, keyed, light_key
from costlens.llm.words import U64, Block, blocks, mix, signed, windows
from costlens.session import scratch_dir

BANDS, ROWS = 40, 6
SHINGLE = 5
SIMILARITY = 0.8
NEXT = 8
CELL = 256
WORDS = 16  # 64-bit words of a text's bitmap
_SALTS = 64
_BITS = [f"bits_{i}" for i in range(WORDS)]
_TAIL = 64  # coordinates that order a bucket, two bytes of each


# --- shingles -----------------------------------------------------------------------


def shingles(block: Block, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each shingle of a block, in text order."""
    words = block.words()
    hashes, inside = windows(words.hashes, words.row, size)
    at = np.flatnonzero(inside)
    rows, found = words.row[at], hashes[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        own = [words.hashes[words.first[r] : words.first[r + 1]] for r in short]
        whole = np.array([windows(h, np.zeros(len(h)), len(h))[0][0] for h in own], U64)
        rows, found = np.concatenate([rows, short]), np.concatenate([found, whole])
        order = np.argsort(rows, kind="stable")
        rows, found = rows[order], found[order]
    return rows, found


def weighted(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each different shingle, ordered by row and hash."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return rows[at], hashes[at], np.diff(np.append(at, len(rows)))


# --- darts --------------------------------------------------------------------------


def _uniform(hashes: np.ndarray) -> np.ndarray:
    """Numbers above 0 and below 1 from the upper bits of hashes."""
    return ((hashes >> U64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _columns(rows, elements, weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut the weight of each element into columns of width one; the last may be narrower."""
    count = np.ceil(weights).astype(np.int64)
    owner = np.repeat(np.arange(len(elements)), count)
    ordinal = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    width = np.minimum(weights[owner] - ordinal, 1.0)
    return rows[owner], mix(elements[owner] + mix(ordinal.astype(U64))), width


def signatures(rows: np.ndarray, elements: np.ndarray, weights: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """Signatures of ``k`` numbers of ``n_rows`` weighted sets; a row without elements gets zeros.

    Equal numbers stand for one dart: its rank in the upper, its hash in the lower bits.
    """
    none = np.uint64(2**64 - 1)
    out = np.full((n_rows, k), none)
    rows, columns, width = _columns(rows, elements, np.asarray(weights, np.float64))
    total = np.bincount(rows, width, minlength=n_rows)
    reach = np.zeros(n_rows)
    unfilled = total > 0
    reach[unfilled] = k * (np.log(k) + 2) / total[unfilled]
    flat = out.reshape(-1)
    while unfilled.any():
        live = np.flatnonzero(unfilled[rows])
        row, column, wide, rank, thrown = rows[live], columns[live], width[live], np.zeros((len(live), 1)), 0
        while len(row):
            at_once = int(np.clip((1 << 16) // len(row), 1, 256))
            number = mix(np.arange(thrown, thrown + at_once, dtype=U64))
            dart = mix(column[:, None] + number)
            ranks = np.cumsum(np.hstack([rank, -np.log(_uniform(dart))]), axis=1)[:, 1:]
            own = mix(dart)
            hit = ranks < reach[row][:, None]
            if (wide < 1).any():  # a dart beyond the weight of its element misses
                hit &= _uniform(mix(own)) < wide[:, None]
            i, j = np.nonzero(hit)
            place = row[i] * k + ((own[i, j] >> U64(32)) % U64(k)).astype(np.int64)
            early = ranks[i, j].astype(np.float32).view(np.uint32).astype(U64)
            np.minimum.at(flat, place, (early << U64(32)) | (own[i, j] & U64(0xFFFFFFFF)))
            near = ranks[:, -1] < reach[row]
            row, column, wide, rank, thrown = row[near], column[near], wide[near], ranks[near, -1:], thrown + at_once
        # A coordinate without a dart so near: throw farther for that row.
        unfilled &= (out == none).any(1)
        reach[unfilled] *= 2
    out[total == 0] = 0
    return out


def bands(signature: np.ndarray, n_bands: int, n_rows: int) -> np.ndarray:
    """One hash for each band of a signature, different between bands."""
    parts = signature.reshape(len(signature), n_bands, n_rows)
    out = np.broadcast_to(mix(np.arange(n_bands, dtype=U64)), parts.shape[:2]).copy()
    for i in range(n_rows):
        out = mix(out ^ parts[:, :, i])
    return out


_SKETCH = "_id long, _twin long, size long, keys array<long>, sketch binary"


def _sketches(n_bands: int, n_rows: int):
    def run(batches):
        for batch in map(distinct_rows, batches):
            for at, block in blocks(batch["text"]):
                row, hashes = shingles(block)
                row, hashes, counts = weighted(row, hashes)
                sizes = np.bincount(row, counts, minlength=block.rows).astype(np.int64)
                full = np.flatnonzero(sizes)
                signature = signatures(row, hashes, counts, block.rows, n_bands * n_rows)[full]
                keys = bands(signature, n_bands, n_rows)
                short = (signature & U64(0xFFFF)).astype(">u2")
                offsets = np.arange(len(full) + 1, dtype=np.int32) * n_bands
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["_id"].slice(at.start, at.stop - at.start).take(pa.array(full)),
                        batch["_twin"].slice(at.start, at.stop - at.start).take(pa.array(full)),
                        pa.array(sizes[full]),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(keys.reshape(-1)))),
                        pa.array([s.tobytes() for s in short], pa.binary()),
                    ],
                    names=["_id", "_twin", "size", "keys", "sketch"],
                )

    return run


# --- pairs --------------------------------------------------------------------------


def _similarities(batches):
    """Weighted Jaccard similarity of the two texts of each row."""
    for batch in batches:
        for at, left in blocks(batch["text"], 1 << 20):
            count = at.stop - at.start
            right_column = batch["other"].slice(at.start, count)
            done = 0
            scores = np.zeros(count)
            for part, right in blocks(right_column, 1 << 20):
                n = part.stop - part.start
                lower, upper = left.bounds[part.start], left.bounds[part.stop]
                mine = Block(left.data[lower:upper], left.bounds[part.start : part.stop + 1] - lower)
                a, b = weighted(*shingles(mine)), weighted(*shingles(right))
                rows, hashes = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
                counts = np.concatenate([a[2], b[2]])
                order = np.lexsort((hashes, rows))
                rows, hashes, counts = rows[order], hashes[order], counts[order]
                twin = np.flatnonzero((rows[1:] == rows[:-1]) & (hashes[1:] == hashes[:-1]))
                both = np.bincount(rows[twin], np.minimum(counts[twin], counts[twin + 1]), minlength=n)
                every = np.bincount(rows, counts, minlength=n)
                scores[done : done + n] = both / np.maximum(every - both, 1)
                done += n
            yield pa.RecordBatch.from_arrays(
                [*(batch[c].slice(at.start, count) for c in ("a", "b")), pa.array(scores)], names=["a", "b", "similarity"]
            )


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of ids ``a`` < ``b`` with the exact similarity of their texts."""
    left = texts.select(F.col(ID).alias("a"), "text")
    right = texts.select(F.col(ID).alias("b"), F.col("text").alias("other"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text", "other")
    return both.mapInArrow(_similarities, "a long, b long, similarity double")


def _next_in_order(similarity: float):
    """For ordered rows, those of the same key and another class among the ``NEXT`` that follow."""

    def run(batches):
        kept = None  # the last rows of the batch before
        for batch in batches:
            now = {c: batch[c].to_numpy() for c in ("key", ID, "root", "size")}
            fresh = len(now["key"])
            if kept is not None:
                now = {c: np.concatenate([kept[c], now[c]]) for c in now}
            old = len(now["key"]) - fresh
            kept = {c: v[-NEXT:] for c, v in now.items()}
            first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for step in range(1, NEXT + 1):
                b = np.arange(max(old, step), old + fresh)
                a = b - step
                least, most = (f(now["size"][a], now["size"][b]) for f in (np.minimum, np.maximum))
                fits = (now["key"][a] == now["key"][b]) & (now["root"][a] != now["root"][b])
                fits &= least >= similarity * most - 1e-9
                first.append(now[ID][a[fits]])
                second.append(now[ID][b[fits]])
            first, second = np.concatenate(first), np.concatenate(second)
            order = np.argsort(first, kind="stable")
            first, second = first[order], second[order]
            texts, at = np.unique(first, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(first)).astype(np.int32)), pa.array(second))
            yield pa.RecordBatch.from_arrays([pa.array(texts), lists], names=[ID, "b"])

    return run


def _classed(members: DataFrame, classes: DataFrame) -> DataFrame:
    return members.join(classes, members[ID] == classes["node"], "left").select(
        "key", "band", ID, "size", F.coalesce("root", ID).alias("root")
    )


def _mixed(classed: DataFrame) -> DataFrame:
    """Buckets of several classes, with their number of texts."""
    found = classed.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.count(ID).alias("n"))
    return found.filter("r <> s").select("key", "n")


def _rest(members: DataFrame, sketches: DataFrame, classes: DataFrame, similarity: float, n_rows: int) -> DataFrame:
    """Pairs of one bucket but of different classes that may be similar; see step 4 above."""
    classed = _classed(members, classes)
    open_members = classed.join(_mixed(classed), "key").join(sketches.select(ID, "sketch"), ID)
    twice = F.concat("sketch", "sketch")  # the signature goes on at its beginning
    tail = F.substr(twice, 2 * n_rows * (F.col("band") + 1) + 1, F.lit(2 * _TAIL))
    ordered = open_members.select("key", tail.alias("tail"), ID, "root", "size", (F.col("n") > NEXT + 1).alias("large"))
    ordered = ordered.repartitionByRange("key", F.expr("if(large, tail, null)"), F.expr(f"if(large, {ID}, null)"))
    ordered = ordered.sortWithinPartitions("key", "tail", ID).drop("large")
    partners = ordered.mapInArrow(_next_in_order(similarity), f"{ID} long, b array<long>").groupBy(ID)
    pairs = partners.agg(F.array_distinct(F.flatten(F.collect_list("b"))).alias("b")).select(ID, F.explode("b").alias("b"))
    return pairs.select(F.least(ID, "b").alias("a"), F.greatest(ID, "b").alias("b")).distinct()


def _bitmaps(rows: np.ndarray, units: np.ndarray, n_rows: int) -> np.ndarray:
    """``WORDS`` numbers for each row; each of its units has swapped one of their bits."""
    out = np.zeros((n_rows, WORDS), U64)
    np.bitwise_xor.at(out, (rows, units % U64(WORDS)), U64(1) << (units // U64(WORDS) % U64(64)))
    return out


_UNIT = f"{ID} long, root long, size long, unit long, bits array<long>"


def _units(batches):
    """Each unit of weight of each shingle of a text, with the text's class and size; its bitmap with the first of them."""
    for batch in batches:
        for at, block in blocks(batch["text"], 1 << 20):
            rows, hashes, counts = weighted(*shingles(block))
            sizes = np.bincount(rows, counts, minlength=block.rows).astype(np.int64)
            rows, units, _ = _columns(rows, hashes, counts)
            ids, roots = (batch[c].to_numpy()[at][rows] for c in (ID, "root"))
            lead = np.ones(len(rows), bool)
            lead[1:] = rows[1:] != rows[:-1]
            bits = _bitmaps(rows, units, block.rows)[rows[lead]]
            bounds = np.append(0, np.cumsum(lead) * WORDS).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(signed(bits.reshape(-1))), mask=pa.array(~lead))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(roots), pa.array(sizes[rows]), pa.array(signed(units)), lists],
                names=[ID, "root", "size", "unit", "bits"],
            )


def _counted(rows: DataFrame) -> DataFrame:
    """Rows with the number ``n`` of rows of their unit and whether several classes are ``among`` them.

    A unit's rows are dealt to ``_SALTS`` parts, so no task reads all of a frequent one.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(ID), F.lit(_SALTS)))
    parts = salted.groupBy("unit", "salt").agg(F.count(ID).alias("n"), F.min("root").alias("r"), F.max("root").alias("s"))
    whole = parts.groupBy("unit").agg(
        F.sum("n").alias("n"), (F.min("r") != F.max("s")).alias("among"), F.collect_list("salt").alias("salts")
    )
    return salted.join(whole.select("unit", "n", "among", F.explode("salts").alias("salt")), ["unit", "salt"]).drop("salt")


def _met(met: DataFrame, similarity: float) -> DataFrame:
    """Pairs of different classes that may be similar, at each unit of both their prefixes."""
    met = met.withColumn("cells", F.ceil(F.col("n") / CELL)).withColumn("own", F.pmod(F.xxhash64(F.lit(1), ID), "cells"))
    carried = (ID, "root", "size", "place", "common", *_BITS)
    left = met.select("unit", F.col("own").alias("i"), F.explode(F.expr("sequence(own, cells - 1)")).alias("j"), *carried)
    right = met.select(
        "unit",
        F.explode(F.expr("sequence(0, own)")).alias("i"),
        F.col("own").alias("j"),
        *(F.col(c).alias(f"{c}_2") for c in carried),
    )
    # What two texts can share at most, by the places of one shared shingle; what they must.
    ahead = F.least(F.col("size") - F.col("place"), F.col("size_2") - F.col("place_2"))
    needed = (F.col("size") + F.col("size_2")) * (similarity / (1 + similarity)) - 1e-6
    fits = (F.col("root") != F.col("root_2")) & ((F.col("i") < F.col("j")) | (F.col(ID) < F.col(f"{ID}_2")))
    fits &= F.least("size", "size_2") >= similarity * F.greatest("size", "size_2") - 1e-9
    fits &= F.least("place", "place_2") + ahead >= needed
    apart = reduce(add, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_2"))) for c in _BITS])
    fits &= (F.least("common", "common_2") >= needed) & (F.col("size") + F.col("size_2") - apart >= 2 * needed)
    both = left.join(right, ["unit", "i", "j"]).filter(fits)
    return both.withColumns({"ahead": ahead, "needed": needed})


def _look_alikes(members: DataFrame, texts: DataFrame, classes: DataFrame, similarity: float, folder: str) -> DataFrame:
    """All pairs of different classes that may be similar, of the texts of step 5 above."""
    classed = _classed(members, classes)
    large = _mixed(classed).filter(F.col("n") > NEXT + 1).select("key")
    wanted = classed.join(large, "key").select(ID, "root").distinct()
    units = texts.join(wanted, ID).mapInArrow(_units, _UNIT)
    units = stored(units, f"{folder}/units")
    place = F.row_number().over(Window.partitionBy(ID).orderBy("among", "n", "unit"))
    common = F.count(F.when(F.col("among"), 1)).over(Window.partitionBy(ID))
    first = F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1
    prefixes = _counted(units.drop("bits")).withColumns({"place": place, "common": common})
    prefixes = prefixes.filter((F.col("place") <= first) & F.col("among")).drop("n", "among")
    bitmaps = units.filter("bits is not null").select(ID, *[F.col("bits")[i].alias(c) for i, c in enumerate(_BITS)])
    met = _counted(stored(prefixes, f"{folder}/prefixes")).filter("among").join(bitmaps, ID)
    pairs = _met(met, similarity).groupBy(F.least(ID, f"{ID}_2").alias("a"), F.greatest(ID, f"{ID}_2").alias("b")).agg(
        F.count("unit").alias("shared"), F.min("ahead").alias("ahead"), F.first("needed").alias("needed")
    )
    return pairs.filter("shared + ahead >= needed").select("a", "b")


def _joined(classes: DataFrame, links: DataFrame, folder: str) -> DataFrame:
    """Classes with further links; what the classes hold together stays together."""
    bridges = classes.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links.select("a", "b"))
    return components(bridges, folder) if links.take(1) else classes


def near_duplicates(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    n_bands: int = BANDS,
    n_rows: int = ROWS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Classes and links.

    Classes: for each row of ``docs`` its ``doc_id`` and ``_twin`` (hash of the text), the
    ``class_id`` (smallest id of the class; null if all are null) and ``keeps``, true for
    the rows of one id and text of each class. Links: pairs ``a``, ``b`` of numbers of
    different texts with their exact ``similarity``; they connect each class.
    """
    folder = scratch_dir(docs.sparkSession)
    texts = keyed(docs, doc_id, text)
    # A number for each different text, fixed by being written.
    firsts = stored(first_copies(docs, doc_id, text).withColumn("_n", F.monotonically_increasing_id()), f"{folder}/firsts")
    known = firsts.select(*KEY, "_n")

    sketches = texts.mapInArrow(_sketches(n_bands, n_rows), _SKETCH)
    sketches = sketches.join(known, KEY).select(F.col("_n").alias(ID), "size", "keys", "sketch")
    sketches = stored(sketches, f"{folder}/sketches")
    members = sketches.select(ID, "size", F.posexplode("keys").alias("band", "key"))
    buckets = members.groupBy("key").agg(F.min(ID).alias("center"), F.max(ID).alias("last")).filter("last > center")
    members = stored(members.join(buckets.select("key", "center"), "key"), f"{folder}/members")

    wanted = members.select(F.col(ID).alias("_n")).distinct().join(known, "_n")
    shared = texts.join(wanted, KEY).dropDuplicates(KEY).select(F.col("_n").alias(ID), "text")
    shared = stored(shared, f"{folder}/texts")

    stars = members.filter(F.col("center") < F.col(ID)).select(F.col("center").alias("a"), F.col(ID).alias("b")).distinct()
    stars = stored(_verified(stars, shared), f"{folder}/stars")
    linked = stars.filter(F.col("similarity") >= similarity)
    early = components(linked, f"{folder}/early")
    rest = _verified(_rest(members, sketches, early, similarity, n_rows), shared)
    rest = stored(rest.filter(F.col("similarity") >= similarity), f"{folder}/rest")
    later = _joined(early, rest, f"{folder}/later")
    alike = _verified(_look_alikes(members, shared, later, similarity, folder), shared)
    alike = stored(alike.filter(F.col("similarity") >= similarity), f"{folder}/alike")
    links = linked.unionByName(rest).unionByName(alike)
    final = _joined(later, alike, f"{folder}/final")

    rooted = firsts.join(final, firsts["_n"] == final["node"], "left").withColumn("_root", F.coalesce("root", "_n"))
    first = F.min(F.struct(ID, "_n")).alias("first")
    names = rooted.groupBy("_root").agg(first)
    by_text = rooted.join(names, "_root").select(
        TWIN, "_other", "_bytes", F.col("first._id").alias("_name"), (F.col("_n") == F.col("first._n")).alias("_lead")
    )
    classes = docs.select(*light_key(doc_id, text), F.col(doc_id)).join(by_text, [TWIN, "_other", "_bytes"])
    return (
        classes.select(
            doc_id,
            TWIN,
            F.nullif(F.col("_name"), F.lit(NO_ID)).alias("class_id"),
            (F.col("_lead") & (F.col(ID) == F.col("_name"))).alias("keeps"),
        ),
        links,
    )
