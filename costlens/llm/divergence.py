"""How far the sources of a language differ in their use of words, term by term.

1. *Terms.* Each block of texts sends its different terms with the number of rows that
   hold them; a language keeps those in ``min_docs`` rows or more.
2. *Vocabulary.* Kept terms are sorted by range partitions; each range becomes minimal
   acyclic transducers that give a term's lexicographic ordinal (``transducer``). The
   ordinals of a language run on over its ranges, so their order is the terms' order.
3. *Recount.* Texts are streamed through the transducers, a block's different terms side
   by side, and give counts of (language, source, ordinal). The transducers are sent to
   all tasks if they are small together (``MAX_BROADCAST``, measured first). Beyond that
   each block's terms are dealt to the range that can hold them, and every range is met
   by its own transducer alone; the counts are the same. Counts travel as packed arrays, one
   value for each block of texts and ``PAIR_TERMS`` ordinals, and are added up in a stream.
4. *Divergence.* Blocks of 4096 ordinals add up the differences of all ordered pairs of a
   language's sources and give each source's best terms; the blocks' sums are added up and
   their best terms ranked. Ties between terms go by ordinal.

What is sent to tasks: the transducers below the bound, or at most ``MAX_RANGES`` range
starts of ``START_CHARS`` characters. A term reaches its count once from each block. The
result has a row for each ordered pair of sources, so a language's sources must be few
enough to be compared pairwise; in a task they are held for 4096 terms at a time.

Defined results: null text, language and source are empty text; every row is a document,
repeated or not, so a text that occurs three times makes its terms kept; a row without
terms still makes its group. An empty table has no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from costlens.llm.components import stored
from costlens.llm.packed import pack, pack_sorted, unpack, unpack_sorted
from costlens.llm.rows import text_of
from costlens.llm.transducer import Transducer
from costlens.llm.words import LETTER, Block, blocks, distinct_codes, lowered, run_texts
from costlens.session import scratch_dir

BLOCK_BYTES = 12 << 20
RANGE_TERMS = 1 << 16
MAX_RANGES = 4096
START_CHARS = 64  # a range begins where these change, so they decide the range of a term
MAX_BROADCAST = 32 << 20
PAIR_TERMS = 4096
_GROUP_ROWS = 1 << 20
_DENSE = 1 << 20  # cells of a matrix of terms and sources
PER_BILLION = 1_000_000_000
_EXACT = (2**63 - 1) // PER_BILLION  # smaller counts times PER_BILLION fit into 64 bits

_DOCS = "lang string, term string, docs long"
_RANGES = (
    "lang string, first string, terms array<string>, n_terms long, size long, "
    "keys binary, targets binary, outputs binary, final binary, longest int"
)
_PACKS = "lang string, block long, sources array<string>, cells binary, counts binary"
_COUNTS = f"{_PACKS}, totals array<long>"
_FOUND = (
    "lang string, range int, number long, n_cells long, sources array<string>, "
    "lengths binary, letters binary, cells binary, counts binary"
)
_DIFFERENCES = "lang string, source string, item string, ordinal long, value long"
_FLAT = ["keys", "targets", "outputs", "final", "longest"]


# --- terms of a block ---------------------------------------------------------------


def _terms(block: Block) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All terms of a block, lower-cased, and the row of each."""
    inside = LETTER[block.data]
    words, row = run_texts(block, inside, lowered()[block.data])
    return words.dictionary_encode(), row


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    encoded = column.dictionary_encode()
    return encoded.indices.to_numpy().astype(np.int64), encoded.dictionary


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers in order, and how often each occurs."""
    values = np.sort(values)
    first = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    at = np.flatnonzero(first)
    return values[at], np.diff(at, append=len(values))


def _term_docs(size: int):
    def run(batches):
        for batch in batches:
            of_row, langs = _codes(batch["lang"])
            for at, block in blocks(batch["text"], size):
                terms, row = _terms(block)
                if not len(terms):
                    continue
                many = len(terms.dictionary)
                held, _ = _counted(row * many + terms.indices.to_numpy())
                both = held % many * len(langs) + of_row[at][held // many]
                different, _, docs = distinct_codes(both, many * len(langs))
                yield pa.RecordBatch.from_arrays(
                    [
                        langs.take(pa.array(different % len(langs))),
                        terms.dictionary.take(pa.array(different // len(langs))),
                        pa.array(docs, pa.int64()),
                    ],
                    names=["lang", "term", "docs"],
                )

    return run


def _block_counts(batches, size: int):
    """Of each block: its different terms, and the counts of (term, language, source).

    Languages and sources are numbers in the arrays that go with them.
    """
    for batch in batches:
        lang, langs = _codes(batch["lang"])
        source, sources = _codes(batch["source"])
        group = lang * len(sources) + source
        many = len(langs) * len(sources)
        for at, block in blocks(batch["text"], size):
            terms, row = _terms(block)
            if len(terms):
                both = terms.indices.to_numpy().astype(np.int64) * many + group[at][row]
                cell, counts = _counted(both)
                group_of = cell % many
                lang_of, source_of = group_of // len(sources), group_of % len(sources)
                yield terms.dictionary, cell // many, (langs, lang_of), (sources, source_of), counts


# --- vocabulary ---------------------------------------------------------------------


def _range_rows(most: int, chars: int):
    """A row for each transducer: a run of sorted terms of one language, cut after ``most``."""

    def cut(batches):
        lang, terms = None, []
        for batch in batches:
            for own, term in zip(batch["lang"].to_pylist(), batch["term"].to_pylist(), strict=True):
                full = len(terms) >= most and term[:chars] != terms[-1][:chars]
                if terms and (own != lang or full):
                    yield lang, terms
                    terms = []
                lang = own
                terms.append(term)
        if terms:
            yield lang, terms

    def run(batches):
        for lang, terms in cut(batches):
            made = Transducer.build([t.encode() for t in terms]).dump()
            size = sum(len(made[k]) for k in _FLAT[:-1])
            row = {"lang": lang, "first": terms[0][:chars], "terms": terms, "n_terms": len(terms), "size": size, **made}
            yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

    return run


_ARROW = pa.schema(
    [
        ("lang", pa.string()), ("first", pa.string()), ("terms", pa.list_(pa.string())), ("n_terms", pa.int64()),
        ("size", pa.int64()), *[(c, pa.binary()) for c in _FLAT[:-1]], ("longest", pa.int32()),
    ]
)


def vocabulary(docs: DataFrame, min_docs: int, folder: str) -> DataFrame:
    """The transducers of all languages in order, with the ordinal of each one's first term."""
    counted = docs.select("lang", "text").mapInArrow(_term_docs(BLOCK_BYTES), _DOCS)
    kept = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    kept = stored(kept.select("lang", "term"), f"{folder}/terms")
    count = kept.count()
    most = max(RANGE_TERMS, count // MAX_RANGES)
    by_start = kept.repartitionByRange(count // most + 1, "lang", F.substring("term", 1, START_CHARS))
    made = by_start.sortWithinPartitions("lang", "term").mapInArrow(_range_rows(most, START_CHARS), _RANGES)
    made = stored(made, f"{folder}/transducers")
    # One row for each range and language, without the arrays.
    earlier = Window.partitionBy("lang").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.orderBy("lang", "first")
    light = made.select("lang", "first", "n_terms").withColumns(
        {"base": F.coalesce(F.sum("n_terms").over(earlier), F.lit(0)), "range": F.row_number().over(order) - 1}
    )
    return made.join(light.select("lang", "first", "base", "range"), ["lang", "first"])


# --- recount ------------------------------------------------------------------------


def _spans(terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a string array, and where each string begins and ends."""
    if not len(terms):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, offsets, data = terms.buffers()
    ends = np.frombuffer(offsets, np.int32)[terms.offset : terms.offset + len(terms) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), ends[:-1], ends[1:]


def _used(names: pa.Array, number: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The names that have numbers here, and the numbers among these names."""
    there = np.bincount(number, minlength=len(names)) > 0
    return names.filter(pa.array(there)).to_pylist(), (np.cumsum(there) - 1)[number]


def _packs(lang: str, names: pa.Array, source, ordinal, count, width: int) -> pa.RecordBatch:
    """Different cells of a language: a row for each block of ``width`` ordinals.

    A cell's number in its block is that of its source times ``width``, plus its place.
    """
    names, source = _used(names, source)
    many = len(names) * width
    code = ordinal // width * many + source * width + ordinal % width
    order = np.argsort(code)
    code, count = code[order], count[order]
    block = code // many
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    runs = list(zip(starts, [*starts[1:], len(code)], strict=True))
    columns = [
        pa.array([lang] * len(runs), pa.string()),
        pa.array(block[starts], pa.int64()),
        pa.array([names] * len(runs), pa.list_(pa.string())),
        pa.array([pack_sorted(code[a:b] % many) for a, b in runs], pa.binary()),
        pa.array([pack(count[a:b]) for a, b in runs], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "block", "sources", "cells", "counts"])


def _stream(shared, size: int, width: int):
    def run(batches):
        by_lang = {}
        for row in shared.value:
            by_lang.setdefault(row["lang"], []).append((row["base"], Transducer.load(row)))
        for terms, term, (langs, lang), (sources, source), counts in _block_counts(batches, size):
            data, starts, ends = _spans(terms)
            for number, name in enumerate(langs.to_pylist()):
                use = np.flatnonzero(lang == number)
                left, _ = _counted(term[use])  # terms of the language that no transducer has told yet
                ordinal = np.full(len(terms), -1, np.int64)
                for base, transducer in by_lang.get(name, ()):
                    own = transducer.ordinals(data, starts[left], ends[left])
                    known = own >= 0
                    ordinal[left[known]] = base + own[known]
                    left = left[~known]
                use = use[ordinal[term[use]] >= 0]
                if len(use):
                    yield _packs(name, sources, source[use], ordinal[term[use]], counts[use], width)

    return run


def _deal(shared, size: int, chars: int):
    """The terms and cells of each block, packed for each range that holds the terms if they are kept at all.

    A cell's number is that of its term times the number of sources, plus its source's.
    """

    def run(batches):
        starts = {}
        for lang, first, number in shared.value:
            starts.setdefault(lang, []).append((first.encode(), number))
        turn = TaskContext.get().partitionId() << 32
        for terms, term, (langs, lang), (sources, source), counts in _block_counts(batches, size):
            begin = pc.utf8_slice_codeunits(terms, 0, chars).cast(pa.binary()).to_pylist()
            begin, turn = np.array(begin, object), turn + 1
            for number, name in enumerate(langs.to_pylist()):
                own = sorted(starts.get(name, ()))
                use = np.flatnonzero(lang == number)
                if not own or not len(use):
                    continue
                different, _ = _counted(term[use])
                of_range = np.searchsorted(np.array([x for x, _ in own], object), begin[different], side="right") - 1
                order = np.argsort(of_range, kind="stable")
                order = order[of_range[order] >= 0]
                different, of_range = different[order], of_range[order]
                place = np.full(len(terms), -1, np.int64)
                place[different] = np.arange(len(different))
                use = use[place[term[use]] >= 0]
                names, source_of = _used(sources, source[use])
                code = place[term[use]] * len(names) + source_of
                order = np.argsort(code)
                code, count = code[order], counts[use[order]]
                edges = np.flatnonzero(np.diff(of_range, prepend=-1, append=len(own)))
                cells = np.searchsorted(code, edges * len(names))
                data, begins, ends = _spans(terms.take(pa.array(different)))
                for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    row = {"lang": name, "range": own[of_range[a]][1], "number": turn, "sources": names}
                    mine = slice(cells[i], cells[i + 1])
                    row |= {"n_cells": cells[i + 1] - cells[i], "lengths": pack(ends[a:b] - begins[a:b])}
                    row["letters"] = pa.compress(data[begins[a] : ends[b - 1]].tobytes(), codec="zstd", asbytes=True)
                    row |= {"cells": pack_sorted(code[mine] - a * len(names)), "counts": pack(count[mine])}
                    yield pa.RecordBatch.from_pylist([row], schema=_ARROW_FOUND)

    return run


def _follow(width: int):
    def run(rows: pa.Table, ranges: pa.Table) -> pa.Table:
        """The packed cells of one range's terms, added up over the blocks of texts."""
        if not len(rows):
            return _ARROW_PACKS.empty_table()
        row = ranges.to_pylist()[0]
        transducer, names, found = Transducer.load(row), {}, []
        for at in range(len(rows)):
            lengths = unpack(rows["lengths"][at])
            ends = np.cumsum(lengths)
            letters = rows["letters"][at].as_buffer()
            letters = pa.decompress(letters, decompressed_size=int(ends[-1]), codec="zstd", asbytes=True)
            ordinal = transducer.ordinals(np.frombuffer(letters, np.uint8), ends - lengths, ends)
            own = np.array([names.setdefault(x, len(names)) for x in rows["sources"][at].as_py()])
            code, count = unpack_sorted(rows["cells"][at]), unpack(rows["counts"][at])
            ordinal, source = ordinal[code // len(own)], own[code % len(own)]
            use = ordinal >= 0
            found.append((ordinal[use], source[use], count[use]))
        ordinal, source, count = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(ordinal):
            return _ARROW_PACKS.empty_table()
        cell, place = np.unique(ordinal * len(names) + source, return_inverse=True)
        sums = np.zeros(len(cell), np.int64)
        np.add.at(sums, place, count)
        ordinal, source = cell // len(names) + row["base"], cell % len(names)
        lang = rows["lang"][0].as_py()
        return pa.Table.from_batches([_packs(lang, pa.array(list(names)), source, ordinal, sums, width)])

    return run


_ARROW_FOUND = pa.schema(
    [
        ("lang", pa.string()), ("range", pa.int32()), ("number", pa.int64()), ("n_cells", pa.int64()),
        ("sources", pa.list_(pa.string())), ("lengths", pa.binary()), ("letters", pa.binary()),
        ("cells", pa.binary()), ("counts", pa.binary()),
    ]
)
_ARROW_PACKS = pa.schema(
    [
        ("lang", pa.string()), ("block", pa.int64()), ("sources", pa.list_(pa.string())),
        ("cells", pa.binary()), ("counts", pa.binary()),
    ]
)


def _add_packs(width: int):
    """Add up packs sorted by language and block: a row for each, with the sum of each source."""

    def cut(batches):
        key, names, sums = None, {}, None
        for batch in batches:
            for at in range(len(batch)):
                row = (batch["lang"][at].as_py(), batch["block"][at].as_py())
                if row != key:
                    if key:
                        yield key, names, sums
                    key, names, sums = row, {}, np.zeros((0, width), np.int64)
                own = np.array([names.setdefault(x, len(names)) for x in batch["sources"][at].as_py()])
                if len(names) > len(sums):
                    sums = np.concatenate([sums, np.zeros((len(names) - len(sums), width), np.int64)])
                code = unpack_sorted(batch["cells"][at])
                sums[own[code // width], code % width] += unpack(batch["counts"][at])
        if key:
            yield key, names, sums

    def run(batches):
        for (lang, block), names, sums in cut(batches):
            flat = sums.reshape(-1)
            code = np.flatnonzero(flat)
            row = {"lang": lang, "block": block, "sources": list(names), "totals": sums.sum(1).tolist()}
            row |= {"cells": pack_sorted(code), "counts": pack(flat[code])}
            yield pa.RecordBatch.from_pylist([row], schema=_ARROW_PACKS.append(pa.field("totals", pa.list_(pa.int64()))))

    return run


def recount(docs: DataFrame, ranges: DataFrame, folder: str, max_broadcast: int | None = None) -> DataFrame:
    """Counts of kept terms, a row for each language and block of ``PAIR_TERMS`` ordinals.

    ``cells`` and ``counts`` are packed, see ``_packs``; ``totals`` has the sum of each of ``sources``.
    """
    spark = docs.sparkSession
    texts = docs.select("lang", "source", "text")
    limit = MAX_BROADCAST if max_broadcast is None else max_broadcast
    size = ranges.agg(F.sum("size")).first()[0] or 0
    if size <= limit:
        small = [r.asDict() for r in ranges.select("lang", "base", *_FLAT).collect()]
        found = texts.mapInArrow(_stream(spark.sparkContext.broadcast(small), BLOCK_BYTES, PAIR_TERMS), _PACKS)
    else:
        found = _dealt(spark, texts, ranges, folder)
    together = found.repartition("lang", "block").sortWithinPartitions("lang", "block")
    return together.mapInArrow(_add_packs(PAIR_TERMS), _COUNTS)


def _dealt(spark: SparkSession, texts: DataFrame, ranges: DataFrame, folder: str) -> DataFrame:
    starts = [tuple(r) for r in ranges.select("lang", "first", "range").collect()]  # about MAX_RANGES
    sent = texts.mapInArrow(_deal(spark.sparkContext.broadcast(starts), BLOCK_BYTES, START_CHARS), _FOUND)
    rows = stored(sent, f"{folder}/dealt")
    parts = rows.groupBy("range").agg(F.floor(F.sum("n_cells") / _GROUP_ROWS + 1).alias("parts"))  # MAX_RANGES rows
    parts = F.broadcast(stored(parts, f"{folder}/parts"))
    of = rows.join(parts, "range").withColumn("part", F.pmod(F.xxhash64("number"), "parts")).drop("parts")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    copies = ranges.join(parts, "range").select("range", "base", *_FLAT, every)
    by = ("range", "part")
    return of.groupBy(*by).cogroup(copies.groupBy(*by)).applyInArrow(_follow(PAIR_TERMS), _PACKS)


# --- divergence ---------------------------------------------------------------------


def probability(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(10**9 * (count + 1) / (total + size)), exact."""
    count, total, size = (x.cast("decimal(20,0)") for x in (count, total, size))
    return 1 + F.call_function("div", F.lit(PER_BILLION) * (count + 1), total + size)


def _shares(count: np.ndarray, total: np.ndarray, size: int) -> np.ndarray:
    """``probability`` of arrays."""
    if len(count) and int(count.max()) >= _EXACT:
        count = count.astype(object)
    return (1 + PER_BILLION * (count + 1) // (total + size)).astype(np.int64)


def _differences(top: int, width: int):
    def run(cells: pa.Table, groups: pa.Table) -> pa.Table:
        """Over one block of terms: the differences of all ordered pairs of sources, each source's best terms."""
        of_group, names = _codes(groups["source"].combine_chunks())
        base, total = np.zeros((2, len(names)), np.int64)
        base[of_group], total[of_group] = groups["p"].to_numpy(), groups["total"].to_numpy()
        sums = np.zeros((len(names), len(names)), np.int64)
        best = [np.zeros(0, np.int64)] * 3
        if len(cells):
            size, lang_total = groups["size"][0].as_py(), groups["lang_total"][0].as_py()
            code, count = unpack_sorted(cells["cells"][0]), unpack(cells["counts"][0])
            source = pc.index_in(cells["sources"][0].values, names).to_numpy()[code // width].astype(np.int64)
            kept, place = np.unique(code % width, return_inverse=True)
            p = _shares(count, total[source], size)
            step = max(1, _DENSE // len(names))
            for at in range(0, len(kept), step):
                use = (place >= at) & (place < at + step)
                dense = np.tile(base, (min(step, len(kept) - at), 1))
                dense[place[use] - at, source[use]] = p[use]
                for i in range(len(names)):
                    apart = dense[:, i : i + 1] - dense
                    sums[i] += (apart * apart // dense).sum(0)
            of_lang = np.zeros(len(kept), np.int64)
            np.add.at(of_lang, place, count)
            q = _shares(of_lang, lang_total, size)[place]
            ordinal = cells["block"][0].as_py() * width + kept
            best = _best(source, (p - q) * (p - q) // q, ordinal[place], p > q, top)
        mine, other = np.nonzero(~np.eye(len(names), dtype=bool))
        columns = [
            pa.array([groups["lang"][0].as_py()] * (len(mine) + len(best[0])), pa.string()),
            names.take(pa.array(np.concatenate([mine, best[0]]))),
            pa.concat_arrays([names.take(pa.array(other)), pa.nulls(len(best[0]), pa.string())]),
            pa.concat_arrays([pa.nulls(len(mine), pa.int64()), pa.array(best[2], pa.int64())]),
            pa.array(np.concatenate([sums[mine, other], best[1]]), pa.int64()),
        ]
        return pa.Table.from_arrays(columns, names=["lang", "source", "item", "ordinal", "value"])

    return run


def _best(source, value, ordinal, use, top: int) -> list[np.ndarray]:
    """The ``top`` cells of each source by value, ties by ordinal, of those in ``use``."""
    source, value, ordinal = source[use], value[use], ordinal[use]
    order = np.lexsort((ordinal, -value, source))
    rank = np.arange(len(order)) - np.searchsorted(source[order], source[order])
    order = order[rank < top]
    return [source[order], value[order], ordinal[order]]


def _group_sizes(docs: DataFrame, cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Every (lang, source) with its total, and the language's total and vocabulary size."""
    groups = docs.select("lang", "source").distinct()
    each = cells.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("own"))
    totals = each.groupBy("lang", F.col("own.sources").alias("source")).agg(F.sum("own.totals").alias("total"))
    langs = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    sizes = ranges.groupBy("lang").agg(F.sum("n_terms").alias("size"))
    joined = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").join(sizes, "lang", "left")
    return joined.fillna(0, ["total", "lang_total", "size"])


def divergence(
    docs: DataFrame,
    min_docs: int = 3,
    top: int = 200,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``.

    Part ``pair``: each other source of the language and the sum over all kept terms of
    floor((p - q)**2 / q), p the source's and q the other's share of the term in
    billionths, smoothed. Part ``term``: the ``top`` terms that the source uses more than
    its language does, with that value against the language's share.
    """
    folder = scratch_dir(docs.sparkSession)
    empty = F.lit("")
    rows = docs.select(
        F.coalesce(F.col(lang).cast("string"), empty).alias("lang"),
        F.coalesce(F.col(source).cast("string"), empty).alias("source"),
        text_of(text).alias("text"),
    )
    ranges = vocabulary(rows, min_docs, folder)
    cells = stored(recount(rows, ranges, folder), f"{folder}/counts")
    groups = stored(_group_sizes(rows, cells, ranges), f"{folder}/groups")
    found = stored(_blocks_apart(cells, groups, top), f"{folder}/differences")
    pairs, terms = _pairs(found), _term_part(found, ranges, top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).unionByName(terms.select(columns))


def _blocks_apart(cells: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """Each block of terms: ``item`` and the sum of differences, or ``ordinal`` and value of a best term."""
    none = probability(F.lit(0), F.col("total"), F.col("size")).alias("p")  # of a term without an occurrence
    last = F.greatest(F.col("size") - 1, F.lit(0))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / PAIR_TERMS))).alias("block")
    bases = groups.withColumn("p", F.when(F.col("size") > 0, none).otherwise(0)).select("*", every)
    by = ("lang", "block")
    both = cells.drop("totals").groupBy(*by).cogroup(bases.groupBy(*by))
    return both.applyInArrow(_differences(top, PAIR_TERMS), _DIFFERENCES)


def _pairs(found: DataFrame) -> DataFrame:
    """Each source against each other one of its language."""
    added = found.filter("ordinal IS NULL").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return added.withColumns({"part": F.lit("pair"), "rank": F.row_number().over(order)})


def _term_part(found: DataFrame, ranges: DataFrame, top: int) -> DataFrame:
    """The terms that a source uses more than its language."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    valued = found.filter("ordinal IS NOT NULL").drop("item")
    best = valued.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    named = ranges.select("lang", "base", F.posexplode("terms").alias("at", "item"))
    named = named.select("lang", (F.col("base") + F.col("at")).alias("ordinal"), "item")
    return best.join(named, ["lang", "ordinal"]).withColumn("part", F.lit("term"))
