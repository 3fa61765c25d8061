"""Phrases whose words occur together more often than alone, mined from sorted relations.

The set-oriented method: a relation of occurrences is written for each phrase length, and
the next length is made from it by a merge join.

1. *Words.* Texts are cut into chunks of about ``CHUNK_BYTES``. A chunk's relation holds
   a place and a word for each occurrence, sorted by place. Places number the words of
   the chunk and skip one number between pieces, so two places that follow each other
   are adjacent positions of one piece; this is the join key (piece, position).
2. *Group and count.* A chunk sends each different phrase once, with its count, to the
   bucket of the phrase; a bucket adds up and numbers the phrases that are frequent.
3. *Semi-join.* Frequent phrases go back to the chunks that hold them, and the relation
   keeps only their occurrences.
4. *Extend.* The kept relation is merge-joined with itself at adjacent places: phrases
   of k words that overlap in k - 1 make one of k + 1. From step 2 for the next length.

A phrase of k + 1 words is known by the numbers of its first k and its last k words, so
keys are exact, not hashes of texts. Relations are kept as packed arrays. Counts of all first and last parts of a phrase are
carried along, and its parts need no further joins.

A phrase reaches its bucket once from each chunk, however often it occurs, and buckets
are as many as the data ask for. A chunk ends at a text's end; a text longer than a chunk
is a chunk of its own. Chunks, relations and frequent phrases stay in the folder.

Defined results: null and empty texts have no words; each row counts, repeated or not;
a null language is ``und``; other columns are not read. An empty table has no phrases.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costlens.llm.components import stored
from costlens.llm.packed import pack, pack_sorted, unpack, unpack_sorted
from costlens.llm.rows import text_of
from costlens.llm.words import Block, blocks, distinct_codes, lowered, mix
from costlens.session import scratch_dir

CHUNK_BYTES = 4 << 20
BUCKET_ENTRIES = 1 << 19
NO_LANG = "und"

BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09]] = True
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True

_ID_BITS = 31
_INDEX_MASK = (1 << 33) - 1  # of monotonically_increasing_id: the row in its partition

_WORDS = "chunk long, places binary, codes binary, langs array<string>, words array<string>, counts array<int>"
_PHRASES = "chunk long, places binary, codes binary, entries int, phrases binary, counts binary"
_ENTRIES = "bucket int, chunk long, codes binary, phrases binary, counts binary"
_COUNTED = "chunk long, codes binary, ids binary, frequent array<struct<id long, phrase long, n long>>"


# --- inside a chunk -----------------------------------------------------------------


def _words_of(block: Block) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """All words of a block, the row of each and its place."""
    inside = ~(BLANK | BREAK)[block.data]
    starts, ends, row = block.runs(inside)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    text = lowered()[block.data][inside]
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(text))
    breaks = np.cumsum(BREAK[block.data])
    apart = np.ones(len(starts), bool)  # this word begins a piece
    apart[1:] = (row[1:] != row[:-1]) | (breaks[starts[1:]] != breaks[starts[:-1]])
    return words, row, np.arange(len(starts)) + np.cumsum(apart)


def _one(values, kind: pa.DataType | None = None) -> pa.ListArray:
    """An array column of a single row."""
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _chunk_number(n: int) -> int:
    return TaskContext.get().partitionId() << 32 | n


def _word_chunks(size: int):
    def run(batches):
        n = 0
        for batch in batches:
            langs = pc.dictionary_encode(pc.fill_null(batch["lang"], NO_LANG))
            many = len(langs.dictionary)
            for at, block in blocks(batch["text"], size):
                words, row, places = _words_of(block)
                if not len(words):
                    continue
                words = words.dictionary_encode()
                of_row = langs.indices.to_numpy()[at].astype(np.int64)
                both = words.indices.to_numpy().astype(np.int64) * many + of_row[row]
                different, codes, counts = distinct_codes(both, len(words.dictionary) * many)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([_chunk_number(n)], pa.int64()),
                        pa.array([pack_sorted(places)]),
                        pa.array([pack(codes)]),
                        _one(langs.dictionary.take(pa.array(different % many))),
                        _one(words.dictionary.take(pa.array(different // many))),
                        _one(counts, pa.int32()),
                    ],
                    names=["chunk", "places", "codes", "langs", "words", "counts"],
                )
                n += 1

    return run


def semi_join(codes: np.ndarray, kept_codes: np.ndarray, kept_ids: np.ndarray) -> np.ndarray:
    """The number of each occurrence's phrase, -1 where it is not frequent."""
    ids = np.full(max(codes.max(initial=-1), kept_codes.max(initial=-1)) + 1, -1, np.int64)
    ids[kept_codes] = kept_ids
    return ids[codes]


def merge_join(places: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and key of each pair of phrases at adjacent places; places are sorted."""
    meet = places[1:] == places[:-1] + 1
    return places[:-1][meet], ids[:-1][meet] << np.int64(32) | ids[1:][meet]


def _kept_words(kept: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    return kept.field("code").to_numpy(), kept.field("id").to_numpy()


def _kept_phrases(kept: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    codes = [unpack_sorted(x) for x in kept.field("codes")]
    return np.concatenate(codes), np.concatenate([unpack(x) for x in kept.field("ids")])


def _extended(read):
    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                places, codes = unpack_sorted(batch["places"][i]), unpack(batch["codes"][i])
                ids = semi_join(codes, *read(batch["kept"][i].values))
                frequent = ids >= 0
                places, pairs = merge_join(places[frequent], ids[frequent])
                if not len(pairs):
                    continue
                phrases, codes, counts = np.unique(pairs, return_inverse=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["chunk"].slice(i, 1),
                        pa.array([pack_sorted(places)]),
                        pa.array([pack(codes)]),
                        pa.array([len(phrases)], pa.int32()),
                        pa.array([pack_sorted(phrases)]),
                        pa.array([pack(counts)]),
                    ],
                    names=["chunk", "places", "codes", "entries", "phrases", "counts"],
                )

    return run


# --- group and count ----------------------------------------------------------------


def _to_buckets(buckets: int):
    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                phrases, counts = unpack_sorted(batch["phrases"][i]), unpack(batch["counts"][i])
                bucket = (mix(phrases.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")  # phrases and codes stay ascending in a bucket
                there, begin = np.unique(bucket[order], return_index=True)
                parts = np.split(order, begin[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(there, pa.int32()),
                        pa.array(np.full(len(there), batch["chunk"][i].as_py()), pa.int64()),
                        pa.array([pack_sorted(x) for x in parts], pa.binary()),
                        pa.array([pack_sorted(phrases[x]) for x in parts], pa.binary()),
                        pa.array([pack(counts[x]) for x in parts], pa.binary()),
                    ],
                    names=["bucket", "chunk", "codes", "phrases", "counts"],
                )

    return run


def _count_bucket(buckets: int, min_count: int):
    """Add up a bucket. One row holds its frequent phrases, one more for each chunk the chunk's."""

    def run(table: pa.Table) -> pa.Table:
        own = [unpack_sorted(x) for x in table["phrases"]]
        phrases, of = np.unique(np.concatenate(own), return_inverse=True)
        totals = np.zeros(len(phrases), np.int64)
        np.add.at(totals, of, np.concatenate([unpack(x) for x in table["counts"]]))
        frequent = totals >= min_count
        ids = (np.cumsum(frequent) - 1) * buckets + table["bucket"][0].as_py()
        if ids.max(initial=0) >> _ID_BITS:
            raise ValueError("too many frequent phrases of one length to be numbered")
        out = [{"frequent": [{"id": i, "phrase": p, "n": n} for i, p, n in zip(
            ids[frequent].tolist(), phrases[frequent].tolist(), totals[frequent].tolist(), strict=True)]}]
        for row, mine in enumerate(np.split(of, np.cumsum([len(x) for x in own])[:-1])):
            use = frequent[mine]
            if use.any():
                codes = unpack_sorted(table["codes"][row])[use]
                out.append({"chunk": table["chunk"][row].as_py(), "codes": pack_sorted(codes), "ids": pack(ids[mine[use]])})
        return pa.Table.from_pylist(out, schema=_COUNTED_ARROW)

    return run


_COUNTED_ARROW = pa.schema(
    [
        ("chunk", pa.int64()),
        ("codes", pa.binary()),
        ("ids", pa.binary()),
        ("frequent", pa.list_(pa.struct([("id", pa.int64()), ("phrase", pa.int64()), ("n", pa.int64())]))),
    ]
)


def _frequent_words(occurrences: DataFrame, min_count: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """Numbered words with their counts, and each chunk's codes and numbers of them."""
    each = F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("code", "w")
    entries = occurrences.select("chunk", each).select("chunk", "code", "w.*")
    entries = entries.withColumnsRenamed({"langs": "lang", "words": "word"})
    counted = entries.groupBy("lang", "word").agg(F.sum("counts").alias("n")).filter(F.col("n") >= min_count)
    numbered = stored(counted.withColumn("at", F.monotonically_increasing_id()), f"{folder}/words")
    index, part = F.col("at").bitwiseAND(F.lit(_INDEX_MASK)), F.shiftright("at", 33)
    parts, longest = numbered.agg(F.max(part), F.max(index)).first()
    parts = (parts or 0) + 1
    if (longest or 0) * parts >> _ID_BITS:
        raise ValueError("too many frequent words to be numbered")
    words = numbered.select("lang", "word", "n", (index * parts + part).alias("id"))
    pairs = entries.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("chunk")
    return words, pairs.agg(F.collect_list(F.struct("code", "id")).alias("kept"))


def _frequent_phrases(occurrences: DataFrame, min_count: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """Numbered phrases (``left``, ``right``: numbers of their parts), and each chunk's of them."""
    entries = occurrences.agg(F.sum("entries")).first()[0] or 0
    buckets = entries // BUCKET_ENTRIES + 1
    dealt = occurrences.select("chunk", "phrases", "counts").mapInArrow(_to_buckets(buckets), _ENTRIES)
    counted = dealt.groupBy("bucket").applyInArrow(_count_bucket(buckets, min_count), _COUNTED)
    counted = stored(counted, folder)
    found = counted.select(F.inline("frequent")).select(
        "id",
        F.shiftright("phrase", 32).alias("left"),
        F.col("phrase").bitwiseAND(F.lit((1 << 32) - 1)).alias("right"),
        "n",
    )
    kept = counted.filter("chunk is not null").groupBy("chunk")
    return found, kept.agg(F.collect_list(F.struct("codes", "ids")).alias("kept"))


# --- phrases ------------------------------------------------------------------------


def _described(found: DataFrame, shorter: DataFrame) -> DataFrame:
    """Language, words and counts of all first and last parts, out of the two parts."""
    first = shorter.select(F.col("id").alias("left"), "lang", "words", "heads")
    last = shorter.select(
        F.col("id").alias("right"), F.element_at("words", -1).alias("last"), "tails"
    )
    return found.join(first, "left").join(last, "right").select(
        "id",
        "left",
        "right",
        "lang",
        "n",
        F.concat("words", F.array("last")).alias("words"),
        F.concat("heads", F.array("n")).alias("heads"),
        F.concat("tails", F.array("n")).alias("tails"),
    )


def _lowest_cut(length: int, a: Column) -> Column:
    """The cut with the smallest score, the first of them: score, k, l and r."""

    def cut(k: Column) -> Column:
        left, right = F.element_at("heads", k), F.element_at("tails", F.lit(length) - k)
        exact = [x.cast("decimal(18,0)") for x in (a, left, right)]
        score = F.call_function("div", F.lit(1_000_000) * exact[0] * exact[0], exact[1] * exact[2])
        return F.struct(score.alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), F.lit(length - 1)), cut))


def _not_inside(phrases: DataFrame, longer: DataFrame | None, share_pct: int) -> DataFrame:
    """Drop phrases that lie in a longer one with at least that share of their count.

    Of all longer phrases around one, one that adds a single word is the most frequent.
    """
    if longer is None:
        return phrases
    around = longer.select(F.inline(F.array(*[F.struct(F.col(c).alias("id"), "n") for c in ("left", "right")])))
    most = around.groupBy("id").agg(F.max("n").alias("most"))
    kept = F.coalesce(F.col("most") * 100 < F.col("n") * share_pct, F.lit(True))
    return phrases.join(most, "id", "left").filter(kept).drop("most")


def _ranked(cuts: DataFrame, words: DataFrame, top: int) -> DataFrame:
    """The best of each language. Only those that can be among them get their texts."""
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = cuts.withColumn("place", F.rank().over(best)).filter(F.col("place") <= top)
    each = near.select("lang", "a", "l", "r", "score", "words", F.posexplode("words").alias("at", "id"))
    named = each.join(words.select("id", "word"), "id").groupBy("lang", "words", "a", "l", "r", "score")
    named = named.agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("texts"))
    phrase = F.array_join(F.col("texts.word"), " ")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    named = named.select("lang", phrase.alias("phrase"), "a", "l", "r", "score")
    return named.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)


def collocations(
    docs: DataFrame,
    max_words: int = 3,
    min_count: int = 10,
    top: int = 2000,
    inside_pct: int = 50,
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """The ``top`` phrases of 2 to ``max_words`` words of each language.

    ``lang``, ``rank``, ``phrase``, ``a`` (its count), ``l`` and ``r`` (counts of the parts
    at its weakest cut), ``n`` (all words of the language) and ``score``, which is
    floor(1000000 * a * a / (l * r)) in exact arithmetic.
    """
    if max_words < 2:
        raise ValueError("a phrase has two words at least")
    folder = scratch_dir(docs.sparkSession)
    rows = docs.select(F.col(lang).cast("string").alias("lang"), text_of(text).alias("text"))
    occurrences = stored(rows.mapInArrow(_word_chunks(CHUNK_BYTES), _WORDS), f"{folder}/occurrences-1")
    sizes = occurrences.select(F.inline(F.arrays_zip("langs", "counts"))).groupBy(F.col("langs").alias("lang"))
    sizes = sizes.agg(F.sum("counts").alias("n"))
    words, kept = _frequent_words(occurrences, min_count, folder)
    one = F.array("n")
    level = words.select("id", "lang", "n", F.array("id").alias("words"), one.alias("heads"), one.alias("tails"))
    levels = []
    for length in range(2, max_words + 1):
        joined = occurrences.select("chunk", "places", "codes").join(kept, "chunk")
        read = _kept_words if length == 2 else _kept_phrases
        occurrences = stored(joined.mapInArrow(_extended(read), _PHRASES), f"{folder}/occurrences-{length}")
        found, kept = _frequent_phrases(occurrences, min_count, f"{folder}/counts-{length}")
        level = stored(_described(found, level), f"{folder}/phrases-{length}")
        levels.append((length, level))
    cuts = None
    for i, (length, level) in enumerate(levels):
        own = _not_inside(level, levels[i + 1][1] if i + 1 < len(levels) else None, inside_pct)
        own = own.withColumn("cut", _lowest_cut(length, F.col("n")))
        own = own.select("lang", F.col("n").alias("a"), "cut.l", "cut.r", "cut.score", "words")
        cuts = own if cuts is None else cuts.unionByName(own)
    found = _ranked(cuts, words, top).join(sizes, "lang")
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
