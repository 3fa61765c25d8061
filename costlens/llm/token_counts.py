"""Token counts from a cache of digests.

A text's content digest is the SHA-256 of its UTF-8 bytes: the tokenizer gets texts as
they are, so the only normalisation that keeps counts is that null counts as empty. The
tokenizer's version digest is that of its file and its library's version. Texts whose
content digest has no count for that version in the cache are encoded, each different
text once, and appended; then all documents take their counts from the cache.

Byte-level tokenizers without a normalizer count by units, the parts of a text between
certain blanks, and remember a bounded number of them; others encode whole texts.

Only one row of each missing text is shuffled with its text, so copies, however many,
cost one digest per map task. A lost append leaves the cache as it was; counts that two
jobs append at the same time are equal and read once.

Defined results: null and empty texts have no tokens. Rows of one id are separate rows.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.llm.rows import ID, NO_ID, text_of

DIGEST = "_digest"
_COUNTS = f"{DIGEST} binary, n_tokens long"
_BATCH_BYTES = 1 << 20


class Tokenizer:
    """A tokenizer file's content, bounded by the file, and its version digest."""

    def __init__(self, path: str):
        import tokenizers

        with open(path, encoding="utf-8") as file:
            self.content = file.read()
        self.version = hashlib.sha256(f"{tokenizers.__version__}\n{self.content}".encode()).hexdigest()

    def load(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        import tokenizers

        out = tokenizers.Tokenizer.from_str(self.content)
        out.no_truncation()
        out.no_padding()
        return out


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(text_of(text), 256))


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The counts of one tokenizer version; none if nothing is stored yet."""
    try:
        stored = spark.read.schema(_COUNTS).parquet(f"{cache}/version={version}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _COUNTS)
    return stored.groupBy(DIGEST).agg(F.max("n_tokens").alias("n_tokens"))


class UnitCounts:
    """Counts by the units of a text, each different unit encoded once while it is remembered.

    Byte-level pre-tokens never hold a blank but as their first byte or next to other white
    space. So a text can be cut before a blank between two characters that are no white
    space, and the tokens of the parts are the tokens of the text. Only characters that
    are certainly none, in whatever version of Unicode, count here.
    """

    SAFE = "[!-~\u00a1-\u024f]"
    MOST = 1 << 19  # units remembered
    LONGEST = 64  # characters of one

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.cut = re.compile(rf" (?<={self.SAFE} )(?={self.SAFE})")
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, int] = {}

    @staticmethod
    def fits(content: str) -> bool:
        """Whether a tokenizer is one that units can be used for."""
        made = json.loads(content)
        steps = made.get("pre_tokenizer") or {}
        byte_level = steps.get("type") == "ByteLevel" and steps.get("use_regex") and not steps.get("add_prefix_space")
        model = made.get("model") or {}
        return bool(byte_level) and not made.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout")

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        # The library looks for added tokens first, across units too.
        plain = [not any(a in t for a in self.added) for t in texts]
        cut = [self.cut.split(t) if p else [t] for t, p in zip(texts, plain, strict=True)]
        firsts = self.encoded([parts[0] for parts in cut])
        counts = [list(map(self.known.get, parts[1:])) for parts in cut]
        new = {u for parts, found in zip(cut, counts, strict=True) if None in found for u, n in zip(parts[1:], found, strict=True) if n is None}
        if new:
            new = list(new)
            fresh = dict(zip(new, self.encoded([" " + u for u in new]), strict=True))
            for i, found in enumerate(counts):
                if None in found:
                    counts[i] = [fresh[u] if n is None else n for u, n in zip(cut[i][1:], found, strict=True)]
            if len(self.known) + len(fresh) > self.MOST:
                self.known.clear()
            short = ((u, n) for u, n in fresh.items() if len(u) <= self.LONGEST)
            self.known.update(itertools.islice(short, self.MOST))
        return [first + sum(found) for first, found in zip(firsts, counts, strict=True)]


class WholeCounts:
    """Counts of whole texts, for any tokenizer."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=1)
def _counter(version: str, load) -> UnitCounts | WholeCounts:
    """A worker process keeps its last counter, with what it remembers, for its next tasks."""
    made = load()
    return (UnitCounts if UnitCounts.fits(made.content) else WholeCounts)(made.load())


class _Load:
    """Fetches the broadcast tokenizer; equal to any other one, so that the version alone counts."""

    def __init__(self, shared):
        self.shared = shared

    def __call__(self) -> Tokenizer:
        return self.shared.value

    def __eq__(self, other):
        return isinstance(other, _Load)

    def __hash__(self):
        return 0


def _counted(shared, version: str):
    def run(batches):
        counter = _counter(version, _Load(shared))
        for batch in batches:
            texts = batch["text"]
            counts, at = [], 0
            while at < len(batch):
                part, size = [], 0
                while at < len(batch) and (not part or size < _BATCH_BYTES):
                    part.append(texts[at].as_py())
                    size += len(part[-1])
                    at += 1
                counts += counter.count(part)
            yield pa.RecordBatch.from_arrays([batch[DIGEST], pa.array(counts, pa.int64())], names=[DIGEST, "n_tokens"])

    return run


def fill_cache(docs: DataFrame, tokenizer: Tokenizer, cache: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode the different texts that the cache lacks and append their counts."""
    spark = docs.sparkSession
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias(ID)
    rows = docs.select(key, _digest(text).alias(DIGEST))
    known = read_cache(spark, cache, tokenizer.version)
    wanted = rows.groupBy(DIGEST).agg(F.min(ID).alias(ID)).join(known, DIGEST, "left_anti")
    texts = docs.select(key, _digest(text).alias(DIGEST), text_of(text).alias("text"))
    missing = texts.join(wanted, [ID, DIGEST]).dropDuplicates([ID, DIGEST]).select(DIGEST, "text")
    shared = spark.sparkContext.broadcast(tokenizer)

    missing.mapInArrow(_counted(shared, tokenizer.version), _COUNTS).write.mode("append").parquet(f"{cache}/version={tokenizer.version}")


def count_tokens(docs: DataFrame, tokenizer: Tokenizer, cache: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``n_bytes`` and ``n_tokens`` of the whole text."""
    fill_cache(docs, tokenizer, cache, doc_id, text)
    rows = docs.select(doc_id, F.octet_length(text_of(text)).cast("long").alias("n_bytes"), _digest(text).alias(DIGEST))
    counts = read_cache(docs.sparkSession, cache, tokenizer.version)
    return rows.join(counts, DIGEST).select(doc_id, "n_bytes", "n_tokens")
