"""Bounded samples of labelled documents."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_held_out(doc_id: str = "doc_id") -> Column:
    """False for the ids that no model learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 != 2, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, sizes: dict[int, int]) -> DataFrame:
    """Id, text and label of at most ``sizes[c]`` ids of each class ``c``: the ids not held
    out with the smallest hashes. Several labels of one id: the largest.
    """
    use = not_held_out() & F.col("doc_id").isNotNull() & F.col(label).isNotNull()
    known = labels.filter(use).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("_label"))
    parts = [
        known.filter(F.col("_label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
        for value, size in sizes.items()
    ]
    chosen = parts[0].unionByName(parts[1])
    # The chosen ids are bounded by the two sizes, so the texts stay where they are.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter(F.col("text").isNotNull())
    # An id has one text, whatever rows it has: the one with the smallest hash.
    first = F.min_by("text", F.struct(F.xxhash64("text"), "text"))
    return rows.groupBy("doc_id").agg(first.alias("text"), F.max("_label").alias("_label"))


def in_order(rows: Iterable[tuple[int, str, int]]) -> list[tuple[str, bool]]:
    """The different texts of a sample with their labels, in one order whatever that of the rows."""
    return [(t, bool(x)) for t, x in sorted({t: x for _, t, x in sorted(rows)}.items())]


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sizes: dict[int, int]) -> list[tuple[str, bool]]:
    """Different labelled texts of the ``sample``."""
    return in_order(sample(docs, labels, label, sizes).collect())
