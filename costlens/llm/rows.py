"""Row keys shared by the operators: one key for each pair of id and text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens.llm.words import U64, mix

ID, TWIN = "_id", "_twin"
KEY = [ID, TWIN]
NO_ID = 2**63 - 1


def text_of(text: str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *extra: Column) -> DataFrame:
    """Id, hash of the text, and the text. A null id counts as the largest id."""
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))
    return docs.select(key.alias(ID), F.xxhash64(text_of(text)).alias(TWIN), text_of(text).alias("text"), *extra)


def light_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Id, two hashes and the length of the text: what tells texts apart without them."""
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias(ID),
        F.xxhash64(text_of(text)).alias(TWIN),
        F.xxhash64(F.lit(7), text_of(text)).alias("_other"),
        F.octet_length(text_of(text)).alias("_bytes"),
    ]


def first_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The smallest id among the rows of each different text, with the text's key.

    Only ids and hashes are shuffled, and copies meet on the map side first, so one
    text may hold any share of the rows.
    """
    light = docs.select(*light_key(doc_id, text))
    return light.groupBy(TWIN, "_other", "_bytes").agg(F.min(ID).alias(ID))


def distinct_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch without repeats of a row's id and text."""
    keys = mix(batch[ID].to_numpy().view(U64)) ^ batch[TWIN].to_numpy().view(U64)
    first = np.sort(np.unique(keys, return_index=True)[1])
    return batch if len(first) == len(batch) else batch.take(pa.array(first))
