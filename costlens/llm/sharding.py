"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Keys and virtual nodes have places on a ring of ``CELLS`` cells, by MD5. A key belongs
to the first virtual node clockwise. A shard takes keys in ring order up to its bound;
those beyond it go on clockwise to the next virtual node whose shard is not full, in
rounds, until all have a place. As the bounds add up to all rows, or more, all do.

Keys of one cell differ only in their order there, so the plan needs the number of rows
of each cell alone: at most ``CELLS`` numbers, whatever the size of the data. It says
which ranks of each cell go to which shard and slot; the rows find theirs by joining on
the cell. Rows are counted before any shuffle, so equal rows travel as one.

Law ``rows``: a shard takes the floor of its share, the first shards one more. With a
``load`` above 1 each shard takes up to that multiple of its share instead, and fewer
keys move when shards come or go.

Defined results: a null id is a key like any other; a null text has size 1 and the
checksum of the empty text; equal rows are all kept, each with a slot of its own.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from costlens.llm.rows import text_of

CELLS = 1 << 16
VIRTUAL_NODES = 64
_RUN = 4096


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """Cell and shard of each virtual node, clockwise."""
    place = lambda s, v: int(hashlib.md5(f"{s}/{v}".encode()).hexdigest()[:4], 16)
    return sorted((place(s, v), s, v) for s in range(shards) for v in range(virtual_nodes))


def bounds(total: int, shards: int, load: float | None) -> list[int]:
    """How many rows each shard takes at most."""
    if load is None:
        return [total // shards + (s < total % shards) for s in range(shards)]
    if load < 1:
        raise ValueError("shards must be able to take all rows")
    return [math.ceil(load * total / shards)] * shards


def plan(counts: dict[int, int], shards: int, load: float | None = None) -> list[tuple[int, int, int, int, int]]:
    """Ranges of ranks: cell, first rank, rank after the last, shard, slot of the first."""
    nodes = [(cell, shard) for cell, shard, _ in ring(shards)]
    free, taken = bounds(sum(counts.values()), shards, load), [0] * shards
    out, waiting, at = [], [], 0
    for cell in sorted(counts):
        while at < len(nodes) and nodes[at][0] < cell:
            at += 1
        waiting.append((cell, 0, counts[cell], at % len(nodes)))
    while waiting:
        over = []
        for cell, first, end, node in waiting:
            shard = nodes[node][1]
            some = min(end - first, free[shard])
            if some:
                out.append((cell, first, first + some, shard, taken[shard]))
                free[shard] -= some
                taken[shard] += some
            if first + some < end:
                over.append((cell, first + some, end, node))
        following = _next_open(nodes, free)
        waiting = [(cell, first, end, following[node]) for cell, first, end, node in over]
    return out


def _next_open(nodes: list[tuple[int, int]], free: list[int]) -> list[int]:
    """For each virtual node the next one clockwise whose shard is not full."""
    out, following = [-1] * len(nodes), -1
    for i in reversed(range(2 * len(nodes))):
        out[i % len(nodes)] = following
        if free[nodes[i % len(nodes)][1]]:
            following = i % len(nodes)
    return out


def _key(doc_id: str) -> Column:
    return F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def assign(
    docs: DataFrame, shards: int = 16, load: float | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot``."""
    spark = docs.sparkSession
    rows = (
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(text_of(text)) + 1).cast("long").alias("size"),
            F.crc32(text_of(text)).alias("text_crc32"),
            _key(doc_id).alias("place"),
        )
        .withColumn("cell", F.conv(F.substring("place", 1, 4), 16, 10).cast("int"))
        .groupBy("cell", "place", "doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # At most one number for each cell of the ring.
    counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    ranges = spark.createDataFrame(
        plan(counts, shards, load), "cell int, first long, end long, shard int, first_slot long"
    )
    order = Window.partitionBy("cell").orderBy("place", "doc_id", "size", "text_crc32")
    ranked = rows.withColumn("upto", F.sum("n").over(order)).withColumn("from", F.col("upto") - F.col("n"))
    placed = (
        ranked.join(ranges, "cell")
        .filter((F.col("first") < F.col("upto")) & (F.col("end") > F.col("from")))
        .withColumn("low", F.greatest("first", "from"))
        .withColumn("high", F.least("end", "upto"))
    )
    # Equal rows part again, in runs, so no array holds more than a run's ranks.
    runs = placed.withColumn("run", F.explode(F.sequence("low", F.col("high") - 1, F.lit(_RUN).cast("long"))))
    ranks = F.sequence("run", F.least(F.col("run") + _RUN, F.col("high")) - 1)
    return runs.withColumn("rank", F.explode(ranks)).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("rank") - F.col("first")).alias("slot")
    )
