"""Nearest neighbours from a hierarchical navigable small-world graph per shard.

Different vectors are spread over shards of about ``SHARD_ROWS`` by their hash; each has
the smallest ids that share it, as many as an answer can hold. A shard's graph has
layers, each with about a sixteenth of the nodes of the one below; a layer is one flat
array of neighbours, ``width`` to a node. Nodes are inserted in batches: a beam search
from the layer above finds candidates, of which those are linked that are nearer to the
node than to a neighbour chosen before; links back are pruned by the same rule.

Queries are packed into blocks. Every block meets every shard once; a shard returns its
best for each query, ranked by exact distances on the original vectors in double
precision, and the shards' answers are merged by rank.

Defined results: vectors that are null, all zero, or hold null or non-finite components
take no part, and neither do null ids; vectors are compared with those of their own
length only; a row that repeats an id and its vector counts once; an id with several
vectors is one answer and one query, at the least distance of them; a query's own id is no
answer; equal distances go to the smaller id. A query without candidates has no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from costlens.llm.components import stored
from costlens.session import scratch_dir

SHARD_ROWS = 8192
BLOCK_QUERIES = 4096
LINKS = 16
BUILD_BEAM = 64
SEARCH_BEAM = 128
_AT_ONCE = 4  # nodes expanded in one step of a beam search
_BATCH = 512


# --- the graph ----------------------------------------------------------------------


def _distances(vectors: np.ndarray, nodes: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its own row of nodes."""
    own = vectors[nodes]
    norms = np.einsum("qnd,qnd->qn", own, own) + np.einsum("qd,qd->q", queries, queries)[:, None]
    return norms - 2 * np.einsum("qnd,qd->qn", own, queries)


def beam_search(vectors, neighbours, queries, entries, beam) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes found for each query, nearest first, -1 for none.

    All queries step together; each step expands the nearest nodes not yet expanded.
    """
    count, size = len(queries), len(vectors)
    seen = np.zeros((count, size + 1), bool)
    seen[:, size] = True  # stands for no node
    rows = np.arange(count)[:, None]
    entries = np.sort(np.where(entries < 0, size, entries), axis=1)
    entries[:, 1:][entries[:, 1:] == entries[:, :-1]] = size
    found = np.full((count, beam), size)
    far = np.full((count, beam), np.inf, np.float32)
    width = min(beam, entries.shape[1])
    found[:, :width] = entries[:, :width]
    real = found < size
    far[real] = _distances(vectors, np.where(real, found, 0), queries)[real]
    seen[rows, found] = True
    done = ~real
    order = np.argsort(far, axis=1, kind="stable")
    found, far, done = (np.take_along_axis(x, order, 1) for x in (found, far, done))
    live = np.arange(count)
    while len(live):
        waiting = ~done[live]
        rank = np.cumsum(waiting, axis=1)
        chosen = waiting & (rank <= _AT_ONCE)
        nodes = np.where(chosen, found[live], size)
        take = np.argsort(~chosen, axis=1, kind="stable")[:, : min(_AT_ONCE, beam)]
        nodes = np.take_along_axis(nodes, take, 1)
        done[live] |= chosen
        around = np.where(nodes[:, :, None] < size, neighbours[np.minimum(nodes, size - 1)], -1).reshape(len(live), -1)
        around = np.sort(np.where(around < 0, size, around), axis=1)
        around[:, 1:][around[:, 1:] == around[:, :-1]] = size
        around[seen[live[:, None], around]] = size
        seen[live[:, None], around] = True
        real = around < size
        near = np.where(real, _distances(vectors, np.where(real, around, 0), queries[live]), np.inf).astype(np.float32)
        every = np.concatenate([far[live], near], axis=1)
        best = np.argsort(every, axis=1, kind="stable")[:, :beam]
        far[live] = np.take_along_axis(every, best, 1)
        found[live] = np.take_along_axis(np.concatenate([found[live], around], axis=1), best, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~real], axis=1), best, 1)
        live = live[(~done[live]).any(1)]
    return np.where(np.isinf(far), -1, found), far


def _spread_links(vectors, owners, candidates, far, width) -> np.ndarray:
    """Choose up to ``width`` neighbours of each owner from candidates ordered by distance:
    those nearer to the owner than to any chosen before, then the nearest of the rest."""
    real = (candidates >= 0) & (candidates != owners[:, None])
    own = vectors[np.maximum(candidates, 0)]
    norm = np.einsum("qcd,qcd->qc", own, own)
    between = norm[:, :, None] + norm[:, None, :] - 2 * np.einsum("qad,qbd->qab", own, own)
    chosen = np.zeros(candidates.shape, bool)
    for i in range(candidates.shape[1]):
        blocked = (chosen & (between[:, i] < far[:, i, None])).any(1)
        chosen[:, i] = real[:, i] & ~blocked & (chosen.sum(1) < width)
    rank = np.where(chosen, 0, np.where(real, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :width]
    return np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(candidates, order, 1), -1)


def _layer(vectors: np.ndarray, width: int, entries: np.ndarray) -> np.ndarray:
    """Neighbours of each node; ``entries`` are nodes known before, from the layer above."""
    size = len(vectors)
    neighbours = np.full((size, width), -1, np.int32)
    order = np.concatenate([np.unique(entries[entries >= 0]), np.zeros(0, np.int64)]).astype(np.int64)
    order = np.concatenate([order, np.setdiff1d(np.arange(size), order)])
    ready = 0
    while ready < size:
        batch = order[ready : ready + max(16, min(_BATCH, ready))]
        queries = vectors[batch]
        mutual = np.broadcast_to(batch, (len(batch), len(batch)))
        candidates, far = mutual, _distances(vectors, mutual, queries).astype(np.float32)
        if ready:
            first = np.where(entries[batch] < 0, order[0], entries[batch])
            linked = (neighbours[first] >= 0).any(2) if ready > 16 else np.zeros(first.shape, bool)
            first = np.where(linked, first, order[0])
            found, near = beam_search(vectors, neighbours, queries, first, BUILD_BEAM)
            candidates, far = np.concatenate([found, candidates], axis=1), np.concatenate([near, far], axis=1)
        far = np.where((candidates < 0) | (candidates == batch[:, None]), np.inf, far)
        best = np.argsort(far, axis=1, kind="stable")[:, : max(BUILD_BEAM, width)]
        candidates, far = np.take_along_axis(candidates, best, 1), np.take_along_axis(far, best, 1)
        candidates = np.where(np.isinf(far), -1, candidates)
        links = _spread_links(vectors, batch, candidates, far, width // 2)
        neighbours[batch, : links.shape[1]] = links
        _link_back(vectors, neighbours, batch, links)
        ready += len(batch)
    return neighbours


def _link_back(vectors, neighbours, batch, links) -> None:
    """Add the new nodes to their neighbours' lists, pruned to the width."""
    width = neighbours.shape[1]
    target, source = links[links >= 0], np.repeat(batch, (links >= 0).sum(1))
    order = np.lexsort((source, target))
    target, source = target[order], source[order]
    nodes, at, count = np.unique(target, return_index=True, return_counts=True)
    deepest = 3 * width
    while len(nodes):
        # A node with very many new links takes them in several turns.
        some = np.minimum(count, deepest)
        place = np.arange(int(some.max()))
        fresh = np.where(place < some[:, None], source[np.minimum(at[:, None] + place, len(source) - 1)], -1)
        every = np.concatenate([neighbours[nodes], fresh], axis=1)
        every = np.sort(every, axis=1)[:, ::-1].copy()
        every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
        far = np.where(every >= 0, _distances(vectors, np.maximum(every, 0), vectors[nodes]), np.inf).astype(np.float32)
        best = np.argsort(far, axis=1, kind="stable")
        every, far = np.take_along_axis(every, best, 1), np.take_along_axis(far, best, 1)
        for part in range(0, len(nodes), 256):
            own = slice(part, part + 256)
            kept = _spread_links(vectors, nodes[own], every[own], far[own], width)
            neighbours[nodes[own], : kept.shape[1]] = kept
        at, count = at + some, count - some
        more = count > 0
        nodes, at, count = nodes[more], at[more], count[more]


def build(vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the top: the nodes of each and their neighbours, as places among its nodes."""
    vectors = vectors.astype(np.float32)
    chance = np.random.default_rng(len(vectors)).random(len(vectors))
    level = np.minimum(-np.log(1 - chance) / np.log(LINKS), 8).astype(int)
    layers: list[tuple[np.ndarray, np.ndarray]] = []
    for height in range(int(level.max()), -1, -1):
        nodes = np.flatnonzero(level >= height)
        entries = _descend(vectors, layers, vectors[nodes], nodes)
        layers.append((nodes, _layer(vectors[nodes], 2 * LINKS if height == 0 else LINKS, entries)))
    return layers


def _descend(vectors, layers, queries, nodes, beam: int = 4) -> np.ndarray:
    """Entries into the layer of ``nodes`` for each query, as places among them."""
    found = np.full((len(queries), beam), -1)
    for i, (own, neighbours) in enumerate(layers):
        below = layers[i + 1][0] if i + 1 < len(layers) else nodes
        start = found if i else np.zeros((len(queries), 1), np.int64)
        places = _in_batches(vectors[own], neighbours, queries, start, beam)
        found = np.where(places >= 0, np.searchsorted(below, own[np.maximum(places, 0)]), -1)
    return found


def search(vectors: np.ndarray, layers, queries: np.ndarray, beam: int) -> np.ndarray:
    """Nodes found for each query, nearest first, -1 for none."""
    small = vectors.astype(np.float32)
    entries = _descend(small, layers[:-1], queries.astype(np.float32), layers[-1][0])
    entries = np.where(entries < 0, 0, entries)
    return _in_batches(small, layers[-1][1], queries.astype(np.float32), entries, beam)


def _in_batches(vectors, neighbours, queries, entries, beam) -> np.ndarray:
    parts = [slice(a, a + _BATCH) for a in range(0, len(queries), _BATCH)]
    return np.concatenate([beam_search(vectors, neighbours, queries[p], entries[p], beam)[0] for p in parts])


# --- on Spark -----------------------------------------------------------------------

_INDEX = "dim int, shard long, ids binary, id_ends binary, vectors binary, nodes array<binary>, neighbours array<binary>"
_BLOCK = "dim int, block long, query_ids binary, queries binary"
_FOUND = "query_id long, vec_id long, score double"


def _build_shard(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    dim = table["dim"][0].as_py()
    ids = table["ids"].combine_chunks()
    vectors = table["vector"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, dim)
    layers = build(vectors)
    row = {
        "dim": [dim],
        "shard": [table["shard"][0].as_py()],
        "ids": [ids.flatten().to_numpy().tobytes()],
        "id_ends": [np.cumsum(ids.value_lengths().to_numpy()).astype(np.int64).tobytes()],
        "vectors": [vectors.tobytes()],
        "nodes": [[n.astype(np.int32).tobytes() for n, _ in layers]],
        "neighbours": [[x.tobytes() for _, x in layers]],
    }
    kinds = {"dim": pa.int32(), "shard": pa.int64(), "nodes": pa.list_(pa.binary()), "neighbours": pa.list_(pa.binary())}
    return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in row.items()})


def _pack_block(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    vectors = table["vector"].combine_chunks().flatten().to_numpy().astype(np.float64)
    row = {
        "dim": pa.array([table["dim"][0].as_py()], pa.int32()),
        "block": pa.array([table["block"][0].as_py()], pa.int64()),
        "query_ids": pa.array([table["vec_id"].to_numpy().tobytes()], pa.binary()),
        "queries": pa.array([vectors.tobytes()], pa.binary()),
    }
    return pa.table(row)


def _search_shards(k: int, beam: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield _search_shard(row, k, beam)

    return run


def _search_shard(row: dict, k: int, beam: int) -> pa.RecordBatch:
    vectors = np.frombuffer(row["vectors"]).reshape(-1, row["dim"])
    ids, ends = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["id_ends"], np.int64)
    nodes = [np.frombuffer(n, np.int32) for n in row["nodes"]]
    layers = [(n, np.frombuffer(x, np.int32).reshape(len(n), -1)) for n, x in zip(nodes, row["neighbours"], strict=True)]
    query_ids, queries = np.frombuffer(row["query_ids"], np.int64), np.frombuffer(row["queries"]).reshape(-1, row["dim"])
    found = search(vectors, layers, queries, beam)
    query, place = np.nonzero(found >= 0)
    node = found[query, place]
    begin = ends - np.diff(ends, prepend=0)
    count = (ends - begin)[node]
    total = np.cumsum(count)
    vec = ids[np.arange(total[-1] if len(total) else 0) + np.repeat(begin[node] - (total - count), count)]
    apart = vectors[node] - queries[query]
    score = np.repeat(np.sqrt((apart * apart).sum(1)), count)
    query = np.repeat(query, count)
    other = vec != query_ids[query]
    query, vec, score = query[other], vec[other], score[other]
    order = np.lexsort((vec, score, query))
    query, vec, score = query[order], vec[order], score[order]
    nearest = np.unique(np.stack([query, vec]), axis=1, return_index=True)[1]  # of an id's vectors
    nearest.sort()
    query, vec, score = query[nearest], vec[nearest], score[nearest]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    best = rank < k
    return pa.RecordBatch.from_arrays(
        [pa.array(query_ids[query[best]]), pa.array(vec[best]), pa.array(score[best])], names=["query_id", "vec_id", "score"]
    )


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Different pairs of ``vec_id`` and ``vector`` that take part, with their ``dim``."""
    fine = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    own = own.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    return own.filter(fine & F.exists("vector", lambda x: x != 0)).withColumn("dim", F.size("vector"))


def build_index(vectors: DataFrame, k: int, folder: str) -> DataFrame:
    """One row for each shard: its ids, vectors and layers. ``k``: the longest answer."""
    nth = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))
    lowest = vectors.withColumn("_nth", nth).filter(F.col("_nth") <= k + 1)
    different = lowest.groupBy("dim", "vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    different = stored(different, f"{folder}/vectors")
    shards = different.count() // SHARD_ROWS + 1
    placed = different.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)))
    return stored(placed.groupBy("dim", "shard").applyInArrow(_build_shard, _INDEX), f"{folder}/index")


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    beam: int = SEARCH_BEAM,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest found for each query."""
    folder = scratch_dir(vectors.sparkSession)
    index = build_index(usable(vectors, vec_id, vector), k, folder)
    asked = stored(usable(queries, vec_id, vector).distinct(), f"{folder}/queries")
    blocks = asked.count() // BLOCK_QUERIES + 1
    packed = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).groupBy("dim", "block")
    packed = packed.applyInArrow(_pack_block, _BLOCK)
    # Each block goes to each shard: the queries are what is copied, not the graphs.
    shards = index.select("dim", "shard").groupBy("dim").agg(F.collect_list("shard").alias("shard"))
    sent = packed.join(shards, "dim").withColumn("shard", F.explode("shard"))
    found = index.join(sent, ["dim", "shard"]).mapInArrow(_search_shards(k, beam), _FOUND)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
