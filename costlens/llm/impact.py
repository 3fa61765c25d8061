"""Exact largest inner products from an impact-ordered index, a score at a time.

Components become whole numbers, floor(256 * x). The vectors are dealt over shards. For
each dimension a shard holds its rows ordered by their value there, cut into segments
where the value's level (one of 16 between the dimension's smallest and largest) changes.

A query takes the segments of all dimensions in descending order of the largest product
that a row of the segment can add, its quantised impact, and adds that to the segment's
rows. A row lies in one segment of each dimension, and no segment still to come adds more
than the next one. So its sum, plus the next impact for each dimension it was not met in,
is never below its true product. The best sums so far are multiplied out, and the k-th
largest true product is a proven limit: rows that cannot reach it are out. Segments are
read until multiplying out all rows that are left costs less than reading on; then that is
done. The answer is exact whatever the time of the stop.

All that is moved are single vectors, never a packed shard. A task gets the rows of one
shard, orders them into its index and lets its queries run through, some at a time; it holds
one shard and one batch of rows, however many rows and queries there are. The shards' answers
are merged. A shard is as large as a task holds well, in rows and in components: the more
rows it has, the sooner its limit rules rows out. Where there are few shards, the queries of
each are spread over several tasks. Results do not depend on any of this.

Defined results: vectors that are null or hold null or non-finite components take no
part, nor do null ids; zero vectors do. Vectors meet those of their own length only. An
id is no answer to itself. Rows of one id count as one: its score is the largest over
its rows, as a query too. Equal scores go to the smaller id. Components whose products
could leave 64 bits raise an error. Without other vectors a query has no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costlens.llm.components import stored
from costlens.session import scratch_dir

SCALE = 256.0
LEVELS = 16
SHARD_ROWS = 1 << 16
SHARD_DIM = 64  # of longer vectors a shard has fewer rows
BLOCK_QUERIES = 64
TASK_BLOCKS = 4  # a task with fewer blocks of queries is not worth a copy of the shard's rows
_CORE_TASKS = 4
_LOOKS = 8

_WHOLE = "vec_id long, dim int, vector binary"
_FOUND = "query_id long, vec_id long, score long"


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x) of each component."""
    dim = vectors.shape[1]
    scaled = np.floor(SCALE * vectors)
    largest = np.abs(scaled).max(initial=0)
    if dim * largest * largest >= 2.0 ** (61 - dim.bit_length()):
        raise ValueError("components are too large for exact products of 64 bits")
    return scaled.astype(np.int32)


class Shard:
    """Vectors as whole numbers, and each dimension's rows in descending order, in segments."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, postings: np.ndarray, starts: np.ndarray):
        self.ids, self.vectors, self.postings, self.starts = ids, vectors, postings, starts
        rows, self.dim = vectors.shape
        self.ends = np.append(starts[1:], rows * self.dim)[: len(starts)]
        self.of_dim = starts // max(rows, 1)
        self.high = vectors[postings[starts], self.of_dim]
        self.low = vectors[postings[self.ends - 1], self.of_dim]

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray) -> Shard:
        rows, dim = vectors.shape
        postings = np.empty((dim, rows), np.int32)
        new = np.ones((dim, rows), bool)
        for d in range(dim):  # one at a time: sorting all at once takes several times the shard's memory
            values = vectors[:, d].astype(np.int64)
            postings[d] = np.argsort(-values, kind="stable")
            values = values[postings[d]]
            level = (values[0] - values) * LEVELS // (values[0] - values[-1] + 1)
            new[d, 1:] = level[1:] != level[:-1]
        return cls(ids, vectors, postings.reshape(-1), np.flatnonzero(new))

    def products(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        return self.vectors[rows] @ query

    def _best(self, rows: np.ndarray, query: np.ndarray, k: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best different ids among the rows with their true scores, which reach the limit."""
        scores = self.products(rows, query)
        if limit is not None:
            rows, scores = rows[scores >= limit], scores[scores >= limit]
        ids = self.ids[rows]
        order = np.lexsort((ids, -scores))
        ids, scores = ids[order], scores[order]
        first = np.sort(np.unique(ids, return_index=True)[1])[:k]
        return ids[first], scores[first]

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the best, and how many postings were read."""
        rows = len(self.ids)
        weight = query[self.of_dim]
        impact = weight * np.where(weight > 0, self.high, self.low)
        order = np.flatnonzero(weight)
        order = order[np.argsort(-impact[order], kind="stable")]
        dims, bits = int(np.count_nonzero(query)), self.dim.bit_length()
        # A row's sum, and in its lowest bits the number of dimensions it was met in.
        sums = np.zeros(rows, np.int64)
        adds = ((impact << bits) + 1).tolist()
        begin, end = self.starts.tolist(), self.ends.tolist()
        total, read, limit = dims * rows, 0, None
        look = total // _LOOKS
        possible = np.flatnonzero(self.ids != query_id)
        for place, segment in enumerate(order.tolist()):
            np.add.at(sums, self.postings[begin[segment] : end[segment]], adds[segment])
            read += end[segment] - begin[segment]
            if read < look or place + 1 == len(order):
                continue
            following = int(impact[order[place + 1]])
            # Bounds only fall and the limit only rises, so rows that are out stay out.
            seen = sums[possible]
            most = (seen >> bits) + (dims - (seen & ((1 << bits) - 1))) * following
            limit = self._limit(most, possible, query, k, limit)
            if limit is not None:
                possible = possible[most >= limit]
            if len(possible) * self.dim <= total - read:
                break
            look = read + total // _LOOKS
        ids, scores = self._best(possible, query, k, limit)
        return ids, scores, read

    def _limit(self, most: np.ndarray, possible: np.ndarray, query: np.ndarray, k: int, limit: int | None) -> int | None:
        """A score that ``k`` different ids reach for certain."""
        tried = min(len(most), 4 * k + 16)
        likely = np.argpartition(most, len(most) - tried)[len(most) - tried :] if tried else []
        _, scores = self._best(possible[likely], query, k)
        found = int(scores[-1]) if len(scores) == k else None
        return found if limit is None or (found is not None and found > limit) else limit


# --- on Spark -----------------------------------------------------------------------


def _pack(batches):
    """The components of each row as whole numbers: the lowest byte of each, then the second and so on, as the
    upper ones are mostly the sign's and compress well."""
    for batch in batches:
        vectors = batch["vector"]
        dims, values = vectors.value_lengths().to_numpy(), vectors.flatten().to_numpy()
        for dim in np.unique(dims).tolist():
            own = dims == dim
            numbers = whole_numbers(values[np.repeat(own, dims)].reshape(int(own.sum()), dim))
            raw = numbers.view(np.uint8).reshape(len(numbers), dim, 4).transpose(0, 2, 1).tobytes()
            ends = np.arange(len(numbers) + 1, dtype=np.int32) * (4 * dim)
            packed = pa.Array.from_buffers(pa.binary(), len(numbers), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
            ids = batch["vec_id"].filter(pa.array(own))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.full(len(ids), dim, np.int32)), packed], names=["vec_id", "dim", "vector"]
            )


def _numbers(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and whole numbers of rows of one length."""
    raw = np.frombuffer(b"".join(batch["vector"].to_pylist()), np.uint8).reshape(len(batch), 4, dim)
    by_place = np.ascontiguousarray(raw.transpose(0, 2, 1))
    return batch["vec_id"].to_numpy(), by_place.view(np.int32).reshape(len(batch), dim)


def _runs(batch: pa.RecordBatch):
    """Neighbouring rows of a batch with the same ``task``, ``dim`` and ``asked``, with these."""
    keys = np.stack([batch[c].to_numpy() for c in ("task", "dim", "asked")])
    first = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0))[: len(batch)])
    ends = np.append(first[1:], len(batch))[: len(first)]
    for begin, end in zip(first.tolist(), ends.tolist(), strict=True):
        yield keys[:, begin].tolist(), batch.slice(begin, end - begin)


def _search(k: int, block: int = BLOCK_QUERIES):
    """For rows ordered by ``task``, ``dim`` and ``asked``: a shard's rows, and then its queries."""

    def run(batches):
        current, held, shard = None, [], None
        for batch in batches:
            for (task, dim, asked), rows in _runs(batch):
                if current != (task, dim):
                    current, held, shard = (task, dim), [], None
                if not asked:
                    held.append(_numbers(rows, dim))
                    continue
                if held:
                    ids, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
                    held = []
                    shard = Shard.build(ids, vectors)
                for begin in range(0, len(rows) if shard else 0, block):
                    yield _answers(shard, *_numbers(rows.slice(begin, block), dim), k)

    return run


def _answers(shard: Shard, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pa.RecordBatch:
    found = [shard.search(i, q, k)[:2] for i, q in zip(query_ids.tolist(), queries.astype(np.int64), strict=True)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(query_ids, [len(x) for x, _ in found])),
            pa.array(np.concatenate([x for x, _ in found])),
            pa.array(np.concatenate([s for _, s in found])),
        ],
        names=["query_id", "vec_id", "score"],
    )


def _usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """Different pairs of id and whole numbers that take part, with their ``dim``."""
    fine = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    own = own.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & fine)
    return own.mapInArrow(_pack, _WHOLE).distinct()


def _layout(rows: int, components: int, queries: int, cores: int) -> tuple[int, int]:
    """Number of shards, and of tasks over which the queries of a shard are spread."""
    shards = max(rows, components // SHARD_DIM) // SHARD_ROWS + 1
    wanted = -(-_CORE_TASKS * cores // shards)
    return shards, min(wanted, queries // (BLOCK_QUERIES * TASK_BLOCKS) + 1)


def largest_products(
    vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` largest products of each query."""
    spark = vectors.sparkSession
    folder = scratch_dir(spark)
    rows = stored(_usable(vectors, vec_id, vector), f"{folder}/vectors")
    asked = stored(_usable(queries, vec_id, vector), f"{folder}/queries")
    count, components = rows.agg(F.count("dim"), F.coalesce(F.sum("dim"), F.lit(0))).first()
    shards, parts = _layout(count, components, asked.count(), spark.sparkContext.defaultParallelism)

    number = F.xxhash64("vec_id", "vector")
    # Task shard * parts + part: a row goes to all parts of its shard, a query to its part of all shards.
    shard, part = (F.pmod(number, F.lit(shards)) * parts).cast("int"), F.pmod(number, F.lit(parts)).cast("int")
    of_row = F.sequence(shard, shard + F.lit(parts - 1))
    of_query = F.sequence(part, part + F.lit((shards - 1) * parts), F.lit(parts))
    dealt = rows.select("*", F.lit(0).alias("asked"), F.explode(of_row).alias("task"))
    dealt = dealt.unionByName(asked.select("*", F.lit(1).alias("asked"), F.explode(of_query).alias("task")))
    dealt = dealt.repartitionById(shards * parts, "task").sortWithinPartitions("task", "dim", "asked")
    found = dealt.mapInArrow(_search(k, BLOCK_QUERIES), _FOUND)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
