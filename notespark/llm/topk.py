"""Exact top-k search by integer inner product.

Queries come in blocks of bounded size; a block is sent to every task, and each task scans its own
share of the vectors once, without a shuffle.  A task takes its vectors in chunks, each chunk in
order of descending length, and keeps the k best of every query:

* by Cauchy-Schwarz a score is at most the product of the two lengths, so once that is below a
  query's k-th best score the rest of the chunk is out for it;
* vectors and queries are rotated by the right singular vectors of a sample, which moves most of
  their length into the first coordinates; the partial sum over those plus the product of the
  lengths of what is left bounds the score, and whoever is below the k-th best is out;
* who is left is scored exactly, in integers.

The k-th best scores start from the longest vectors of all (a bounded number), so that every task
prunes from its first chunk on.  Bounds carry a margin above their rounding error: pruning never
changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written

SCALE = 1024
#: Rows that the rotation is fitted on; any rotation gives the same results.
SAMPLE = 4096
#: The longest vectors, from which the first thresholds are taken.
LONGEST = 2048
#: Bytes of one block of queries.
BLOCK_BYTES = 16 << 20
CHUNK = 4096
QUERIES_AT_A_TIME = 256

_LARGEST = 2**63 - 1


def scaled(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(1024 x) of each vector, padded with zeros to ``width``; and which rows take part."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        flat = np.floor(flat * SCALE)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out = np.zeros((len(lengths), width))
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    valid = column.is_valid().to_numpy(zero_copy_only=False).copy()
    valid[rows[~np.isfinite(flat)]] = False
    out[~valid] = 0
    return out, valid


class _Best:
    """The k best of a block of queries so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, k: int, floor=None):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.rotation, self.head = rotation, max(1, rotation.shape[0] // 4)
        self.lengths = _lengths(vectors)
        self.rotated = vectors @ rotation
        self.rest = _lengths(self.rotated[:, self.head :])
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor
        empty = np.empty(0)
        self.found = [(empty.astype(np.int64), empty.astype(np.int64), empty)] * -(-len(ids) // QUERIES_AT_A_TIME)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        lengths = _lengths(vectors)
        order = np.argsort(-lengths, kind="stable")
        ids, vectors, lengths = ids[order], vectors[order], lengths[order]
        with np.errstate(over="ignore"):
            top = np.abs(vectors).max(initial=0) * np.abs(self.vectors).max(initial=0) * vectors.shape[1]
        exact = top < 2.0**53
        if exact:
            rotated = vectors @ self.rotation
            rest = _lengths(rotated[:, self.head :])
            margin = 1.0 + 1e-9 * top
        for part, begin in enumerate(range(0, len(self.ids), QUERIES_AT_A_TIME)):
            q = slice(begin, begin + QUERIES_AT_A_TIME)
            floor = self.floor[q]
            if not exact:
                scores = _integers(self.vectors[q]) @ _integers(vectors).T
                scores = np.clip(scores, -_LARGEST, _LARGEST)
                alive = ~(self.ids[q, None] == ids[None, :])
            else:
                reach = self.lengths[q].max(initial=0) * lengths + margin >= floor.min(initial=np.inf)
                n = int(np.count_nonzero(reach))  # a prefix: lengths descend
                if not n:
                    continue
                bound = self.rotated[q, : self.head] @ rotated[:n, : self.head].T
                bound += self.rest[q, None] * rest[None, :n] + margin
                alive = (bound >= floor[:, None]) & (self.ids[q, None] != ids[None, :n])
                columns = np.flatnonzero(alive.any(axis=0))
                if not len(columns):
                    continue
                alive = alive[:, columns]
                scores = self.vectors[q] @ vectors[columns].T
                own = ids[columns]
            if exact:
                masked = np.where(alive, scores, -np.inf)
                if masked.shape[1] > self.k:
                    kth = np.partition(masked, masked.shape[1] - self.k, axis=1)[:, -self.k]
                    alive &= masked >= np.maximum(kth, floor)[:, None]
                row, column = np.nonzero(alive)
                self._merge(part, begin, row, own[column], scores[row, column])
            else:
                row, column = np.nonzero(alive)
                self._merge(part, begin, row, ids[column], scores[row, column])

    def _merge(self, part: int, begin: int, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        old = self.found[part]
        row, ids = np.concatenate((old[0], row)), np.concatenate((old[1], ids))
        scores = np.concatenate((old[2].astype(scores.dtype), scores))
        order = np.lexsort((ids, -scores, row))
        row, ids, scores = row[order], ids[order], scores[order]
        starts = np.searchsorted(row, row)
        rank = np.arange(len(row)) - starts
        keep = rank < self.k
        self.found[part] = row[keep], ids[keep], scores[keep]
        full = rank == self.k - 1
        at = begin + row[full]
        self.floor[at] = np.maximum(self.floor[at], scores[full].astype(np.float64))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position of the query, id and score of its best."""
        rows = [r + i * QUERIES_AT_A_TIME for i, (r, _, _) in enumerate(self.found)]
        scores = [s if s.dtype == object else s.astype(np.int64) for _, _, s in self.found]
        return np.concatenate(rows), np.concatenate([i for _, i, _ in self.found]), np.concatenate(scores)


def _integers(vectors: np.ndarray) -> np.ndarray:
    """Python integers, for vectors whose scores double precision can't hold."""
    return np.vectorize(int, otypes=[object])(vectors) if vectors.size else vectors.astype(object)


def _lengths(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((vectors * vectors).sum(axis=1))


def _collected(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    table = rows.toArrow()
    vectors, valid = scaled(table.column(1).combine_chunks(), width)
    return table.column(0).to_numpy()[valid], vectors[valid]


def _chosen(data: DataFrame, order: list, n: int) -> DataFrame:
    """About the first ``n`` rows in an order, at most 2 n; ids are ranked alone, without vectors."""
    ids = data.select("vec_id", *[o.alias(f"_{i}") for i, o in enumerate(order)]).orderBy(*[f"_{i}" for i in range(len(order))], "vec_id")
    return data.join(F.broadcast(ids.limit(n).select("vec_id").distinct()), "vec_id").limit(2 * n)


def top_k(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """The ``k`` best of each query: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``.

    ``vectors`` has ``vec_id`` and ``embedding``; ``is_query`` is a condition on ``vec_id``.  A
    query's candidates are all rows but those with its own vec_id.  Each component becomes
    floor(1024 x); the score is the integer inner product, ties go to the smaller vec_id.

    Nulls and other cases: rows take no part whose vec_id or vector is null or whose vector holds a
    null or a number that is not finite.  A shorter vector counts as padded with zeros, so an empty
    one scores 0.  Repeated rows are candidates each; a repeated query is one query, and rows that
    share a vec_id with different vectors are queries of their own under that id.  Scores outside
    64 bits stop at the largest ones.  An empty table gives an empty result.  Extra columns are
    left out.
    """
    data = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id IS NOT NULL")
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    data = data.where(finite)
    asked = written(data.where(is_query).distinct())
    spark = vectors.sparkSession
    width, n = data.agg(F.max(F.size("embedding"))).first()[0], asked.count()
    schema = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], schema)
    width = max(width, 1)
    _, sample = _collected(_chosen(data, [F.xxhash64("vec_id")], SAMPLE), width)
    scale = np.abs(sample).max(initial=0) or 1.0
    rotation = np.linalg.svd(sample / scale, full_matrices=True)[2].T if len(sample) >= width else np.eye(width)
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    longest = _collected(_chosen(data, [-squares], LONGEST), width)

    per_block = max(1, BLOCK_BYTES // (8 * width))
    blocks = -(-n // per_block)
    results = []
    for block in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block)
        ids, queries = _collected(mine, width)
        seeds = _Best(ids, queries, rotation, k)
        for i in range(0, len(longest[0]), CHUNK):
            seeds.add(longest[0][i : i + CHUNK], longest[1][i : i + CHUNK])
        sent = spark.sparkContext.broadcast((ids, queries, rotation, seeds.floor))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, queries, rotation, floor = sent.value
            best = _Best(ids, queries, rotation, k, floor.copy())
            for batch in batches:
                for i in range(0, batch.num_rows, CHUNK):
                    part = batch.slice(i, CHUNK)
                    found, valid = scaled(part.column(1), width)
                    best.add(part.column(0).to_numpy()[valid], found[valid])
            query, vec_id, score = best.rows()
            columns = [query, ids[query], vec_id, np.array([int(s) for s in score], dtype=np.int64)]
            yield pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], names=["query", "query_id", "vec_id", "score"])

        found = data.mapInArrow(run, "query long, query_id long, vec_id long, score long")
        order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked = ranked.select("query_id", "rank", "vec_id", "score")
        results.append(ranked if blocks == 1 else written(ranked))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
