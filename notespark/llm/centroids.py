"""Centroid clustering in integers (Lloyd's rounds), with Drake's adaptive bounds.

Every vector carries its centroid, an upper bound of the distance to it, the nearest other centroids with
a lower bound of the distance to each, and one lower bound for all the rest.  When centroids move, bounds
move along.  A vector whose upper bound stays below all lower bounds keeps its centroid unseen.  Else the
upper bound is made exact; then only so many listed centroids are measured that the bounds behind them
certify the order, and all centroids only if no such prefix does.  The lists get shorter when no vector of
a round needed so many.  Bounds are widened beyond their rounding errors: they never change a result.

One round is one job over a written table of vectors with their bounds, without a shuffle of vectors:
tasks add up the components of their vectors by centroid, and those partial sums (k rows a task) lie in
the same table, in columns that only the next, tiny aggregation reads.  Written tables cut the lineage; a
round's table goes when the next one is written.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, unused, written

SCALE = 1024
#: Rows that are worked on at a time.
CHUNK = 4096
#: Up to this size of components, squared distances are exact in doubles (for 64 components).
_NARROW = 1 << 22
_LARGEST = 2**63 - 1
_SUMS = "n long, sums array<decimal(38,0)>, used int"
_BOUNDS = "cluster int, upper double, near array<int>, lower array<double>, rest double"


def _points(vectors: DataFrame, width: int, id_col: str, vector_col: str) -> DataFrame:
    x = F.col(vector_col)
    usable = lambda v: v.isNotNull() & (F.abs(v.cast("double") * SCALE) < 2.0**62)  # noqa: E731  (false for NaN, too: it is the largest)
    whole = (F.size(x) == width) & F.forall(x, usable)
    return vectors.where(whole).select(
        F.col(id_col).alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("long")).alias("point")
    )


def _squares(points: np.ndarray, centres: np.ndarray, narrow: bool) -> np.ndarray:
    """Squared distances of all pairs as doubles: exact if ``narrow``."""
    p, c = points.astype(np.float64), centres.astype(np.float64)
    if narrow:
        return (p * p).sum(axis=1)[:, None] - 2.0 * (p @ c.T) + (c * c).sum(axis=1)
    return np.stack([((p - row) ** 2).sum(axis=1) for row in c], axis=1)


def _exactly(point: np.ndarray, centre: np.ndarray) -> int:
    return sum((int(a) - int(b)) ** 2 for a, b in zip(point, centre))


class _Round:
    """Assigns chunks of vectors to ``centres``, which have moved by ``moves`` since the last round; lists
    have ``keep`` places."""

    def __init__(self, centres: list[list[int]], moves: list[float], keep: int):
        self.centres, self.moves = np.array(centres, dtype=np.int64), np.array(moves)
        self.keep, self.used = min(keep, len(centres) - 1), 0
        self.narrow_centres = bool(np.abs(self.centres).max(initial=0) <= _NARROW)

    def assign(self, points: np.ndarray, state: tuple | None) -> tuple:
        """The new state: cluster, upper, near, lower, rest."""
        n, keep = len(points), self.keep
        narrow = self.narrow_centres and bool(np.abs(points).max(initial=0) <= _NARROW) and points.shape[1] <= 64
        if state is None:
            fresh = (np.empty(n, np.int32), np.empty(n), np.empty((n, keep), np.int32), np.empty((n, keep)), np.empty(n))
            return self._all(points, np.arange(n), fresh, narrow)
        cluster, upper, near, lower, rest = state
        shift, farthest = self.moves[near], self.moves.max(initial=0)
        lower = lower - shift - (np.abs(lower) + shift) * 1e-12
        rest = rest - farthest - np.where(np.isfinite(rest), (np.abs(rest) + farthest) * 1e-12, 0)
        upper = (upper + self.moves[cluster]) * (1 + 1e-12)
        if near.shape[1] > keep:
            rest = np.minimum(rest, lower[:, keep:].min(axis=1))
            near, lower = near[:, :keep], lower[:, :keep]
        state = cluster.copy(), upper, near.copy(), lower.copy(), rest
        behind = self._behind(lower, rest)
        open_ = np.flatnonzero(upper >= behind[:, 0])
        if len(open_) and narrow:
            gap = (points[open_] - self.centres[cluster[open_]]).astype(np.float64)
            upper[open_] = np.sqrt((gap * gap).sum(axis=1)) * (1 + 1e-12)
            certain = upper[open_, None] < behind[open_]
            prefix = np.where(certain.any(axis=1), certain.argmax(axis=1), keep + 1)
            for length in range(1, keep + 1):
                self._prefix(points, open_[prefix == length], state, length)
            self.used = max(self.used, int(np.minimum(prefix, keep).max(initial=0)))
            open_ = open_[prefix > keep]
        elif len(open_):
            self.used = keep
        return self._all(points, open_, state, narrow)

    @staticmethod
    def _behind(lower: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """For each length of a prefix of the list, the least bound behind it."""
        bounds = np.concatenate((lower, rest[:, None]), axis=1)
        return np.minimum.accumulate(bounds[:, ::-1], axis=1)[:, ::-1]

    def _prefix(self, points: np.ndarray, rows: np.ndarray, state: tuple, length: int) -> None:
        """Measures and sorts the own centroid and the first ``length`` listed ones."""
        if not len(rows):
            return
        cluster, upper, near, lower, _ = state
        ids = np.sort(np.concatenate((cluster[rows, None], near[rows, :length]), axis=1), axis=1)
        gap = (points[rows, None, :] - self.centres[ids]).astype(np.float64)
        found = (gap * gap).sum(axis=2)
        order = np.argsort(found, axis=1, kind="stable")  # ids ascend: equal distances go to the smaller one
        ids, far = np.take_along_axis(ids, order, 1), np.sqrt(np.take_along_axis(found, order, 1))
        cluster[rows], upper[rows] = ids[:, 0], far[:, 0] * (1 + 1e-12)
        near[rows, :length], lower[rows, :length] = ids[:, 1:], far[:, 1:] * (1 - 1e-12)

    def _all(self, points: np.ndarray, rows: np.ndarray, state: tuple, narrow: bool) -> tuple:
        """Measures all centroids for ``rows``."""
        if not len(rows):
            return state
        cluster, upper, near, lower, rest = state
        found, keep = _squares(points[rows], self.centres, narrow), self.keep
        order = np.argsort(found, axis=1, kind="stable")
        far, slack = np.sqrt(np.take_along_axis(found, order, 1)), 1e-12 if narrow else 1e-9
        if not narrow and len(self.centres) > 1:
            for i in np.flatnonzero(far[:, 1] <= far[:, 0] * (1 + 1e-9)):
                best = min(range(len(self.centres)), key=lambda j: (_exactly(points[rows[i]], self.centres[j]), j))
                order[i] = [best, *(j for j in order[i] if j != best)]
        cluster[rows], upper[rows] = order[:, 0], far[:, 0] * (1 + slack)
        near[rows], lower[rows] = order[:, 1 : keep + 1], far[:, 1 : keep + 1] * (1 - slack)
        rest[rows] = far[:, keep + 1] * (1 - slack) if keep + 1 < far.shape[1] else np.inf
        return state

    def distances(self, points: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """Exact squared distances to the own centroid, at most the largest long."""
        own = self.centres[cluster]
        loose = np.flatnonzero((np.abs(points).max(axis=1, initial=0) > _NARROW) | (np.abs(own).max(axis=1, initial=0) > _NARROW))
        gap = points - own
        gap[loose] = 0
        out = (gap * gap).sum(axis=1)
        for i in loose:
            out[i] = min(_exactly(points[i], own[i]), _LARGEST)
        return out


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel(), kind))


def _matrix(column: pa.Array, kind, width: int | None = None) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1 if width is None else width)


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, tuple | None]]:
    for batch in batches:
        for begin in range(0, batch.num_rows, CHUNK):
            part = batch.slice(begin, CHUNK)
            points, state = _matrix(part.column(1), np.int64, width), None
            if part.num_columns > 2:
                cluster, upper, near, lower, rest = (part.column(i) for i in range(2, 7))
                listed = len(near.flatten()) // len(part)
                state = (cluster.to_numpy(), upper.to_numpy(), _matrix(near, np.int32, listed), _matrix(lower, np.float64, listed), rest.to_numpy())
            yield part, points, state


def _assigned(table: DataFrame, centres: list, moves: list, keep: int, width: int) -> DataFrame:
    """The table with its new bounds, and behind each task's rows its partial sums by centroid."""

    def run(batches):
        step, sums, counts = _Round(centres, moves, keep), {}, {}
        names = ["vec_id", "point", "cluster", "upper", "near", "lower", "rest", "n", "sums", "used"]
        kind = None
        for part, points, state in _chunks(batches, width):
            cluster, upper, near, lower, rest = step.assign(points, state)
            kind = part.schema.field(0).type
            wide = np.abs(points).max(initial=0) > 1 << 48
            for j in np.unique(cluster).tolist():
                rows = points[cluster == j]
                total = (rows.astype(object) if wide else rows).sum(axis=0).tolist()
                sums[j] = [a + int(b) for a, b in zip(sums.get(j, [0] * width), total)]
                counts[j] = counts.get(j, 0) + len(rows)
            none = len(part)
            columns = [part.column(0), part.column(1), pa.array(cluster, pa.int32()), pa.array(upper), _lists(near, pa.int32()), _lists(lower, pa.float64()), pa.array(rest)]
            columns += [pa.nulls(none, pa.int64()), pa.nulls(none, pa.list_(pa.decimal128(38, 0))), pa.nulls(none, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        if counts:
            of = sorted(counts)
            empty = [pa.nulls(len(of), t) for t in (kind, pa.list_(pa.int64()))]
            bounds = [pa.nulls(len(of), t) for t in (pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.float64())]
            totals = pa.array([[Decimal(x) for x in sums[j]] for j in of], pa.list_(pa.decimal128(38, 0)))
            columns = [*empty, pa.array(of, pa.int32()), *bounds, pa.array([counts[j] for j in of], pa.int64()), totals, pa.array([step.used] * len(of), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    id_type = table.schema["vec_id"].dataType.simpleString()
    return table.mapInArrow(run, f"vec_id {id_type}, point array<long>, {_BOUNDS}, {_SUMS}")


def _measured(table: DataFrame, centres: list, moves: list, keep: int, width: int) -> DataFrame:
    """The last assignment: vec_id, cluster, distance."""

    def run(batches):
        step = _Round(centres, moves, keep)
        for part, points, state in _chunks(batches, width):
            cluster = step.assign(points, state)[0]
            columns = [part.column(0), pa.array(cluster, pa.int32()), pa.array(step.distances(points, cluster), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    id_type = table.schema["vec_id"].dataType.simpleString()
    return table.mapInArrow(run, f"vec_id {id_type}, cluster int, distance long")


def cluster_vectors(
    vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, listed: int | None = None, seed: str = "3:", id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector of
    exactly ``width`` components, each scaled to floor(1024 x).

    The first centroids are the ``k`` vectors with the smallest sha256 of ``seed`` and id; each of ``rounds``
    rounds assigns all vectors (ties: the smaller number) and replaces each non-empty centroid by the floor of
    its vectors' means; then all are assigned once more.  ``listed``: places of the lists of near centroids.

    Vectors that are null, of another width, or hold a null or non-finite component (or one of 2^62 and more
    after scaling, whose distances no long holds) take no part.  Repeated rows count each; rows without an id
    take part and start a centroid only if there are fewer than ``k`` others; of equal ids the smaller vector
    starts first.  With fewer than ``k`` vectors there are as many centroids; no vectors give no rows.
    Distances and inertia beyond the largest long are that number.  Further columns are left out.
    """
    spark = vectors.sparkSession
    points = _points(vectors, width, id_col, vector_col)
    digest = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    name = unused(points, "digest")
    first = points.withColumn(name, digest).orderBy(F.col(name).asc_nulls_last(), "point").limit(k).select("point").collect()
    id_type = points.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centres = [list(r[0]) for r in first]
    keep = min(max(2, len(centres) // 4) if listed is None else listed, len(centres) - 1)
    fewest, moves, table = min(keep, max(1, len(centres) // 8)), [0.0] * len(centres), points
    with Scratch(spark) as scratch:
        for at in range(rounds):
            previous, table = table, scratch.written(_assigned(table, centres, moves, keep, width))
            if at:
                scratch.drop(previous)
            parts = table.where(F.col("n").isNotNull()).select("cluster", "n", "used", F.posexplode("sums").alias("place", "x"))
            sums = parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.max("used").alias("used")).collect()  # k rows of ``width``
            old, centres = centres, [list(c) for c in centres]
            for r in sums:
                centres[r["cluster"]][r["place"]] = int(r["x"]) // r["n"]
            moves = [math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y))) * (1 + 1e-12) for x, y in zip(old, centres)]
            if at:
                keep = min(keep, max(fewest, max((r["used"] for r in sums), default=0)))
            table = table.where(F.col("n").isNull()).drop("n", "sums", "used")
            if not any(moves):
                break  # further rounds change nothing
        out = written(_measured(table, centres, moves, keep, width))
    totals = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()  # k rows
    whole = min(sum(int(r["x"]) for r in totals), _LARGEST)
    facts = [(r["cluster"], min(int(r["x"]), _LARGEST), whole, hashlib.sha256(",".join(map(str, centres[r["cluster"]])).encode()).hexdigest()) for r in totals]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
