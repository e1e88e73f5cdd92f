"""Near copies at a similarity of word shingles.

Rows with the same set of shingles are one class.  SimHash proposes the classes whose fingerprints links of
at most two bits bring together, as ``simhash`` finds them.  At a similarity of 0.8 about ten bits differ, so
MinHash bands propose further pairs (two at 0.8 share no band six times in 100,000).  One byte of each sketch
value filters both ``MARGIN`` below the similarity (which a pair at 0.8 misses about four times in 100,000),
and the sets of shingles decide.

What SimHash links is a bucket like those of the bands.  Large buckets aren't paired up as rows.  First their members are compared with the smallest
one, and what that links makes components.  A bucket whose other members are of several components is
then compared in full, but for pairs of one component: it is dealt out in blocks, every two of which
meet in a group of at most about ``2 * BLOCK`` rows.  Members that are linked already still take part,
so every similar pair that shares a band ends in one component.

Tables between the steps hold hashes and sketches, never texts; the few texts that pairs ask for are
read again.  Tables of a step go when the result is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, bounded, slices, text_slices, unused, utf8, word_hashes, written
from .components import connected_components
from .decontamination import shingle_hashes
from .simhash import fingerprint, fingerprint_links

BANDS, ROWS_A_BAND = 32, 6
#: Words of a shingle of the SimHash fingerprints.
PRINTED = 3
#: A pair's shingles are compared if the share of equal sketch bytes is this much below the similarity at most.
MARGIN = 0.12
#: Members of a bucket that a block holds, about, and pairs that share one copy of their centre.
BLOCK, SHARE = 256, 512

_RNG = np.random.default_rng(20)
_FACTORS = _RNG.integers(1, 2**31, BANDS * ROWS_A_BAND, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_CHUNK = 1024
_AT_ONCE = 64


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The low byte of the least product of a hash with each of the multipliers."""
    upper = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_FACTORS), 2**32 - 1, dtype=np.uint32)
    for i in range(0, len(upper), _CHUNK):
        np.minimum(out, (upper[i : i + _CHUNK, None] * _FACTORS).min(axis=0), out=out)
    return out.astype(np.uint8)


def _shingle_sets(texts: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    hashes, begins = word_hashes([t.lower() for t in texts])
    for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(hashes)], strict=True):
        words = hashes[begin:end]
        yield np.unique(shingle_hashes(words, max(1, min(shingle, len(words)))))


def _row_hash() -> Column:
    """What tells a row from others: a hash of its doc_id and its text."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id``, ``row`` (``_row_hash``), the class of the row's shingles, the bytes of its sketch, and ``fp``,
    the text's SimHash fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 2):
            texts = utf8(part.column(2))
            classes, found = [], []
            for hashes in _shingle_sets(texts, shingle):
                classes.append(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).astype(np.int64))
                found.append(sketch(hashes).tobytes())
            prints = pa.array([fingerprint(text, PRINTED) for text in texts], pa.int64())
            columns = [part.column(0), part.column(1), pa.array(classes, pa.int64()), pa.array(found, pa.binary()), prints]
            yield pa.record_batch(columns, names=["doc_id", "row", "class", "sketch", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _row_hash().alias("row"), "text").mapInArrow(run, f"doc_id {kind}, row long, class long, sketch binary, fp long")


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, len(_FACTORS))


def _likely(pairs: DataFrame, least: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            keep = pa.array((_rows(part.column(2)) == _rows(part.column(3))).mean(axis=1) >= least, pa.bool_())
            yield pa.record_batch([part.column(0).filter(keep), part.column(1).filter(keep)], names=["u", "v"])

    return pairs.mapInArrow(run, "u long, v long")


class _Group:
    """Members of a bucket whose shingle sets are compared: no two of one root, and no two that an
    earlier band brings together."""

    def __init__(self, numbers: np.ndarray, sketches: np.ndarray, texts: list[bytes], shingle: int, similarity: float):
        self.classes, self.root, self.side, self.band = numbers[:, 5], numbers[:, 6], numbers[:, 4], int(numbers[0, 0])
        self.sketches, self.texts, self.shingle, self.similarity = sketches, texts, shingle, similarity
        self.before = sketches[:, : self.band * ROWS_A_BAND].reshape(len(sketches), self.band, ROWS_A_BAND)
        self.sets: dict[int, np.ndarray] = {}

    def _set(self, i: int) -> np.ndarray:
        if i not in self.sets:
            self.sets[i] = next(_shingle_sets([self.texts[i]], self.shingle))
        return self.sets[i]

    def _links(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
        for i in range(0, len(a), _AT_ONCE):
            x = a[i : i + _AT_ONCE]
            alike = (self.sketches[x, None] == self.sketches[b][None]).sum(axis=2, dtype=np.uint8)
            x, y = (c.tolist() for c in _indices(alike >= (self.similarity - MARGIN) * len(_FACTORS), x, b))
            for u, v in zip(x, y, strict=True):
                if self.root[u] == self.root[v] or (self.before[u] == self.before[v]).all(axis=1).any():
                    continue
                if _similar(self._set(u), self._set(v), self.similarity):
                    yield int(self.classes[u]), int(self.classes[v])
                    self.root[self.root == self.root[u]] = self.root[v]

    def links(self) -> Iterator[tuple[int, int]]:
        """Links between the sides, or within the only one."""
        roots, counts = np.unique(self.root, return_counts=True)
        if len(roots) < 2:
            return
        # the most frequent root's members need no comparison with each other
        first, rest = self.side == 0, self.root != roots[counts.argmax()]
        second = first if first.all() else ~first
        yield from self._links(np.flatnonzero(first & rest), np.flatnonzero(second))
        yield from self._links(np.flatnonzero(first & ~rest), np.flatnonzero(second & rest))


def _indices(keep: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.nonzero(keep)
    return a[x], b[y]


def _block_links(members: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links between ``members`` (``band``, ``key``, ``n``, ``class``, ``root``, ``sketch``, ``text``) of one bucket."""
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("long")
    own = members.withColumn("_own", F.pmod(F.xxhash64("class", F.lit(7)), blocks))
    met = own.withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    group = ["band", "key", "i", "j"]
    low, high = F.least("_own", "_with").alias("i"), F.greatest("_own", "_with").alias("j")
    met = met.select("band", "key", low, high, (F.col("_own") > F.col("_with")).cast("long").alias("side"), "class", "root", "sketch", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _and_last(batches):
            if batch is not None:
                numbers = np.stack([batch.column(c).to_numpy() for c in range(7)], axis=1)
                here = numbers, _rows(batch.column(7)), np.array([*utf8(batch.column(8)), None], dtype=object)[:-1]
                held = here if held is None else tuple(np.concatenate(x) for x in zip(held, here, strict=True))
            if held is None or not len(held[0]):
                continue
            edges = np.flatnonzero((held[0][1:, :4] != held[0][:-1, :4]).any(axis=1)) + 1
            edges = [0, *edges.tolist(), *([len(held[0])] if batch is None else [])]
            found = []
            for begin, end in zip(edges, edges[1:], strict=False):
                found += _Group(*(x[begin:end] for x in held), shingle, similarity).links()
            held = tuple(x[edges[-1] :] for x in held)
            if found:
                u, v = zip(*found, strict=True)
                yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return met.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "u long, v long")


def _similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= least * (len(a) + len(b) - shared) - 1e-9


def _and_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    for batch in batches:
        yield from slices([batch])
    yield None


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float, tables: Scratch) -> DataFrame:
    """The pairs (``u``, ``v``) of classes whose sets of shingles are similar enough.

    A centre ``v`` comes once for each ``SHARE`` of its pairs, in front of them, not once for each pair: tasks
    hold the set of one centre and of one other class at a time, and a centre with many pairs is dealt out.
    """
    counts = pairs.groupBy(F.col("v").alias("_v")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SHARE)
    dealt = pairs.join(bounded(tables.written(counts)), F.col("v") == F.col("_v"), "left")
    share = F.pmod(F.xxhash64("u"), F.ceil(F.coalesce(F.col("_n"), F.lit(1)) / F.lit(SHARE)).cast("long"))
    dealt = tables.written(dealt.select("u", "v", share.alias("share")))
    own = texts.select(F.col("_class").alias("_c"), "text")
    others = dealt.join(own, F.col("u") == F.col("_c")).select("v", "share", F.lit(1).alias("part"), "u", "text")
    centres = dealt.select("v", "share").distinct().join(own, F.col("v") == F.col("_c")).select("v", "share", F.lit(0).alias("part"), F.col("v").alias("u"), "text")
    key = ["v", "share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, of = None, None
        for part in text_slices(batches, 4):
            vs, kinds, us = (part.column(c).to_pylist() for c in (0, 2, 3))
            found = []
            for v, kind, u, own_set in zip(vs, kinds, us, _shingle_sets(utf8(part.column(4)), shingle), strict=True):
                if kind == 0:
                    centre, of = own_set, v
                elif of == v and _similar(own_set, centre, similarity):
                    found.append((u, v))
            yield pa.record_batch([pa.array([f[i] for f in found], pa.int64()) for i in range(2)], names=["u", "v"])

    return others.unionByName(centres).repartition(*key).sortWithinPartitions(*key, "part").mapInArrow(run, "u long, v long")


def _printed(prints: DataFrame, tables: Scratch) -> DataFrame:
    """The buckets of SimHash (``band``, ``key``, ``class``), whose band comes after the others: fingerprints
    that links join up are one bucket.  A class is in that of each of its rows' fingerprints."""
    own = tables.written(prints.select("class", "fp").distinct())
    values = tables.written(own.select("fp").distinct())
    roots = tables.written(connected_components(fingerprint_links(values)))
    placed = own.join(bounded(roots), F.col("fp") == F.col("node"), "left")
    return tables.written(placed.select(F.lit(BANDS).alias("band"), F.coalesce("root", "fp").alias("key"), "class").distinct())


class _Classes:
    """Classes of equal shingle sets (``class``, the ``row`` that stands for it, ``sketch``), the buckets that
    SimHash has of them, and what links them."""

    def __init__(self, docs: DataFrame, classes: DataFrame, printed: DataFrame, tables: Scratch, shingle: int, similarity: float):
        self.docs, self.classes, self.printed, self.tables = docs, classes, printed, tables
        self.shingle, self.similarity = shingle, similarity

    def _of(self, ids: DataFrame) -> DataFrame:
        """``_class``, ``row``, ``sketch`` of the classes in ``ids`` (``_class``, distinct)."""
        found = self.classes.join(bounded(self.tables.written(ids)), F.col("class") == F.col("_class"))
        return self.tables.written(found.select("_class", "row", "sketch"))

    def _texts(self, some: DataFrame) -> DataFrame:
        """``_class`` and ``text`` of the classes in ``some``; copies of a row are one."""
        wanted = bounded(self.tables.written(some.select("_class", F.col("row").alias("_row"))))
        found = self.docs.select(_row_hash().alias("_hash"), F.coalesce("text", F.lit("")).alias("text"))
        found = found.join(wanted, F.col("_hash") == F.col("_row"))
        return self.tables.written(found.groupBy("_class").agg(F.first("text").alias("text")))

    def _crowded(self) -> tuple[DataFrame, DataFrame]:
        """Members of buckets in company (``band``, ``key``, ``n``, ``class``, ``centre``, without the
        centre), and the centres."""
        keys = F.array([F.xxhash64(F.substring("sketch", 1 + ROWS_A_BAND * b, ROWS_A_BAND)) for b in range(BANDS)])
        members = self.classes.select(F.posexplode(keys).alias("band", "key"), "class").unionByName(self.printed)
        centres = members.groupBy("band", "key").agg(F.min("class").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
        centres = self.tables.written(centres.select(F.col("band").alias("_band"), F.col("key").alias("_key"), "centre", "n"))
        met = members.join(bounded(centres), (F.col("band") == F.col("_band")) & (F.col("key") == F.col("_key")))
        return self.tables.written(met.where("class <> centre").select("band", "key", "class", "centre", (F.col("n") - 1).alias("n"))), centres

    def _star_links(self, met: DataFrame, centres: DataFrame) -> DataFrame:
        """Links between the buckets' members and their centres."""
        near = self._of(met.select(F.col("class").alias("_class")).union(centres.select("centre")).distinct())
        own, other = (near.select(F.col("_class").alias(c), F.col("sketch").alias(s)) for c, s in (("_u", "own"), ("_v", "other")))
        pairs = met.select(F.col("class").alias("u"), F.col("centre").alias("v")).distinct()
        pairs = pairs.join(own, F.col("u") == F.col("_u")).join(other, F.col("v") == F.col("_v"))
        tried = self.tables.written(_likely(pairs.select("u", "v", "own", "other"), self.similarity - MARGIN))
        ends = tried.select(F.col("u").alias("_end")).union(tried.select("v")).distinct()
        texts = self._texts(near.join(ends, F.col("_class") == F.col("_end")))
        return self.tables.written(_verified(tried, texts, self.shingle, self.similarity, self.tables))

    def roots(self) -> DataFrame:
        """``node``, ``root`` of the classes that similar pairs join up."""
        met, centres = self._crowded()
        roots = self.tables.written(connected_components(self._star_links(met, centres)))
        named = roots.select(F.col("node").alias("_node"), "root")
        met = met.where("n > 1").join(named, F.col("class") == F.col("_node"), "left")
        met = self.tables.written(met.select("band", "key", "n", "class", F.coalesce("root", "class").alias("root")))
        several = met.groupBy("band", "key").agg(F.min("root").alias("_least"), F.max("root").alias("_most")).where("_least <> _most")
        several = self.tables.written(several.select(F.col("band").alias("_band"), F.col("key").alias("_key")))
        if several.isEmpty():  # every bucket is of one component
            return roots
        left = met.join(several, (F.col("band") == F.col("_band")) & (F.col("key") == F.col("_key"))).drop("_band", "_key")
        left = self.tables.written(left)
        near = self._of(left.select(F.col("class").alias("_class")).distinct())
        with_text = self.tables.written(near.select(F.col("_class").alias("_c"), "sketch").join(self._texts(near), F.col("_c") == F.col("_class")))
        left = left.join(with_text, F.col("class") == F.col("_class")).select("band", "key", "n", "class", "root", "sketch", "text")
        links = _block_links(left, self.shingle, self.similarity)
        return connected_components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links))


def _placed(docs: DataFrame, tables: Scratch, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``doc_id``, ``row``, ``class`` of all rows, and ``_class`` with the ``root`` of its component."""
    prints = tables.written(_sketches(docs, shingle))
    classes = tables.written(prints.groupBy("class").agg(F.min("row").alias("row"), F.min("sketch").alias("sketch")))
    roots = tables.written(_Classes(docs, classes, _printed(prints, tables), tables, shingle, similarity).roots())
    placed = classes.select("class").join(bounded(roots), F.col("class") == F.col("node"), "left")
    return prints.select("doc_id", "row", "class"), tables.written(placed.select(F.col("class").alias("_class"), F.coalesce("root", "class").alias("root")))


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id`` and ``component_id`` of every row of ``docs``: the smallest doc_id that links reach.

    Links join rows whose shingle sets have a Jaccard similarity of at least ``similarity``.  Nulls
    and other cases are as for ``simhash_components``; texts without words are one class.
    """
    with Scratch(docs.sparkSession) as tables:
        rows, placed = _placed(docs, tables, shingle, similarity)
        rows = rows.join(placed, F.col("class") == F.col("_class")).select("doc_id", F.col("root").alias("_of"))
        rows = tables.written(rows)
        firsts = tables.written(rows.groupBy("_of").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("_of", "root"))
        return written(rows.join(firsts, F.col("_of") == F.col("root")).select("doc_id", "component_id"))


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each component of near copies: the one with the smallest doc_id.

    Nulls and other cases: rows without a doc_id come after those that have one, and of equal
    doc_ids the one with the smaller hash of doc_id and text stays, so that texts that are no near
    copies stay whatever their doc_ids are.  Rows that agree in doc_id and text are one row, the one
    whose columns have the smallest hash.  Null, empty and wordless texts are copies of each other.
    An empty table gives an empty result.
    """
    with Scratch(docs.sparkSession) as tables:
        rows, placed = _placed(docs, tables, shingle, similarity)
        rows = tables.written(rows.join(placed, F.col("class") == F.col("_class")).select("doc_id", "row", F.col("root").alias("_of")))
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
        firsts = tables.written(rows.groupBy("_of").agg(F.min(order).alias("first")).select(F.col("_of").alias("root"), F.col("first.row").alias("_first")))
        others = rows.join(firsts, F.col("_of") == F.col("root")).where("row <> _first")
        dropped = written(others.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).distinct())
        again = rows.groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        repeated = written(again.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")))
    names, own = docs.columns, unused(docs, "_own")
    marked = docs.withColumn(own, _row_hash())
    here = lambda table: marked["doc_id"].eqNullSafe(table["_id"]) & (marked[own] == table["_row"])
    left = marked.join(bounded(dropped), here(dropped), "left_anti")
    if repeated.isEmpty():
        return left.select(*names)
    once = left.join(bounded(repeated), here(repeated), "left_anti").select(*names)
    several = left.join(bounded(repeated), here(repeated), "left_semi")
    hashed = F.xxhash64(*[f.name for f in docs.schema if not f.dataType.simpleString().startswith("map")])
    chosen = several.groupBy("doc_id", own).agg(F.min_by(F.struct(*names), hashed).alias("x"))
    return once.unionByName(chosen.select("x.*"))
