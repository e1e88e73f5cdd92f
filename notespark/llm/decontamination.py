"""Benchmark decontamination: item-sized windows of documents against benchmark items.

A document leaks an item when one of its windows, as many words long as the item, has a weighted
Jaccard similarity of at least ``similarity`` with it over word shingles (repeats count).

*Windows.*  A window with that similarity shares most shingles with one item, so positions whose
shingle occurs in any item are marked first, and a window is looked at only if it holds enough
marks: with a shared count s of the window's and the item's shingles v and w, the similarity
s / (v + w - s) asks for s >= similarity (v + w) / (1 + similarity).  No window that could pass is
left out.

*Candidates.*  These windows are fingerprinted by SimHash.  Items of the same size within
``RADIUS`` bits are found by multi-index hashing: of ``BLOCKS`` blocks of eight bits one must be
within ``RADIUS // BLOCKS`` bits, and the items are sorted by each block, so that those near a value
are slices.  All fingerprints within the radius are found; at the default similarity of 0.8 about ten
of 64 bits differ, and the radius leaves room for more than four times the standard deviation.  A
radius of that size makes the blocks list most items of a size for any fingerprint; what keeps the
work small are the marks, which leave hardly a window that doesn't leak.

*Verification.*  The exact similarity is computed from the shingles' hashes.

Items are sent to the workers in blocks of a bounded number of words; a larger benchmark takes more
passes over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded, text_slices, utf8, word_hashes, written

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCKS = 8
#: A size of more items than this has an index.
INDEXED = 64
#: Bytes of items that go to the workers at once; prepared they take about four times as many.
BLOCK_CHARS = 4 << 20

_B = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k-word shingles of a sequence of word hashes."""
    n = len(words) - k + 1
    if n < 1 or k < 1:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * _B + words[j : j + n]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def simhash(hashes: np.ndarray) -> np.ndarray:
    """Eight bytes: bit b is 1 where more than half of the hashes have it."""
    return np.packbits(_bits(hashes).sum(axis=0, dtype=np.int64) * 2 > len(hashes), bitorder="little")


def _weighted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes in ascending order, and how often each occurs."""
    return np.unique(hashes, return_counts=True)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    return shared / (int(a[1].sum()) + int(b[1].sum()) - shared)


#: For each value of a block the values within the bits that one of the blocks may differ by.
_NEAR = np.stack([np.flatnonzero(np.bitwise_count(np.arange(256, dtype=np.uint8) ^ np.uint8(v)) <= RADIUS // BLOCKS) for v in range(256)])


class _Size:
    """The items of one number of words, in flat arrays, with their multi-index.

    For each block the items are sorted by the block's value, ``edges`` has where each value begins:
    40 bytes an item and 16 kB a size.  Sizes of few items need no index, as blocks list most of them.
    """

    def __init__(self, n: int, ids: list, words: list[np.ndarray]):
        self.n, self.k, self.ids = n, min(SHINGLE, n), ids
        hashes = [shingle_hashes(w, self.k) for w in words]
        distinct, counts = zip(*map(_weighted, hashes), strict=True)
        self.begins = np.cumsum([0, *map(len, distinct)])
        self.hashes, self.counts = np.concatenate(distinct), np.concatenate(counts).astype(np.int32)
        self.prints = np.stack([simhash(h) for h in hashes])
        self.order = None
        if len(ids) > INDEXED:
            self.order = np.argsort(self.prints.T, axis=1, kind="stable").astype(np.int32)
            sorted_prints = np.take_along_axis(self.prints.T, self.order, axis=1)
            self.edges = np.stack([np.searchsorted(row, np.arange(257)) for row in sorted_prints])

    def item(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The weighted shingles of an item."""
        part = slice(self.begins[i], self.begins[i + 1])
        return self.hashes[part], self.counts[part]

    def listed(self, fingerprint: np.ndarray) -> np.ndarray:
        """The items of which some block is near the fingerprint's."""
        if self.order is None:
            return np.arange(len(self.ids))
        block, near = np.arange(BLOCKS)[:, None], _NEAR[fingerprint]
        begins, ends = self.edges[block, near], self.edges[block, near + 1]
        found = np.zeros(len(self.ids), dtype=bool)
        for b in range(BLOCKS):
            found[self.order[b][_ranges(begins[b], ends[b] - begins[b])]] = True
        return np.flatnonzero(found)

    def candidates(self, fingerprint: np.ndarray) -> np.ndarray:
        """The items within the radius."""
        listed = self.listed(fingerprint)
        distance = np.bitwise_count(self.prints[listed] ^ fingerprint).sum(axis=1)
        return listed[distance <= RADIUS]


def _ranges(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers begin, ..., begin + length - 1 of every pair, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(begins - (ends - lengths), lengths)


class Items:
    """A block of benchmark items, ready to be looked for."""

    def __init__(self, items: list[tuple[int | None, bytes]], similarity: float):
        self.similarity = similarity
        by_size: dict[int, tuple[list, list]] = {}
        for item, text in items:
            words, _ = word_hashes([text.lower()])
            if len(words):
                ids, kept = by_size.setdefault(len(words), ([], []))
                ids.append(item)
                kept.append(words)
        self.sizes = [_Size(n, *by_size[n]) for n in sorted(by_size)]
        self.known = {k: np.unique(np.concatenate([s.hashes for s in self.sizes if s.k == k])) for k in {s.k for s in self.sizes}}

    def leaks(self, words: np.ndarray) -> list[tuple]:
        """(item, similarity, start, number of words) of the best window for each leaked item."""
        best: dict = {}
        marks = {}
        for k, known in self.known.items():
            hashes = shingle_hashes(words, k)
            at = np.searchsorted(known, hashes)
            hit = known[np.minimum(at, len(known) - 1)] == hashes
            if hit.any():
                marks[k] = hashes, np.concatenate(([0], np.cumsum(hit)))
        for size in self.sizes:
            if size.k not in marks:
                continue
            hashes, sums = marks[size.k]
            n = min(size.n, len(words))
            v, w = n - size.k + 1, size.n - size.k + 1
            least = self.similarity * (v + w) / (1 + self.similarity)
            for start in np.flatnonzero(sums[v:] - sums[:-v] >= least - 1e-9).tolist():
                window = hashes[start : start + v]
                found = size.candidates(simhash(window))
                own = _weighted(window) if len(found) else None
                for i in found.tolist():
                    value = weighted_jaccard(own, size.item(i))
                    if value >= self.similarity and (size.ids[i] not in best or value > best[size.ids[i]][0]):
                        best[size.ids[i]] = value, start, n
        return [(item, *x) for item, x in best.items()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """A row for each row of ``docs`` (``doc_id``, ``text``) and item (``item_id``, ``text`` of
    ``benchmark``) it leaks: ``doc_id``, ``item_id``, ``similarity`` and ``start``, ``n_words`` of
    the most similar window (the first of equals).  A-Z are lower-cased; words are as elsewhere.

    Nulls and other cases: null and empty texts neither leak nor are leaked; an item shorter than a
    shingle is one shingle; a document shorter than an item is one window; a null doc_id or item_id
    is reported as such; repeated items are one item by their item_id (the best counts), repeated
    documents have rows each.  Empty tables give an empty result.  Extra columns are left out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, similarity double, start long, n_words long"
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-total // BLOCK_CHARS)
    found = docs.sparkSession.createDataFrame([], schema)
    for block in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        rows = mine.orderBy("item_id", "text").toArrow()
        pairs = list(zip(rows.column(0).to_pylist(), utf8(rows.column(1).combine_chunks()), strict=True))
        sent = docs.sparkSession.sparkContext.broadcast(Items(pairs, similarity))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for part in text_slices(batches, 1):
                hashes, begins = word_hashes([t.lower() for t in utf8(part.column(1))])
                ends = np.append(begins[1:], len(hashes))
                out = []
                for i, (begin, end) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
                    if end > begin:
                        out += [(i, *leak) for leak in items.leaks(hashes[begin:end])]
                if out:
                    which, item, value, start, n = zip(*out, strict=True)
                    columns = [part.column(0).take(pa.array(which)), pa.array(item, pa.int64()), pa.array(value, pa.float64()), pa.array(start, pa.int64()), pa.array(n, pa.int64())]
                    yield pa.record_batch(columns, names=["doc_id", "item_id", "similarity", "start", "n_words"])

        leaks = docs.select("doc_id", "text").mapInArrow(run, schema)
        found = leaks if blocks == 1 else found.unionByName(written(leaks))
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns, whatever their names.

    Nulls and other cases: a null or empty text leaks nothing and stays; rows that share a doc_id, null
    among them, go together if one of them leaks; repeated rows stay or go each; whole texts count, however
    long; an empty table of documents gives none, an empty one of items takes none away.
    """
    leaked = written(find_leaks(docs, benchmark, similarity).select(F.col("doc_id").alias("_leaked")).distinct())
    return docs.join(bounded(leaked), docs["doc_id"].eqNullSafe(leaked["_leaked"]), "left_anti")
