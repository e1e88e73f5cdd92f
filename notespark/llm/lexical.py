"""Ranked lexical search: Block-Max WAND over an index of compressed posting blocks.

The index is built by shards, each from a bounded share of one task's documents, without a shuffle: a row
for each (shard, term) with its postings in blocks of fixed size, and one row for the shard's documents.
Block-Max data lie beside the compressed bytes of a block (last document, largest impact), so that a block
can be passed over unread.  Written once, it serves any number of searches.

A search reads the postings of its own terms only, brings each shard's into one task (a shard is bounded),
and runs Block-Max WAND there for each query: cursors in order of document; the pivot is where the sum of
the terms' largest scores can first beat the k-th best; shallow moves look up the blocks around the pivot,
and if their sum cannot beat it either, cursors jump behind the nearest block end without decompressing.
A task's heaps live through all its shards, and start from what a few shards gave for the query: the k-th
best of some documents is never above that of all.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize, text_slices, utf8, written

#: One term; ``folded`` cuts UTF-8 at the same characters, which are all ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Postings of a block.
BLOCK = 64
#: Bytes of text and documents of a shard, at most (a longer text is a shard by itself).
SHARD_BYTES, SHARD_DOCS = 16 << 20, 1 << 16
#: Bytes of the texts of one block of queries: each block is one pass over its terms' postings.
QUERY_BYTES = 4 << 20
#: Shards that a search looks into for its first thresholds (any choice gives the same results).
FIRST_SHARDS = 4
#: The row of a shard's documents; no term is empty.
_DOCS = ""

INDEX = "shard long, term string, n_docs long, lasts array<int>, impacts array<long>, blocks array<binary>, doc_ids array<long>, norms array<long>"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def impact(tf, norm):
    """A posting's share of the score, before the term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * norm)


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values, seven bits each with a mark if more follow, and the bytes before each value."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        sizes += values >= np.uint64(1) << np.uint64(bits)
    begins = np.zeros(len(values) + 1, np.int64)
    np.cumsum(sizes, out=begins[1:])
    out = np.empty(begins[-1], np.uint8)
    for i in range(int(sizes.max(initial=0))):
        more = sizes > i
        byte = (values[more] >> np.uint64(7 * i)) & np.uint64(127)
        out[begins[:-1][more] + i] = byte | np.where(sizes[more] > i + 1, 128, 0).astype(np.uint64)
    return out, begins


def _numbers(data: bytes) -> np.ndarray:
    """The values of ``_varints``."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    begins = np.concatenate(([0], ends[:-1] + 1))
    shift = 7 * (np.arange(len(raw)) - np.repeat(begins, ends - begins + 1))
    return np.add.reduceat((raw & 127).astype(np.int64) << shift, begins)


class _Shard:
    """Postings of some documents until they are written as one shard."""

    def __init__(self):
        self.ids, self.counts, self.words, self.docs, self.tfs, self.bytes = [], [], {}, [], [], 0

    def add(self, doc_id, text: bytes) -> None:
        found = Counter(terms_of(text))
        if found:
            words = self.words
            self.docs.append(np.fromiter((words.setdefault(w, len(words)) for w in found), np.int32, len(found)))
            self.tfs.append(np.fromiter(found.values(), np.int64, len(found)))
            self.ids.append(doc_id)
            self.counts.append(sum(found.values()))
            self.bytes += len(text)

    def rows(self, shard: int, n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
        ids = np.array([-(1 << 63) if i is None else i for i in self.ids], np.int64)
        missing = np.array([i is None for i in self.ids])
        order = np.lexsort((ids, missing))  # rows without an id come last
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        norms = np.array([50 + (50 * n * n_docs) // n_terms for n in self.counts], np.int64)
        term = np.concatenate(self.docs)
        doc = np.repeat(place, [len(d) for d in self.docs])
        tf = np.concatenate(self.tfs)
        by = np.lexsort((doc, term))
        term, doc, tf = term[by], doc[by], tf[by]
        heads = np.searchsorted(term, np.arange(len(self.words) + 1))  # every term has postings
        at = np.arange(len(term)) - heads[term]
        first = at % BLOCK == 0
        starts = np.flatnonzero(first)
        gaps = np.where(at == 0, doc, doc - np.concatenate(([0], doc[:-1])))
        # a block: gaps and frequencies, in turn; the first gap counts from the block before
        coded, begins = _varints(np.stack((gaps, tf), axis=1).ravel())
        impacts = np.maximum.reduceat(impact(tf, norms[order][doc]), starts)
        ends = np.append(starts[1:], len(term))
        lasts, cuts = doc[ends - 1], begins[2 * np.append(starts, len(term))]
        data = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(coded)])
        block_of = np.searchsorted(starts, heads).astype(np.int32)
        names = np.array(list(self.words), dtype=object)
        sorted_ = np.argsort(names, kind="stable")  # files sorted by term: statistics prune what a search doesn't ask for
        lists = lambda values: pa.ListArray.from_arrays(pa.array(block_of), values)
        none = pa.nulls(len(names), pa.list_(pa.int64()))
        table = pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(names), shard)),
                pa.array(names.tolist(), pa.binary()).cast(pa.string()),
                pa.array(np.diff(heads)),
                lists(pa.array(lasts, pa.int32())),
                lists(pa.array(impacts)),
                lists(data),
                none,
                none,
            ],
            names=[c.split()[0] for c in INDEX.split(", ")],
        )
        docs = [[shard], [_DOCS], [len(order)], [None], [None], [None], [[self.ids[i] for i in order]], [norms[order].tolist()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(docs, table.schema)], schema=table.schema)
        table = table.take(pa.array(sorted_))
        for begin in range(0, table.num_rows, 4096):
            yield table.slice(begin, 4096)


def _docs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all documents that hold a term, not yet written: ``INDEX``.

    Texts of null or without terms are in no posting and in no count.  Repeated ids stay documents of
    their own; rows without an id are indexed like others.  Further columns are left out.
    """
    docs = _docs(docs, id_col, text_col)

    def count(batches):
        for part in text_slices(batches, 0):
            sizes = [len(terms_of(text)) for text in utf8(part.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([sum(n > 0 for n in sizes)]), pa.array([sum(sizes)])], names=["docs", "terms"])

    counted = docs.select("text").mapInArrow(count, "docs long, terms long")
    n_docs, n_terms = counted.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()

    def run(batches):
        task, made, shard = TaskContext.get().partitionId(), 0, _Shard()
        for part in text_slices(batches, 1):
            for doc_id, text in zip(part.column(0).to_pylist(), utf8(part.column(1))):
                if shard.ids and (shard.bytes + len(text) > SHARD_BYTES or len(shard.ids) >= SHARD_DOCS):
                    yield from shard.rows((task << 24) + made, n_docs, n_terms)
                    made, shard = made + 1, _Shard()
                shard.add(doc_id, text)
        if shard.ids:
            yield from shard.rows((task << 24) + made, n_docs, n_terms)

    return docs.mapInArrow(run, INDEX)


class _Cursor:
    """One term's postings in a shard: blocks are decompressed only when a document in them is asked for."""

    __slots__ = ("weight", "lasts", "tops", "blocks", "top", "block", "docs", "tfs", "at", "doc", "opened")

    def __init__(self, weight: int, lasts: list, tops: list, blocks: list, opened: dict):
        self.weight, self.lasts, self.tops, self.blocks, self.opened = weight, lasts, tops, blocks, opened
        self.top = max(tops)
        self.block, self.docs, self.doc = -1, None, -1

    def shallow(self, doc: int) -> int:
        """The block that would hold ``doc``."""
        return bisect_left(self.lasts, doc, max(self.block, 0))

    def move(self, doc: int) -> bool:
        """To the first posting at or behind ``doc``; False if there is none."""
        block = self.shallow(doc)
        if block == len(self.lasts):
            return False
        if block != self.block:
            found = self.opened.get(block)
            if found is None:
                numbers = _numbers(self.blocks[block])
                docs = np.cumsum(numbers[::2]) + (self.lasts[block - 1] if block else 0)
                found = self.opened[block] = docs.tolist(), numbers[1::2].tolist()
            self.docs, self.tfs = found
            self.block, self.at = block, 0
        self.at = bisect_left(self.docs, doc, self.at)
        self.doc = self.docs[self.at]
        return True


_doc = attrgetter("doc")


def block_max_wand(cursors: list[_Cursor], norms: list[int], best: list, k: int, floor: int, key) -> None:
    """Puts the documents of one shard into ``best``, a heap of at most ``k`` pairs (score, key(document)),
    whose keys are larger for smaller ids.  Scores of ``floor`` and less cannot enter."""
    alive = sorted((c for c in cursors if c.top and c.move(0)), key=_doc)
    least = max(floor, best[0][0] - 1 if len(best) == k else 0)  # an equal score may still win by its id
    while alive:
        total, pivot = 0, -1
        for i, c in enumerate(alive):
            total += c.top
            if total > least:
                pivot = i
                break
        if pivot < 0:
            return
        doc = alive[pivot].doc
        while pivot + 1 < len(alive) and alive[pivot + 1].doc == doc:
            pivot += 1
        total, end = 0, alive[pivot + 1].doc if pivot + 1 < len(alive) else 1 << 62
        for c in alive[: pivot + 1]:
            block = c.shallow(doc)
            if block < len(c.lasts):
                total += c.tops[block]
                end = min(end, c.lasts[block] + 1)
        if total <= least:
            target = end
        elif alive[0].doc == doc:
            score = 0
            for c in alive[: pivot + 1]:
                score += c.weight * impact(c.tfs[c.at], norms[doc])
            if score > least:
                entry = (score, key(doc))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
                if len(best) == k:
                    least = max(floor, best[0][0] - 1)
            target = doc + 1
        else:
            target = doc
        moved = [c for c in alive[: pivot + 1] if c.doc >= target or c.move(target)]
        alive[: pivot + 1] = moved
        alive.sort(key=_doc)


def _key(doc_id: int | None) -> int:
    """Larger for smaller ids, smallest for none."""
    return -(1 << 63) if doc_id is None else -doc_id


def _search_shard(rows: list[dict], queries: list[tuple], weights: dict, best: dict, floors: dict, k: int) -> None:
    postings, norms, ids = {}, None, None
    for r in rows:
        if r["term"] == _DOCS:
            ids, norms = r["doc_ids"], r["norms"]
        else:
            weight = weights[r["term"]]
            postings[r["term"]] = weight, r["lasts"], [weight * x for x in r["impacts"]], r["blocks"], {}
    key = lambda doc: _key(ids[doc])
    for number, terms in queries:
        cursors = [_Cursor(*postings[t]) for t in terms if t in postings]
        heap, floor = best.setdefault(number, []), floors.get(number, 0)
        if sum(c.top for c in cursors) > max(floor, heap[0][0] - 1 if len(heap) == k else 0):
            block_max_wand(cursors, norms, heap, k, floor, key)


def _run(index: DataFrame, shards: int, queries: list[tuple], weights: dict, floors: dict, k: int) -> DataFrame:
    """number, doc_id, score of the ``k`` best of each task's shards, for each query."""
    tasks = max(1, min(shards, max(3 * index.sparkSession.sparkContext.defaultParallelism, shards // 16)))

    def run(batches):
        best, rows, shard = {}, [], None
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                for r in batch.slice(begin, 1024).to_pylist():
                    if r["shard"] != shard and rows:
                        _search_shard(rows, queries, weights, best, floors, k)
                        rows = []
                    shard = r["shard"]
                    rows.append(r)
        if rows:
            _search_shard(rows, queries, weights, best, floors, k)
        none = _key(None)
        found = [(n, None if key == none else -key, score) for n, heap in best.items() for score, key in heap]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["number", "doc_id", "score"])

    return index.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(run, "number long, doc_id long, score long")


def _query_blocks(queries: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """(id, distinct terms) of the queries, in blocks of ``QUERY_BYTES`` of text."""
    block, size = [], 0
    for item, text in queries.select(id_col, text_col).toLocalIterator():
        raw = (text or "").encode()
        if block and size + len(raw) > QUERY_BYTES:
            yield block
            block, size = [], 0
        block.append((item, sorted({t.decode() for t in terms_of(raw)})))
        size += len(raw)
    if block:
        yield block


def search(index: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The ``k`` best documents of each query with a score above 0: item_id, rank (from 1), doc_id, score;
    equal scores by ascending doc_id, rows without an id behind the others.

    ``index``: as ``build_index`` gives it, written.  A query counts each of its terms once; one without
    text or terms, or whose terms no document holds, has no rows.  Repeated query rows each get their rows;
    empty tables give none.  Queries go in blocks of bounded size, each one pass over its postings.
    """
    spark = index.sparkSession
    n_docs, shards = index.where(F.col("term") == _DOCS).agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.count(F.lit(1))).first()
    id_type = queries.schema[id_col].dataType.simpleString()
    found = spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    for block in _query_blocks(queries, id_col, text_col):
        terms = sorted({t for _, of in block for t in of})
        if not terms or not n_docs:
            continue
        asked = spark.createDataFrame([(t,) for t in [_DOCS, *terms]], "term string")  # of QUERY_BYTES at most
        postings = index.join(F.broadcast(asked), "term", "left_semi")
        frequencies = postings.where(F.col("term") != _DOCS).groupBy("term").agg(F.sum("n_docs").alias("df")).collect()
        weights = {r["term"]: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1))) for r in frequencies}
        numbered = [(i, [t for t in of if weights.get(t)]) for i, (_, of) in enumerate(block)]
        some = [r[0] for r in index.where(F.col("term") == _DOCS).orderBy(F.desc("n_docs"), "shard").select("shard").limit(FIRST_SHARDS).collect()]
        best = Window.partitionBy("number").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        first = ranked(_run(postings.where(F.col("shard").isin(some)), len(some), numbered, weights, {}, k))
        floors = {r["number"]: r["score"] - 1 for r in first.where(F.col("rank") == k).collect()}  # a row a query
        rows = materialize(ranked(_run(postings, shards, numbered, weights, floors, k)))
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"number long, item_id {id_type}")
        found = found.unionByName(rows.join(F.broadcast(names), "number").select("item_id", "rank", "doc_id", "score"))
    return found


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 50, **columns) -> DataFrame:
    """``search`` in an index of ``docs`` that is written to the shared folder first."""
    return search(written(build_index(docs, **columns)), queries, k)
