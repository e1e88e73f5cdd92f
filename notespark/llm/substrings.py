"""Removal of passages that repeat, by level-wise doubling of repeated word windows.

A window of ``length`` words goes when the same words also start earlier.  Looking at every window
at full length would move the whole corpus several times over.  Levels of doubling length get rid
of nearly all of it first (20 words: levels of 5, 10 and 20):

*Base level.*  Each full window names one of its base windows, the one with the smallest hash, the
leftmost of equals.  Equal full windows name equal base windows at the same offset, so a window
whose base window occurs once cannot repeat.  Neighbouring windows mostly name the same base
window, so there is a row, an anchor, for about every eighth word.  The windows of an anchor
are its run.  Anchors whose base hash occurs once are dropped; that is most of them.

*Whole runs.*  Anchors with equal runs (same words, same offset) are interchangeable: in all but
the first of them every window has an earlier equal.  They are settled here.  The first one needs
a closer look only where its base window also occurs in a different run.

*Doubled levels.*  Of those, the windows around the base window at twice its length are counted
next, and so on; what repeats is extended again until the full length is reached or no candidates
survive.  At full length windows are compared one by one by a 128-bit hash.

All counts are grouped aggregates with partial sums and joins between written tables, which
adaptive execution can split, so a passage that a third of all documents share is no hot spot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import mixed, slices, text_slices, utf8, word_hashes, written

#: Words in the shortest level are at least this many.
LEAST = 4

_FIRST = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
#: Bits of a position among the words that are looked at together; the same whatever their number.
_POSITION_BITS = 23


def levels(length: int) -> list[int]:
    """Window lengths from the base level to ``length``, each twice the one before."""
    found = [length]
    while found[0] % 2 == 0 and found[0] // 2 >= LEAST:
        found.insert(0, found[0] // 2)
    return found


class _Windows:
    """Hashes of any windows of one sequence of words, from prefix sums of a polynomial."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, hashes: np.ndarray, base: np.uint64 = _FIRST):
        n = len(hashes)
        known = self._powers.get(int(base))
        if known is None or len(known[0]) <= n:
            size = max(1024, 2 * n)
            ups = np.ones(size, dtype=np.uint64)
            downs = np.ones(size, dtype=np.uint64)
            ups[1:] = base
            downs[1:] = np.uint64(pow(int(base), -1, 1 << 64))
            known = self._powers[int(base)] = (np.multiply.accumulate(ups), np.multiply.accumulate(downs))
        self._downs = known[1]
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(hashes * known[0][:n], out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self._sums[ends] - self._sums[starts]) * self._downs[starts] + (ends - starts).astype(np.uint64))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        keys = np.minimum(keys[:-done], keys[done:])
        done *= 2
    return np.minimum(keys[: len(keys) - (width - done)], keys[width - done :]) if done < width else keys


def anchors(hashes: np.ndarray, length: int, begins: np.ndarray, windows: _Windows | None = None) -> tuple[np.ndarray, ...]:
    """Base hash, position, first window, number of windows and run hash of each anchor.

    ``hashes`` are those of several documents' words, one after the other; ``begins`` is the first
    word of each.  Windows don't reach over the end of a document.
    """
    base = levels(length)[0]
    windows = windows or _Windows(hashes)
    n = len(hashes)
    if n < length:
        empty = np.empty(0, dtype=np.int64)
        return empty.astype(np.uint64), empty, empty, empty, empty.astype(np.uint64)
    starts = np.arange(n - base + 1)
    base_hashes = windows.of(starts, starts + base)
    # The upper bits order base windows, the lower ones break ties to the left.
    low = np.uint64(max(_POSITION_BITS, int(n).bit_length()))
    keys = (base_hashes >> low << low) | starts.astype(np.uint64)
    named = (_least(keys, length - base + 1) & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    ends = np.append(begins[1:], n)
    whole = np.zeros(len(named) + 1, dtype=np.int64)
    fits = ends - begins >= length
    np.add.at(whole, begins[fits], 1)
    np.add.at(whole, ends[fits] - length + 1, -1)
    inside = np.cumsum(whole[:-1]) > 0
    at = np.flatnonzero(inside)
    named = named[at]
    opens = np.flatnonzero((np.diff(named, prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1))
    first, position = at[opens], named[opens]
    count = np.diff(opens, append=len(at))
    run = windows.of(first, first + count + (length - 1))
    run = mixed(run + (position - first).astype(np.uint64) * _SECOND + count.astype(np.uint64))
    return base_hashes[position], position, first, count, run


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``version`` and ``text``: the version tells rows apart that share a doc_id.

    It is a constant where no doc_id does.
    """
    shared = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    version = F.lit(0) if shared.isEmpty() else F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", version.cast("long").alias("version"), "text")


def _place(start: str) -> Column:
    """What orders windows: doc_id (null last), version, start."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version", F.col(start).alias("start"))


def _anchor_rows(keyed: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 2):
            hashes, begins = word_hashes(utf8(part.column(2)))
            base, _, first, count, whole = anchors(hashes, length, begins)
            # Texts without words begin where the next one does; the last of equals has the words.
            which = np.searchsorted(begins, first, side="right") - 1
            rows = pa.array(which)
            yield pa.record_batch(
                [_signed(base), _signed(whole), part.column(0).take(rows), part.column(1).take(rows),
                 pa.array(first - begins[which], pa.int32()), pa.array(count, pa.int32())],
                names=["base", "run", "doc_id", "version", "start", "n"],
            )

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"base long, run long, doc_id {kind}, version long, start int, n int")


def _packed(keyed: DataFrame) -> DataFrame:
    """``keyed`` with compressed texts, which are what the joins by document have to move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1).compress
        for part in text_slices(batches, 2):
            texts = pa.array([compress(t) for t in utf8(part.column(2))], pa.binary())
            yield pa.record_batch([part.column(0), part.column(1), texts], names=["doc_id", "version", "text"])

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"doc_id {kind}, version long, text binary")


def _unpacked(part: pa.RecordBatch, column: int) -> list[bytes]:
    decompress = zstandard.ZstdDecompressor().decompress
    return [decompress(t) for t in part.column(column).to_pylist()]


def _same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["of"]) & (left["version"] == right["of_version"])


def _gathered(places: DataFrame) -> DataFrame:
    """Starts and counts of each document's entries: bounded by the document's own length."""
    packed = F.collect_list(F.struct("start", "n")).alias("entries")
    grouped = places.groupBy("doc_id", "version").agg(packed)
    return grouped.select(F.col("doc_id").alias("of"), F.col("version").alias("of_version"), "entries").hint("shuffle_hash")


def _window_rows(keyed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """A row for each window of the runs in ``wanted`` (``start``, ``n``): its hash at the second
    level around its base window, its 128-bit hash at full length, its place.
    """
    steps = levels(length)
    hashes_each = max(2, len(steps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 2):
            hashes, begins = word_hashes(_unpacked(part, 2))
            entries = part.column(3).to_pylist()
            starts = np.array([begins[i] + j for i, own in enumerate(entries) for e in own for j in range(e["start"], e["start"] + e["n"])], dtype=np.int64)
            windows = _Windows(hashes)
            _, position, first, _, _ = anchors(hashes, length, begins, windows)
            position = position[np.searchsorted(first, starts, side="right") - 1]
            out = []
            for step in steps[1:-1]:
                begin = np.clip(position, starts, starts + length - step)
                out.append(windows.of(begin, begin + step) ^ mixed((position - begin).astype(np.uint64)))
            out += [windows.of(starts, starts + length), _Windows(hashes, _SECOND).of(starts, starts + length)]
            which = np.searchsorted(begins, starts, side="right") - 1
            rows = pa.array(which)
            columns = [*map(_signed, out), part.column(0).take(rows), part.column(1).take(rows), pa.array(starts - begins[which], pa.int32())]
            yield pa.record_batch(columns, names=[*(f"level{k}" for k in range(len(out))), "doc_id", "version", "start"])

    packed = _packed(keyed)
    joined = packed.join(wanted, _same_row(packed, wanted)).select("doc_id", "version", "text", "entries")
    kind = keyed.schema["doc_id"].dataType.simpleString()
    hashed = ", ".join(f"level{k} long" for k in range(hashes_each))
    return joined.mapInArrow(run, f"{hashed}, doc_id {kind}, version long, start int")


def _repeated(windows: DataFrame, length: int) -> DataFrame:
    """Places (``doc_id``, ``version``, ``start``) of the windows that also start earlier."""
    for k in range(len(levels(length)) - 2):  # the doubled levels below the full length
        column = f"level{k}"
        often = written(windows.groupBy(column).agg(F.count(F.lit(1)).alias("times")).where("times > 1").select(F.col(column).alias("again")))
        windows = written(windows.join(often, F.col(column) == F.col("again"), "left_semi").drop(column))
    *_, high, low = (c for c in windows.columns if c.startswith("level"))
    grouped = windows.groupBy(high, low).agg(F.min(_place("start")).alias("earliest"), F.count(F.lit(1)).alias("times"))
    firsts = written(grouped.where("times > 1").select(F.col(high).alias("high"), F.col(low).alias("low"), "earliest"))
    joined = windows.join(firsts, (F.col(high) == F.col("high")) & (F.col(low) == F.col("low")))
    return joined.where(_place("start") != F.col("earliest")).select("doc_id", "version", "start")


def repeated_windows(keyed: DataFrame, length: int) -> DataFrame:
    """``doc_id``, ``version``, ``start``, ``n``: runs of n windows from ``start``, each of which
    also starts earlier; together all such windows.
    """
    rows = _anchor_rows(keyed, length)
    often = written(rows.groupBy("base").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select(F.col("base").alias("again")))
    live = written(rows.join(often, F.col("base") == F.col("again"), "left_semi"))

    runs = live.groupBy("base", "run").agg(F.min(_place("start")).alias("earliest"), F.max("n").alias("n"))
    runs = written(runs.select(F.col("base").alias("of_base"), F.col("run").alias("of_run"), "earliest", "n"))
    first = runs.drop("n")
    later = live.join(first, (F.col("base") == F.col("of_base")) & (F.col("run") == F.col("of_run")))
    later = later.where(_place("start") != F.col("earliest")).select("doc_id", "version", "start", "n")

    several = written(runs.groupBy("of_base").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select(F.col("of_base").alias("again")))
    unsettled = runs.join(several, F.col("of_base") == F.col("again"), "left_semi")
    unsettled = unsettled.select("earliest.doc_id", "earliest.version", "earliest.start", "n")
    windows = written(_window_rows(keyed, _gathered(unsettled), length))
    single = _repeated(windows, length).withColumn("n", F.lit(1))
    return later.unionByName(single)


def remove_repeated_passages(docs: DataFrame, length: int = 20) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``n_words``, ``n_removed``
    and ``kept``, the words left, joined by single spaces.

    A word goes when a window of ``length`` words that covers it has an equal that starts earlier:
    in a smaller doc_id or earlier in the same document.  Windows are judged on the input.

    Nulls and other cases: a null or empty text has no words; a text shorter than a window loses
    nothing; a null doc_id is later than any other.  Rows that share a doc_id are one document
    where their texts are equal (each row loses what it would lose alone) and otherwise ordered by
    a hash of the text.  An empty table gives an empty result.  Extra columns are left out.
    """
    if length < LEAST:
        raise ValueError(f"length must be at least {LEAST}")
    keyed = _keyed(docs)
    removal = _gathered(repeated_windows(keyed, length).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            entries = part.column(2).to_pylist()
            total, gone, kept = [], [], []
            for text, own in zip(_unpacked(part, 1), entries, strict=True):
                words = text.split()
                total.append(len(words))
                if own:
                    edges = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(edges, [e["start"] for e in own], 1)
                    np.add.at(edges, [e["start"] + e["n"] + length - 1 for e in own], -1)
                    covered = np.cumsum(edges[:-1]) > 0
                    words = [w for w, x in zip(words, covered.tolist(), strict=True) if not x]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            columns = [part.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.record_batch(columns, names=["doc_id", "n_words", "n_removed", "kept"])

    packed = _packed(keyed)
    joined = packed.join(removal, _same_row(packed, removal), "left").select("doc_id", "text", "entries")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")
