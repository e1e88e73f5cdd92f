"""What the operators of this subpackage share: words, Arrow batches, tables kept between jobs."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word, as every contract of this subpackage has it.  ``bytes.split()`` cuts at the same six
#: characters (space and \x09-\x0D), so Python workers need no regular expression for it.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a batch that are turned into Python objects at a time: bounds a worker's memory when
#: texts are very long.
ROWS = 256


def _shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; set here only where it is unset, and in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="notespark-checkpoints-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder: for small tables.

    Spark removes the files when nothing refers to them, if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the checkpoint folder and read again: for tables whose
    size follows the corpus, which take a fraction of a checkpoint's space this way.

    The files stay until the folder is cleaned up: they may be read as long as results are lazy.
    """
    return _written(df, f"{_shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with marks in front if ``df`` has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Rows of a table that a join may send to all executors: some tens of megabytes.
BROADCAST_ROWS = 300_000


def bounded(table: DataFrame) -> DataFrame:
    """A written table, with the hint to broadcast it if it has ``BROADCAST_ROWS`` rows at most; a
    larger one is joined by a shuffle.  For rows of a few numbers."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


class Scratch:
    """Written tables that go when the ``with`` block ends; nothing that outlives it may read them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{_shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def written(self, df: DataFrame) -> DataFrame:
        return _written(df, f"{self.folder}/{uuid.uuid4().hex}")

    def drop(self, table: DataFrame) -> None:
        """Deletes the files of one table of this scratch."""
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if self.folder.rsplit("/", 1)[1] in folder:
                self._delete(folder)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._delete(self.folder)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ``ROWS`` rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def text_slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``ROWS`` rows and ``most`` bytes of text, one row at least."""
    for part in slices(batches):
        sizes = pc.fill_null(pc.binary_length(part.column(column)), 0).to_pylist()
        begin, total = 0, 0
        for i, size in enumerate(sizes):
            if i > begin and total + size > most:
                yield part.slice(begin, i - begin)
                begin, total = i, 0
            total += size
        yield part.slice(begin)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def n_words(text: Column) -> Column:
    """Number of words of a text column (null: 0), by Spark functions only."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    count = F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    return F.when(F.octet_length(trimmed) > 0, count).otherwise(0).cast("long")


_SEPARATOR = re.compile(rb"[\x20\x09-\x0D]")
_PIECE = 1 << 20
_SEED = 42


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with all bits depending on all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _piece_hashes(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some bytes, and where each word begins."""
    n = len(piece)
    padded = piece + bytes(8)
    data = np.frombuffer(piece, dtype=np.uint8)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    sizes = (ends - begins).astype(np.uint64)
    eight = np.ndarray((n + 1,), dtype="<u8", buffer=padded, strides=(1,))[begins].astype(np.uint64)
    bits = np.uint64(8) * np.minimum(sizes, np.uint64(7))
    hashes = mixed((eight & ((np.uint64(1) << bits) - np.uint64(1))) | (sizes << np.uint64(56)))
    longer = np.flatnonzero(sizes > 7)
    digest = xxhash.xxh64_intdigest
    hashes[longer] = np.array([digest(piece[i:j], _SEED) for i, j in zip(begins[longer].tolist(), ends[longer].tolist())], dtype=np.uint64)
    return hashes, begins


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some texts, one after the other, and the number of words before
    each text.  Words of up to seven bytes have hashes of their own (their bytes and length, mixed one to
    one); longer ones have XXH64.  Long texts go in pieces that end between words.
    """
    joined = b"\n".join(texts)
    hashes, places, at = [], [], 0
    while at < len(joined):
        cut = _SEPARATOR.search(joined, at + _PIECE) if at + _PIECE < len(joined) else None
        end = cut.start() if cut else len(joined)
        found, begins = _piece_hashes(joined[at:end])
        hashes.append(found)
        places.append(begins + at)
        at = end
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    if not hashes:
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), np.cumsum(sizes) - sizes)
