"""Token ids of documents in ORC files: sorted, with row indexes, Bloom filters and whole-number offsets.

Documents are dealt out by ranges of their id and sorted; each task encodes its range and writes one file,
so the files in order of their part are the corpus in order of its ids.  ORC packs ids in integer runs (RLE
version 2, about as many bits as the largest id of a run needs), keeps smallest and largest doc_id of each
stripe and row group, and a Bloom filter of doc_ids for each row group.  Stripes are read in parallel; a
search for some documents opens only the row groups that may hold them.

A row carries its part and the ids before it in that part, so the place of a document in the whole stream
takes one number a part, not a sort or a window over all rows.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import _shared_folder, bounded, text_slices, utf8, written

#: Bytes of a stripe before compression, rows of a row group, and share of false hits of a Bloom filter.
STRIPE_BYTES, GROUP_ROWS, FALSE_HITS = 16 << 20, 1000, 0.01
#: Bytes of words that a worker remembers the ids of, of a piece of a long text, and words encoded at a time.
CACHE_BYTES, PIECE, WORDS = 12 << 20, 1 << 20, 1 << 12
#: Words of plain letters that are encoded as one text.
JOINED = 64

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Small letters of Latin-1 only: a word of them is normalized already, and one piece.
_LETTERS = re.compile(rb"(?:[a-z]|\xC3[\x9F-\xB6\xB8-\xBF])+")
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: 1: small letters and digits, 2: marks that begin a new piece behind these (``'`` may not, ``<`` begins special tokens).
_KINDS = bytes(1 if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 2 if chr(c) in '!"#$%&()*+,-./:;=>?@[\\]^_`{|}~' else 0 for c in range(256))


class WordEncoder:
    """Ids of whole texts, as the library gives them.

    For tokenizers that ignore case, and whose pieces never reach across white space, which they drop: a
    text's ids are those of its words (by space and \\x09-\\x0D) one after the other.  Words are encoded by the library when first
    seen, and remembered within ``CACHE_BYTES``.
    """

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer)
        self.letters = _of_letters(tokenizer)
        if self.letters:
            vocabulary, suffix = self.letters.get_vocab(), self.letters.model.end_of_word_suffix
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.rows, self.bytes = {}, 0
        self.ends, self.ids = np.zeros(1 << 10, np.int64), np.empty(1 << 12, np.int32)

    def _learn(self, words: list[bytes]) -> None:
        if self.bytes > CACHE_BYTES:
            self._forget()
        plain, other = [], []
        for w in dict.fromkeys(words):
            if w not in self.rows:
                (plain if self.letters and _LETTERS.fullmatch(w) else other).append(w)
        for new, encoded in ((plain, self._of_plain), (other, self._of_any)):
            for begin in range(0, len(new), WORDS):
                some = new[begin : begin + WORDS]
                ids, sizes = encoded(some)
                n = len(self.rows)
                ends = self.ends[n] + np.cumsum(sizes)
                self.ends, self.ids = _room(self.ends, n + len(some) + 1), _room(self.ids, int(ends[-1]))
                self.ids[self.ends[n] : ends[-1]] = ids
                self.ends[n + 1 : n + 1 + len(some)] = ends
                self.rows.update(zip(some, range(n, n + len(some))))
                self.bytes += sum(map(len, some))

    def _of_any(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        found = [e.ids for e in self.library.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        return [x for ids in found for x in ids], [len(x) for x in found]

    def _of_plain(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words of plain letters go as texts of several; an id that ends a word tells them apart."""
        texts = [b" ".join(words[i : i + JOINED]).decode() for i in range(0, len(words), JOINED)]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in self.letters.encode_batch_fast(texts, add_special_tokens=False)])
        return ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and the number of ids of each."""
        try:
            rows = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        except KeyError:
            self._learn(words)  # knows all of these afterwards
            rows = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        begins = self.ends[rows]
        sizes = self.ends[rows + 1] - begins
        before = np.cumsum(sizes) - sizes
        return self.ids[np.repeat(begins - before, sizes) + np.arange(int(sizes.sum()))], sizes

    def texts(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with ``end_id`` behind it, and the number of each."""
        counts, parts = np.zeros(len(texts), np.int64), [np.empty(0, np.int32)]
        words, owners, size = [], [], 0

        def flush() -> None:
            ids, sizes = self.encode(words)
            parts.append(ids)
            np.add.at(counts, np.repeat([o for o, _ in owners], [n for _, n in owners]), sizes)
            words.clear(), owners.clear()

        for i, text in enumerate(texts):
            for piece in _pieces(text):
                own = _plain(piece).split()
                words += own
                owners.append((i, len(own)))
                size += len(piece)
                if size >= PIECE:
                    flush()
                    size = 0
        if owners:
            flush()
        flat = np.concatenate(parts)
        out = np.full(len(flat) + len(texts), end_id, np.int32)
        ends = np.cumsum(counts + 1) - 1
        inside = np.ones(len(out), bool)
        inside[ends] = False
        out[inside] = flat
        return out, counts + 1


@lru_cache(1)
def _encoder(tokenizer: str) -> WordEncoder:
    """One encoder a Python worker, which its tasks share."""
    return WordEncoder(tokenizer)


def _room(values: np.ndarray, n: int) -> np.ndarray:
    """``values`` with room for ``n``: twice as much at least, if there is to be more."""
    return values if n <= len(values) else np.concatenate((values, np.zeros(max(n - len(values), len(values)), values.dtype)))


def _of_letters(tokenizer: str):
    """The tokenizer without the steps that leave a word of plain letters as it is; None if there may be others."""
    from tokenizers import Tokenizer, pre_tokenizers

    parts = json.loads(tokenizer)
    steps = [*(parts["normalizer"] or {}).get("normalizers", []), *(parts["pre_tokenizer"] or {}).get("pretokenizers", [])]
    if [x["type"] for x in steps] != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] or not parts["model"].get("end_of_word_suffix"):
        return None
    _, space, _, split, level = steps
    if (space["pattern"], split["pattern"], split["invert"], level["use_regex"], level["add_prefix_space"]) != ({"Regex": "\\s+"}, {"Regex": _PIECES}, True, False, False):
        return None
    found = Tokenizer.from_str(tokenizer)
    found.normalizer = None
    found.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return found


def _plain(piece: bytes) -> bytes:
    """A text with fewer different words and the same ids: these tokenizers ignore case, and begin a new piece
    between a letter or digit and a mark.  Only their special tokens, which begin with ``<|``, mind case."""
    if b"<|" in piece:
        return piece
    small = piece.lower()
    kinds = np.frombuffer(small.translate(_KINDS), np.uint8)
    at = np.flatnonzero((kinds[:-1] == 1) & (kinds[1:] == 2)) + 1
    return np.insert(np.frombuffer(small, np.uint8), at, 32).tobytes() if len(at) else small


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces that end between words."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def write_token_ids(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, files: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encodes every whole text with the tokenizer of that JSON text and writes ORC files to ``path``:
    doc_id, part, before (ids before it in its part), n_tokens, ids; ``end_id`` ends each document.

    ``files``: number of ranges (default: that of shuffles, merged by adaptive execution).
    Null texts are empty: their only id is ``end_id``.  Rows without an id come last.  Repeated ids stay
    rows of their own, by a hash of their texts, then as they come; many rows of one id are still dealt out.
    An empty table gives no rows.  Texts of any length are whole.  Further columns are left out.
    """
    text = F.col(text_col)
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("i"))
    order = F.col("doc_id").asc_nulls_last(), F.col("h"), F.col("i")
    dealt = keyed.repartitionByRange(*([files] if files else []), *order).sortWithinPartitions(*order)

    def run(batches):
        encoder, part, before = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        for rows in text_slices(batches, 1):
            ids, counts = encoder.texts(utf8(rows.column(1)), end_id)
            ends = np.cumsum(counts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids, pa.int32()))
            columns = [rows.column(0), pa.array(np.full(len(rows), part), pa.int32()), pa.array(before + ends - counts), pa.array(counts), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "before", "n_tokens", "ids"])
            before += int(ends[-1]) if len(ends) else 0

    found = dealt.select("doc_id", "text").mapInArrow(run, _schema(keyed.schema["doc_id"].dataType.simpleString()))
    settings = {
        "compression": "zstd",
        "orc.create.index": "true",
        "orc.row.index.stride": str(GROUP_ROWS),
        "orc.stripe.size": str(STRIPE_BYTES),
        "orc.rows.between.memory.checks": "128",  # rows may be long: their number says little of a stripe's size
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": str(FALSE_HITS),
    }
    found.write.options(**settings).orc(path)


def _schema(id_type: str) -> str:
    return f"doc_id {id_type}, part int, before long, n_tokens long, ids array<int>"


def read_token_ids(spark: SparkSession, path: str, ids: Iterable[int] | None = None, id_type: str = "bigint") -> DataFrame:
    """The rows of ``write_token_ids``; of the documents ``ids`` only, which statistics and Bloom filters of
    the files narrow down before a stripe is read."""
    table = spark.read.schema(_schema(id_type)).orc(path)
    return table if ids is None else table.where(F.col("doc_id").isin(list(ids)))


def with_starts(table: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of ``files`` (as read, or derived with their ``part`` and ``before``) with ``start``, the number
    of ids of all rows before: one number a part is summed up."""
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row a file
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = written(parts.select("part", F.coalesce(before, F.lit(0)).alias("_offset")))
    return table.join(bounded(offsets), "part").withColumn("start", F.col("_offset") + F.col("before")).drop("_offset")


def checksums(table: DataFrame) -> DataFrame:
    """doc_id, part, before, n_tokens (counted from the ids) and ids_crc32, the unsigned CRC-32 of the ids as
    little-endian unsigned 32-bit integers."""

    def run(batches):
        for rows in batches:
            lists = rows.column(3)
            flat, ends = lists.flatten().to_numpy().astype("<u4"), np.cumsum(lists.value_lengths().to_numpy())
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(np.concatenate(([0], ends[:-1])), ends)]
            columns = [*(rows.column(i) for i in range(3)), pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "before", "n_tokens", "ids_crc32"])

    id_type = table.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, part int, before long, n_tokens long, ids_crc32 long"
    return table.select("doc_id", "part", "before", "ids").mapInArrow(run, schema)


def write_and_verify(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, **more) -> DataFrame:
    """Writes the files (in the shared folder by default) and reads them back: doc_id, start, n_tokens,
    ids_crc32 of every document."""
    spark = docs.sparkSession
    path = path or f"{_shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_ids(docs, path, tokenizer, end_id, **more)
    table = read_token_ids(spark, path, id_type=docs.schema[more.get("id_col", "doc_id")].dataType.simpleString())
    return with_starts(checksums(table), table).select("doc_id", "start", "n_tokens", "ids_crc32")
