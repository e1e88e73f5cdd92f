"""Near-duplicate documents by SimHash fingerprints and covering locality-sensitive hashing.

Fingerprints have 64 bits.  Two fingerprints link when at most two bits differ.  Covering
hashing finds every such pair, not most of them: bit i of the fingerprint is given the vector
m(i) = 1 + i mod (2^(radius+1) - 1) of radius + 1 bits, and table t, for each such vector t other
than zero, keeps the bits whose m(i) has an odd product with t.  The vectors of at most radius
differing bits span less than the whole space, so some t has an even product with all of them:
table t keeps none of the differing bits and the pair falls into one bucket there.  The radius of
2 gives seven tables of 36 or 37 kept bits.

Links within a bucket are found without pairing its members.  Two members that differ in at most
two bits share a midpoint, a value within one bit of either, reached by flipping one of the bits
that the table leaves out.  Each member of a bucket with company sends itself to its midpoints; at
most 65 fingerprints can meet at one, and all that meet there are linked.  So a bucket costs the
number of its members times the number of bits left out, however large it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, slices, utf8
from .components import connected_components

BITS = 64
SEED = 42
#: Links are found through midpoints one bit away, so the radius is fixed.
RADIUS = 2


def fingerprint(text: bytes, shingle: int) -> int:
    """The SimHash of a text (UTF-8), as a signed 64-bit number; 0 without words."""
    words = text.lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return 0
    if len(words) <= shingle:
        pieces = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
        pieces = [joined[i:j] for i, j in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(x, SEED) for x in pieces], dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):  # whole texts, in pieces of bounded memory
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id`` and ``fp`` (long) of every row of ``docs`` (``doc_id``, ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            values = [fingerprint(text, shingle) for text in utf8(part.column(1))]
            yield pa.record_batch([part.column(0), pa.array(values, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def covering_masks(radius: int) -> list[int]:
    """The bits that each table keeps, as signed 64-bit numbers."""
    vectors = range(1, 2 ** (radius + 1))
    masks = []
    for t in vectors:
        kept = [i for i in range(BITS) if (vectors[i % len(vectors)] & t).bit_count() % 2]
        masks.append(int(np.uint64(sum(1 << i for i in kept)).astype(np.int64)))
    return masks


def _signed(bit: int) -> int:
    return (1 << bit) - (1 << BITS if bit == BITS - 1 else 0)


def fingerprint_links(values: DataFrame) -> DataFrame:
    """Links (``u``, ``v``) that join up all of ``values`` (``fp`` long, distinct) within ``RADIUS``.

    Not every pair gets a row: those that meet at a midpoint are linked to the smallest of them.
    """
    masks = covering_masks(RADIUS)
    table = F.posexplode(F.array([F.col("fp").bitwiseAND(F.lit(m)) for m in masks]))
    members = values.select("fp", table.alias("table", "bucket"))
    crowded = members.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    crowded = materialize(crowded.select(F.col("table").alias("_t"), F.col("bucket").alias("_b")))
    company = members.join(crowded, (F.col("table") == F.col("_t")) & (F.col("bucket") == F.col("_b")))

    left_out = [[_signed(i) for i in range(BITS) if not (m >> i) & 1] for m in masks]
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(x).cast("long") for x in xs]) for xs in left_out])
    flip = F.explode(F.element_at(flips, F.col("table") + 1)).alias("flip")
    met = company.select("fp", flip).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    groups = met.groupBy("middle").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return groups.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).where("u <> v").distinct()


def simhash_components(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fp`` and ``component_id``.

    ``component_id`` is the smallest doc_id that links reach, the row's own included.

    Nulls and other cases: a text that is null, empty or only separators has fingerprint 0, which
    links like any other; fewer words than a shingle make one shingle; a null doc_id keeps its row,
    never becomes a component_id, and has a null one only if nothing it reaches has a doc_id.
    Repeated rows and doc_ids each keep their row.  An empty table gives an empty result.  Extra
    columns are left out.
    """
    prints = materialize(fingerprints(docs, shingle))
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = materialize(connected_components(fingerprint_links(classes.select("fp"))))
    placed = classes.join(roots, F.col("fp") == F.col("node"), "left")
    placed = materialize(placed.select("fp", "first", F.coalesce("root", "fp").alias("root")))
    firsts = placed.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "_root")
    named = placed.join(firsts, F.col("root") == F.col("_root"))
    named = materialize(named.select(F.col("fp").alias("_fp"), "component_id"))
    return prints.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")
