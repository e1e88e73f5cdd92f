"""Toxicity by a bag of subwords: embeddings averaged into a linear softmax, trained jointly.

A word's vector is the average of the embeddings of its character n-grams and of the word itself,
so a misspelling that was never seen shares most of its vector with the word it comes from.  A
passage of ``PASSAGE`` words averages its words and a linear layer with softmax gives the two
classes.  A text's score is that of its most toxic passage, so that a long text doesn't water down
what it says in one place; passages overlap by half and cover the whole text.

Training runs in numpy on the driver, on all passages of a sample of labelled rows that is bounded
in rows and bytes; embeddings and linear layer get their gradients together.  Being linear, the
trained model gives each bucket one number, its share of the logit.  Words, n-grams and averages of
a batch of texts are found by array operations over its characters, without a word in Python's hands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._labels import labelled, sigmoid
from ._shared import text_slices, utf8

PASSAGE = 64
BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
WIDTH = 8
GRAMS = (3, 4, 5)
EPOCHS_ON_ALL, EPOCHS = 2, 40
BATCH = 256
RATE, LAYER_RATE, BIAS_RATE = 0.3, 0.05, 0.5
#: Averages are multiplied by this before the linear layer.
SPREAD = 32
RIDGE = 0.5
_EDGES = " \t\n\x0b\f\r.,;:!?*&%$#|\"'()[]{}<>-_=+/\\`~^@"
_EDGE = np.zeros(128, dtype=bool)
_EDGE[[ord(c) for c in _EDGES]] = True
_OPEN, _CLOSE = ord("<"), ord(">")
#: Characters that are worked on at once, up to the end of a word.
_PIECE = 1 << 19
_SEPARATOR = re.compile("[\x20\x09-\x0d]")
_ODD = np.random.default_rng(31).integers(0, 2**31, 16, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _ranges(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers begin, ..., begin + length - 1 of every pair, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - lengths), lengths)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return x ^ (x >> np.uint32(12))


class Words:
    """The words of a text in lower case and without marks at their ends, each between ``<`` and
    ``>``, as one array of characters; ``begins`` and ``sizes`` (the two included) of each."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = ~((codes == 32) | ((codes >= 9) & (codes <= 13)))
        edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
        self.at, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        kept = np.flatnonzero(inside & ~_EDGE[np.minimum(codes, 127)] | (codes > 127))
        low, high = np.searchsorted(kept, self.at), np.searchsorted(kept, ends)
        empty = low == high
        padded = np.append(kept, 0)
        first = np.where(empty, self.at, padded[low])
        length = np.where(empty, 0, padded[high - 1] + 1 - first)
        self.sizes = length + 2
        self.begins = np.cumsum(self.sizes) - self.sizes
        chars = np.empty(int(self.sizes.sum()), dtype=np.uint32)
        chars[self.begins], chars[self.begins + length + 1] = _OPEN, _CLOSE
        chars[_ranges(self.begins + 1, length)] = codes[_ranges(first, length)]
        self.values = _mixed(chars * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15))

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length the places of its n-grams and their buckets."""
        n, values = len(self.values), self.values
        left = (np.repeat(self.begins + self.sizes, self.sizes) - np.arange(n)).astype(np.int32)
        total = np.zeros(n, dtype=np.uint32)
        for j in range(max(GRAMS)):
            total[: n - j] += values[j:] * _ODD[j]
            if j + 1 in GRAMS:
                at = np.flatnonzero(left > j)
                yield at, self._buckets(total[at] + _ODD[8 + j])

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the whole words."""
        if not len(self.begins):
            return np.empty(0, dtype=np.uint64)
        powers = np.full(int(self.sizes.max()), 0xD6E8FEB86659FD93, dtype=np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        place = np.arange(len(self.values)) - np.repeat(self.begins, self.sizes)
        return np.add.reduceat(self.values * powers[place], self.begins)

    def whole(self) -> np.ndarray:
        """Buckets of the whole words."""
        hashes = self.hashes()
        return self._buckets((hashes ^ (hashes >> np.uint64(32))).astype(np.uint32))

    @staticmethod
    def _buckets(x: np.ndarray) -> np.ndarray:
        return (_mixed(x * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)

    def owners(self) -> np.ndarray:
        """The word of each character."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def counts(self) -> np.ndarray:
        """Number of n-grams of each word, the word itself included."""
        return 1 + sum(np.maximum(self.sizes - n + 1, 0) for n in GRAMS)


def _pieces(texts: list[bytes]) -> Iterator[tuple[str, int]]:
    """The texts in lower case, joined, in pieces that end between words, and where each piece begins."""
    joined = "\n".join([t.decode().lower() for t in texts])
    at = 0
    while at < len(joined):
        cut = _SEPARATOR.search(joined, at + _PIECE) if at + _PIECE < len(joined) else None
        end = cut.start() if cut else len(joined)
        yield joined[at:end], at
        at = end


def _first_words(texts: list[bytes], places: list[np.ndarray]) -> np.ndarray:
    """The number of words before each text and, last, of all."""
    sizes = np.array([len(t.decode().lower()) + 1 for t in texts], dtype=np.int64)
    at = np.concatenate(places) if places else np.empty(0, dtype=np.int64)
    return np.append(np.searchsorted(at, np.cumsum(sizes) - sizes), len(at))


@dataclass
class Model:
    """What each subword bucket adds to a word's logit, the bias, and the score without a model."""

    share: np.ndarray | None
    bias: float

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """What each word of the texts adds, and the number of words before each text and of all."""
        values, places = [], []
        for piece, at in _pieces(texts):
            words = Words(piece)
            if not len(words.sizes):
                continue
            sums = np.zeros(len(words.values))
            for where, buckets in words.grams():
                sums[where] += self.share[buckets]
            values.append((np.add.reduceat(sums, words.begins) + self.share[words.whole()]) / words.counts())
            places.append(words.at + at)
        return np.concatenate(values) if values else np.empty(0), _first_words(texts, places)

    def word(self, word: str) -> float:
        return float(self.words([word.encode()])[0][0])

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """Of each text the logit of its most toxic passage; the bias without words."""
        out = np.full(len(texts), self.bias)
        if self.share is None:
            return out
        values, first = self.words(texts)
        for i, (begin, end) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if end > begin:
                sums = np.concatenate(([0.0], np.cumsum(values[begin:end])))  # a text's own, whatever stands before it
                starts = passages(end - begin)
                ends = np.minimum(starts + PASSAGE, end - begin)
                out[i] += ((sums[ends] - sums[starts]) / (ends - starts)).max()
        return out


def passages(n: int) -> np.ndarray:
    """Starts of the passages of ``n`` words: half a passage apart, the last one at the end."""
    last = max(0, n - PASSAGE)
    return np.unique(np.append(np.arange(0, last, PASSAGE // 2), last))


class _Bags:
    """All passages of some texts as bags of subwords, in flat arrays: the driver's memory is small."""

    def __init__(self, texts: list[bytes]):
        hashes, places, known, grams, owners = [], [], np.empty(0, dtype=np.uint64), [], []
        for piece, at in _pieces(texts):
            words = Words(piece)
            hashes.append(words.hashes())
            places.append(words.at + at)
            _, first = np.unique(hashes[-1], return_index=True)
            new = np.zeros(len(words.sizes), dtype=bool)
            new[first[~np.isin(hashes[-1][first], known)]] = True
            owner = words.owners()
            for where, buckets in words.grams():
                fresh = new[owner[where]]
                grams.append(buckets[fresh])
                owners.append(hashes[-1][owner[where[fresh]]])
            grams.append(words.whole()[new])
            owners.append(hashes[-1][new])
            known = np.union1d(known, hashes[-1])
        first = _first_words(texts, places)
        self.tokens = np.searchsorted(known, np.concatenate(hashes)).astype(np.int32)
        owner = np.searchsorted(known, np.concatenate(owners))
        order = np.argsort(owner, kind="stable")
        self.grams = np.concatenate(grams)[order]
        self.gram_sizes = np.bincount(owner, minlength=len(known))
        self.gram_begins = np.cumsum(self.gram_sizes) - self.gram_sizes
        each = [passages(n) for n in np.diff(first).tolist()]
        self.owners = np.repeat(np.arange(len(texts)), [len(x) for x in each])
        self.begins = np.concatenate(each) + np.repeat(first[:-1], [len(x) for x in each])
        self.sizes = np.minimum(self.begins + PASSAGE, first[1:][self.owners]) - self.begins
        kept = self.sizes > 0
        self.owners, self.begins, self.sizes = self.owners[kept], self.begins[kept], self.sizes[kept]

    def curvature(self) -> np.ndarray:
        """Sum over the passages of each bucket's squared share."""
        out = np.zeros(BUCKETS)
        for i in range(0, len(self.sizes), BATCH):
            n = self.sizes[i : i + BATCH]
            words = self.tokens[_ranges(self.begins[i : i + BATCH], n)]
            gn = self.gram_sizes[words]
            share = SPREAD / np.repeat(np.repeat(n, n) * gn, gn)
            key = np.repeat(np.repeat(np.arange(len(n)), n), gn) * BUCKETS + self.grams[_ranges(self.gram_begins[words], gn)]
            key, at = np.unique(key, return_inverse=True)
            out += np.bincount(key % BUCKETS, np.bincount(at, share) ** 2, BUCKETS)
        return out

    def averages(self, word_values: np.ndarray) -> np.ndarray:
        """Of a number for each word, the average over each passage."""
        sums = np.concatenate(([0.0], np.cumsum(word_values[self.tokens])))
        return (sums[self.begins + self.sizes] - sums[self.begins]) / self.sizes


def fit(texts: list[bytes], labels: np.ndarray, weights: dict[int, float], seed: int = 0) -> Model:
    """Trains embeddings and linear layer together on all passages of labelled texts.

    The first epochs take every passage with its text's class; the others take of each text the
    passage that the model so far finds most toxic, which is what scores a text.  Averages are
    centred, and a bucket's steps are divided by its curvature plus a constant, so that common
    subwords don't swing and rare ones don't learn single texts by heart.
    """
    if len(set(labels.tolist())) < 2:
        return Model(None, 20.0 if len(labels) and labels[0] else -20.0)
    bags = _Bags(texts)
    owners, labels = bags.owners, labels[bags.owners]
    if len(set(labels.tolist())) < 2:  # the texts of a class have no words
        return Model(None, 0.0)
    rng = np.random.default_rng(seed)
    embeddings = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    layer, bias, mean = rng.normal(0, 0.5, (2, WIDTH)), np.zeros(2), np.zeros(WIDTH)
    step = RATE / (bags.curvature() + RIDGE)
    weight = np.array([weights[x] for x in labels.tolist()])
    weight /= weight.mean()
    chosen = np.arange(len(labels))
    for epoch in range(EPOCHS):
        if epoch >= EPOCHS_ON_ALL:
            values = np.add.reduceat((embeddings @ (layer[1] - layer[0]))[bags.grams], bags.gram_begins) / bags.gram_sizes
            order = np.lexsort((-bags.averages(values), owners))
            chosen = order[np.flatnonzero(np.diff(owners[order], prepend=-1))]
        order = rng.permutation(chosen)
        for i in range(0, len(order), BATCH):
            batch = order[i : i + BATCH]
            n = bags.sizes[batch]
            words, place = np.unique(bags.tokens[_ranges(bags.begins[batch], n)], return_inverse=True)
            gn = bags.gram_sizes[words]
            used, at = np.unique(bags.grams[_ranges(bags.gram_begins[words], gn)], return_inverse=True)
            vectors = np.add.reduceat(embeddings[used][at], np.cumsum(gn) - gn) / gn[:, None]
            averages = np.add.reduceat(vectors[place], np.cumsum(n) - n) / n[:, None]
            mean += 0.1 * (averages.mean(axis=0) - mean)
            inputs = (averages - mean) * SPREAD
            logits = inputs @ layer.T + bias
            exp = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = exp / exp.sum(axis=1, keepdims=True)
            error[np.arange(len(batch)), labels[batch]] -= 1
            error *= weight[batch, None]
            back = error @ layer
            to_token = np.repeat(SPREAD * (back - back.mean(axis=0)) / n[:, None], n, axis=0)
            for k in range(WIDTH):
                to_word = np.bincount(place, to_token[:, k], len(words)) / gn
                embeddings[used, k] -= step[used] * np.bincount(at, np.repeat(to_word, gn), len(used))
            layer -= LAYER_RATE * (error.T @ inputs) / len(batch)
            bias -= BIAS_RATE * error.sum(axis=0) / len(batch)
    direction = (layer[1] - layer[0]) * SPREAD
    return Model((embeddings - mean) @ direction, float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, learnable: Column, per_class: int = 1500, most_bytes: int = 8 << 20) -> Model:
    """The model learnt from ``labels.toxic`` of rows where ``learnable`` (a condition on doc_id)
    holds, from at most ``per_class`` rows of each class and ``most_bytes`` of text.
    """
    texts, found, weights = labelled(docs, labels, "toxic", learnable, per_class, most_bytes)
    return fit(texts, found, weights)


def score_toxicity(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of ``docs`` but any of that name, and ``name``: double, 0 to 1.

    Nulls and other cases: a null or empty text scores what the bias alone gives; texts of any
    length are scored whole; rows are scored one by one, so repeated rows and ties score alike; a
    model without both classes in its labels scores all texts alike; an empty table gives an empty
    result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by BUCKETS
    others = [c for c in docs.columns if c.lower() != name.lower()]
    kept = docs.select(*others, F.col("text").alias("_text"))  # the last column is the text, whatever the others are

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for part in text_slices(batches, len(others)):
            found = pa.array(sigmoid(model.logits(utf8(part.column(part.num_columns - 1)))))
            yield pa.record_batch([*part.columns[:-1], found], names=[*others, name])

    schema = docs.select(*others).withColumn(name, F.lit(0.0)).schema
    return kept.mapInArrow(run, schema)
