"""Token counts of a unigram tokenizer, without making the tokens.

The tokenizer replaces spaces by U+2581, puts one in front of a text that has none there, and cuts
before each of them.  Within a cut the best segmentation is the one with the largest sum of piece
scores.  An Aho-Corasick automaton enumerates all pieces of the vocabulary that end at a position,
longest first; dynamic programming over positions carries the best score and its number of pieces.

Ties are those of the tokenizer: of equal scores the segmentation found first stays, where the
tokenizer goes through starts in ascending order.  For one end that is longest piece first, which
is the automaton's order.  A character that is no piece by itself may be unknown, with the lowest
score of the vocabulary less ``UNKNOWN``; unknown neighbours are one token, or as many as their
bytes if the vocabulary has a piece for each byte.  Sums are double precision in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import text_slices, utf8

SPACE = "▁"
UNKNOWN = 10.0
_CACHED_WORDS, _CACHED_CHARS = 300_000, 64


@dataclass(frozen=True)
class Vocabulary:
    """Pieces and scores of a unigram vocabulary, and the number of its unknown piece."""

    pieces: tuple[tuple[str, float], ...]
    unknown: int


def load_vocabulary(path: str) -> Vocabulary:
    """The pieces and scores of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = tuple((model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()))
    return Vocabulary(pieces, model.unk_id())


class Counter(dict):
    """Token counts of cuts; short ones are remembered, so that memory is bounded in bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        self.known = set()
        for number, (piece, score) in enumerate(vocabulary.pieces):
            self.known.add(piece)
            if piece:
                self.automaton.add_word(piece, (len(piece), score, number == vocabulary.unknown))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary.pieces) - UNKNOWN
        self.longest = max(map(len, self.known), default=0)
        self.bytes = all(f"<0x{b:02X}>" in self.known for b in range(256))

    def __missing__(self, cut: str) -> int:
        value = self.count(cut)
        if len(cut) <= _CACHED_CHARS:
            if len(self) >= _CACHED_WORDS:
                self.clear()
            self[cut] = value
        return value

    def count(self, cut: str) -> int:
        n = len(cut)
        sizes: list[int] = []  # UTF-8 bytes before each place, once an unknown character asks for them

        def run(begin: int, end: int) -> int:
            """Tokens of a run of unknown characters: its bytes, or one if it is a piece after all."""
            if not self.bytes or (end - begin <= self.longest and cut[begin:end] in self.known):
                return 1
            if not sizes:
                sizes.extend(accumulate((1 + (c > "\x7f") + (c > "\u07ff") + (c > "\uffff") for c in cut), initial=0))
            return sizes[end] - sizes[begin]

        score = [0.0] + [None] * n
        pieces = [0] * (n + 1)
        since = [-1] * (n + 1)  # where the run of unknown characters that ends here began
        single = [False] * (n + 1)
        here = 0

        def close(end: int) -> None:
            """Adds the unknown character before each end up to ``end`` where no piece is it."""
            for e in range(here + 1, end + 1):
                if not single[e] and (score[e] is None or self.unknown + score[e - 1] > score[e]):
                    score[e], since[e] = self.unknown + score[e - 1], since[e - 1] if since[e - 1] >= 0 else e - 1
                    pieces[e] = pieces[since[e]] + run(since[e], e)

        for last, (length, value, is_unknown) in self.automaton.iter(cut):
            end = last + 1
            if end - 1 > here:
                close(end - 1)
                here = end - 1
            start = end - length
            single[end] |= length == 1
            candidate = value + score[start]
            if score[end] is None or candidate > score[end]:
                score[end] = candidate
                if is_unknown:
                    since[end] = since[start] if since[start] >= 0 else start
                    pieces[end] = pieces[since[end]] + run(since[end], end)
                else:
                    since[end], pieces[end] = -1, pieces[start] + 1
        close(n)
        return pieces[n]

    def text(self, text: str) -> int:
        """Number of tokens of a whole text."""
        if not text:
            return 0
        marked = text.replace(" ", SPACE)
        cuts = marked.split(SPACE)
        if marked[0] == SPACE:
            del cuts[0]
        return sum([self[SPACE + c] for c in cuts])


def count_tokens(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id`` and ``n_tokens`` (long) of every row of ``docs`` (``doc_id``, ``text``).

    Nulls and other cases: a null or empty text has no tokens; texts are counted whole; a null
    doc_id and repeated rows keep their rows; an empty table gives an empty result.  Extra columns
    are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the vocabulary's own size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value)
        for part in text_slices(batches, 1):
            counts = [counter.text(t.decode()) for t in utf8(part.column(1))]
            yield pa.record_batch([part.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long")
