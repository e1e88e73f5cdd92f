"""Secret scans: rules for known forms, and character Markov models for the rest.

The rules find assignments, access keys and hexadecimal runs.  The models are two character Markov
chains of order 2, one of random strings, one of ordinary identifiers; a token that no rule covers
is a secret when its log-likelihood ratio per character exceeds a threshold.

Training samples are labelled by how they come about.  Random ones are drawn with a fixed seed from
the alphabets that keys use.  Ordinary ones are identifiers with the case styles and numbers of
program text.  Their words follow the corpus: the letter triples of all words of all documents are
counted, which is a table of a fixed size, and words are drawn from that chain with a fixed seed.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import text_slices, utf8

ASSIGN = re.compile(
    r"""(?a:([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run is as long as it can be, so its least length may be asked for at once.
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Kinds as they are listed; the last one is what the models find.
KINDS = ("assign", "access", "hex", "random")
#: Words drawn from the chain of the corpus's words, and samples of either class.
DRAWN_WORDS, SAMPLES = 4000, 20000
#: Letters of a word whose triples count.
WORD_LETTERS = 2, 12
THRESHOLD = 0.8

_ALPHABET = string.ascii_letters + string.digits + "+/_=-"
_INDEX = {c: i for i, c in enumerate(_ALPHABET)}


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) of what the rules find: leftmost, not overlapping per kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


class Chains:
    """Log-likelihood ratios of two Markov chains of order 2 over the characters of a token."""

    def __init__(self, random_strings: list[str], identifiers: list[str]):
        n = len(_ALPHABET)
        logs = []
        for sample in (random_strings, identifiers):
            pairs = np.full((n, n), 0.5)
            triples = np.zeros((n, n, n))
            for text in sample:
                at = [_INDEX[c] for c in text]
                for a, b in zip(at, at[1:], strict=False):
                    pairs[a, b] += 1
                for a, b, c in zip(at, at[1:], at[2:], strict=False):
                    triples[a, b, c] += 1
            second = pairs / pairs.sum(axis=1, keepdims=True)
            logs.append(np.log((triples + 8 * second[None]) / (triples.sum(axis=2, keepdims=True) + 8)))
        self.ratio = (logs[0] - logs[1]).ravel()

    def score(self, token: str) -> float:
        """Mean log-likelihood ratio per character; positive: rather random."""
        n = len(_ALPHABET)
        at = np.array([_INDEX[c] for c in token])
        return float(self.ratio[(at[:-2] * n + at[1:-1]) * n + at[2:]].mean())


def _identifiers(words: list[str], rng: random.Random) -> list[str]:
    out = []
    for _ in range(SAMPLES):
        parts = [rng.choice(rng.choice((_COMMON, words or _COMMON))).lower() for _ in range(rng.randrange(1, 6))]
        style = rng.randrange(6)
        if style == 0:
            text = "".join(p.capitalize() for p in parts)
        elif style == 1:
            text = parts[0] + "".join(p.capitalize() for p in parts[1:])
        elif style == 2:
            text = "".join(parts).upper() if rng.random() < 0.5 else "_".join(parts).upper()
        elif style == 3:
            text = "".join(parts)
        else:
            text = rng.choice("_-/=+").join(parts)
        out.append(text + (str(rng.randrange(10 ** rng.randrange(1, 5))) if rng.random() < 0.3 else ""))
    return out


def _random_strings(rng: random.Random) -> list[str]:
    alphabets = (string.ascii_letters + string.digits, _ALPHABET[:64], string.ascii_uppercase + string.digits,
                 string.digits + "abcdef", string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "-_")
    return ["".join(rng.choices(rng.choice(alphabets), k=rng.randrange(16, 49))) for _ in range(SAMPLES)]


#: Half of the parts of ordinary samples; the other half are words of the documents.
_COMMON = """
access account action add address agent all alpha application argument array async attribute audio auth base batch
begin binary block body bool buffer build button bytes cache call camera cancel change channel char check child class
clean click client clock close cluster code collection color column command commit common compare component config
connect content context control copy core count create current custom data database date debug default delete depth
device dialog dictionary directory display document domain double draft driver duration editor element email enable
encode end entity entry enum environment error estimate event example exception execute export factory field file
filter find first flag float folder font format frame function generic get group handler hash header height hidden
""".split()


#: By byte: 0 between tokens, 1 to 26 a letter, 27 what makes a token no word.
_LETTER = np.full(256, 27, dtype=np.int64)
for _i in range(26):
    _LETTER[ord("a") + _i] = _LETTER[ord("A") + _i] = _i + 1
_LETTER[[b for b in range(128) if chr(b) not in _ALPHABET]] = 0


def letter_triples(text: bytes) -> np.ndarray:
    """Counts of the letter triples of a text's words, a word's ends being 0: 27 * 27 * 27 numbers.

    A word is a token of letters only, 2 to 12 of them, neither in capitals nor with capitals inside.
    """
    codes = np.frombuffer(b"\n" + text + b"\n\n", np.uint8)
    letters = _LETTER[codes]
    edges = np.diff((letters > 0).astype(np.int8), prepend=0)
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    upper = (codes >= 65) & (codes <= 90)
    bad = np.concatenate(([0], np.cumsum((letters == 27) | upper & (np.roll(letters, 1) > 0))))
    good = (bad[ends] == bad[begins]) & (ends - begins >= WORD_LETTERS[0]) & (ends - begins <= WORD_LETTERS[1])
    step = np.zeros(len(codes) + 1, dtype=np.int8)
    step[begins[good]] += 1
    step[ends[good] + 1] -= 1
    at = np.flatnonzero(np.cumsum(step[:-1]))  # the letters of a word and the place behind it
    before = np.where(letters[at - 1] > 0, letters[np.maximum(at - 2, 0)], 0)
    return np.bincount((before * 27 + letters[at - 1]) * 27 + letters[at], minlength=27**3)


def corpus_triples(docs: DataFrame) -> np.ndarray:
    """``letter_triples`` over all whole texts of ``docs``: an aggregate of at most 27 * 27 * 27 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27**3, dtype=np.int64)
        for part in text_slices(batches, 0):
            total += letter_triples(b"\n".join(utf8(part.column(0))))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["triple", "n"])

    counted = docs.select("text").mapInArrow(run, "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(27**3)
    out[counted.column("triple").to_numpy()] = counted.column("n").to_numpy()
    return out


def drawn_words(triples: np.ndarray, n: int, rng: random.Random) -> list[str]:
    """``n`` words drawn from the chain of order 2 that the triples make."""
    sums = triples.reshape(27, 27, 27).cumsum(axis=2)
    out = []
    while len(out) < n and sums[0, 0, -1] > 0:
        word, a, b = "", 0, 0
        while len(word) < WORD_LETTERS[1]:
            c = int(np.searchsorted(sums[a, b], rng.random() * sums[a, b, -1], side="right"))
            if c == 0:
                break
            word, a, b = word + chr(96 + c), b, c
        out.append(word)
    return out


def train(docs: DataFrame, seed: int = 0) -> Chains:
    """The two chains; those of ordinary identifiers follow the words of all ``docs``."""
    rng = random.Random(seed)
    words = drawn_words(corpus_triples(docs), DRAWN_WORDS, rng)
    return Chains(_random_strings(rng), _identifiers(words, rng))


def all_spans(text: str, chains: Chains) -> list[tuple[int, int, int]]:
    """The rules' spans, and tokens beside them that the models take for random."""
    found = rule_spans(text)
    added, at, reached = [], 0, 0
    for m in TOKEN.finditer(text):  # both lists ascend, so they are merged
        begin, end = m.span()
        while at < len(found) and found[at][0] < end:
            reached = max(reached, found[at][1])
            at += 1
        if reached <= begin and chains.score(m[0]) > THRESHOLD:
            added.append((begin, end, 3))
    return sorted(found + added, key=lambda s: (s[0], s[2])) if added else found


def find_secrets(docs: DataFrame, chains: Chains) -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``spans``, an array of kind, begin and end (code
    points, end exclusive) ordered by begin, then kind as listed.

    Nulls and other cases: a null text is empty and has no spans; a null doc_id and repeated rows
    keep their rows; texts are scanned whole; an empty table gives an empty result.  Extra columns
    are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(chains)  # a fixed size: the alphabet's triples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))
        for part in text_slices(batches, 1):
            spans = [[{"kind": KINDS[k], "begin": b, "end": e} for b, e, k in all_spans(t.decode(), model)] for t in utf8(part.column(1))]
            yield pa.record_batch([part.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,begin:bigint,end:bigint>>")


def redact_secrets(docs: DataFrame, chains: Chains, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``mark``; overlapping spans by one.

    Other columns stay as they are, whatever their names, and so does a null text; rows without a doc_id and
    repeated rows are rows like others; texts are searched whole, however long; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(chains)
    names, at = docs.columns, docs.columns.index("text")

    def clean(text: str | None, model: Chains) -> str | None:
        if text is None:
            return None
        out, done, reached = [], 0, -1
        for begin, end, _ in all_spans(text, model):
            if begin >= reached:
                out += [text[done:begin], mark]
            done = reached = max(reached, end)
        return "".join([*out, text[done:]]) if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for part in text_slices(batches, at):
            texts = pa.array([clean(t, model) for t in part.column(at).to_pylist()], pa.string())
            yield pa.record_batch([*part.columns[:at], texts, *part.columns[at + 1 :]], names=names)

    return docs.mapInArrow(run, docs.schema)
