import random
import time

import pytest

from notespark.llm.queries import TOKENIZER
from notespark.llm.tokencounts import Counter, Vocabulary, count_tokens, load_vocabulary

tokenizers = pytest.importorskip("tokenizers")


def _library(vocabulary):
    from tokenizers import Tokenizer, models, pre_tokenizers

    found = Tokenizer(models.Unigram(list(vocabulary.pieces), vocabulary.unknown, True))
    found.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    return lambda text: len(found.encode(text, add_special_tokens=False).ids)


def test_equals_the_library_on_documents(spark, sf):
    vocabulary = load_vocabulary(TOKENIZER)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plain = _library(vocabulary)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs, vocabulary).collect()}
    assert got == {i: plain(t or "") for i, t in texts.items()}


def test_equals_the_library_on_ties_and_unknown_characters():
    rng = random.Random(6)
    for with_bytes in (False, True):
        pieces = {"<unk>": 0.0} | ({f"<0x{b:02X}>": 0.0 for b in range(256)} if with_bytes else {})
        pieces |= {"▁": -2.0, "▁a": -2.0}
        for _ in range(60):
            pieces["".join(rng.choices("abc▁", weights=[3, 3, 3, 1], k=rng.randrange(1, 5)))] = float(-rng.randrange(1, 4))
        vocabulary = Vocabulary(tuple(pieces.items()), 0)
        plain, counter = _library(vocabulary), Counter(vocabulary)
        for _ in range(1500):
            text = "".join(rng.choices(["a", "b", "c", " ", "é", "日", "𝕏", "<unk>", "\n", "▁"], k=rng.randrange(14)))
            assert counter.text(text) == plain(text), text


def test_awkward_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (3, " ", 1), (None, "a", 1), (4, "word " * 40000, 1), (4, "word " * 40000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    vocabulary = load_vocabulary(TOKENIZER)
    plain = _library(vocabulary)
    got = sorted((str(r.doc_id), r.n_tokens) for r in count_tokens(docs, vocabulary).collect())
    assert got == sorted((str(i), plain(t or "")) for i, t, _ in rows)
    assert count_tokens(docs.limit(0), vocabulary).count() == 0


def test_long_runs_of_unknown_characters():
    vocabulary = load_vocabulary(TOKENIZER)
    plain, counter = _library(vocabulary), Counter(vocabulary)
    for text in ("\U0001fae8" * 3000, "\U0001fae8a日\U0001fae9" * 500, "x" + "\U0001fae8" * 50 + "<0x41>" + "\U0001fae8" * 50):
        assert counter.text(text) == plain(text)
    begin = time.perf_counter()
    assert counter.text("\U0001fae8" * 200_000) == 1 + 4 * 200_000
    assert time.perf_counter() - begin < 30
