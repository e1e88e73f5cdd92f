import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import notespark.llm.tokenfiles as tokenfiles
from notespark.llm.queries import WORD_TOKENIZER
from notespark.llm.tokenfiles import WordEncoder, read_token_ids, with_starts, write_and_verify, write_token_ids

JSON = Path(WORD_TOKENIZER).read_text(encoding="utf-8")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_TOKENIZER)


def _ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def _plain(library, rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    out, start = [], 0
    for i, text in rows:
        ids = _ids(library, text)
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def _table(spark, rows):
    return spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, part int").repartition(3)


def test_words_one_by_one_are_the_whole_text(library, monkeypatch):
    monkeypatch.setattr(tokenfiles, "PIECE", 7)
    monkeypatch.setattr(tokenfiles, "CACHE_BYTES", 300)
    rng = random.Random(5)
    marks = [" ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "　", " ", "a", "A'S", "'re", "'", "é", "é", "́", "İ", "Σ", "1", "٣", "!?",
             "<|endoftext|>", "<|startoftext|>", "<|", "\U0001f600", "한글", "가", "\x00", "�", "ﬁ", "word", "Don't", ".", ",", ";", ":", "!", "Z", "5", "\u0338", "\u037e", "<|ENDOFTEXT|>", "ABC."]
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 25))) for _ in range(3000)]
    encoder = WordEncoder(JSON)
    for begin in range(0, len(texts), 50):
        some = texts[begin : begin + 50]
        ids, counts = encoder.texts([t.encode() for t in some], 2)
        assert ids.tolist() == [x for t in some for x in _ids(library, t)]
        assert counts.tolist() == [len(_ids(library, t)) for t in some]


def test_words_of_plain_letters_take_a_shorter_way(library, monkeypatch):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzßàéèêçñöüøÿ"
    words = ["".join(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(2500)]
    words += ["".join(rng.choices(letters + "ABÉÜ÷×12'#$%&()*+-/=>@[]^_`{|}~<.,´ǆſªµ\u0338\u0301", k=rng.randint(1, 6))) for _ in range(2500)]
    rng.shuffle(words)
    encoder, whole = WordEncoder(JSON), []
    encode = encoder._of_any
    monkeypatch.setattr(encoder, "_of_any", lambda some: whole.extend(some) or encode(some))
    texts = [" ".join(words[i : i + 40]) for i in range(0, len(words), 40)]
    ids, _ = encoder.texts([t.encode() for t in texts], 2)
    assert ids.tolist() == [x for t in texts for x in _ids(library, t)]
    assert not any(w.decode().isalpha() and w.isascii() for w in whole) and any(w.decode().isalpha() for w in whole)


def test_equals_the_library(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = sorted(tuple(r) for r in write_and_verify(docs, JSON, 2).collect())
    assert got == _plain(library, [tuple(r) for r in docs.collect()])


def test_awkward_rows(spark, library):
    rows = [(3, None), (1, ""), (2, " \n"), (-5, "Straße <|endoftext|> x\x00y"), (None, "no id"), (9, "word " * 300_000), (8, "漢" * 50_000), (4, "a b c")]
    assert sorted((tuple(r) for r in write_and_verify(_table(spark, rows), JSON, 2).collect()), key=lambda r: (r[0] is None, r[0] or 0)) == _plain(library, rows)
    assert write_and_verify(_table(spark, []), JSON, 2).collect() == []
    same = [(7, "same words")] * 400 + [(7, "others"), (6, "before"), (8, "behind")]
    got = [tuple(r) for r in write_and_verify(_table(spark, same), JSON, 2, files=8).collect()]
    of = sorted((i, n, c) for i, _, n, c in got)
    assert of == sorted((i, n, c) for i, _, n, c in _plain(library, same))
    at = 0
    for i, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    assert [r[0] for r in sorted(got, key=lambda r: r[1])] == [6] + [7] * 401 + [8]


def _scanned(df):
    """Rows that the scan gave to the rest of the plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    leaf = leaves.apply(0)
    if leaf.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        leaf = leaf.executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


def test_files_are_sorted_and_pruned(spark, tmp_path):
    docs = spark.createDataFrame([(2 * i, f"text number {i}") for i in range(9000)], "doc_id long, text string").repartition(5)
    path = str(tmp_path / "ids")
    write_token_ids(docs, path, JSON, 2, files=3)
    table = read_token_ids(spark, path)
    assert with_starts(table, table).orderBy("start").select("doc_id").first()[0] == 0
    ranges = [r[0] for r in table.groupBy("part").agg(F.min("doc_id")).orderBy("part").select("min(doc_id)").collect()]
    assert len(ranges) == 3 and ranges == sorted(ranges)
    one = read_token_ids(spark, path, [5000])
    assert "In(doc_id" in one._jdf.queryExecution().toString() or "EqualTo(doc_id" in one._jdf.queryExecution().toString()
    assert one.count() == 1 and _scanned(one) <= tokenfiles.GROUP_ROWS  # statistics of row groups
    absent = read_token_ids(spark, path, [5001])
    assert absent.count() == 0 and _scanned(absent) == 0  # within the range: only the Bloom filter can tell


def test_large_files_have_stripes(spark, tmp_path, monkeypatch):
    from pyarrow import orc

    monkeypatch.setattr(tokenfiles, "STRIPE_BYTES", 1 << 16)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(800))) for i in range(3000)]
    write_token_ids(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "ids"), JSON, 2, files=1)
    file = orc.ORCFile(next((tmp_path / "ids").glob("*.orc")))
    assert file.nstripes > 1 and file.row_index_stride == tokenfiles.GROUP_ROWS and file.nrows == 3000
