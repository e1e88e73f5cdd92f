import random

from notespark.functions import fragmenter as f
from notespark.functions import markdown as m
from notespark.functions.stemming import stem
from notespark.operators.fragments import fragmented


def test_stems_of_the_published_vocabularies():
    english = "consigned consign,consolatory consolatori,consolingly consol,knightly knight,generously generous,happy happi,relational relat," \
              "vileness vile,hopping hop,hoping hope,ties tie,cries cri,say say,dying die,agreed agre,troubled troubl,this this,kiwis kiwi"
    russian = "вавиловка вавиловк,важная важн,важнее важн,важности важност,валялась валя,валяются валя,вариантов вариант," \
              "противно противн,падают пада,павлиний павлин,падением паден,пакостей пакост,патриотическая патриотическ,вода вода"
    for pair in f"{english},{russian}".split(","):
        word, want = pair.split()
        assert stem(word) == want, word


def test_cleaning_steps():
    assert m.clean("# T\n\n1. **b** __c__ ~~d~~ ==e== `f` *g* [l](u) [[a|b]] [[c]]\n- item\n***\n\nX") == "t\nb c d e f g l b c\nitem\nx"
    assert m.clean("x*y*z a_b_c 3) y") == "x*y*z a_b_c 3) y"
    assert m.formatted_latex("$\\alpha + \\alpha_1 \\frac{a}{b} \\vec{v}$ and $$\\sum_{i}^{n} \\foo{x}$$") == "$α + _1 (a)/(b) v\u20d7$ and $$∑_i^n $$"
    assert m.removed_latex("a $x$ b $$y\nz$$ c") == "a  b  c"
    assert m.clean("| a | b |\n|---|---|\n| 1 | 2 |\n| | 3 |\n\nend") == "a: 1. b: 2\nb: 3\nend"
    assert m.clean("# T\n*x*", m.RAW) == "# T\n*x*"


NOTE = "intro\n\n## A\n\npara one\n\n### sub\n\ntext under\n\n## B\n\n| x | y |\n|---|---|\n| 1 | 2 |\n\nafter"


def test_headings_glue_and_tables():
    atoms = [(a.text.strip(), a.title) for a in f.heading_atoms("intro\n\n## A\n\npara\n\n### s\n\nunder\n\n## B\nx")]
    assert atoms == [("intro", None), ("## A\n\npara", "A"), ("### s\n\nunder", "A"), ("## B\nx", "B")]
    pairs = [(x.text, clean) for x, clean in f.fragment_pairs(NOTE)]
    assert [c for _, c in pairs] == ["intro", "a\na\npara one\nsub\ntext under", "b\nx: 1. y: 2", "b\nafter"]
    plain = [(x.text, x.title) for x in f.fragment(NOTE, f.GENERATION_PRESET)]
    assert plain == [("intro", None), ("para one", "A"), ("text under", "A"), ("| x | y |\n|---|---|\n| 1 | 2 |", "B"), ("after", "B")]
    assert f.front_matter("---\na: 1\n---\nx") == ({"a": 1}, "x") and f.front_matter("---\n: [\n---\nx") == (None, "x") and f.front_matter("---\nx") == (None, "---\nx")
    assert f.first_heading("x\n ### T \n# U") == ("T", 3) and f.first_heading("x") is None


def test_blocks_and_bytes():
    text = "# H\npara\ncont\n\n- a\n- b\n  c\n\n- d\n\n```\n# x\n\ny\n```\n> q\n> r\n\nSet\n===\n***\n| a |\n|---|\n| 1 |"
    assert list(f.blocks(text)) == ["# H", "para\ncont", "- a\n- b\n  c\n\n- d", "```\n# x\n\ny\n```", "> q\n> r", "Set\n===", "***", "| a |\n|---|\n| 1 |"]
    packed = f.pack_bytes(f.block_atoms("one two\n\nthree\n\n# H\n\nfour\n\n" + "five " * 20), 20)
    assert [(x.text[:8], x.title) for x in packed] == [("one two\n", "one two"), ("# H\n\nfou", "H"), ("five fiv", ("five " * 8) + "...")]
    alike = f.semantic_chunks("aa\n\nbb\n\n# H\n\ncc", lambda ts: [[1.0, 0.0]] * len(ts), 800, 0.7)
    assert [x.text for x in alike] == ["aa\n\nbb", "# H\n\ncc"]
    assert [x.text for x in f.semantic_chunks("aa\n\nbb", lambda ts: 1 / 0, 800, 0.7)] == ["aa\n\nbb"]


def test_budgets_hold_and_nothing_is_lost():
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "longerword ", "End. ", "\n", "Ask? ", "x" * 30 + " "]) for _ in range(rng.randrange(1, 200)))
        for cut in (f.by_words, f.by_sentences, f.by_lines):
            pieces = cut(text, 20)
            assert "".join("".join(p.split()) for p, _ in pieces) == "".join(text.split())
            assert all(n <= 20 or " " not in p.strip() or cut is f.by_words for p, n in pieces)
        atoms = [f.Atom(t) for t in text.split("\n") if t.strip()]
        for overlap in (0, 8):
            packed = f.pack_tokens(atoms, 20, overlap)
            if not overlap:
                assert "".join("".join(p.text.split()) for p in packed) == "".join(text.split())
    titled = [f.Atom("a " * 10, "T", ("## T",)), f.Atom("b " * 10, "T", ("## T",))]
    assert [x.title for x in f.pack_tokens(titled, 20)] == [None, "T"] and [x.title for x in f.pack_tokens(titled, 20, keep_titles=True)] == ["T", "T"]
    short = [f.Atom("a"), f.Atom("b " * 6), f.Atom("c")]
    assert [x.text.split()[0] for x in f.pack_tokens(short, 10, 2)] == ["a", "a", "c"]  # the overlap comes on top of a budget


def test_notes_become_rows(spark):
    rows = [(1, NOTE), (2, None), (3, ""), (None, "only"), (1, NOTE)]
    notes = spark.createDataFrame(rows, "note_id long, content string").repartition(2)
    got = fragmented(notes).collect()
    assert len(got) == 9 and sorted(r.order_index for r in got if r.note_id == 1) == [0, 0, 1, 1, 2, 2, 3, 3]
    assert [(r.raw_text, r.clean_text) for r in got if r.note_id is None] == [("only", "only")]
    assert fragmented(notes.limit(0)).count() == 0
