import os

import pytest

from notespark.functions.models import HashingEmbedder
from notespark.operators import postings
from notespark.sources.imports import Imports
from notespark.streaming.index import IndexTables


def _picky():
    """Made here so that workers get it by value."""

    class Picky(HashingEmbedder):
        name = "picky"

        def embed(self, texts):
            if any("poison" in t for t in texts):
                raise ValueError("won't embed that")
            return HashingEmbedder.embed(self, texts)

    return Picky(16)


def _write(folder, name, content):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())


def _report(rows):
    return {os.path.basename(r.path): (r.n_fragments, r.error) for r in rows.collect()}


def test_a_broken_file_is_one_row_and_a_dead_run_leaves_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BUCKETS", 3)
    folder = tmp_path / "notes"
    _write(folder, "Math.md", "intro\n## Limits\nbanana")
    _write(folder, "sub/Broken.md", b"\xff\xfe no text")
    _write(folder, "sub/Poison.md", "fine\n## Bad\npoison")
    _write(folder, "other.txt", "no note")
    imports = Imports(IndexTables(spark, str(tmp_path / "index"), _picky()))
    put, imports.files.put = imports.files.put, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        imports.run(str(folder), 0)
    assert imports.files.live().count() == 0
    imports.files.put = put
    got = _report(imports.run(str(folder), 0))
    assert got == {"Math.md": (2, None), "Broken.md": (0, "not valid UTF-8"), "Poison.md": (2, "ValueError: won't embed that")}
    assert imports.tables.vectors().count() == 3 and imports.tables.failures().count() == 1
    ids = {r.title: r.note_id for r in imports.files.live().collect()}
    assert sorted(ids) == ["Broken", "Math", "Poison"] and len(set(ids.values())) == 3

    _write(folder, "sub/Broken.md", "mended banana")
    _write(folder, "New.md", "another banana")
    (folder / "sub/Poison.md").unlink()
    got = _report(imports.run(str(folder), 1))
    assert got == {"Math.md": (2, None), "Broken.md": (1, None), "New.md": (1, None)}
    after = {r.title: r.note_id for r in imports.files.live().collect()}
    assert after["Math"] == ids["Math"] and after["Broken"] == ids["Broken"] and after["New"] not in ids.values()
    assert imports.tables.failures().count() == 0
    asked = spark.createDataFrame([(0, "banana")], "query_id int, text string")
    assert imports.tables.keywords().search(asked, 9).count() == 3
