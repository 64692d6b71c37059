from __future__ import annotations

import pytest

from scriptorium.sources import files


def test_text_folder(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\nbody é\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.md").write_text("")
    (tmp_path / "c.bin").write_text("no")
    rows = {r.path: r for r in files.connector("markdown")(spark, str(tmp_path)).collect()}
    assert rows["a.md"].content == "# A\nbody é\n" and rows["a.md"].size_bytes == 12 and "c.bin" not in rows


def test_manual_notes(spark):
    notes = spark.createDataFrame([("My First Note!", "x"), ("Too long", "y" * 50_001), ("none", None)], "title string, content string")
    assert [r.path for r in files.connector("manual")(notes).collect()] == ["manual/my-first-note.md"]


def test_unknown_connector():
    with pytest.raises(ValueError):
        files.connector("url")
