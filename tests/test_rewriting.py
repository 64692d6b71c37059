"""Rewriting of answers and packing of paragraphs on literal cases."""

from __future__ import annotations

import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from scriptorium.operators import chunking, verification as vf


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_code_that_stands_in_no_snippet_goes(spark):
    answer = "Before\n\n```py\nrun( 1 )\nstop()\n```\n\nbetween\n\n```\ninvented()\n# note\nmore()\n```\n\n\n\nafter"
    got = one(spark, vf.drop_code(F.col("a"), F.array("s")), a=answer, s="def f():\n  run( 1 )\n  stop()")
    assert got == "Before\n\n```py\nrun( 1 )\nstop()\n```\n\nbetween\n\nafter"
    assert one(spark, vf.drop_code(F.col("a"), F.array().cast("array<string>")), a="x\n```\ny\n```") == "x"
    assert one(spark, vf.drop_code(F.col("a"), F.array("s")), a="no fence ``` open", s="") == "no fence ``` open"


def test_denials_of_what_is_there_go(spark):
    facts = F.array(F.lit("route"))
    answer = "There are no routes here.\nThere is no cache.\nI did not find grounded evidence of it: no http routes."
    assert one(spark, vf.drop_denials(F.col("a"), facts), a=answer) == "There is no cache."


def test_bounds_and_gaps(spark):
    gaps = F.array(*map(F.lit, (" lexical ", "", "b", "c", "d", "e", "f", "g")))
    got = one(spark, vf.with_bounds_and_gaps(F.col("a"), F.array(F.lit("path")), gaps), a="There is no cache.\n")
    assert got.startswith("There is no cache.\n\n## Bounds\n") and got.count("\n- ") == 6 and "- lexical\n" in got and "- g" not in got
    assert one(spark, vf.with_bounds_and_gaps(F.col("a"), F.array(F.lit("path")), gaps), a="All good.") == "All good."
    assert "Grounded gaps" not in one(spark, vf.with_bounds_and_gaps(F.col("a"), F.array(F.lit("path")), F.array().cast("array<string>")), a="There is no cache.")


def test_answers_without_issues_stay(spark):
    none = F.array().cast("array<string>")
    assert one(spark, vf.rewritten(F.col("a"), none, none, none, none), a="x\n```\ny\n```") == "x\n```\ny\n```"
    assert one(spark, vf.rewritten(F.col("a"), F.array(F.lit("unsupported_file_reference")), F.array(F.lit("a.md")), none, none), a="see A.md\nkept\n```\ny\n```") == "kept"


def test_all_other_names_are_looked_for(spark):
    others = F.array(F.lit("Beta"), F.lit("C++ (old)"), F.lit("gamma"))
    for body, want in {"like beta there": True, "alphabet": False, "the GAMMA one": True, "plain": False, "gammas": False}.items():
        assert one(spark, vf.leaks(F.col("b"), others), b=body) is want


def slow(text, most, overlap):
    """The same pieces, by looking at every run of paragraphs."""
    if len(text) <= most:
        return [text]
    out, held = [], None
    for p in re.split(r"\n\s*\n", text):
        before = held or ""
        if len(before) + len(p) + 2 <= most:
            held = f"{before}\n\n{p}".lstrip("\n")
            continue
        out += [held] if held else []
        if len(p) <= most:
            held = f"{before[-overlap:]}\n\n{p}".lstrip("\n") if before else p
        else:
            out += [p[i : i + most] for i in range(0, len(p), most - overlap)]
            held = None
    return out + ([held] if held else [])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab \n", max_size=30), max_size=12), st.integers(6, 25), st.integers(1, 5))
def test_paragraph_pieces(parts, most, overlap):
    text = "\n\n".join(parts)
    pieces = list(chunking.packed_paragraphs(text, most, overlap))
    assert pieces == slow(text, most, overlap)
    assert "".join(re.sub(r"\s", "", text)) == "" or pieces


def test_paragraph_table(spark):
    rows = [(1, "a" * 30 + "\n\n" + "b" * 30), (2, None), (3, ""), (None, "c" * 90), (1, "d")]
    found = chunking.paragraph_pieces(spark.createDataFrame(rows, "k int, t string"), "k", "t", 40, 10).collect()
    assert sorted((r.k or 0, r.piece_no, r.piece) for r in found) == sorted([(1, 0, "a" * 30), (1, 1, "a" * 10 + "\n\n" + "b" * 30), (1, 0, "d"), (3, 0, ""), (0, 0, "c" * 40), (0, 1, "c" * 40), (0, 2, "c" * 30)])
