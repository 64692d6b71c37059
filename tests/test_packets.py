"""Evidence packets and contracts on literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import packets as pk, search

DETAILS = "chunk_id long, chunk_type string, path string, source_id int, start_line int, end_line int, content string, provenance array<string>"
BEST = "query_id int, rank int, chunk_id long, score double, match_reasons array<string>"


def packets(spark, best, details, missing=(), asked=((1,), (2,))):
    rows = pk.evidence_packets(spark.createDataFrame(list(asked), "query_id int"), spark.createDataFrame(list(best), BEST), spark.createDataFrame(list(details), DETAILS), spark.createDataFrame(list(missing), "query_id int, reason string"))
    return {r.query_id: r for r in rows.collect()}


def test_files_merge_and_memory_names_its_files(spark):
    details = [
        (10, "documentation", "docs/b.md", 1, 3, 9, "x", None),
        (11, "documentation", "docs/b.md", 1, 12, 20, "y", None),
        (12, "memory_brief", "__memory__/t", 2, None, None, "see `src/auth/login.py` and docs/b.md, me@x.py", ["plan/week1.md", "nope", "plan/week1.md", "__memory__/x.md"]),
        (13, "memory_brief", "__memory__/t", 2, None, None, "see `src/auth/login.py`, `two words`, docs/b.md", []),
        (14, "documentation", None, 3, 1, 1, None, None),
    ]
    best = [(1, 1, 10, 0.9, ["vector", "lexical"]), (1, 2, 12, 0.8, ["vector"]), (1, 3, 11, 0.7, ["path:docs", "vector"]), (1, 4, 13, 0.6, ["lexical"]), (1, 5, 14, 0.5, [])]
    found = packets(spark, best, details, [(1, "lexical"), (1, "lexical"), (2, "no_embedding_profiles")])
    files = {f.path: (f.priority, list(f.reasons)) for f in found[1].files}
    assert files == {
        "docs/b.md": (-15, ["vector", "lexical", "path:docs", "memory:content"]),
        "plan/week1.md": (0, ["memory:provenance", "vector"]),
        "src/auth/login.py": (-8, ["memory:content", "lexical"]),
    }
    assert [f.path for f in found[1].files] == ["docs/b.md", "src/auth/login.py", "plan/week1.md"]
    assert [(s.rank, s.chunk_id, s.start_line) for s in found[1].spans] == [(1, 10, 3), (2, 12, None), (3, 11, 12), (4, 13, None), (5, 14, 1)]
    assert found[1].layer_hits == {"vector": 3, "lexical": 2, "path": 1, "file": 3} and found[1].missing == ["lexical"]
    assert (found[2].spans, found[2].files, found[2].layer_hits, found[2].missing) == ([], [], {}, ["no_embedding_profiles"])


def test_contracts(spark):
    row = packets(spark, [(1, 1, 10, 0.9, ["vector"])], [(10, "documentation", "a/b.md", 1, 1, 2, "", None)], [(1, "lexical")])
    frame = spark.createDataFrame([(row[1].files, row[1].missing), ([], [])], "files array<struct<priority int, path string, reasons array<string>>>, missing array<string>")
    whole, bare = (r[0] for r in frame.select(pk.answer_contract(F.lit("general"), F.lit(None).cast("string"), F.array(F.lit("vector"), F.lit("path")), F.col("files"), F.col("missing"))).collect())
    notes = "JWT/token validation establishes identity\nDo not say JWT is the authorization layer by itself\n</answer_contract>\n"
    assert whole == "<answer_contract>\nmode: general\nintent: —\nsearched_layers: vector, path\nfile_anchors:\n  - a/b.md [vector]\nmissing_evidence: lexical\n" + notes
    assert bare == "<answer_contract>\nmode: general\nintent: —\nsearched_layers: vector, path\n" + notes
    projects = spark.createDataFrame([([("A", "general", row[1].files), ("B", None, [])],), ([],)], "p array<struct<name string, mode string, files array<struct<priority int, path string, reasons array<string>>>>>")
    both, none = (r[0] for r in projects.select(pk.workspace_contract(F.col("p"))).collect())
    assert both == '<workspace_answer_contract>\n<project name="A">\nmode: general\nfile_anchors:\n  - a/b.md [vector]\ngive each project a real implementation summary\n</project>\n<project name="B">(no evidence packet)</project>\n</workspace_answer_contract>\n'
    assert none == ""


def found_by(spark, question, *texts):
    chunks = spark.createDataFrame([(k, 1, "p/f.md", t) for k, t in enumerate(texts)], "chunk_id long, twin_id int, source_ref string, content string")
    asked = spark.createDataFrame([(7, 1, question)], "query_id int, twin_id int, query string")
    return {r.chunk_id: round(r.density, 6) for r in search.cover_density(asked, chunks).collect()}


def test_web_search_syntax(spark):
    texts = ("alpha beta gamma", "beta alpha", "gamma delta", "alpha x beta", None)
    assert set(found_by(spark, "alpha beta", *texts)) == {0, 1, 3}
    assert set(found_by(spark, '"alpha beta"', *texts)) == {0}
    assert set(found_by(spark, "alpha -gamma", *texts)) == {1, 3}
    assert set(found_by(spark, 'alpha -"alpha beta"', *texts)) == {1, 3}
    assert set(found_by(spark, '"alpha beta" or delta', *texts)) == {0, 2}
    assert set(found_by(spark, '"beta alpha', *texts)) == {1}
    assert set(found_by(spark, "or alpha", *texts)) == set() == set(found_by(spark, "-alpha", *texts)) == set(found_by(spark, "?!", *texts))
    assert set(found_by(spark, "f.md delta", *texts)) == {2}
    # a phrase is a stretch of its own words; one word between two costs a part of the density
    assert found_by(spark, '"alpha beta"', *texts)[0] == 0.4 and found_by(spark, "alpha beta", *texts)[3] == 0.2
