"""Rebuilding stored graphs of single twins."""

from __future__ import annotations

import pytest

from scriptorium.sources.graphs import ENTITY, RELATION, GraphTable

REFS, NONE = ["a.md"], None


def entities(spark, *rows):
    return spark.createDataFrame([(twin, at, name, "t", "d", REFS if at == 0 else NONE, NONE) for twin, at, name in rows], ENTITY)


def relations(spark, *rows):
    return spark.createDataFrame([(twin, at, a, b, "r", NONE) for twin, at, a, b in rows], RELATION)


def twins(spark, *ids):
    return spark.createDataFrame([(k,) for k in ids], "twin_id long")


def state(graph):
    return (
        sorted(tuple(r) for r in graph.entities().select("twin_id", "position", "name").collect()),
        sorted(tuple(r) for r in graph.relations().select("twin_id", "position", "src", "dst").collect()),
    )


@pytest.fixture()
def graph(spark, tmp_path):
    graph = GraphTable(spark, str(tmp_path / "graph"))
    assert state(graph) == ([], [])
    found = entities(spark, (1, 0, "Api"), (1, 1, "Store"), (1, 2, "API"), (2, 0, "Api"), (2, 1, "Queue"))
    graph.rebuild(twins(spark, 1, 2), found, relations(spark, (1, 0, "api", "STORE"), (1, 1, "Api", "Queue"), (2, 0, "Queue", "Api"), (2, 1, "Api", "api")))
    return graph


def test_ends_are_found_by_name_within_the_twin(graph):
    assert state(graph)[1] == [(1, 0, 2, 1), (2, 0, 1, 0), (2, 1, 0, 0)]
    assert {r.weight for r in graph.relations().collect()} == {1.0}
    assert {r.position: r.source_refs for r in graph.entities().where("twin_id = 1").collect()} == {0: REFS, 1: [], 2: []}


def test_other_twins_stay_and_a_rerun_changes_nothing(spark, graph):
    before = state(graph)
    new = entities(spark, (1, 0, "Cache"), (1, 1, "Api"), (2, 0, "not rebuilt"), (None, 0, "nobody's"))
    for _ in range(2):
        graph.rebuild(twins(spark, 1, 1, None), new, relations(spark, (1, 5, "cache", "api"), (1, 6, "Store", "Api"), (2, 7, "Api", "Queue")))
        nodes, edges = state(graph)
        assert nodes == [(1, 0, "Cache"), (1, 1, "Api")] + [n for n in before[0] if n[0] == 2]
        assert edges == [(1, 5, 0, 1)] + [e for e in before[1] if e[0] == 2]


def test_an_empty_extraction_empties_its_twin_alone(spark, graph):
    before = state(graph)
    graph.rebuild(twins(spark, 1), entities(spark), relations(spark, (1, 0, "Api", "Store")))
    assert state(graph) == tuple([x for x in part if x[0] == 2] for part in before)
    graph.rebuild(twins(spark), entities(spark), relations(spark))
    assert state(graph) == tuple([x for x in part if x[0] == 2] for part in before)


def test_null_names_repeats_and_missing_columns(spark, tmp_path):
    graph = GraphTable(spark, str(tmp_path / "graph"))
    found = spark.createDataFrame([(1, 0, None, 9), (1, 1, "A", 9), (1, 1, "A", 9), (1, 2, "", 9)], "twin_id long, position long, name string, weight int")
    asked = spark.createDataFrame([(1, 0, None, "a"), (1, 1, "", "a"), (1, 2, "a", None)], "twin_id long, position long, source string, target string")
    graph.rebuild(twins(spark, 1), found, asked)
    assert graph.entities().count() == 4
    assert state(graph)[1] == [(1, 1, 2, 1)]
    assert GraphTable(spark, graph.folder).entities().count() == 4  # opening a table again leaves it as it is
