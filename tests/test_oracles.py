"""Every query with SQL gives the rows of that SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from scriptorium.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT:
            return "NULL"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    ours = pd.DataFrame([tuple(r) for r in found.collect()], columns=found.columns, dtype=object)
    cur = duck.execute(registry.ORACLE_SQL[name])
    theirs = pd.DataFrame(cur.fetchall(), columns=[c[0] for c in cur.description], dtype=object)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
