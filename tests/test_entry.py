"""What the entry point hands out."""

from __future__ import annotations

import __spark_entry__


def test_oracles_are_sql():
    found = __spark_entry__.oracle_sql()
    assert all(isinstance(sql, str) for sql in found.values())
    assert found.keys() <= __spark_entry__.queries().keys()
