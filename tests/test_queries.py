"""Every query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import rows_of

from sightline.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    found = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    assert rows_of(df.columns, rows, order) == rows_of(columns, found.fetchall(), order)


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 25
