"""Every query against its SQL; those without run and give rows."""

import pytest

from axisframe.queries import ORACLES, QUERIES

from .conftest import DATA, comparable


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = comparable(df.select(*columns).collect())
    assert rows
    if name in ORACLES:
        got = duck.sql(ORACLES[name])
        assert sorted(got.columns) == columns
        assert rows == comparable(duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall())


def test_entry_registers_all(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
