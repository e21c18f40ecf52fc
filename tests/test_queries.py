"""Every core query with SQL against DuckDB, over the smallest whole tables."""

import pytest

from pathloom import queries as core
from tests.conftest import DATA
from tools.compare import connect, rows_of


@pytest.fixture(scope="module")
def con(data):
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(core.all_queries()))
def test_query(spark, con, name):
    df = core.all_queries()[name](spark, DATA)
    got = rows_of(df.columns, df.collect())
    if sql := core.all_sql().get(name):
        cur = con.execute(sql)
        columns = [c[0] for c in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows_of(columns, cur.fetchall())


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["rank", "path", "name", "score", "size", "mtime"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
