"""Every query against its DuckDB equivalent."""

import pytest

from tessavox.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, data, duck, rows_of):
    got, wanted = QUERIES[name](spark, data).toArrow(), duck.sql(SQL[name]).to_arrow_table()
    assert rows_of(got) == rows_of(wanted)
    assert {f.name: str(f.type) for f in got.schema} == {f.name: str(f.type) for f in wanted.schema}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
