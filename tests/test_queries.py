"""Every engine query with SQL against DuckDB on the smallest tables, and the others for rows."""

import pytest
from orrery import queries as q
from tables import DATA, same


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_equals_sql(spark, oracle, name):
    df = q.QUERIES[name](spark, DATA)
    columns, expected = oracle(q.SQL[name])
    assert sorted(df.columns) == columns
    assert same(df.columns, [tuple(r) for r in df.collect()]) == expected


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.SQL) - {"f10_robust_line"}))
def test_runs(spark, name):
    assert len(q.QUERIES[name](spark, DATA).columns) > 0
    q.QUERIES[name](spark, DATA).write.format("noop").mode("overwrite").save()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
