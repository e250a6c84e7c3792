"""Driver contract: entry runs; every query has a callable; oracles are
registered for the SQL-expressible ones."""

import __spark_entry__ as entry


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns == ["facet", "label", "cnt"]


def test_registry_complete():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert len(qs) >= 60
    assert set(sql) <= set(qs)
