"""Every query against its SQL in DuckDB, on the smallest tables."""

import pytest

from tessera.plans import analytics_queries, control_queries, ingest_queries, search_queries, stream_queries

from .oracle import database, difference

ALL = [(name, f, module.register.oracles.get(name)) for module in (search_queries, analytics_queries, ingest_queries, control_queries, stream_queries) for name, f in module.register.queries.items()]


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name,query,sql", ALL, ids=[a[0] for a in ALL])
def test_query(spark, sf_dir, con, name, query, sql):
    df = query(spark, sf_dir)
    if sql is None:
        assert df.columns and df.count() >= 0
    else:
        assert difference(df, con, sql) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
