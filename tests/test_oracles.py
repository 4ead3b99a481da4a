"""Every registered query against its DuckDB oracle on the sf0.001 tables
(row count, column names and the multiset of rows)."""
import duckdb
import pytest

from conftest import SF_SMALL
from cartograph.plans.registry import load_all
from cartograph.sources.shop import DRIVER_TABLES
from tools.oracle_check import rows

QUERIES = load_all()
WITH_ORACLE = sorted(n for n, q in QUERIES.items() if q.oracle)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", WITH_ORACLE)
def test_matches_oracle(spark, con, name):
    q = QUERIES[name]
    got_cols, got = rows(q.build(spark, SF_SMALL).toPandas())
    exp_cols, exp = rows(con.sql(q.oracle).df())
    assert got_cols == exp_cols
    assert len(got) == len(exp)
    assert got == exp


def test_every_query_runs(spark):
    for name, q in QUERIES.items():
        if q.oracle is None:
            df = q.build(spark, SF_SMALL)
            assert df.count() >= 0, name


def test_entry_contract(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
