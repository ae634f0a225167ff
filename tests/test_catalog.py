"""Each query with an oracle gives DuckDB's rows on the smallest scale."""

import duckdb
import pandas as pd
import pytest

from tallyveil import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def normal(df):
    def cell(v):
        return "null" if pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, row)) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(spark, db, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), db.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", ["r1_compiled_mixed", "r1_compiled_noop"])
def test_reports_of_many_values_equal_oracle(spark, tmp_path, name):
    """More than 10,000 values in one group of an unencoded histogram."""
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    many = "SELECT 11 * n AS event_id, TIMESTAMP '2024-01-10' + to_seconds(n) AS ts, n AS user_id, 'type' || n % 11500 AS event_type, 1.5 AS value, '{\"k\": 3}' AS props FROM range(12000) r(n)"
    for t, rows in (("events", many), ("nation", f"FROM '{SF}/nation.parquet'"), ("region", f"FROM '{SF}/region.parquet'")):
        c.sql(f"COPY ({rows}) TO '{tmp_path}/{t}.parquet'")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, str(tmp_path)).toPandas(), c.sql(catalog.ORACLES[name]).df()
    assert len(want) > 10_000 and normal(got) == normal(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - {"a19_joint_em", "a20_joint_variance", "a21_independence_test", "r2_joint_report"}))
def test_query_without_oracle_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_has_all_queries():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert catalog.FLAGSHIP in entry.queries()
