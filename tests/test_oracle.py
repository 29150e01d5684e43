"""Every registered query with an SQL equivalent, compared through DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = [f[: -len(".parquet")] for f in sorted(os.listdir(DATA))] if os.path.isdir(DATA) else []


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


@pytest.mark.skipif(not TABLES, reason="benchmark tables absent")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    expected = sorted(repr([r[columns.index(c)] for c in order]) for r in result.fetchall())
    found = sorted(repr([r[c] for c in order]) for r in df.collect())
    assert found == expected


def test_only_iterative_fits_lack_an_sql_equivalent():
    assert sorted(set(QUERIES) - set(ORACLES)) == [
        "boosted_model", "feature_importance", "forest_model", "logistic_model", "metric_summary", "platt_calibrated_scores",
    ]
