"""The driver contract, and a sample of the queries against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from modelwake.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "window_bounds", "monitor_window_quality", "error_groups", "ks_by_window", "wasserstein_by_window", "js_by_window",
    "psi_by_window", "quality_profile", "churn_features", "item_sales_features", "auc_exact", "cohort_metrics",
    "threshold_sweep", "perturb_shuffle",
]

needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    without = set(QUERIES) - set(entry.oracle_sql())
    assert without == {
        "rf_regression", "rf_importance", "permutation_importance", "partial_dependence", "gbt_classifier", "tabular_regression"
    }


@needs_tables
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == entry.entry(spark).columns and df.count() > 0


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@needs_tables
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    df = entry.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())
