"""Every registered query against its SQL at the smallest scale, as the driver does."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, canon

SF_DIR = "/root/testdata/sf0.001"
# The training-data operators have tests of their own.
OWN = {name for area in entry._AREAS for name in area.QUERIES}
QUERIES = {name: query for name, query in entry.queries().items() if name in OWN}
ORACLE = {name: sql for name, sql in entry.oracle_sql().items() if name in OWN}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["filing", "metric", "value"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, tables, name):
    df = QUERIES[name](spark, SF_DIR)
    rows = df.collect()
    assert rows or name in {"low_support_columns", "min_support_columns", "drop_columns_from_table"}
    tables.execute(f"CREATE OR REPLACE VIEW compared AS {ORACLE[name]}")  # as whoever compares may do
    found = tables.execute("SELECT * FROM compared")
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert canon(rows, df.columns) == canon(found.fetchall(), names)


@pytest.mark.parametrize(("name", "most"), [("stack_tables", 3), ("drop_empty_columns", 2), ("carry_header_dates", 2)])
def test_inputs_are_passed_over_few_times(spark, name, most):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= most


@pytest.mark.parametrize("name", ["carry_header_dates", "drop_empty_columns", "training_table", "document_type", "analyze_documents", "hconcat"])
def test_plans_hold_no_products(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
