"""Small rows that are many do not go through the driver, however little room their files take."""

import pytest
from pyspark.sql import functions as F

from filingforge.operators import facts as facts_ops
from filingforge.operators import grid as grid_ops
from filingforge.operators.ordered import number_rows
from filingforge.operators.staging import stage
from filingforge.operators.tables import find_finance_tables, single_grid, stack_tables
from workload import grids


@pytest.fixture
def no_broadcast(spark):
    """A broadcast of more than 1 KB is an error, as that of a large one is."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1024")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def _rows(spark, filings=60):
    lines = [["", "December 31, 2020"], ["Cash", "10"], ["Net loss", "$20"], ["Assets", "30"]]
    rows = [(f"F{n}", t, i, ["0", "1"], line) for n in range(filings) for t in (0, 1) for i, line in enumerate(lines)]
    return stage(spark.createDataFrame(rows, "filing string, table_id int, row_idx int, labels array<string>, cells array<string>"), "rows")


def test_finance_tables_and_stacking(spark, no_broadcast):
    assert find_finance_tables(_rows(spark)).count() == 480
    assert stack_tables(_rows(spark)).count() == 480


@pytest.mark.parametrize("step", [grid_ops.drop_empty_columns, grid_ops.with_first_column, grid_ops.numeric_columns, grid_ops.clean_grid])
def test_known_columns(spark, no_broadcast, step):
    assert step(stage(single_grid(_rows(spark).where("table_id = 0")), "grid")).count() == 240


def test_facts(spark, no_broadcast):
    grid = stage(stack_tables(_rows(spark)), "grid")
    facts = stage(grid_ops.locate_facts(grid_ops.clean_grid(grid)), "facts")
    assert facts.count() == 360
    assert facts_ops.trend_and_recent(facts_ops.format_and_filter(facts)).count() > 0


def test_row_numbers_of_many_runs(spark, no_broadcast):
    rows = stage(spark.range(400).selectExpr("concat('K', id % 200) AS k", "id << 12 AS at"), "rows")
    assert number_rows(rows, ["k"], "at", "n").where("n > 1").count() == 0


@pytest.mark.parametrize("name", sorted(set(grids.QUERIES) - {"null_placeholders", "date_header_rows", "carry_header_dates"}))
def test_grid_queries(spark, no_broadcast, tmp_path, name):
    orders = [(10 * n + k, n, "O", 1000.0 + k, f"{1995 + k}-03-01", f"{k + 1}-HIGH") for n in range(80) for k in range(5)]
    columns = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string"
    spark.createDataFrame(orders, columns).withColumn("o_orderdate", F.to_timestamp("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    assert grids.QUERIES[name](spark, str(tmp_path)).count() >= 80
