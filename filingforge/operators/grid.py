"""Grids of one filing, as rows: (filing, row_no, cells).

`cells` is ARRAY<STRUCT<col: BIGINT, text: STRING>>, only the columns the row has. A row's own
width is small and fixed by its table, so everything about one row is a plain expression; work
across rows groups with map-side combining or goes through `ordered`, and no task ever holds
a whole filing. `row_no` and `col` are order keys and need not be dense.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from filingforge import vocabulary as V
from filingforge.functions.dates import extract_date_text, has_header_date
from filingforge.functions.numbers import is_plain_number, parse_amount
from filingforge.operators.ordered import RUN, TABLE_SHIFTS, carry_forward
from filingforge.operators.staging import by_sorted_shuffle, stage, with_once

CELLS_TYPE = "array<struct<col:bigint,text:string>>"
TABLE_SHIFT = 40  # of row_no: what is above is the table
_MARK_SHIFTS = (39, 13)  # of twice the run: 2^24 rows, then 1,024 tables


def explode_cells(grid: DataFrame) -> DataFrame:
    """Long form: (filing, row_no, col, cell)."""
    return grid.select("filing", "row_no", F.inline("cells").alias("col", "cell"))


def table_columns(grid: DataFrame) -> DataFrame:
    """(filing, __table, col, n_cells, blank, nulls, numbers): what is known about every column of every table.

    Counted with map-side combining; pseudo column -1 counts the rows of the table. One small row per column, written
    once, so that the cells are passed over once for all that is asked of columns.
    """
    col, text = F.col("cell.col"), F.col("cell.text")
    one_per_row = F.array(F.struct(F.lit(-1).cast("long").alias("col"), F.lit(None).cast("string").alias("text")))
    blank = text.rlike(r"(?U)^\s*\x{200B}*\s*$")
    per_column = (
        grid.select("filing", _table().alias("__table"), F.explode(F.concat(one_per_row, F.col("cells"))).alias("cell"))
        .groupBy("filing", "__table", col.alias("col"))
        .agg(
            F.count(F.lit(1)).alias("n_cells"),
            F.bool_and(F.coalesce(blank, F.lit(False))).alias("blank"),
            F.bool_and(text.isNull()).alias("nulls"),
            F.bool_or(F.coalesce(is_plain_number(text), F.lit(False))).alias("numbers"),
        )
    )
    return stage(per_column, "table-columns")


def _table() -> Column:
    return F.shiftright("row_no", TABLE_SHIFT)


def filing_columns(tables: DataFrame) -> DataFrame:
    """(filing, col, n_cells, blank, nulls, numbers, n_rows): the same per filing, from `table_columns`."""
    rows = tables.where("col = -1").groupBy("filing").agg(F.sum("n_cells").alias("n_rows"))
    return (
        tables.where("col >= 0").groupBy("filing", "col")
        .agg(
            F.sum("n_cells").alias("n_cells"), F.bool_and("blank").alias("blank"), F.bool_and("nulls").alias("nulls"),
            F.bool_or("numbers").alias("numbers"),
        )
        .join(by_sorted_shuffle(rows), "filing")
    )


# A row without the column counts as null there, so blanks are "all" only if every row has one.
_NOT_EMPTY = "not nulls and not (blank and n_cells = n_rows)"


def _with_known(grid: DataFrame, wanted: str, of: str = "true") -> DataFrame:
    """Rows with `first_col`, the leftmost column of the filing `of` which a condition holds, and `cols`, those of the
    `wanted` ones that occur in the row's table. A row is met by what is known about its table only."""
    tables = table_columns(grid)
    columns = filing_columns(tables).where(of)
    first = columns.groupBy("filing").agg(F.min("col").alias("first_col"))
    chosen = columns.where(wanted).select("filing", "col")
    held = tables.join(by_sorted_shuffle(chosen), ["filing", "col"], "left_semi")
    cols = held.groupBy("filing", "__table").agg(F.collect_list("col").alias("cols"))
    known = tables.where("col = -1").select("filing", "__table").join(by_sorted_shuffle(first), "filing", "left")
    known = stage(known.join(by_sorted_shuffle(cols), ["filing", "__table"], "left"), "known-columns")
    return grid.withColumn("__table", _table()).join(by_sorted_shuffle(known), ["filing", "__table"]).drop("__table")


def _keep(grid: DataFrame, wanted) -> DataFrame:
    return grid.withColumn("cells", F.filter("cells", lambda c: F.coalesce(wanted(c), F.lit(False))))


def _is_chosen(c: Column) -> Column:
    return F.coalesce(F.array_contains(F.col("cols"), c["col"]), F.lit(False))


def drop_empty_columns(grid: DataFrame) -> DataFrame:
    """Drops columns whose cells are all blank, or all null. Blanks mixed with nulls stay."""
    return _keep(_with_known(grid, _NOT_EMPTY), _is_chosen).drop("cols", "first_col")


def with_first_column(grid: DataFrame) -> DataFrame:
    """Adds `first_col`, the leftmost column of the filing, which holds the labels."""
    return _with_known(grid, "false").drop("cols")


def null_placeholders(grid: DataFrame) -> DataFrame:
    """Whole-cell `$`, `$—` and `—` become null, except in the first column. Needs `first_col`."""

    def clean(c: Column) -> Column:
        dash = c["text"].isin(V.DASH_PLACEHOLDERS) & (c["col"] != F.col("first_col"))
        return F.struct(c["col"].alias("col"), F.when(~dash, c["text"]).alias("text"))

    return grid.withColumn("cells", F.transform("cells", clean))


def numeric_columns(grid: DataFrame) -> DataFrame:
    """Keeps the first column and every column in which some cell is a plain number."""
    rows = _with_known(grid, "numbers")
    return _keep(rows, lambda c: (c["col"] == F.col("first_col")) | _is_chosen(c)).drop("first_col", "cols")


def drop_empty_rows(grid: DataFrame) -> DataFrame:
    """Drops rows that are null in every column."""
    return grid.where(F.exists("cells", lambda c: c["text"].isNotNull()))


def clean_grid(grid: DataFrame, remove_empty: bool = True) -> DataFrame:
    """Empty columns, placeholders, number-free columns and empty rows removed in one pass.

    Same result as `drop_empty_columns`, `with_first_column`, `null_placeholders`,
    `numeric_columns` and `drop_empty_rows` in turn: a placeholder is never a plain number, so
    what is known about the raw columns decides all of it. Adds `first_col`.
    """
    rows = _with_known(grid, "numbers", _NOT_EMPTY if remove_empty else "true")
    kept = _keep(rows, lambda c: (c["col"] == F.col("first_col")) | _is_chosen(c))
    return drop_empty_rows(null_placeholders(kept)).drop("cols")


def date_header_rows(grid: DataFrame) -> DataFrame:
    """Adds `is_header`: some cell of the row holds a date."""
    found = F.exists("cells", lambda c: has_header_date(c["text"]))
    return grid.withColumn("is_header", F.coalesce(found, F.lit(False)))


def header_dates(grid: DataFrame) -> DataFrame:
    """(filing, col, row_no, date_text, context): what each block of header rows says per column.

    Neighbouring header rows form a block. Per column its non-blank cells, blanks collapsed, are
    joined in row order; a column whose text holds no date gives no row. `row_no` is the block's
    last row with a cell for the column. Needs `is_header`.
    """
    rows = grid.withColumn("__data_row", F.when(~F.col("is_header"), F.col("row_no")))
    flags = rows.select("filing", "row_no", "__data_row")
    blocks = carry_forward(flags, ["filing"], "row_no", "__data_row", "__block", shifts=TABLE_SHIFTS)
    numbered = blocks.where("__data_row is null").select("filing", "row_no", F.coalesce("__block", F.lit(-1)).alias("__block"))
    headers = grid.where("is_header").join(by_sorted_shuffle(numbered), ["filing", "row_no"])
    cells = headers.select("filing", "__block", "row_no", F.inline("cells").alias("col", "text"))
    text = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    parts = with_once(cells.where("text is not null"), {"text": text}).where("text != ''")
    joined = parts.groupBy("filing", "__block", "col").agg(
        F.max("row_no").alias("row_no"),
        F.array_sort(F.collect_list(F.struct("row_no", "text"))).alias("parts"),
    )
    contexts = with_once(joined, {"context": F.array_join(F.transform("parts", lambda p: p["text"]), " ")})
    dated = with_once(contexts, {"date_text": extract_date_text(F.col("context"))})
    return dated.where("date_text is not null").select("filing", "col", "row_no", "date_text", "context")


def carry_header_dates(grid: DataFrame) -> DataFrame:
    """(filing, row_no, col, label, cell, date_text, context) for the cells of data rows.

    A column keeps its date until a later block gives it another, across the tables of a
    filing; a block at the end of a filing changes nothing. Needs `first_col` and `is_header`.

    Only dates move through a filing: the last date of every column is carried from run to run of rows, for the columns
    that the run has. Inside a run the cells of a column and its dates are read once, in order, after the date that the
    run begins with, so the work is linear whatever the share of header rows, and no task holds more than a run.
    """
    run, said = F.shiftright("row_no", RUN), F.struct("row_no", "date_text", "context")
    heads = stage(header_dates(grid), "header-dates").select("filing", run.alias("run"), "col", "row_no", said.alias("said"))
    data = grid.where("not is_header")
    columns = data.select("filing", run.alias("run"), F.explode(F.transform("cells", lambda c: c["col"])).alias("col")).distinct()
    lasts = heads.groupBy("filing", "col", "run").agg(F.max("said").alias("said"))
    marks = columns.select("filing", "col", (F.col("run") * 2).alias("at"), F.lit(None).cast(lasts.schema["said"].dataType).alias("said"))
    marks = stage(marks.unionByName(lasts.select("filing", "col", (F.col("run") * 2 + 1).alias("at"), "said")), "date-marks")
    carried = carry_forward(marks, ["filing", "col"], "at", "said", "before", shifts=_MARK_SHIFTS)
    before = carried.where("at % 2 = 0 and before is not null").select(
        "filing", F.shiftright("at", 1).alias("run"), "col", F.lit(-1).cast("long").alias("row_no"), F.col("before").alias("said")
    )
    labels = F.filter("cells", lambda c: c["col"] == F.col("first_col"))
    others = F.filter("cells", lambda c: (c["col"] != F.col("first_col")) & c["text"].isNotNull())
    cells = data.select(
        "filing", run.alias("run"), "row_no", F.coalesce(F.get(labels, F.lit(0))["text"], F.lit("")).alias("label"),
        F.inline(F.transform(others, lambda c: F.struct(c["col"].alias("col"), c["text"].alias("cell")))),
    )
    column_of_run = W.partitionBy("filing", "run", "col").orderBy("row_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    dates = stage(heads.unionByName(before), "dates-of-runs")  # written once: the cells are passed over once, and so are the dates
    rows = cells.unionByName(dates, allowMissingColumns=True)
    dated = rows.withColumn("said", F.last("said", ignorenulls=True).over(column_of_run)).where("cell is not null")
    return dated.select("filing", "row_no", "col", "label", "cell", "said.date_text", "said.context")


def emit_facts(dated: DataFrame) -> DataFrame:
    """(filing, label, date_text, context, value) for dated cells that hold an amount.

    A column read as numeric as a whole can hold no header text and so never has a date; the
    amounts of dated columns are therefore always read from text.
    """
    amounts = with_once(dated.where("date_text is not null"), {"value": parse_amount(F.col("cell"))})
    return amounts.where("value is not null").select("filing", "label", "date_text", "context", "value")


def locate_facts(grid: DataFrame) -> DataFrame:
    """Facts of cleaned grids: header rows, carried dates, amounts.

    The marked rows are read several times below, so they are written once.
    """
    return emit_facts(carry_header_dates(stage(date_header_rows(grid), "marked-grid")))
