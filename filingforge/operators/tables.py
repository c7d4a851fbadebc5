"""Choosing the finance tables of a filing and stacking them into one grid.

Table rows are (filing, table_id, row_idx, labels, cells) as `html_table_rows` gives them.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingforge import vocabulary as V
from filingforge.operators.staging import by_sorted_shuffle, stage

_BITS = 62  # terms of one mask


def _mask(text: Column, terms: list[str]) -> Column:
    """Which terms occur, one bit each."""
    bits = [F.when(text.contains(t.lower()), F.lit(1 << i).cast("long")).otherwise(0) for i, t in enumerate(terms)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def _packed(*parts: tuple[Column, int]) -> Column:
    """Non-negative numbers side by side in one BIGINT, from the highest; one that needs more bits is an error."""
    fits = reduce(lambda a, b: a & b, [F.shiftright(value.cast("long"), bits) == 0 for value, bits in parts])
    out = F.lit(0).cast("long")
    for value, bits in parts:
        out = F.shiftleft(out, bits) + value.cast("long")
    return F.when(fits, out).otherwise(F.raise_error(F.lit("a table has too many columns, copies or rows")).cast("long"))


def find_finance_tables(
    rows: DataFrame, terms=V.FINANCE_TABLE_TERMS, min_rows: int = 4, multiplicity: str = "once"
) -> DataFrame:
    """Rows of tables with at least `min_rows` rows of which some cell names a term.

    Header labels are not searched. With multiplicity `per_keyword` a table comes once per term
    it names (`copy` 0, 1, …), with `once` only as copy 0. Which terms a table names is one bit
    mask per row, or-ed per table with map-side combining.
    """
    if not terms:
        raise ValueError("no terms")
    text = F.lower(F.array_join("cells", "\x01"))
    masks = {f"__named{n}": _mask(text, terms[n : n + _BITS]) for n in range(0, len(terms), _BITS)}
    tables = (
        rows.select("filing", "table_id", *[m.alias(name) for name, m in masks.items()])
        .groupBy("filing", "table_id")
        .agg(F.count(F.lit(1)).alias("n_rows"), *[F.bit_or(name).alias(name) for name in masks])
        .withColumn("named", reduce(lambda a, b: a + b, [F.bit_count(name) for name in masks]))
        .where((F.col("n_rows") >= min_rows) & (F.col("named") != 0))
    )
    copies = F.col("named") if multiplicity == "per_keyword" else F.lit(1)
    # One small row per table, written once: below it meets the rows in one join, which splits hot tables.
    chosen = stage(tables.select("filing", "table_id", copies.alias("copies")), "finance-tables")
    found = rows.join(by_sorted_shuffle(chosen), ["filing", "table_id"])
    return found.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")


def stack_tables(rows: DataFrame) -> DataFrame:
    """One grid per filing: (filing, row_no, cells), columns with the same label aligned.

    `row_no` orders by table, copy and row. `col` is the place (table, position) where the label
    first occurs, so columns keep their order of appearance without numbering a whole filing.
    """
    if "copy" not in rows.columns:
        rows = rows.withColumn("copy", F.lit(0))
    labels = (
        rows.where("row_idx = 0 and copy = 0")
        .select("filing", "table_id", F.posexplode("labels").alias("pos", "label"))
        .withColumn("place", _packed((F.col("table_id"), 42), (F.col("pos"), 20)))
    )
    # The labels are few, one list per table; what they come to is written once and meets the rows in one join.
    labels = stage(labels, "labels")
    first = stage(labels.groupBy("filing", "label").agg(F.min("place").alias("col")), "first-labels")
    tables = labels.join(by_sorted_shuffle(first), ["filing", "label"]).groupBy("filing", "table_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "col"))).alias("places")
    )
    placed = rows.join(by_sorted_shuffle(stage(tables, "places")), ["filing", "table_id"])
    row_no = _packed((F.col("table_id"), 23), (F.col("copy"), 6), (F.col("row_idx"), 34))
    cells = F.zip_with("places", "cells", lambda p, text: F.struct(p["col"].alias("col"), text.alias("text")))
    return placed.select("filing", row_no.alias("row_no"), cells.alias("cells"))


def single_grid(rows: DataFrame) -> DataFrame:
    """The grid of frames that hold one table per filing: columns by position."""
    cells = F.transform("cells", lambda text, i: F.struct(i.cast("long").alias("col"), text.alias("text")))
    return rows.select("filing", F.col("row_idx").cast("long").alias("row_no"), cells.alias("cells"))
