"""What went wrong with which filing: stages give rows and errors in one pass, and nothing stops the others."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingforge.operators.facts import format_and_filter, trend_and_recent
from filingforge.operators.grid import clean_grid, locate_facts
from filingforge.operators.html import html_table_results
from filingforge.operators.staging import stage
from filingforge.operators.tables import find_finance_tables, stack_tables
from filingforge.plans.financials import skip_report

NOTHING = "nothing found"


def split_errors(results: DataFrame, name: str, key: str = "filing") -> tuple[DataFrame, DataFrame]:
    """The rows of `results` (key, …, error) without an error, and (key, stage, message) of the others.

    `results` is read twice: stage it if it is costly. A key may have rows and errors.
    """
    errors = results.where("error is not null").select(key, F.lit(name).alias("stage"), F.col("error").alias("message"))
    return results.where("error is null").drop("error"), errors


def failures(catalog: DataFrame, stages: dict[str, DataFrame], errors: DataFrame) -> DataFrame:
    """(filing, stage, message): every error, and the stage that gave nothing for filings that reach no end without one.

    `stages` maps names, in order, to frames with a `filing` column; `errors` is (filing, stage, message). Filings that
    are not in the catalogue are reported if they have errors. Repeated errors of a filing are one row.
    """
    errors = errors.distinct()
    silent = skip_report(catalog, stages).join(errors.select("filing").distinct(), "filing", "left_anti")
    return errors.unionByName(silent.select("filing", F.col("stopped_before").alias("stage"), F.lit(NOTHING).alias("message")))


def filing_failures(pages: DataFrame) -> DataFrame:
    """`failures` of (filing, html) pages through the financial chain; the pages are parsed once."""
    rows, errors = split_errors(stage(html_table_results(pages), "table-results"), "tables")
    chosen = stage(find_finance_tables(rows), "finance-rows")
    facts = stage(locate_facts(clean_grid(stage(stack_tables(chosen), "grid"))), "facts")
    found = {"tables": rows, "finance tables": chosen, "facts": facts, "metrics": trend_and_recent(format_and_filter(facts))}
    return failures(pages.select("filing"), {name: df.select("filing").distinct() for name, df in found.items()}, errors)


def failure_summary(failed: DataFrame) -> DataFrame:
    """(stage, message, n_filings, first_filing) of `failures`, counted map-side."""
    one = failed.select("filing", "stage", "message").distinct()
    return one.groupBy("stage", "message").agg(F.count(F.lit(1)).alias("n_filings"), F.min("filing").alias("first_filing"))


def first_failures(failed: DataFrame, n: int = 10, key: str = "filing", order: list[str] = ()) -> DataFrame:
    """The first `n` rows by key, then `order`, with `rank` from 1 and `n_more`, the number of rows that are not shown.
    Each task keeps `n` rows; only they meet in one."""
    rest = [c for c in failed.columns if c not in (key, *order)]
    rows = F.array_sort(F.collect_list(F.struct(key, *order, *rest))).alias("rows")
    shown = failed.orderBy(key, *order).limit(n).agg(rows).select(F.posexplode("rows").alias("rank", "row"))
    total = failed.agg(F.count(F.lit(1))).scalar()
    return shown.select((F.col("rank") + 1).alias("rank"), "row.*", F.greatest(total - n, F.lit(0)).alias("n_more"))
