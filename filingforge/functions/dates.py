"""Dates inside cells and headers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from filingforge import vocabulary as V

# Unicode classes: filings are full of no-break spaces, which plain \s misses.
_FLAGS = "(?iU)"
_HEADER = _FLAGS + "|".join(V.HEADER_DATE_PATTERNS)
_MAY_HOLD_DATE = r"[-/\p{L}]"  # every notation has a dash, a slash or a month's name; most amounts have none of them


def has_header_date(text: Column) -> Column:
    """True when the text holds a date in any of the header notations."""
    found = F.replace(text, F.lit("  "), F.lit(" ")).rlike(_HEADER)
    return F.when(text.rlike(_MAY_HOLD_DATE), found).when(text.isNotNull(), False)


def extract_date_text(text: Column) -> Column:
    """First month-day-year, else first day-month-year, written as `Month D, YYYY`."""
    month_first = F.regexp_extract(text, _FLAGS + V.MONTH_DAY_YEAR, 0)
    day_first = F.regexp_extract(text, _FLAGS + V.DAY_MONTH_YEAR, 0)
    return F.when(
        month_first != "",
        F.regexp_replace(month_first, _FLAGS + V.MONTH_DAY_YEAR, "$1 $2, $3"),
    ).when(
        day_first != "",
        F.regexp_replace(day_first, _FLAGS + V.DAY_MONTH_YEAR, "$2 $1, $3"),
    )


def parse_mixed_date(text: Column, this_year: int | None = None) -> Column:
    """`Month D, YYYY` or `Month D, YY` to a date, anything else to null.

    A two-digit year is placed in the century nearest to `this_year` (default: the current year).
    """
    now = F.year(F.current_date()) if this_year is None else F.lit(this_year)
    full = F.try_to_timestamp(text, F.lit("MMMM d, yyyy")).cast("date")
    short = F.try_to_timestamp(text, F.lit("MMMM d, yy")).cast("date")
    near = F.when(F.year(short) >= now + 50, F.add_months(short, -1200)).otherwise(short)
    return F.coalesce(full, near)


def document_dates(text: Column) -> Column:
    """All dates in the text, by four notations, without repeats, sorted."""
    found = [F.regexp_extract_all(text, F.lit(_FLAGS + p), F.lit(0)) for p in V.DOCUMENT_DATE_PATTERNS]
    return F.array_sort(F.array_distinct(F.concat(*found)))
