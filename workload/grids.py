"""Date-header algorithm and facts over the grids built from orders."""

from pyspark.sql import functions as F

from filingforge import vocabulary as V
from filingforge.operators import facts as facts_ops
from filingforge.operators import grid as grid_ops
from filingforge.operators.staging import stage
from workload.inputs import GRID, grid, with_sql

_M, _S = V.MONTHS, V.SHORT_MONTHS
_THIS_YEAR = 2024

# ---------------------------------------------------------------- SQL, step by step
_COLUMNS = """
first_cols AS (SELECT filing, min(col) AS first_col FROM grid GROUP BY filing),
placed AS (
  SELECT filing, row_no, col, first_col,
    CASE WHEN col > first_col AND cell IN ('$', '$—', '—') THEN NULL ELSE cell END AS cell
  FROM grid JOIN first_cols USING (filing)),
number_cols AS (
  SELECT filing, col FROM placed GROUP BY ALL
  HAVING bool_or(coalesce(regexp_matches(cell, '^\\s*[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?\\s*$'), false))
    OR any_value(first_col) = col),
kept AS (SELECT placed.* FROM placed JOIN number_cols USING (filing, col)),
full_rows AS (SELECT filing, row_no FROM kept GROUP BY ALL HAVING count(cell) > 0),
clean AS (SELECT kept.* FROM kept JOIN full_rows USING (filing, row_no))
"""
_DATE_IN_CELL = f"""(
    regexp_matches(x, '\\b\\d{{1,2}}[-/]\\d{{1,2}}[-/]\\d{{2,4}}\\b')
    OR regexp_matches(x, '\\b\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}\\b')
    OR regexp_matches(x, '(?i)\\b({_M})\\s*\\d{{1,2}},?\\s*\\d{{4}}\\b')
    OR regexp_matches(x, '(?i)\\b\\d{{1,2}}\\s+({_M})\\s+\\d{{2,4}}\\b')
    OR regexp_matches(x, '(?i)For\\s+the\\s+.*?ended\\s+({_M})\\s*\\d{{1,2}},?\\s*\\d{{4}}')
    OR regexp_matches(x, '(?i)\\b\\d{{1,2}}\\s+({_S})\\.?\\s+\\d{{2,4}}\\b')
    OR regexp_matches(x, '(?i)\\b({_S})\\.?\\s+\\d{{1,2}},?\\s+\\d{{2,4}}\\b'))"""
_HEADERS = f"""
header_rows AS (
  SELECT filing, row_no, bool_or(coalesce({_DATE_IN_CELL}, false)) AS is_header
  FROM (SELECT *, replace(cell, '  ', ' ') AS x FROM clean) GROUP BY ALL)
"""
_DATED = f"""
blocks AS (
  SELECT filing, row_no, is_header, sum(CASE WHEN is_header THEN 0 ELSE 1 END)
    OVER (PARTITION BY filing ORDER BY row_no) AS block
  FROM header_rows),
parts AS (
  SELECT filing, block, col, row_no, regexp_replace(trim(cell), '\\s+', ' ', 'g') AS part
  FROM clean JOIN blocks USING (filing, row_no) WHERE is_header AND cell IS NOT NULL AND trim(cell) <> ''),
contexts AS (
  SELECT filing, block, col, max(row_no) AS row_no, string_agg(part, ' ' ORDER BY row_no) AS context FROM parts GROUP BY ALL),
spoken AS (
  SELECT *, regexp_replace(regexp_extract(context, '(?i)({_M})\\s*(\\d{{1,2}}),?\\s*(\\d{{4}})'),
    '(?i)({_M})\\s*(\\d{{1,2}}),?\\s*(\\d{{4}})', '\\1 \\2, \\3') AS date_text
  FROM contexts WHERE regexp_matches(context, '(?i)({_M})\\s*(\\d{{1,2}}),?\\s*(\\d{{4}})')),
data_cells AS (
  SELECT c.filing, c.row_no, c.col, coalesce(l.cell, '') AS label, c.cell
  FROM clean c JOIN header_rows h USING (filing, row_no)
  LEFT JOIN clean l ON l.filing = c.filing AND l.row_no = c.row_no AND l.col = c.first_col
  WHERE NOT is_header AND c.col <> c.first_col AND c.cell IS NOT NULL),
dated AS (
  SELECT d.filing, d.row_no, d.col, d.label, d.cell,
    max_by(s.date_text, s.row_no) AS date_text, max_by(s.context, s.row_no) AS context
  FROM data_cells d LEFT JOIN spoken s ON s.filing = d.filing AND s.col = d.col AND s.row_no < d.row_no
  GROUP BY ALL)
"""
_FACTS = """
amounts AS (
  SELECT *, TRY_CAST(nullif(translate(regexp_extract(cell, '\\$\\([0-9,]+(?:\\.[0-9]+)?\\)|\\$[0-9,]+(?:\\.[0-9]+)?|^\\([0-9,]+(?:\\.[0-9]+)?\\)$|^[0-9,]+(?:\\.[0-9]+)?$'), '$(),', ''), '') AS DOUBLE)
    * CASE WHEN contains(cell, '(') AND contains(cell, ')') THEN -1 ELSE 1 END AS value
  FROM dated WHERE date_text IS NOT NULL),
facts AS (SELECT filing, label, date_text, context, value FROM amounts WHERE value IS NOT NULL)
"""
_NAMED = """
named AS (
  SELECT filing, trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(label), '[",''’:;().·]', '', 'g'), '\\s+', ' ', 'g')),
      '[-\\s]+', '_', 'g'), '_+', '_', 'g'), '_') AS label,
    CAST(try_strptime(date_text, '%B %d, %Y') AS DATE) AS date, context, value
  FROM facts)
"""
_TERMS_SQL = "|".join(V.LINE_ITEM_TERMS)
_ITEMS = f"""
items AS (SELECT * FROM named WHERE regexp_matches(label, '{_TERMS_SQL}') AND length(label) < 30)
"""
_LARGEST = """
largest AS (
  SELECT filing, label, date, best.value AS value, best.context AS context FROM (
    SELECT filing, label, date, max({'value': value, 'context': context}) AS best FROM items GROUP BY ALL))
"""
_PERIODS = """
periods AS (
  SELECT filing, label, date, context, value FROM largest
  WHERE regexp_matches(context, '(?i)^[A-Za-z]+\\s+\\d{1,2},\\s+\\d{4}$|Years?\\s+Ended?|Year?\\s+Ended?|As\\s+of'))
"""
_TREND = """
ends_ AS (
  SELECT filing, label, arg_min(value, coalesce(date, DATE '9999-12-31')) AS a, arg_max(value, coalesce(date, DATE '9999-12-31')) AS b
  FROM periods GROUP BY ALL),
trends AS (
  SELECT filing, label || '_trend' AS metric, b - a AS value FROM ends_
  UNION ALL SELECT filing, label || '_recent', b FROM ends_)
"""
STEPS = [GRID, _COLUMNS, _HEADERS, _DATED, _FACTS, _NAMED, _ITEMS, _LARGEST, _PERIODS, _TREND]


def _upto(n: int, select: str) -> str:
    return with_sql(",\n".join(s.strip() for s in STEPS[: n + 1]), select=select)


# ---------------------------------------------------------------- Spark


def _clean(spark, sf_dir):
    return grid_ops.clean_grid(grid(spark, sf_dir), remove_empty=False)


def _facts(spark, sf_dir):
    return grid_ops.locate_facts(_clean(spark, sf_dir))


def _named_facts(spark, sf_dir):
    return facts_ops.name_facts(_facts(spark, sf_dir), this_year=_THIS_YEAR)


def null_placeholders(spark, sf_dir):
    rows = grid_ops.with_first_column(grid(spark, sf_dir))
    return grid_ops.explode_cells(grid_ops.null_placeholders(rows))


def numeric_columns(spark, sf_dir):
    return grid_ops.explode_cells(grid_ops.numeric_columns(grid(spark, sf_dir)))


def drop_empty_rows(spark, sf_dir):
    return grid_ops.explode_cells(_clean(spark, sf_dir))


def date_header_rows(spark, sf_dir):
    return grid_ops.date_header_rows(_clean(spark, sf_dir)).select("filing", "row_no", "is_header")


def carry_header_dates(spark, sf_dir):
    return grid_ops.carry_header_dates(stage(grid_ops.date_header_rows(_clean(spark, sf_dir)), "marked-grid"))


def emit_facts(spark, sf_dir):
    return _facts(spark, sf_dir)


def dedupe_facts(spark, sf_dir):
    return facts_ops.dedupe_facts(_facts(spark, sf_dir))


def keyword_label_filter(spark, sf_dir):
    return facts_ops.keyword_label_filter(_named_facts(spark, sf_dir))


def max_per_label_date(spark, sf_dir):
    return facts_ops.max_per_label_date(facts_ops.keyword_label_filter(_named_facts(spark, sf_dir)))


def period_context_filter(spark, sf_dir):
    return facts_ops.format_and_filter(_facts(spark, sf_dir), this_year=_THIS_YEAR)


def sort_multi(spark, sf_dir):
    return facts_ops.sort_facts(period_context_filter(spark, sf_dir))


def trend_and_recent(spark, sf_dir):
    return facts_ops.trend_and_recent(period_context_filter(spark, sf_dir)).select(
        "filing", "metric", F.round("value", 4).alias("value")
    )


QUERIES = {
    "null_placeholders": null_placeholders,
    "numeric_columns": numeric_columns,
    "drop_empty_rows": drop_empty_rows,
    "date_header_rows": date_header_rows,
    "carry_header_dates": carry_header_dates,
    "emit_facts": emit_facts,
    "dedupe_facts": dedupe_facts,
    "keyword_label_filter": keyword_label_filter,
    "max_per_label_date": max_per_label_date,
    "period_context_filter": period_context_filter,
    "sort_multi": sort_multi,
    "trend_and_recent": trend_and_recent,
}

ORACLE = {
    "null_placeholders": _upto(1, "SELECT filing, row_no, col, cell FROM placed"),
    "numeric_columns": _upto(1, "SELECT filing, row_no, col, grid.cell FROM grid JOIN number_cols USING (filing, col)"),
    "drop_empty_rows": _upto(1, "SELECT filing, row_no, col, cell FROM clean"),
    "date_header_rows": _upto(2, "SELECT filing, row_no, is_header FROM header_rows"),
    "carry_header_dates": _upto(3, "SELECT * FROM dated"),
    "emit_facts": _upto(4, "SELECT * FROM facts"),
    "dedupe_facts": _upto(4, "SELECT DISTINCT * FROM facts"),
    "keyword_label_filter": _upto(6, "SELECT * FROM items"),
    "max_per_label_date": _upto(7, "SELECT filing, label, date, context, value FROM largest"),
    "period_context_filter": _upto(8, "SELECT * FROM periods"),
    "sort_multi": _upto(8, "SELECT * FROM periods ORDER BY label, date NULLS LAST"),
    "trend_and_recent": _upto(9, "SELECT filing, metric, round(value, 4) AS value FROM trends"),
}
