"""HTML of pages, and tables of pages built from orders."""

from pyspark.sql import functions as F

from filingforge.functions.labels import url_basename
from filingforge.operators import grid as grid_ops
from filingforge.operators import html as html_ops
from filingforge.operators import tables as table_ops
from filingforge.operators.staging import new_folder, stage
from filingforge.operators.wide import pivot_metrics
from filingforge.plans import failures as failure_plans
from filingforge.plans import financials as plans
from filingforge.sources import files
from workload.grids import STEPS
from workload.inputs import ELEMENT_LIST, ELEMENTS, FEATURES, TABLE_CELLS, features, markup, table, table_rows, with_sql


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def html_normalize(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.md5(html_ops.html_normalize(F.col("html"))).alias("normalized"))


def document_length(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", html_ops.document_length(F.col("html")).alias("document_length"))


def html_text(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.md5(html_ops.html_text(F.col("html"))).alias("text"))


def word_count(spark, sf_dir):
    text = html_ops.html_text(F.col("html"))
    return _pages(spark, sf_dir).select("page_id", html_ops.word_count(text).alias("word_count"))


def scan_html_files(spark, sf_dir):
    """Pages written as one file each, then read as whole files."""
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("S"), (F.col("page_id") % 50).cast("string")).alias("symbol"),
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("name"), "html",
    )
    found = files.read_filings(spark, files.write_filings(pages, new_folder(spark, "html-files")))
    return found.select(
        F.regexp_extract(F.concat_ws("/", "symbol", "file_name"), "page-[^/]*", 0).alias("name"), F.length(F.regexp_replace("html", "\n$", "")).alias("length"),
        F.md5(F.regexp_replace("html", "\n$", "")).alias("content"),
    )


def table_elements(spark, sf_dir):
    found = html_ops.table_elements(markup(spark, sf_dir))
    return found.select("filing", "table_id", F.md5("table_html").alias("content"))


def html_table_cells(spark, sf_dir):
    return html_ops.html_table_cells(html_ops.html_table_rows(markup(spark, sf_dir))).select(
        "filing", "table_id", "row_idx", "col_idx", "col_name", "cell"
    )


def flatten_headers(spark, sf_dir):
    """Labels of tables under two header rows, one of them spanning columns."""
    page = F.concat(
        F.lit("<table><thead><tr><th></th><th colspan=2>"), F.col("c_mktsegment"),
        F.lit("</th></tr><tr><th>Item</th><th>"), F.col("c_name"), F.lit("</th><th></th></tr></thead><tr><td>a</td><td>"),
        F.col("c_acctbal").cast("string"), F.lit("</td><td>x</td></tr></table>"),
    )
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("filing"), page.alias("html"))
    rows = html_ops.html_table_rows(pages)
    return rows.select("filing", F.posexplode("labels").alias("col_idx", "label"))


def _rows(spark, sf_dir):
    return stage(table_rows(spark, sf_dir), "table-rows")


def find_finance_tables(spark, sf_dir):
    found = table_ops.find_finance_tables(_rows(spark, sf_dir), multiplicity="per_keyword")
    return found.select("filing", "table_id", "copy", "row_idx", F.array_join("cells", "|", "<null>").alias("cells"))


def stack_tables(spark, sf_dir):
    chosen = table_ops.find_finance_tables(_rows(spark, sf_dir))
    return grid_ops.explode_cells(table_ops.stack_tables(chosen))


def drop_empty_columns(spark, sf_dir):
    chosen = table_ops.find_finance_tables(_rows(spark, sf_dir))
    return grid_ops.explode_cells(grid_ops.drop_empty_columns(stage(table_ops.stack_tables(chosen), "grid")))


def _training(multiplicity):
    def query(spark, sf_dir):
        """Pages to facts, metrics, sizes and all keyword features, one row per filing."""
        keywords = pivot_metrics(features(spark, sf_dir).where("kind = 'keyword'"), ELEMENTS, key="symbol", name="element")
        found = plans.training_table(stage(markup(spark, sf_dir), "pages"), keywords, share=0.30, multiplicity=multiplicity)
        return found.select(*[F.round(c, 4).alias(c) if c.endswith(("_recent", "_trend")) else F.col(f"`{c}`") for c in found.columns])

    return query


def _supplier_rows(spark, sf_dir):
    """Tables of suppliers, which stop at every stage: of four suppliers one has none, one a table that names no finance
    term, one a finance table without dates, one dated amounts that are no line items."""
    balance = F.col("s_acctbal").cast("decimal(15,2)").cast("string")

    def lines(*pairs):
        return F.array(*[F.array(F.lit(a), b) for a, b in pairs])

    number = F.col("s_suppkey") % 4
    body = (
        F.when(number == 1, lines(("Orders", balance), ("Smallest", F.lit("1")), ("Largest", F.lit("2")), ("Note", F.lit(""))))
        .when(number == 2, lines(("Cash", balance), ("Inventory", F.lit("1")), ("Earnings", F.lit("2")), ("Note", F.lit("x"))))
        .when(number == 3, lines(("As of", F.lit("December 31, 1995")), ("Plants", F.lit("12")), ("Trucks", balance), ("Cash", F.lit(None).cast("string"))))
    )
    rows = table(spark, sf_dir, "supplier").where(number != 0)
    return rows.select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("filing"), F.lit(0).alias("table_id"),
        F.array(F.lit("0"), F.lit("1")).alias("labels"), F.posexplode(body).alias("row_idx", "cells"),
    ).select("filing", "table_id", "row_idx", "labels", "cells")


def skip_report(spark, sf_dir):
    """Customers and suppliers by the first stage they are missing from: no tables, no finance table, no facts, no metrics."""
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("filing"))
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("filing"))
    rows = stage(table_rows(spark, sf_dir).unionByName(_supplier_rows(spark, sf_dir)), "table-rows")
    return plans.skip_report(customers.union(suppliers), plans.chain_stages(rows))


def _pages_of_all(spark, sf_dir):
    """Pages of customers and suppliers; those of suppliers stop at every stage, and of four one has a span that no
    table can hold."""
    rows = _supplier_rows(spark, sf_dir)
    cell = lambda text: F.concat(F.lit("<td>"), F.coalesce(text, F.lit("")), F.lit("</td>"))
    line = F.concat(F.lit("<tr>"), F.array_join(F.transform("cells", cell), ""), F.lit("</tr>"))
    lines = F.array_sort(F.collect_list(F.struct("row_idx", line.alias("line"))))  # four a page
    good = rows.groupBy("filing").agg(
        F.concat(F.lit("<table>"), F.array_join(F.transform(lines, lambda x: x["line"]), ""), F.lit("</table>")).alias("html")
    )
    broken = table(spark, sf_dir, "supplier").where("s_suppkey % 4 = 0").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("filing"),
        F.concat(F.lit("<table><tr><td>Cash</td><td>1</td></tr><tr><td colspan=300000000>"), F.col("s_name"), F.lit("</td></tr></table>")).alias("html"),
    )
    return stage(markup(spark, sf_dir).unionByName(good).unionByName(broken), "pages")


def filing_failures(spark, sf_dir):
    """Customers and suppliers whose pages cannot be read or give nothing at some stage, with the reason."""
    return failure_plans.filing_failures(_pages_of_all(spark, sf_dir))


def failure_summary(spark, sf_dir):
    return failure_plans.failure_summary(failure_plans.filing_failures(_pages_of_all(spark, sf_dir)))


QUERIES = {
    "filing_failures": filing_failures,
    "failure_summary": failure_summary,
    "training_table": _training("once"),
    "training_table_per_keyword": _training("per_keyword"),
    "skip_report": skip_report,
        "scan_html_files": scan_html_files,
    "html_normalize": html_normalize,
    "document_length": document_length,
    "html_text": html_text,
    "word_count": word_count,
    "table_elements": table_elements,
    "html_table_cells": html_table_cells,
    "find_finance_tables": find_finance_tables,
    "stack_tables": stack_tables,
    "flatten_headers": flatten_headers,
    "drop_empty_columns": drop_empty_columns,
}

_NO_COMMENTS = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
_LOWERED = (
    f"array_to_string(list_transform(regexp_extract_all({_NO_COMMENTS}, '<[^>]+>|[^<]+|<'), "
    "lambda p: CASE WHEN regexp_matches(p, '^<[^>]+>$') THEN lower(p) ELSE p END), '')"
)
_BARE = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', '', 'g'), "
    "'(?is)<style\\b.*?</style\\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '<[A-Za-z/!?][^>]*>', '', 'g')"
)
_BLANK = "[\\s\\x{00A0}\\x{0B}]"
PAGE_TEXT = _BARE
for _name, _char in (
    ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
    ("&nbsp;", "\u00a0"),
):
    PAGE_TEXT = f"replace({PAGE_TEXT}, '{_name}', '{_char}')"
PAGE_TEXT = f"regexp_replace({PAGE_TEXT}, '&amp;?', '&', 'g')"  # a reference may be cut off
_TEXT = (
    f"regexp_replace(regexp_replace(regexp_replace({PAGE_TEXT}, '{_BLANK}*[\\n\\r]{_BLANK}*', ' ', 'g'), "
    f"'{_BLANK}*  {_BLANK}*', ' ', 'g'), '^{_BLANK}+|{_BLANK}+$', '', 'g')"
)
_FINANCE = """
hits AS (
  SELECT filing, table_id, count(DISTINCT term) AS terms FROM table_cells,
    (VALUES ('revenue'), ('accounts receivable'), ('liabilities'), ('assets'), ('cash'), ('common stock'),
      ('differed tax'), ('inventory'), ('earnings'), ('operating loss'), ('months ended'), ('year ended'),
      ('depreciation')) t(term)
  WHERE contains(lower(cell), term) GROUP BY ALL),
chosen AS (
  SELECT filing, table_id, count(DISTINCT row_idx) AS n_rows, any_value(terms) AS terms
  FROM table_cells JOIN hits USING (filing, table_id) GROUP BY ALL HAVING count(DISTINCT row_idx) >= 4),
places AS (
  SELECT filing, col_name, min(table_id * 1048576 + col_idx) AS col
  FROM table_cells JOIN chosen USING (filing, table_id) GROUP BY ALL),
stacked AS (
  SELECT filing, CAST(table_id AS BIGINT) * 1099511627776 + row_idx AS row_no, CAST(col AS BIGINT) AS col, cell
  FROM table_cells JOIN chosen USING (filing, table_id) JOIN places USING (filing, col_name))
"""
_TABLES = TABLE_CELLS.replace("places AS (", "slots AS (").replace("FROM places LEFT JOIN", "FROM slots LEFT JOIN")

_LINES = """
lines AS (
  SELECT filing, table_id, row_idx, any_value(col_name) FILTER (col_idx = 0) AS name,
    '<tr>' || string_agg('<td>' || coalesce(cell, '') || '</td>', '' ORDER BY col_idx) || '</tr>' AS line
  FROM table_cells GROUP BY ALL),
elements AS (
  SELECT filing, table_id, '<Table border=0>'
    || CASE WHEN any_value(name) = 'Item' THEN '<thead><tr><th>Item</th><th>1</th></tr></thead>' ELSE '' END
    || string_agg(line, chr(10) ORDER BY row_idx) || '</table>' AS element
  FROM lines GROUP BY ALL)
"""
_NOT_EMPTY = """
sizes AS (SELECT filing, count(DISTINCT row_no) AS n FROM stacked GROUP BY ALL),
good AS (
  SELECT filing, col FROM stacked JOIN sizes USING (filing) GROUP BY ALL
  HAVING count(cell) > 0 AND NOT (bool_and(coalesce(trim(cell) = '', false)) AND count(*) = any_value(n)))
"""
_PARSED = """
parsed AS (
  SELECT filing, table_id, row_idx, col_idx, col_name,
    CASE WHEN regexp_matches(cell, '^[0-9,]+\\.[0-9]+$') THEN replace(cell, ',', '') ELSE nullif(cell, '') END AS cell
  FROM table_cells)
"""
_METRICS = [f"{name}_{end}" for name in ("cash", "net_loss", "shareholders_equity", "total_revenue_net") for end in ("recent", "trend")]

_COPIES = _FINANCE.replace(
    "FROM table_cells JOIN chosen USING (filing, table_id) JOIN places", "FROM table_cells JOIN copied USING (filing, table_id) JOIN places"
).replace("+ row_idx AS row_no", "+ copy * 17179869184 + row_idx AS row_no").replace(
    "stacked AS (", "copied AS (SELECT filing, table_id, unnest(range(terms)) AS copy FROM chosen),\nstacked AS ("
)


def _training_sql(finance):
    return with_sql(
        _TABLES, _LINES, _PARSED, finance.replace("FROM table_cells", "FROM parsed"), _NOT_EMPTY,
        "grid AS (SELECT stacked.* FROM stacked JOIN good USING (filing, col))", *[s.strip() for s in STEPS[1:]],
        """pages_ AS (
          SELECT filing, '<!DOCTYPE html><html><body>' || string_agg(element, '<p>text</p>' ORDER BY table_id) || '</body></html>' AS html
          FROM elements GROUP BY ALL)""",
        f"document_sizes AS (SELECT filing, length(html) AS document_length, len(regexp_extract_all({_TEXT}, '[^\\s\\x{{00A0}}]+')) AS word_count FROM pages_)",
        FEATURES,
        "wide AS (SELECT filing, " + ", ".join(f"max(value) FILTER (metric = '{m}') AS {m}" for m in _METRICS) + " FROM trends GROUP BY filing)",
        select="SELECT k.*, " + ", ".join(f"round({m}, 4) AS {m}" for m in _METRICS)
        + f""", document_length, word_count
          FROM wide JOIN document_sizes USING (filing) JOIN (
            PIVOT (SELECT symbol, element, value FROM features WHERE kind = 'keyword') ON {ELEMENT_LIST} USING max(value) GROUP BY symbol) k
          ON k.symbol = filing""",
    )


_CHAIN = (
    _TABLES,
    """supplier_lines AS (
      SELECT 'S' || s_suppkey AS filing, 0 AS table_id, row_idx, label, value
      FROM (SELECT *, CAST(CAST(s_acctbal AS DECIMAL(15,2)) AS VARCHAR) AS balance FROM supplier), LATERAL (VALUES
        (1, 0, 'Orders', balance), (1, 1, 'Smallest', '1'), (1, 2, 'Largest', '2'), (1, 3, 'Note', ''),
        (2, 0, 'Cash', balance), (2, 1, 'Inventory', '1'), (2, 2, 'Earnings', '2'), (2, 3, 'Note', 'x'),
        (3, 0, 'As of', 'December 31, 1995'), (3, 1, 'Plants', '12'), (3, 2, 'Trucks', balance), (3, 3, 'Cash', NULL)
      ) t(kind, row_idx, label, value) WHERE s_suppkey % 4 = kind)""",
    """all_cells AS (
      SELECT filing, table_id, row_idx, col_idx, col_name, cell FROM table_cells
      UNION ALL SELECT filing, table_id, row_idx, 0, '0', label FROM supplier_lines
      UNION ALL SELECT filing, table_id, row_idx, 1, '1', value FROM supplier_lines)""",
    _FINANCE.replace("FROM table_cells", "FROM all_cells"), _NOT_EMPTY,
    "grid AS (SELECT stacked.* FROM stacked JOIN good USING (filing, col))", *[s.strip() for s in STEPS[1:]],
)
_STOPPED = """SELECT f.filing, CASE
            WHEN f.filing NOT IN (SELECT filing FROM all_cells) THEN 'tables'
            WHEN f.filing NOT IN (SELECT filing FROM chosen) THEN 'finance tables'
            WHEN f.filing NOT IN (SELECT filing FROM facts) THEN 'facts' ELSE 'metrics' END AS stopped_before
          FROM (SELECT 'C' || c_custkey AS filing FROM customer UNION ALL SELECT 'S' || s_suppkey FROM supplier) f
          WHERE f.filing NOT IN (SELECT filing FROM trends)"""
_FAILED = f"""SELECT filing, stopped_before AS stage, CASE
    WHEN filing LIKE 'S%' AND CAST(substr(filing, 2) AS BIGINT) % 4 = 0 THEN 'ValueError: spans add more than 10000000 cells'
    ELSE 'nothing found' END AS message
  FROM ({_STOPPED})"""

ORACLE = {
    "training_table": _training_sql(_FINANCE),
    "training_table_per_keyword": _training_sql(_COPIES),
    "skip_report": with_sql(
        *_CHAIN,
        select=f"SELECT filing, stopped_before FROM ({_STOPPED})",
    ),
    "filing_failures": with_sql(*_CHAIN, select=_FAILED),
    "failure_summary": with_sql(
        *_CHAIN,
        select=f"""SELECT stage, message, count(*) AS n_filings, min(filing) AS first_filing
          FROM ({_FAILED}) GROUP BY stage, message""",
    ),
    "scan_html_files": "SELECT 'page-' || page_id AS name, length(html) AS length, md5(html) AS content FROM pages",
    "html_normalize": f"""SELECT page_id, md5(array_to_string(list_transform(
        regexp_extract_all({_LOWERED}, '<!doctype[^>]*>|[^<]+|<'),
        lambda p: CASE WHEN regexp_matches(p, '^<!doctype[^>]*>$') THEN upper(p) ELSE p END), '')) AS normalized FROM pages""",
    "document_length": f"SELECT page_id, length({_NO_COMMENTS}) AS document_length FROM pages",
    "html_text": f"SELECT page_id, md5({_TEXT}) AS text FROM pages",
    "word_count": f"SELECT page_id, len(regexp_extract_all({_TEXT}, '[^\\s\\x{{00A0}}]+')) AS word_count FROM pages",
    "table_elements": with_sql(
        _TABLES,
        _LINES,
        select="SELECT filing, table_id, md5(element) AS content FROM elements",
    ),
    "html_table_cells": with_sql(
        _TABLES,
        select="""SELECT filing, table_id, row_idx, col_idx, col_name,
            CASE WHEN regexp_matches(cell, '^[0-9,]+\\.[0-9]+$') THEN replace(cell, ',', '') ELSE nullif(cell, '') END AS cell
          FROM table_cells""",
    ),
    "find_finance_tables": with_sql(
        _TABLES, _FINANCE,
        """found AS (
          SELECT filing, table_id, row_idx, any_value(terms) AS terms, string_agg(coalesce(cell, '<null>'), '|' ORDER BY col_idx) AS cells
          FROM table_cells JOIN chosen USING (filing, table_id) GROUP BY ALL)""",
        select="SELECT filing, table_id, CAST(unnest(range(terms)) AS INTEGER) AS copy, row_idx, cells FROM found",
    ),
    "stack_tables": with_sql(_TABLES, _FINANCE, select="SELECT * FROM stacked"),
    "flatten_headers": """SELECT CAST(c_custkey AS VARCHAR) AS filing, unnest([0, 1, 2]) AS col_idx,
        unnest(['Unnamed: 0_level_0|Item', c_mktsegment || '|' || c_name, c_mktsegment || '|Unnamed: 2_level_1']) AS label
      FROM customer""",
    "drop_empty_columns": with_sql(
        _TABLES, _FINANCE, _NOT_EMPTY,
        select="SELECT stacked.* FROM stacked JOIN good USING (filing, col)",
    ),
}
