"""Inputs of the operators, derived from the given tables: once as DataFrames, once as SQL.

The given tables hold no filings, so grids, pages, catalogues and documents are built from them,
row by row or customer by customer, and grow with them.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingforge.operators.staging import stage
from filingforge.operators.stats import unpivot
from filingforge.operators.tables import stack_tables

PARENTS = ["folder-1", "folder-2", "folder-3", "folder-4", "folder-5"]
LINE_LABELS = ["Total Revenue (net)", "Shareholders’ Equity", "Cash", "Net Loss", "Other"]
TERMS = ["license", "mit", "apache", "public", "that", "data", "app"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_sql(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + select


def _nulls(kind: str):
    return F.lit(None).cast(kind)


# ---------------------------------------------------------------- catalogue


def catalog(spark, sf_dir) -> DataFrame:
    """One row per order: a filing of the customer, with prices."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"),
        F.concat(F.lit("https://example.com/filings/"), F.col("o_custkey").cast("string"), F.lit("/doc-"),
                 key.cast("string"), F.lit(".htm")).alias("url"),
        (key % 1000 * 100).cast("double").alias("volume"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_orderdate").cast("date").alias("ipo_date"),
        price.alias("open"),
        F.round(price + (key % 21 - 10) * 125, 2).alias("close"),
        ((key % 21 - 10) * 125).cast("double").alias("diff"),
        F.round(price / 1000, 1).alias("public_price_per_share"),
        price.alias("price_public_total"),
        key.alias("position"),
        F.col("o_orderstatus").alias("status"),
    )


CATALOG = """
catalog AS (
  SELECT 'C' || o_custkey AS symbol,
    'https://example.com/filings/' || o_custkey || '/doc-' || o_orderkey || '.htm' AS url,
    CAST(o_orderkey % 1000 * 100 AS DOUBLE) AS volume,
    CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) AS ipo_date,
    o_totalprice AS open, round(o_totalprice + (o_orderkey % 21 - 10) * 125, 2) AS close,
    CAST((o_orderkey % 21 - 10) * 125 AS DOUBLE) AS diff,
    round(o_totalprice / 1000, 1) AS public_price_per_share, o_totalprice AS price_public_total,
    o_orderkey AS position, o_orderstatus AS status
  FROM orders)
"""


def files(spark, sf_dir) -> DataFrame:
    """Files that exist: those of orders that are not pending."""
    return catalog(spark, sf_dir).where("status != 'P'").select(
        "symbol", F.substring_index("url", "/", -1).alias("file_name")
    )


FILES = """
files AS (
  SELECT symbol, regexp_extract(url, '[^/]*$') AS file_name FROM catalog WHERE status <> 'P')
"""


def candidates(spark, sf_dir) -> DataFrame:
    """Files in several parent folders: (parent, priority, symbol, file_name)."""
    listed = files(spark, sf_dir).withColumn("n", F.regexp_extract("file_name", r"(\d+)", 1).cast("long"))
    places = F.array_distinct(F.array(F.col("n") % 5, F.col("n") % 3 + 2))
    return listed.select("symbol", "file_name", F.explode(places).alias("priority")).withColumn(
        "parent", F.get(F.array(*map(F.lit, PARENTS)), F.col("priority").cast("int"))
    )


CANDIDATES = """
candidates AS (
  SELECT DISTINCT symbol, file_name, 'folder-' || (p + 1) AS parent, p AS priority
  FROM (SELECT symbol, file_name, CAST(regexp_extract(file_name, '([0-9]+)', 1) AS BIGINT) AS n FROM files),
    LATERAL (SELECT unnest([n % 5, n % 3 + 2]) AS p))
"""

# ---------------------------------------------------------------- tables of a filing


def filing_tables(spark, sf_dir) -> DataFrame:
    """(filing, tables): four tables per customer, from the customer's orders.

    Table 0 is a statement: two header rows with December dates, five line items, a header with
    March dates for three columns, two line items again; column 8 is all `$`, column 9 blank.
    Table 1 is too short, table 2 names no finance term, table 3 has a header of its own.
    """
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("filing"),
        (F.substring("o_orderpriority", 1, 1).cast("int") * 7 - 7 + F.year("o_orderdate") - 1995).alias("slot"),
        F.col("o_totalprice").cast("decimal(15,2)").alias("price"),
    )
    slots = [F.sum(F.when(F.col("slot") == s, F.col("price"))) for s in range(35)]
    sums = orders.groupBy("filing").agg(
        F.array(*slots).alias("amounts"), F.count(F.lit(1)).alias("n"),
        F.min("price").alias("lo"), F.max("price").alias("hi"),
    )
    labels = F.array(*map(F.lit, LINE_LABELS))

    def money(x):
        return F.format_number(x.cast("double"), 2)

    def cell(r, c):
        item = F.when(r < 7, r - 2).otherwise(r - 8)
        amount = F.get(F.col("amounts"), item * 7 + c - 1)
        style = (item + c) % 4
        shown = (
            F.when(style == 0, F.concat(F.lit("$"), money(amount)))
            .when(style == 1, F.concat(F.lit("("), money(amount), F.lit(")")))
            .when(style == 2, F.replace(money(amount), F.lit(","), F.lit("")))
            .otherwise("—")
        )
        year = (c + 1994).cast("string")
        inner = c.between(1, 7)
        return (
            F.when(c == 9, "")
            .when((r < 2) & (c == 0), "As of January 1, 1995")
            .when((r == 0) & inner, "December 31,")
            .when((r == 1) & inner, year)
            .when((r == 7) & c.between(1, 3), F.concat(F.lit("Years Ended March 31, "), year))
            .when((r < 2) | (r == 7), _nulls("string"))
            .when(c == 0, F.get(labels, item))
            .when(c == 8, "$")
            .when(amount.isNotNull(), shown)
        )

    line = F.sequence(F.lit(0), F.lit(9))
    statement = F.transform(line, lambda r: F.transform(line, lambda c: cell(r, c)))
    lo, hi, n = money(F.col("lo")), money(F.col("hi")), F.col("n").cast("string")

    def rows(*pairs):
        return F.array(*[F.array(F.lit(a), b) for a, b in pairs])

    small = rows(("Cash", n), ("Assets", lo), ("Earnings", hi))
    other = rows(("Orders", n), ("Smallest", lo), ("Largest", hi), ("Nothing", _nulls("string")))
    named = rows(
        ("Inventory", F.concat(F.lit("$"), hi)), ("Depreciation", F.concat(F.lit("("), lo, F.lit(")"))),
        ("Common Stock", _nulls("string")), ("Note", F.lit("")),
    )

    def one(table_id, names, body):
        return F.struct(F.lit(table_id).alias("table_id"), F.array(*map(F.lit, names)).alias("labels"), body.alias("lines"))

    positions = [str(i) for i in range(10)]
    tables = F.array(
        one(0, positions, statement), one(1, positions[:2], small), one(2, positions[:2], other),
        one(3, ["Item", "1"], named),
    )
    return sums.select("filing", tables.alias("tables"))


def table_rows(spark, sf_dir) -> DataFrame:
    """(filing, table_id, row_idx, labels, cells) of `filing_tables`."""
    tables = filing_tables(spark, sf_dir).select("filing", F.inline("tables"))
    return tables.select("filing", "table_id", "labels", F.posexplode("lines").alias("row_idx", "cells")).select(
        "filing", "table_id", "row_idx", "labels", "cells"
    )


def markup(spark, sf_dir) -> DataFrame:
    """(filing, html): the tables as a page."""

    def tags(tag, texts):
        return F.concat(
            F.lit("<tr>"),
            F.array_join(F.transform(texts, lambda t: F.concat(F.lit(f"<{tag}>"), F.coalesce(t, F.lit("")), F.lit(f"</{tag}>"))), ""),
            F.lit("</tr>"),
        )

    def body(t):
        head = F.when(t["labels"][0] == "Item", F.concat(F.lit("<thead>"), tags("th", t["labels"]), F.lit("</thead>")))
        lines = F.array_join(F.transform(t["lines"], lambda line: tags("td", line)), "\n")
        return F.concat(F.lit("<Table border=0>"), F.coalesce(head, F.lit("")), lines, F.lit("</table>"))

    return filing_tables(spark, sf_dir).select(
        "filing",
        F.concat(
            F.lit("<!DOCTYPE html><html><body><!-- <table><tr><td>gone</td></tr></table> -->"),
            F.array_join(F.transform("tables", body), "<p>text</p>"), F.lit("</body></html>"),
        ).alias("html"),
    )


def grid(spark, sf_dir) -> DataFrame:
    """All tables of every filing stacked, written once: the operators read it twice, and stacking reads the rows twice."""
    return stage(stack_tables(stage(table_rows(spark, sf_dir), "table-rows")), "grid-input")


TABLE_CELLS = """
sums AS (
  SELECT 'C' || o_custkey AS filing, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS item,
    year(o_orderdate) - 1994 AS c, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) AS amount
  FROM orders GROUP BY ALL),
filings AS (
  SELECT 'C' || o_custkey AS filing, CAST(count(*) AS VARCHAR) AS n,
    format('{:,.2f}', min(o_totalprice)) AS lo, format('{:,.2f}', max(o_totalprice)) AS hi
  FROM orders GROUP BY ALL),
places AS (
  SELECT filing, r, c, CASE WHEN r < 7 THEN r - 2 ELSE r - 8 END AS item
  FROM filings, range(10) x(r), range(10) y(c)),
table_cells AS (
  SELECT filing, 0 AS table_id, CAST(r AS INTEGER) AS row_idx, CAST(c AS INTEGER) AS col_idx,
    CAST(c AS VARCHAR) AS col_name,
    CASE WHEN c = 9 THEN '' WHEN r < 2 AND c = 0 THEN 'As of January 1, 1995'
      WHEN r = 0 AND c BETWEEN 1 AND 7 THEN 'December 31,'
      WHEN r = 1 AND c BETWEEN 1 AND 7 THEN CAST(1994 + c AS VARCHAR)
      WHEN r = 7 AND c BETWEEN 1 AND 3 THEN 'Years Ended March 31, ' || (1994 + c)
      WHEN r < 2 OR r = 7 THEN NULL
      WHEN c = 0 THEN ['Total Revenue (net)', 'Shareholders’ Equity', 'Cash', 'Net Loss', 'Other'][item + 1]
      WHEN c = 8 THEN '$' WHEN amount IS NULL THEN NULL
      WHEN (item + c) % 4 = 0 THEN '$' || format('{:,.2f}', amount)
      WHEN (item + c) % 4 = 1 THEN '(' || format('{:,.2f}', amount) || ')'
      WHEN (item + c) % 4 = 2 THEN format('{:.2f}', amount) ELSE '—' END AS cell
  FROM places LEFT JOIN sums USING (filing, item, c)
  UNION ALL
  SELECT filing, table_id, row_idx, unnest([0, 1]), unnest(names), unnest([label, shown])
  FROM (
    SELECT filing, unnest([1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3]) AS table_id,
      unnest([0, 1, 2, 0, 1, 2, 3, 0, 1, 2, 3]) AS row_idx,
      unnest(['Cash', 'Assets', 'Earnings', 'Orders', 'Smallest', 'Largest', 'Nothing',
              'Inventory', 'Depreciation', 'Common Stock', 'Note']) AS label,
      unnest([n, lo, hi, n, lo, hi, NULL, '$' || hi, '(' || lo || ')', NULL, '']) AS shown
    FROM filings) t
  JOIN (VALUES (1, ['0', '1']), (2, ['0', '1']), (3, ['Item', '1'])) l(tid, names) ON tid = table_id)
"""
GRID = TABLE_CELLS.rstrip() + """,
first_places AS (SELECT filing, col_name, min(table_id * 1048576 + col_idx) AS col FROM table_cells GROUP BY ALL),
grid AS (
  SELECT filing, CAST(table_id AS BIGINT) * 1099511627776 + row_idx AS row_no, CAST(col AS BIGINT) AS col, cell
  FROM table_cells JOIN first_places USING (filing, col_name))
"""

# ---------------------------------------------------------------- features


def features(spark, sf_dir) -> DataFrame:
    """(symbol, element, kind, value): parts ordered by a customer, the kind by line number."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.initcap("p_name").alias("element"))
    kind = F.get(F.array(F.lit("keyword"), F.lit("Person"), F.lit("underwriter")), F.col("l_linenumber") % 3)
    return (
        lines.join(orders, "l_orderkey").join(parts, "l_partkey")
        .groupBy(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"), "element", kind.alias("kind"))
        .agg(F.sum("l_quantity").cast("long").alias("value"))
    )


#: All elements of `features`: parts are named by a kind and a thing.
ELEMENTS = [
    f"{kind} {thing}" for kind in ("Blue", "Cold", "Hot", "Large", "New", "Old", "Red", "Small")
    for thing in ("Anvil", "Bolt", "Gear", "Gizmo", "Plate", "Ring", "Rod", "Widget")
]
#: For the head of a PIVOT: without the list it cannot stand in a view.
ELEMENT_LIST = "element IN (" + ", ".join(f"'{e}'" for e in ELEMENTS) + ")"

FEATURES = """
features AS (
  SELECT 'C' || o_custkey AS symbol,
    array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS element,
    ['keyword', 'Person', 'underwriter'][l_linenumber % 3 + 1] AS kind,
    CAST(sum(l_quantity) AS BIGINT) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  GROUP BY ALL)
"""


def metrics(spark, sf_dir) -> DataFrame:
    """(filing, metric, value): one amount per customer and kind of order, named like line items."""
    names = {
        "1": "cash_trend", "2": "cash_and_cash_equivalents_trend", "3": "total_stockholders_equity_recent",
        "4": "total_shareholders_equity_recent", "5": "net_loss_recent",
    }
    metric = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.substring("o_orderpriority", 1, 1)]
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("filing"), metric.alias("metric"))
        .agg(F.sum(F.col("o_totalprice").cast("decimal(15,2)")).cast("double").alias("value"))
    )


METRICS = """
metrics AS (
  SELECT 'C' || o_custkey AS filing,
    ['cash_trend', 'cash_and_cash_equivalents_trend', 'total_stockholders_equity_recent',
     'total_shareholders_equity_recent', 'net_loss_recent'][CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS metric,
    CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) AS value
  FROM orders GROUP BY ALL)
"""


def keyword_wide(spark, sf_dir) -> DataFrame:
    """(symbol, diff, one count per term): all documents; the sign of diff by quality, null without a label."""
    labels = table(spark, sf_dir, "labels")
    text = F.lower("text")
    counts = [F.regexp_count(text, F.lit(t)).cast("double").alias(t) for t in TERMS]
    diff = ((F.col("quality") * 2 - 1) * (F.col("doc_id") % 7)).cast("double")
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("symbol"), diff.alias("diff"), *counts
    )


def keyword_values(spark, sf_dir) -> DataFrame:
    return unpivot(keyword_wide(spark, sf_dir).where("diff is not null"), TERMS, ["symbol", "diff"])


KEYWORD_WIDE = (
    "keyword_wide AS (SELECT 'D' || doc_id AS symbol, CAST((quality * 2 - 1) * (doc_id % 7) AS DOUBLE) AS diff, "
    + ", ".join(f"CAST(len(regexp_extract_all(lower(text), '{t}')) AS DOUBLE) AS {t}" for t in TERMS)
    + " FROM documents LEFT JOIN labels USING (doc_id))"
)
KEYWORD_VALUES = (
    KEYWORD_WIDE + ",\nkeyword_values AS (SELECT symbol, diff, unnest(["
    + ", ".join(f"'{t}'" for t in TERMS) + "]) AS \"column\", unnest([" + ", ".join(TERMS) + "]) AS value FROM keyword_wide WHERE diff IS NOT NULL)"
)

# ---------------------------------------------------------------- grid documents


def document_rows(spark, sf_dir) -> DataFrame:
    """(doc, row_idx, cells): one document per customer, one row per order; what a row says goes by
    the order's number. Some rows are empty, some terms and dates run over cells and rows."""
    o = table(spark, sf_dir, "orders")
    amount = F.format_number("o_totalprice", 2)
    none, lit, cat = _nulls("string"), F.lit, F.concat
    kinds = [
        [lit("Total Assets"), lit("$"), amount, none],
        [lit("Net income (loss)"), cat(lit("("), amount), lit(")"), lit("—")],
        [lit("Total liabilities and shareholder’s equity"), cat(lit("$"), amount), lit("N/A"), none],
        [lit("Premiums Written"), cat(F.floor(F.col("o_totalprice") / 1000).cast("string"), lit("K")), none, lit("-")],
        [lit("Combined Ratio"), cat(lit("95."), (F.col("o_orderkey") % 90 + 10).cast("string"), lit("%x")), lit("1.5x"), lit("1.25")],
        [lit("Total Deposits"), amount, none, none],
        [cat(lit("Example "), F.col("o_custkey").cast("string"), lit(" Corp. #1")), none, F.date_format("o_orderdate", "MMMM d, yyyy"), none],
        [none, none, none, none],
        [lit("Trust"), lit("Account"), cat(lit("$"), amount), none],
        [lit("Operating Activities"), cat(amount, lit(" (1)")), none, lit("(3")],
        [lit(" "), F.year("o_orderdate").cast("string"), lit("Balance"), lit("Sheet")],
        [none, lit("Current ratio"), lit("December"), lit("31,")],
        [lit(" "), lit("  "), lit(" "), lit("   ")],
    ]
    # Some rows are of blanks only, so that dates run across such rows too.
    number = F.when(F.col("o_orderkey") % 24 == 7, 12).otherwise(F.col("o_orderkey") % 12)
    # Only the row's own kind is worked out, not all of them.
    cells = reduce(lambda found, k: found.when(number == k, F.array(*kinds[k])), range(1, len(kinds)), F.when(number == 0, F.array(*kinds[0])))
    return o.select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("doc"),
        F.col("o_orderkey").alias("row_idx"), cells.alias("cells"),
    )


DOCUMENT_CELLS = """
raw_cells AS (
  SELECT 'C' || o_custkey AS doc, o_orderkey AS rid, unnest([0, 1, 2, 3]) AS pos, unnest(
    CASE CASE WHEN o_orderkey % 24 = 7 THEN 12 ELSE o_orderkey % 12 END
      WHEN 12 THEN [' ', '  ', ' ', '   ']
      WHEN 0 THEN ['Total Assets', '$', format('{:,.2f}', o_totalprice), NULL]
      WHEN 1 THEN ['Net income (loss)', '(' || format('{:,.2f}', o_totalprice), ')', '—']
      WHEN 2 THEN ['Total liabilities and shareholder’s equity', '$' || format('{:,.2f}', o_totalprice), 'N/A', NULL]
      WHEN 3 THEN ['Premiums Written', CAST(floor(o_totalprice / 1000) AS BIGINT) || 'K', NULL, '-']
      WHEN 4 THEN ['Combined Ratio', '95.' || (o_orderkey % 90 + 10) || '%x', '1.5x', '1.25']
      WHEN 5 THEN ['Total Deposits', format('{:,.2f}', o_totalprice), NULL, NULL]
      WHEN 6 THEN ['Example ' || o_custkey || ' Corp. #1', NULL, strftime(o_orderdate, '%B %-d, %Y'), NULL]
      WHEN 7 THEN [NULL, NULL, NULL, NULL]
      WHEN 8 THEN ['Trust', 'Account', '$' || format('{:,.2f}', o_totalprice), NULL]
      WHEN 9 THEN ['Operating Activities', format('{:,.2f}', o_totalprice) || ' (1)', NULL, '(3']
      WHEN 10 THEN [' ', CAST(year(o_orderdate) AS VARCHAR), 'Balance', 'Sheet']
      ELSE [NULL, 'Current ratio', 'December', '31,'] END) AS cell
  FROM orders),
full_rows AS (SELECT doc, rid FROM raw_cells GROUP BY ALL HAVING count(cell) > 0),
full_cols AS (SELECT doc, pos FROM raw_cells GROUP BY ALL HAVING count(cell) > 0),
doc_cells AS (
  SELECT doc, dense_rank() OVER (PARTITION BY doc ORDER BY rid) - 1 AS row_idx,
    dense_rank() OVER (PARTITION BY doc ORDER BY pos) - 1 AS col,
    CASE WHEN cell NOT IN ('—', '-', '', 'N/A', 'n/a', 'NULL') THEN cell END AS cell
  FROM raw_cells JOIN full_rows USING (doc, rid) JOIN full_cols USING (doc, pos)),
tokens AS (
  SELECT doc, row_idx, col, unnest(toks) AS raw_value, unnest(range(len(toks))) AS token
  FROM (SELECT *, regexp_extract_all(cell, '\\$?[\\(]?[\\d,]+\\.?\\d*[\\)]?[MmBbKk]?') AS toks FROM doc_cells
        WHERE cell IS NOT NULL)),
money AS (
  SELECT * FROM (SELECT *, CASE WHEN contains(raw_value, '(') THEN -1 ELSE 1 END
      * TRY_CAST(translate(raw_value, '$,()KkMmBb', '') AS DOUBLE)
      * CASE lower(right(raw_value, 1)) WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 ELSE 1 END AS cleaned_value
    FROM tokens) WHERE cleaned_value IS NOT NULL),
ratio_tokens AS (
  SELECT doc, row_idx, col, n, unnest(found) AS tok, unnest(range(len(found))) AS k
  FROM (SELECT doc, row_idx, col, n, regexp_extract_all(cell, pattern) AS found FROM doc_cells,
      (VALUES (1, '(?i)\\b\\d+\\.\\d+x\\b'), (2, '(?i)\\b\\d+\\.\\d+%\\b'), (3, '(?i)\\b\\d+\\.\\d{2,3}\\b')) p(n, pattern)
    WHERE cell IS NOT NULL)),
ratios AS (
  SELECT *, TRY_CAST(translate(tok, 'x%', '') AS DOUBLE) AS ratio FROM ratio_tokens
  WHERE TRY_CAST(translate(tok, 'x%', '') AS DOUBLE) IS NOT NULL),
row_texts AS (
  SELECT doc, row_idx, lower(coalesce(string_agg(cell, ' ' ORDER BY col), '')) AS row_text FROM doc_cells GROUP BY ALL),
row_money AS (
  SELECT doc, row_idx, list(cleaned_value ORDER BY col, token) AS money FROM money GROUP BY ALL),
row_ratios AS (
  SELECT doc, row_idx, list(ratio ORDER BY col, n, k) AS ratios FROM ratios GROUP BY ALL),
row_features AS (
  SELECT doc, row_idx, row_text, money, ratios FROM row_texts
  LEFT JOIN row_money USING (doc, row_idx) LEFT JOIN row_ratios USING (doc, row_idx)),
doc_texts AS (
  SELECT doc, string_agg(coalesce(cell, 'nan'), ' ' ORDER BY row_idx, col) AS text FROM doc_cells GROUP BY ALL)
"""
