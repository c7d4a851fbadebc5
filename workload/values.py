"""Column expressions over text built from orders, line items and parts."""

from pyspark.sql import functions as F

from filingforge import vocabulary as V
from filingforge.functions import dates, labels, numbers
from workload.inputs import table

_THIS_YEAR = 2024
_M = V.MONTHS


def _order_dates(spark, sf_dir):
    """Order dates in six notations, by order number."""
    day = F.col("o_orderdate")
    notations = [
        F.concat(F.lit("For the year ended "), F.date_format(day, "MMMM d"), F.lit(",  "), F.year(day).cast("string")),
        F.concat(F.lower(F.date_format(day, "MMMM d")), F.year(day).cast("string")),
        F.date_format(day, "d MMMM yy"),
        F.date_format(day, "MM/dd/yyyy"),
        F.date_format(day, "MMM. d, yyyy"),
        F.date_format(day, "MMMM yyyy"),
    ]
    text = F.get(F.array(*notations), (F.col("o_orderkey") % 6).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))


_ORDER_DATES = """WITH texts AS (
  SELECT o_orderkey, CASE o_orderkey % 6
    WHEN 0 THEN 'For the year ended ' || strftime(o_orderdate, '%B %-d,  %Y')
    WHEN 1 THEN lower(strftime(o_orderdate, '%B %-d%Y'))
    WHEN 2 THEN strftime(o_orderdate, '%-d %B %y') WHEN 3 THEN strftime(o_orderdate, '%m/%d/%Y')
    WHEN 4 THEN strftime(o_orderdate, '%b. %-d, %Y') ELSE strftime(o_orderdate, '%B %Y') END AS text
  FROM orders)
"""


def extract_date_text(spark, sf_dir):
    return _order_dates(spark, sf_dir).select("o_orderkey", dates.extract_date_text(F.col("text")).alias("date_text"))


_EXTRACT = f"""CASE
    WHEN regexp_matches(text, '(?i)({_M})\\s*(\\d{{1,2}}),?\\s*(\\d{{4}})')
    THEN regexp_replace(regexp_extract(text, '(?i)({_M})\\s*(\\d{{1,2}}),?\\s*(\\d{{4}})'),
      '(?i)({_M})\\s*(\\d{{1,2}}),?\\s*(\\d{{4}})', '\\1 \\2, \\3')
    WHEN regexp_matches(text, '(?i)\\b(\\d{{1,2}})\\s+({_M})\\s+(\\d{{2,4}})\\b')
    THEN regexp_replace(regexp_extract(text, '(?i)\\b(\\d{{1,2}})\\s+({_M})\\s+(\\d{{2,4}})\\b'),
      '(?i)\\b(\\d{{1,2}})\\s+({_M})\\s+(\\d{{2,4}})\\b', '\\2 \\1, \\3') END"""


def parse_mixed_date(spark, sf_dir):
    """Dates written with four and two digits of the year, an impossible day, and no date."""
    day = F.col("o_orderdate")
    notations = [
        F.date_format(day, "MMMM d, yyyy"), F.date_format(day, "MMMM d, yy"),
        F.concat(F.lit("February 30, "), F.year(day).cast("string")), F.lit("not a date"),
    ]
    text = F.get(F.array(*notations), (F.col("o_orderkey") % 4).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.parse_mixed_date(text, _THIS_YEAR).alias("date"))


def _line_amounts(spark, sf_dir):
    n = F.format_number("l_extendedprice", 2)
    cat, lit = F.concat, F.lit
    notations = [
        cat(lit("$("), n, lit(")")), cat(lit("$"), n), cat(lit("("), n, lit(")")), n, cat(lit("$"), n, lit(" (1)")),
        cat(lit("about $"), n, lit(" each")), cat(lit("("), n), cat(lit("-"), n), lit(","),
    ]
    text = F.get(F.array(*notations), ((F.col("l_orderkey") + F.col("l_linenumber")) % 9).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("text"))


_LINE_AMOUNTS = """WITH texts AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE (l_orderkey + l_linenumber) % 9
    WHEN 0 THEN '$(' || n || ')' WHEN 1 THEN '$' || n WHEN 2 THEN '(' || n || ')' WHEN 3 THEN n
    WHEN 4 THEN '$' || n || ' (1)' WHEN 5 THEN 'about $' || n || ' each' WHEN 6 THEN '(' || n
    WHEN 7 THEN '-' || n ELSE ',' END AS text
  FROM (SELECT *, format('{:,.2f}', l_extendedprice) AS n FROM lineitem))
"""


def parse_amount(spark, sf_dir):
    amounts = _line_amounts(spark, sf_dir)
    return amounts.withColumn("value", numbers.parse_amount(F.col("text")))


_AMOUNT_SQL = (
    "TRY_CAST(nullif(translate(regexp_extract(text, '\\$\\([0-9,]+(?:\\.[0-9]+)?\\)|\\$[0-9,]+(?:\\.[0-9]+)?"
    "|^\\([0-9,]+(?:\\.[0-9]+)?\\)$|^[0-9,]+(?:\\.[0-9]+)?$'), '$(),', ''), '') AS DOUBLE)"
)


def _part_labels(spark, sf_dir):
    label = F.concat(
        F.initcap("p_name"), F.lit(" ("), F.lower("p_type"), F.lit(") - Maker's “"), F.col("p_brand"),
        F.lit("”: netCash, end  of Year;"),
    )
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("label"))


_PART_LABELS = """WITH texts AS (
  SELECT p_partkey,
    array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')
    || ' (' || lower(p_type) || ') - Maker''s “' || p_brand || '”: netCash, end  of' || chr(160) || 'Year;' AS label
  FROM part)
"""


def _snake_sql(x):
    return (
        f"trim(regexp_replace(lower(regexp_replace(regexp_replace(replace(regexp_replace({x}, '\\([^)]*\\)', '', 'g'), "
        "'''', ''), '[-\\s\\x{00A0}]+', '_', 'g'), '([a-z])([A-Z])', '\\1_\\2', 'g')), '_+', '_', 'g'), '_')"
    )


_CLEAN_SQL = "trim(regexp_replace(regexp_replace(lower(label), '[\",''’:;().·]', '', 'g'), '[\\s\\x{00A0}]+', ' ', 'g'))"


def snake_case(spark, sf_dir):
    return _part_labels(spark, sf_dir).select(
        "p_partkey", labels.snake_case(F.col("label")).alias("snake"),
        labels.metric_name(F.col("label"), first_generation=True).alias("first_generation"),
    )


def clean_label(spark, sf_dir):
    return _part_labels(spark, sf_dir).select(
        "p_partkey", labels.clean_label(F.col("label")).alias("cleaned"), labels.metric_name(F.col("label")).alias("metric")
    )


def _line_cells(spark, sf_dir):
    """A row of three cells per line item, with money and ratio tokens in them."""
    price = F.format_number("l_extendedprice", 2)
    cells = F.array(
        F.concat(F.lit("$"), price, F.lit(" and ("), F.col("l_quantity").cast("int").cast("string"), F.lit("K), net")),
        F.concat(F.lit("rate 1"), F.format_number("l_discount", 2), F.lit("x or "), F.format_number(F.col("l_tax") * 100, 1), F.lit("%p, ")),
        F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("("), (F.col("l_partkey") % 100).cast("string"), F.lit("M"))),
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cells.alias("cells"))


_LINE_CELLS = """WITH rows_ AS (
  SELECT row_number() OVER () AS rid, l_orderkey, l_linenumber, l_partkey, l_suppkey, [
    '$' || format('{:,.2f}', l_extendedprice) || ' and (' || CAST(l_quantity AS INTEGER) || 'K), net',
    'rate 1' || format('{:,.2f}', l_discount) || 'x or ' || format('{:,.1f}', l_tax * 100) || '%p, ',
    CASE WHEN l_linenumber % 3 <> 0 THEN '(' || (l_partkey % 100) || 'M' END] AS cells
  FROM lineitem),
cells AS (
  SELECT rid, l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest(cells) AS cell, unnest([0, 1, 2]) AS col FROM rows_),
found AS (
  SELECT * EXCLUDE toks, unnest(toks) AS token, unnest(range(len(toks))) AS pos
  FROM (SELECT *, regexp_extract_all(cell, '\\$?[\\(]?[\\d,]+\\.?\\d*[\\)]?[MmBbKk]?') AS toks FROM cells WHERE cell IS NOT NULL)),
money AS (
  SELECT *, CASE WHEN contains(token, '(') THEN -1 ELSE 1 END
    * TRY_CAST(nullif(translate(token, '$,()KkMmBb', ''), '') AS DOUBLE)
    * CASE lower(right(token, 1)) WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 ELSE 1 END AS value
  FROM found)
"""
_LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_KEY_SQL = ", ".join(_LINE_KEY)


def _line_tokens(spark, sf_dir):
    cells = _line_cells(spark, sf_dir).select(*_LINE_KEY, F.posexplode("cells").alias("col", "cell"))
    return cells.select(*_LINE_KEY, "col", F.posexplode(numbers.money_tokens(F.col("cell"))).alias("pos", "token"))


def money_tokens(spark, sf_dir):
    return _line_tokens(spark, sf_dir)


def money_value(spark, sf_dir):
    tokens = _line_tokens(spark, sf_dir)
    return tokens.withColumn("value", numbers.money_value(F.col("token")))


def ratio_tokens(spark, sf_dir):
    cells = _line_cells(spark, sf_dir).select(*_LINE_KEY, F.posexplode("cells").alias("col", "cell"))
    return cells.select(*_LINE_KEY, "col", F.posexplode(numbers.ratio_values(F.col("cell"))).alias("pos", "ratio"))


def row_money(spark, sf_dir):
    from filingforge.operators.statements import row_money as values

    rows = _line_cells(spark, sf_dir)
    return rows.select(*_LINE_KEY, F.posexplode(values(F.col("cells"))).alias("pos", "value"))


def humanize_money(spark, sf_dir):
    """Order totals from cents to billions, some negative, some missing."""
    scale = F.get(F.array(*map(F.lit, [0.0001, 0.01, 1.0, 100.0, 10000.0])), (F.col("o_custkey") % 5).cast("int"))
    sign = F.when(F.col("o_orderstatus") == "F", -1).otherwise(1)
    value = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice") * scale * sign)
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.humanize_money(value).alias("shown"))


def title_case(spark, sf_dir):
    text = F.concat(F.upper("p_name"), F.lit(" e-commerce's "), F.lower("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", labels.title_case(text).alias("title"))


def url_basename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", labels.url_basename(F.col("url")).alias("file_name"))


QUERIES = {
    "extract_date_text": extract_date_text,
    "parse_amount": parse_amount,
    "snake_case": snake_case,
    "clean_label": clean_label,
    "parse_mixed_date": parse_mixed_date,
    "money_tokens": money_tokens,
    "money_value": money_value,
    "ratio_tokens": ratio_tokens,
    "row_money": row_money,
    "humanize_money": humanize_money,
    "title_case": title_case,
    "url_basename": url_basename,
}

ORACLE = {
    "extract_date_text": _ORDER_DATES + f"SELECT o_orderkey, {_EXTRACT} AS date_text FROM texts",
    "parse_amount": _LINE_AMOUNTS
    + f"""SELECT *, CASE WHEN contains(text, '(') AND contains(text, ')') THEN -{_AMOUNT_SQL} ELSE {_AMOUNT_SQL} END AS value
    FROM texts""",
    "snake_case": _PART_LABELS
    + f"SELECT p_partkey, {_snake_sql('label')} AS snake, {_snake_sql('lower(label)')} AS first_generation FROM texts",
    "clean_label": _PART_LABELS + f"SELECT p_partkey, {_CLEAN_SQL} AS cleaned, {_snake_sql(_CLEAN_SQL)} AS metric FROM texts",
    "parse_mixed_date": """SELECT o_orderkey,
      CASE WHEN o_orderkey % 4 < 2 THEN CAST(o_orderdate AS DATE) END AS date FROM orders""",
    "money_tokens": _LINE_CELLS + f"SELECT {_KEY_SQL}, col, pos, token FROM found",
    "money_value": _LINE_CELLS + f"SELECT {_KEY_SQL}, col, pos, token, value FROM money",
    "ratio_tokens": _LINE_CELLS
    + f""", ratio_found AS (
      SELECT rid, {_KEY_SQL}, col, unnest(toks) AS tok, unnest(range(len(toks))) AS k, n FROM (
        SELECT *, regexp_extract_all(cell, pattern) AS toks FROM cells,
          (VALUES (1, '(?i)\\b\\d+\\.\\d+x\\b'), (2, '(?i)\\b\\d+\\.\\d+%\\b'), (3, '(?i)\\b\\d+\\.\\d{{2,3}}\\b')) p(n, pattern)
        WHERE cell IS NOT NULL)),
    ratios AS (SELECT *, TRY_CAST(translate(tok, 'x%', '') AS DOUBLE) AS ratio FROM ratio_found)
    SELECT {_KEY_SQL}, col, row_number() OVER (PARTITION BY rid, col ORDER BY n, k) - 1 AS pos, ratio
    FROM ratios WHERE ratio IS NOT NULL""",
    "row_money": _LINE_CELLS
    + f"""SELECT {_KEY_SQL}, row_number() OVER (PARTITION BY rid ORDER BY col, pos) - 1 AS pos, value
    FROM money WHERE value IS NOT NULL""",
    "humanize_money": """WITH amounts AS (
      SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice
        * CAST([0.0001, 0.01, 1.0, 100.0, 10000.0][o_custkey % 5 + 1] AS DOUBLE)
        * CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END END AS v
      FROM orders)
    SELECT o_orderkey, CASE WHEN v IS NULL THEN 'N/A' ELSE CASE WHEN v < 0 THEN '-$' ELSE '$' END
      || CASE WHEN abs(v) >= 1e9 THEN format('{:.1f}', abs(v) / 1e9) || 'B'
        WHEN abs(v) >= 1e6 THEN format('{:.1f}', abs(v) / 1e6) || 'M'
        WHEN abs(v) >= 1e3 THEN format('{:.1f}', abs(v) / 1e3) || 'K'
        ELSE format('{:,.2f}', abs(v)) END END AS shown FROM amounts""",
    "title_case": """SELECT p_partkey, array_to_string(list_transform(
        regexp_extract_all(upper(p_name) || ' e-commerce''s ' || lower(p_type), '\\pL+|\\PL+'),
        lambda w: upper(w[1]) || lower(w[2:])), '') AS title FROM part""",
    "url_basename": "SELECT page_id, regexp_extract(url, '[^/]*$') AS file_name FROM pages",
}
