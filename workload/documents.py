"""Grid documents: classification, statement lines, metrics, batch statistics."""

from pyspark.sql import functions as F

from filingforge import vocabulary as V
from filingforge.operators import statements as S
from filingforge.operators import stats
from filingforge.operators.staging import stage
from filingforge.plans.documents import analyze_documents as analyze
from filingforge.plans.failures import first_failures
from workload.inputs import DOCUMENT_CELLS, document_rows, table, with_sql


def _cleaned(spark, sf_dir):
    rows = stage(document_rows(spark, sf_dir), "document-rows")
    return stage(S.clean_documents(rows), "documents")


def _features(spark, sf_dir):
    return stage(S.row_features(_cleaned(spark, sf_dir)), "row-features")


def null_tokens(spark, sf_dir):
    rows = _cleaned(spark, sf_dir)
    return rows.select("doc", "row_idx", F.posexplode("cells").alias("col", "cell"))


def document_type(spark, sf_dir):
    return S.document_type(_cleaned(spark, sf_dir))


def company_name(spark, sf_dir):
    return S.company_name(_cleaned(spark, sf_dir))


def document_dates(spark, sf_dir):
    return S.document_date_list(_cleaned(spark, sf_dir))


def _items(statement):
    def query(spark, sf_dir):
        found = S.line_items(_features(spark, sf_dir), [statement])
        return found.select(
            "doc", "statement", "item", "row_index", F.array_join(F.col("values").cast("array<decimal(20,2)>"), "|").alias("values"),
            F.array_join(F.col("ratios").cast("array<decimal(20,3)>"), "|").alias("ratios"), "raw_text",
        )

    return query


def monetary_cells(spark, sf_dir):
    return S.monetary_cells(_cleaned(spark, sf_dir))


def _metrics(kind):
    def query(spark, sf_dir):
        return S.document_metrics(_features(spark, sf_dir), [kind]).select("doc", "metric", "value")

    return query


def metrics_by_type(spark, sf_dir):
    cleaned = _cleaned(spark, sf_dir)
    return S.metrics_by_type(stage(S.row_features(cleaned), "row-features"), S.document_type(cleaned))


def _analyzed(spark, sf_dir):
    """All customers and suppliers as documents. Suppliers have no rows, or rows without cells, and fail."""
    documents = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("doc"))
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("doc"))
    nothing = suppliers.where(F.substring("doc", 2, 20).cast("long") % 2 == 0).select(
        "doc", F.lit(1).cast("long").alias("row_idx"), F.array(F.lit(None).cast("string"), F.lit(None)).alias("cells")
    )
    return analyze(stage(document_rows(spark, sf_dir).unionByName(nothing), "document-rows"), documents.union(suppliers))


def analyze_documents(spark, sf_dir):
    total = F.aggregate(F.map_values("key_metrics"), F.lit(0.0), lambda a, v: a + v)
    return _analyzed(spark, sf_dir).withColumns(
        {"metric_names": F.array_join(F.array_sort(F.map_keys("key_metrics")), "|"), "metric_total": F.round(total, 2)}
    ).drop("key_metrics")


def batch_stats(spark, sf_dir):
    """Totals over the statuses of the analysis: a document fails that has no cells."""
    return stats.batch_stats(_analyzed(spark, sf_dir)).withColumn("success_rate", F.round("success_rate", 6))


def document_stats(spark, sf_dir):
    """Number, largest and smallest value per document, with the first line items of every statement and the first dates."""
    cleaned = _cleaned(spark, sf_dir)
    items = S.first_items(S.line_items(S.row_features(cleaned)))
    dates = S.first_dates(S.document_date_list(cleaned))
    listed = F.array_sort(F.collect_list(F.format_string("%s %d %s @%d", "statement", "rank", "item", "row_index")))  # at most 20
    firsts = items.groupBy("doc").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(listed, "|").alias("first_items"))
    days = dates.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list("date_text")), "|").alias("dates"))
    numbers = S.document_stats(S.monetary_cells(cleaned))
    return numbers.join(firsts, "doc", "left").join(days, "doc", "left")


def document_first_items(spark, sf_dir):
    """The first line items of every statement of a document."""
    items = S.first_items(S.line_items(_features(spark, sf_dir)))
    return items.select("doc", "statement", "rank", "item", "row_index")


def document_type_counts(spark, sf_dir):
    return stats.group_count_desc(document_type(spark, sf_dir), "document_type")


def first_failed_documents(spark, sf_dir):
    """The first ten documents that failed, why, and how many more did."""
    failed = _analyzed(spark, sf_dir).where("status = 'failed'").select("doc", "error")
    return first_failures(failed, key="doc")


QUERIES = {
    "first_failed_documents": first_failed_documents,
    "null_tokens": null_tokens,
    "document_type": document_type,
    "company_name": company_name,
    "document_dates": document_dates,
    "balance_sheet_items": _items("balance_sheet"),
    "income_statement_items": _items("income_statement"),
    "cash_flow_items": _items("cash_flow"),
    "key_metric_rows": _items("key_metrics"),
    "monetary_cells": monetary_cells,
    "metrics_by_type": metrics_by_type,
    "metrics_spac": _metrics("spac"),
    "metrics_insurance": _metrics("insurance"),
    "metrics_banking": _metrics("banking"),
    "metrics_general": _metrics("general"),
    "analyze_documents": analyze_documents,
    "batch_stats": batch_stats,
    "document_stats": document_stats,
    "document_first_items": document_first_items,
    "document_type_counts": document_type_counts,
}

# ---------------------------------------------------------------- SQL
_TYPE_ROWS = ", ".join(
    f"({rank}, '{name}', '{term.lower()}')" for rank, (name, terms) in enumerate(V.DOCUMENT_TYPES) for term in terms
)
_TYPES = f"""
scores AS (
  SELECT doc, rank, name, count_if(contains(lower(text), term)) AS score
  FROM doc_texts, (VALUES {_TYPE_ROWS}) t(rank, name, term) GROUP BY ALL),
types AS (
  SELECT doc, CASE WHEN max(score) = 0 THEN 'unknown' ELSE arg_max(name, score * 100 - rank) END AS document_type
  FROM scores GROUP BY doc)
"""
_DATES = f"""
dates AS (
  SELECT DISTINCT doc, regexp_replace(unnest(regexp_extract_all(text, '(?i)' || pattern)), '\\s+', ' ', 'g') AS date_text FROM doc_texts,
    (VALUES ('\\b\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}\\b'), ('\\b\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}\\b'),
      ('\\b(?:{V.MONTHS})\\s+\\d{{1,2}},?\\s+\\d{{4}}\\b'), ('\\b\\d{{1,2}}\\s+(?:{V.MONTHS})\\s+\\d{{4}}\\b')) p(pattern))
"""


def _items_sql(statement):
    terms = ", ".join(f"('{t}')" for t in V.STATEMENT_TERMS[statement])
    keep = "money IS NOT NULL OR ratios IS NOT NULL" if statement == "key_metrics" else "money IS NOT NULL"
    ratios = (
        "array_to_string(list_transform(coalesce(ratios, []), lambda v: format('{:.3f}', v)), '|')"
        if statement == "key_metrics" else "NULL::VARCHAR"
    )
    return with_sql(
        DOCUMENT_CELLS,
        select=f"""SELECT doc, '{statement}' AS statement, term AS item, row_idx AS row_index,
          array_to_string(list_transform(coalesce(money, []), lambda v: format('{{:.2f}}', v)), '|') AS values,
          {ratios} AS ratios, left(row_text, 100) AS raw_text
          FROM row_features, (VALUES {terms}) t(term) WHERE contains(row_text, term) AND ({keep})""",
    )


_PICKS = {"max_money": "list_max(money)", "first_money": "money[1]", "first_ratio": "ratios[1]"}


def _metric_select(kind):
    lines = []
    for metric, groups, pick in V.METRIC_RULES[kind]:
        value = "NULL::DOUBLE"
        if groups:
            named = " AND ".join("(" + " OR ".join(f"contains(row_text, '{t}')" for t in g) + ")" for g in groups)
            value = f"arg_max({_PICKS[pick]}, row_idx) FILTER ({named} AND {_PICKS[pick]} IS NOT NULL)"
        lines.append(f"SELECT doc, '{kind}' AS kind, '{metric}' AS metric, {value} AS value FROM row_features GROUP BY doc")
    return " UNION ALL ".join(lines)


_COUNTS = ", ".join(
    f"CAST(sum(CASE WHEN {'money IS NOT NULL OR ratios IS NOT NULL' if s == 'key_metrics' else 'money IS NOT NULL'} THEN "
    + " + ".join(f"CAST(contains(row_text, '{t}') AS INTEGER)" for t in terms)
    + f" ELSE 0 END) AS BIGINT) AS {'key_metric_rows' if s == 'key_metrics' else s + '_items'}"
    for s, terms in V.STATEMENT_TERMS.items()
)
_COMPANY = """
named AS (
  SELECT doc, row_idx, col, trim(regexp_replace(cell, '[^\\w\\s.,&\\-]', '', 'g')) AS name FROM doc_cells
  WHERE row_idx < 10 AND regexp_matches(lower(cell), 'inc\\.|corp\\.|ltd\\.|llc|company')),
companies AS (
  SELECT doc, coalesce(arg_min(name, row_idx * 10 + col) FILTER (length(name) > 3), 'Unknown Company') AS company_name
  FROM (SELECT DISTINCT doc FROM doc_cells) LEFT JOIN named USING (doc) GROUP BY doc)
"""
_BY_TYPE = (
    "metrics AS (" + " UNION ALL ".join(map(_metric_select, V.METRIC_RULES)) + "),\n"
    "type_metrics AS (SELECT doc, document_type, metric, value FROM types JOIN metrics USING (doc) WHERE kind = "
    "CASE WHEN document_type IN ('spac', 'insurance', 'banking') THEN document_type ELSE 'general' END)"
)

_FIRST_ITEMS = (
    "SELECT doc, statement, CAST(row_number() OVER (PARTITION BY doc, statement ORDER BY row_idx, n) AS INTEGER) AS rank, "
    "term AS item, row_idx AS row_index FROM row_features, (VALUES "
    + ", ".join(f"('{s}', '{t}', {n})" for s, terms in V.STATEMENT_TERMS.items() for n, t in enumerate(terms))
    + """) t(statement, term, n)
      WHERE contains(row_text, term) AND (money IS NOT NULL OR (statement = 'key_metrics' AND ratios IS NOT NULL))
      QUALIFY rank <= 5"""
)

ORACLE = {
    "analyze_documents": with_sql(
        DOCUMENT_CELLS, _TYPES, _DATES, _COMPANY, _BY_TYPE,
        f"item_counts AS (SELECT doc, {_COUNTS} FROM row_features GROUP BY doc)",
        "date_counts AS (SELECT doc, count(*) AS n_dates FROM dates GROUP BY doc)",
        "numbers AS (SELECT doc, count(*) AS n_values, max(cleaned_value) AS largest, min(cleaned_value) AS smallest FROM money GROUP BY doc)",
        """sums AS (SELECT doc, string_agg(metric, '|' ORDER BY metric) AS metric_names, round(sum(value), 2) AS metric_total
          FROM type_metrics WHERE value IS NOT NULL GROUP BY doc)""",
        select="""SELECT d.doc, document_type, company_name, metric_names, metric_total,
            coalesce(balance_sheet_items, 0) AS balance_sheet_items, coalesce(income_statement_items, 0) AS income_statement_items,
            coalesce(cash_flow_items, 0) AS cash_flow_items, coalesce(key_metric_rows, 0) AS key_metric_rows,
            coalesce(n_dates, 0) AS n_dates, coalesce(n_values, 0) AS n_values, largest, smallest,
            CASE WHEN document_type IS NULL THEN 'failed' ELSE 'success' END AS status,
            CASE WHEN document_type IS NULL THEN 'file is empty after cleaning' END AS error
          FROM (SELECT 'C' || c_custkey AS doc FROM customer UNION ALL SELECT 'S' || s_suppkey FROM supplier) d
          LEFT JOIN types USING (doc) LEFT JOIN companies USING (doc) LEFT JOIN sums USING (doc)
          LEFT JOIN item_counts USING (doc) LEFT JOIN date_counts USING (doc) LEFT JOIN numbers USING (doc)""",
    ),
    "null_tokens": with_sql(DOCUMENT_CELLS, select="SELECT doc, row_idx, col, cell FROM doc_cells"),
    "document_type": with_sql(DOCUMENT_CELLS, _TYPES, select="SELECT * FROM types"),
    "company_name": with_sql(DOCUMENT_CELLS, _COMPANY, select="SELECT * FROM companies"),
    "document_dates": with_sql(DOCUMENT_CELLS, _DATES, select="SELECT * FROM dates"),
    "balance_sheet_items": _items_sql("balance_sheet"),
    "income_statement_items": _items_sql("income_statement"),
    "cash_flow_items": _items_sql("cash_flow"),
    "key_metric_rows": _items_sql("key_metrics"),
    "monetary_cells": with_sql(
        DOCUMENT_CELLS,
        select="""SELECT doc, row_idx AS row, col, token, raw_value, cleaned_value,
          contains(raw_value, '(') OR contains(raw_value, '-') AS is_negative FROM money""",
    ),
    "metrics_by_type": with_sql(DOCUMENT_CELLS, _TYPES, _BY_TYPE, select="SELECT * FROM type_metrics"),
    **{
        f"metrics_{kind}": with_sql(DOCUMENT_CELLS, select=f"SELECT doc, metric, value FROM ({_metric_select(kind)})")
        for kind in V.METRIC_RULES
    },
    "batch_stats": with_sql(
        DOCUMENT_CELLS, _TYPES,
        """results AS (SELECT doc, document_type IS NOT NULL AS ok
          FROM (SELECT 'C' || c_custkey AS doc FROM customer UNION ALL SELECT 'S' || s_suppkey FROM supplier) LEFT JOIN types USING (doc))""",
        select="""SELECT count(*) AS total_files, count_if(ok) AS successful, count_if(NOT ok) AS failed,
          round(count_if(ok) / count(*) * 100, 6) AS success_rate FROM results""",
    ),
    "first_failed_documents": with_sql(
        DOCUMENT_CELLS, _TYPES,
        """missing AS (SELECT doc FROM (SELECT 'C' || c_custkey AS doc FROM customer UNION ALL SELECT 'S' || s_suppkey FROM supplier)
          WHERE doc NOT IN (SELECT doc FROM types WHERE document_type IS NOT NULL))""",
        select="""SELECT CAST(row_number() OVER (ORDER BY doc) AS INTEGER) AS rank, doc, 'file is empty after cleaning' AS error,
            greatest((SELECT count(*) FROM missing) - 10, 0) AS n_more
          FROM missing QUALIFY rank <= 10""",
    ),
    "document_stats": with_sql(
        DOCUMENT_CELLS, _DATES,
        f"items AS (SELECT *, statement || ' ' || rank || ' ' || item || ' @' || row_index AS listed FROM ({_FIRST_ITEMS})),"
        """
        first_dates AS (SELECT * FROM dates QUALIFY row_number() OVER (PARTITION BY doc ORDER BY date_text) <= 3),
        numbers AS (SELECT doc, count(*) AS n_values, max(cleaned_value) AS largest, min(cleaned_value) AS smallest FROM money GROUP BY doc),
        firsts AS (SELECT doc, count(*) AS n_items, string_agg(listed, '|' ORDER BY listed) AS first_items FROM items GROUP BY doc),
        days AS (SELECT doc, string_agg(date_text, '|' ORDER BY date_text) AS dates FROM first_dates GROUP BY doc)""",
        select="SELECT * FROM numbers LEFT JOIN firsts USING (doc) LEFT JOIN days USING (doc)",
    ),
    "document_first_items": with_sql(
        DOCUMENT_CELLS,
        select=_FIRST_ITEMS,
    ),
    "document_type_counts": with_sql(
        DOCUMENT_CELLS, _TYPES, select="SELECT document_type, count(*) AS count FROM types GROUP BY ALL"
    ),
}
