"""Grid documents to one classified summary row each."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingforge import vocabulary as V
from filingforge.operators import statements as S
from filingforge.operators.staging import stage


def analyze_documents(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per document of `documents` (doc): status, type, company, counts and metrics.

    `key_metrics` are those of the document's type; `key_metric_rows` counts the matching lines,
    which stay a separate result. A document without cells fails.
    """
    cleaned = stage(S.clean_documents(rows), "documents")
    features = stage(S.row_features(cleaned), "row-features")
    types = S.document_type(cleaned)
    metrics = (
        S.metrics_by_type(features, types).where("value is not null")
        .groupBy("doc")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("key_metrics"))
    )
    counts = S.line_items(features).groupBy("doc").agg(
        *[
            F.count_if(F.col("statement") == s).alias("key_metric_rows" if s == "key_metrics" else f"{s}_items")
            for s in V.STATEMENT_TERMS
        ]
    )
    dates = S.document_date_list(cleaned).groupBy("doc").agg(F.count(F.lit(1)).alias("n_dates"))
    result = documents.select("doc").distinct()
    for part in (types, S.company_name(cleaned), metrics, counts, dates, S.document_stats(S.monetary_cells(cleaned))):
        result = result.join(part, "doc", "left")
    failed = F.col("document_type").isNull()
    numbers = ["balance_sheet_items", "income_statement_items", "cash_flow_items", "key_metric_rows", "n_dates", "n_values"]
    return result.fillna(0, subset=numbers).withColumns(
        {
            "status": F.when(failed, "failed").otherwise("success"),
            "error": F.when(failed, "file is empty after cleaning"),
        }
    )
