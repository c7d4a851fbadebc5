"""Filing pages to feature rows, and their association with the first-day price change."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingforge import vocabulary as V
from filingforge.operators.columns import drop_elements_containing, drop_listed_elements
from filingforge.operators.features import (
    KINDS, banks_in_context, banks_in_table, keyword_pairs, person_pairs, suffix_duplicates,
)
from filingforge.operators.html import strip_tags, table_texts
from filingforge.operators.stats import low_support_columns, mean_difference_by_sign


def filing_features(
    pages: DataFrame, terms=V.TARGET_KEYWORDS, banks=V.UNDERWRITERS, denied_names=()
) -> DataFrame:
    """(symbol, element, value, kind) of (symbol, html) pages, duplicate names suffixed.

    A page is one row, so its features are found in one pass without a shuffle; only the
    suffixes group the (small) feature rows.
    """
    parsed = pages.select(
        "symbol", F.lower("html").alias("markup"), strip_tags(F.col("html")).alias("text"),
        table_texts(F.col("html")).alias("tables"),
    ).withColumn("lower_text", F.lower("text"))
    in_tables = F.flatten(F.transform("tables", lambda t: banks_in_table(F.lower(t), banks)))
    named = F.array_distinct(F.concat(in_tables, banks_in_context(F.col("markup"), banks)))
    underwriters = F.transform(named, lambda n: F.struct(n.alias("element"), F.lit(1).cast("long").alias("value")))
    found = [keyword_pairs(F.col("lower_text"), terms), person_pairs(F.col("text"), denied_names), underwriters]

    def of_kind(pairs, kind):
        return F.transform(pairs, lambda p: F.struct(p["element"].alias("element"), p["value"].alias("value"), F.lit(kind).alias("kind")))

    rows = F.concat(*map(of_kind, found, KINDS))
    return suffix_duplicates(parsed.select("symbol", F.inline(rows)))


def feature_association(
    features: DataFrame, catalog: DataFrame, denied_words=(), max_count: int = 6
) -> DataFrame:
    """Mean difference by sign of `diff` for features that are frequent and not denied."""
    if denied_words:
        features = drop_elements_containing(features, list(denied_words))
    frequent = drop_listed_elements(features, low_support_columns(features, max_count))
    joined = frequent.join(catalog.select("symbol", "diff"), "symbol")
    return mean_difference_by_sign(joined.select(F.col("element").alias("column"), "value", "diff"))
