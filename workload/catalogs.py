"""Sources, column operators, joins and sorts over the catalogue built from orders."""

from pyspark.sql import functions as F

from filingforge.operators import columns as column_ops
from filingforge.operators import stats
from filingforge.operators import wide
from filingforge.operators.staging import new_folder, with_once
from filingforge.sources import committed
from filingforge.sources import files as file_ops
from workload.inputs import (
    CANDIDATES, CATALOG, DOCUMENT_CELLS, FEATURES, FILES, KEYWORD_WIDE, METRICS, TERMS, candidates, catalog,
    document_rows, features, files, keyword_wide, metrics, table, with_sql,
)

_CATALOG_COLUMNS = [
    "symbol", "url", "volume", "day", "ipo_date", "open", "close", "diff", "public_price_per_share", "price_public_total",
]
_WORDS = ["Ring", "Blue", "Gea"]
_BATCH = 500

# ---------------------------------------------------------------- sources and sinks


def scan_catalog(spark, sf_dir):
    """Catalogue exported as CSV with header and read back with its schema."""
    path = new_folder(spark, "catalog-csv")
    file_ops.export_csv(catalog(spark, sf_dir).select(*_CATALOG_COLUMNS), path)
    return file_ops.read_catalog(spark, path)


def scan_grid_headerless(spark, sf_dir):
    """Rows of ten customers at a time written as one headerless CSV file and read back."""
    path = new_folder(spark, "grids")
    group = F.floor(F.substring("doc", 2, 20).cast("long") / 10).cast("string")
    rows = with_once(document_rows(spark, sf_dir), {"doc": group, "cells": F.col("cells")})
    rows.select("doc", "row_idx", *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(4)]).where(
        "coalesce(c0, c1, c2, c3) is not null"
    ).repartition("doc").sortWithinPartitions("doc", "row_idx").drop("row_idx").write.partitionBy("doc").csv(
        path, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    # A file has no name of its own here; its first cell with the place makes its rows comparable.
    cells = F.array_join("cells", "|", "<null>")
    return file_ops.read_grids(spark, f"{path}/*").select("row_idx", cells.alias("cells"))


def resolve_first_source(spark, sf_dir):
    return file_ops.resolve_first_source(catalog(spark, sf_dir), candidates(spark, sf_dir))


def file_semi_join(spark, sf_dir):
    """Catalogue rows with a file, and those without."""
    rows, found = catalog(spark, sf_dir), files(spark, sf_dir)
    kept = file_ops.file_semi_join(rows, found).withColumn("exists", F.lit(True))
    missing = file_ops.file_semi_join(rows, found, missing=True).withColumn("exists", F.lit(False))
    return kept.unionByName(missing).select("symbol", "file_name", "exists")


def scan_dir_union(spark, sf_dir):
    """Order files of two periods with different columns in one folder, read as one table."""
    path = new_folder(spark, "folder")
    orders = table(spark, sf_dir, "orders")
    early, late = F.col("o_orderdate") < "1998-01-01", F.col("o_orderdate") >= "1998-01-01"
    orders.where(early).select("o_orderkey", "o_totalprice").write.parquet(path)
    orders.where(late).select("o_orderstatus", "o_orderkey", "o_custkey").write.mode("append").parquet(path)
    return file_ops.read_folder(spark, path).select("o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey")


def scan_csv_folder(spark, sf_dir):
    """Order files with different headers in one folder of CSV files, aligned by name in long form."""
    path = new_folder(spark, "csv-folder")
    orders = table(spark, sf_dir, "orders")
    early, late = F.col("o_orderdate") < "1998-01-01", F.col("o_orderdate") >= "1998-01-01"
    orders.where(early).select("o_orderkey", "o_orderpriority").write.csv(path, header=True)
    orders.where(late).select("o_orderstatus", "o_orderkey", "o_custkey").write.mode("append").csv(path, header=True)
    names = ["o_orderkey", "o_orderpriority", "o_orderstatus", "o_custkey"]
    cells = file_ops.read_folder_long(spark, path)
    return cells.groupBy("file_name", "row_no").agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in names]).select(*names)


def sink_tables(spark, sf_dir):
    """Metrics written as Parquet by a coarse column and read back."""
    path = new_folder(spark, "metrics-table")
    file_ops.write_table(metrics(spark, sf_dir), path, ["metric"])
    return spark.read.parquet(path).select("filing", "metric", "value")


def sink_written_again(spark, sf_dir):
    """Metrics written by a coarse column; then half of them again with other values, twice, and once without a commit,
    as a killed job leaves it."""
    path = new_folder(spark, "metrics-again")
    rows = metrics(spark, sf_dir)
    committed.write_table_again(rows, path, ["metric"])
    again = rows.where("metric like '%trend'").withColumn("value", F.col("value") * 2)
    for _ in range(2):
        committed.write_table_again(again, path, ["metric"])
    committed.write_version(rows.withColumn("value", F.lit(0.0)), path, ["metric"])
    return committed.read_committed(spark, path).select("filing", "metric", "value")


def scan_growing_folder(spark, sf_dir):
    """Order files of three periods, added to one folder one after the other and read as they come."""
    source, target = new_folder(spark, "growing"), new_folder(spark, "grown")
    orders = table(spark, sf_dir, "orders")
    period = F.when(F.col("o_orderdate") < "1996-01-01", 0).when(F.col("o_orderdate") < "1998-01-01", 1).otherwise(2)
    headers = [["o_orderkey", "o_orderpriority"], ["o_orderstatus", "o_orderkey"], ["o_custkey", "o_orderkey"]]
    for n, names in enumerate(headers):
        orders.where(period == n).select(*names).write.mode("append").csv(source, header=True)
        committed.add_new_files(spark, source, target)
    committed.add_new_files(spark, source, target)  # nothing is new
    cells = committed.read_added(spark, target)
    names = ["o_orderkey", "o_orderpriority", "o_orderstatus", "o_custkey"]
    return cells.groupBy("file_name", "row_no").agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in names]).select(*names)


# ---------------------------------------------------------------- columns and rows


def project_columns(spark, sf_dir):
    return column_ops.project_columns(catalog(spark, sf_dir), ["symbol", "url", "public_price_per_share"])


def drop_columns(spark, sf_dir):
    return column_ops.drop_columns(catalog(spark, sf_dir), ["day", "ipo_date", "status", "no_such_column"])


def drop_columns_from_table(spark, sf_dir):
    rows = features(spark, sf_dir)
    return column_ops.drop_listed_elements(rows, stats.low_support_columns(rows, _LOW))


def drop_columns_containing(spark, sf_dir):
    return column_ops.drop_elements_containing(features(spark, sf_dir), _WORDS)


def add_constants(spark, sf_dir):
    first = wide.distinct_on(catalog(spark, sf_dir), ["symbol"], [F.col("position")])
    return column_ops.add_constants(features(spark, sf_dir), first, ["volume", "day", "diff"])


def lowercase_columns(spark, sf_dir):
    rows = keyword_wide(spark, sf_dir).select("symbol", *[F.col(t).alias(t.title()) for t in TERMS])
    return column_ops.lowercase_columns(rows)


def batch_slice(spark, sf_dir):
    rows = catalog(spark, sf_dir).withColumn("file_name", F.substring_index("url", "/", -1))
    batches = column_ops.sized_batches(rows, files(spark, sf_dir), _BATCH, "position", ["symbol", "file_name"])
    return batches.select("batch", "symbol", "file_name")


# ---------------------------------------------------------------- joins, unions, sorts


def inner_join_symbol(spark, sf_dir):
    """Sums per customer joined with the catalogue; `diff` is on both sides."""
    sums = metrics(spark, sf_dir).groupBy(F.col("filing").alias("symbol")).agg(F.count(F.lit(1)).cast("double").alias("diff"))
    return wide.merge_on(sums, catalog(spark, sf_dir).select("symbol", "diff", "position"), ["symbol"])


def left_join_multi_key(spark, sf_dir):
    rows = catalog(spark, sf_dir).select(
        F.col("symbol").alias("Symbol"), F.when(F.col("position") % 5 != 0, F.col("price_public_total")).alias("Price_Public_Total"),
        F.col("public_price_per_share").alias("Public_Price_Per_Share"), F.col("position").alias("Id"),
    )
    prices = catalog(spark, sf_dir).select("symbol", "public_price_per_share", "price_public_total", "url", "ipo_date")
    return wide.merge_on(column_ops.lowercase_columns(rows), prices, ["symbol", "price_public_total"], "left")


def coalesce_like_terms(spark, sf_dir):
    return wide.coalesce_like_terms(metrics(spark, sf_dir))


def union_by_name(spark, sf_dir):
    rows = catalog(spark, sf_dir)
    return wide.union_by_name(
        rows.where("status = 'F'").select("symbol", "open", "position"), rows.where("status = 'O'").select("close", "symbol", "position"),
        rows.where("status = 'P'").select("position", "day"),
    )


def hconcat(spark, sf_dir):
    """Orders beside line prices by position; the two have different lengths."""
    left = catalog(spark, sf_dir).where("status != 'O'").select("symbol", F.col("position").alias("order_no"))
    right = catalog(spark, sf_dir).where("status = 'O'").select("url", F.col("position").alias("other_no"))
    return wide.hconcat(left, right, "order_no", "other_no")


def distinct_on(spark, sf_dir):
    rows = catalog(spark, sf_dir).select("symbol", "url", "public_price_per_share", "position")
    return wide.distinct_on(rows, ["symbol"], [F.col("position")])


def largest_diffs(spark, sf_dir):
    rows = catalog(spark, sf_dir).select("symbol", "day", "close", "volume", "diff", "position")
    return stats.largest_diffs(rows, ["day", "close", "volume"])


def top_k(spark, sf_dir):
    rows = catalog(spark, sf_dir).select("symbol", "open", "position")
    return stats.top_k(rows, ["symbol"], [F.desc("open"), F.col("position")], 3)


_LOW = 400

QUERIES = {
    "scan_catalog": scan_catalog,
    "scan_grid_headerless": scan_grid_headerless,
    "resolve_first_source": resolve_first_source,
    "file_semi_join": file_semi_join,
    "scan_dir_union": scan_dir_union,
    "scan_csv_folder": scan_csv_folder,
    "sink_tables": sink_tables,
    "sink_written_again": sink_written_again,
    "scan_growing_folder": scan_growing_folder,
    "project_columns": project_columns,
    "drop_columns": drop_columns,
    "drop_columns_from_table": drop_columns_from_table,
    "drop_columns_containing": drop_columns_containing,
    "add_constants": add_constants,
    "lowercase_columns": lowercase_columns,
    "batch_slice": batch_slice,
    "inner_join_symbol": inner_join_symbol,
    "left_join_multi_key": left_join_multi_key,
    "coalesce_like_terms": coalesce_like_terms,
    "union_by_name": union_by_name,
    "hconcat": hconcat,
    "distinct_on": distinct_on,
    "largest_diffs": largest_diffs,
    "top_k": top_k,
}

ORACLE = {
    "scan_catalog": with_sql(CATALOG, select=f"SELECT {', '.join(_CATALOG_COLUMNS)} FROM catalog"),
    "scan_grid_headerless": with_sql(
        DOCUMENT_CELLS.split("full_cols AS")[0].rstrip().rstrip(","),
        """numbered AS (
          SELECT doc, dense_rank() OVER (PARTITION BY doc ORDER BY rid) - 1 AS row_idx, cell, pos
          FROM (SELECT floor(CAST(doc[2:] AS BIGINT) / 10) AS doc, rid, cell, pos FROM raw_cells JOIN full_rows USING (doc, rid)))""",
        select="""SELECT row_idx, string_agg(coalesce(nullif(nullif(cell, 'N/A'), ''), '<null>'), '|' ORDER BY pos) AS cells
          FROM numbered GROUP BY doc, row_idx""",
    ),
    "resolve_first_source": with_sql(
        CATALOG, FILES, CANDIDATES,
        select="SELECT symbol, file_name, arg_min(parent, priority) AS parent FROM candidates GROUP BY ALL",
    ),
    "file_semi_join": with_sql(
        CATALOG, select="""SELECT symbol, regexp_extract(url, '[^/]*$') AS file_name, status <> 'P' AS "exists" FROM catalog"""
    ),
    "scan_dir_union": """SELECT o_orderkey, o_totalprice, NULL::VARCHAR AS o_orderstatus, NULL::BIGINT AS o_custkey
        FROM orders WHERE o_orderdate < DATE '1998-01-01'
      UNION ALL SELECT o_orderkey, NULL, o_orderstatus, o_custkey FROM orders WHERE o_orderdate >= DATE '1998-01-01'""",
    "scan_csv_folder": """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN early THEN o_orderpriority END AS o_orderpriority,
        CASE WHEN NOT early THEN o_orderstatus END AS o_orderstatus, CASE WHEN NOT early THEN CAST(o_custkey AS VARCHAR) END AS o_custkey
      FROM (SELECT *, o_orderdate < DATE '1998-01-01' AS early FROM orders)""",
    "sink_tables": with_sql(METRICS, select="SELECT filing, metric, value FROM metrics"),
    "sink_written_again": with_sql(
        METRICS, select="SELECT filing, metric, CASE WHEN metric LIKE '%trend' THEN 2 * value ELSE value END AS value FROM metrics"
    ),
    "scan_growing_folder": """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN period = 0 THEN o_orderpriority END AS o_orderpriority,
        CASE WHEN period = 1 THEN o_orderstatus END AS o_orderstatus, CASE WHEN period = 2 THEN CAST(o_custkey AS VARCHAR) END AS o_custkey
      FROM (SELECT *, CASE WHEN o_orderdate < DATE '1996-01-01' THEN 0 WHEN o_orderdate < DATE '1998-01-01' THEN 1 ELSE 2 END AS period FROM orders)""",
    "project_columns": with_sql(CATALOG, select="SELECT symbol, url, public_price_per_share FROM catalog"),
    "drop_columns": with_sql(CATALOG, select="SELECT * EXCLUDE (day, ipo_date, status) FROM catalog"),
    "drop_columns_from_table": with_sql(
        FEATURES,
        select=f"""SELECT element, symbol, kind, value FROM features WHERE element NOT IN (
          SELECT element FROM features GROUP BY element HAVING count(value) <= {_LOW})""",
    ),
    "drop_columns_containing": with_sql(
        FEATURES, select="SELECT * FROM features WHERE NOT (" + " OR ".join(f"contains(element, '{w}')" for w in _WORDS) + ")"
    ),
    "add_constants": with_sql(
        CATALOG, FEATURES,
        "firsts AS (SELECT * FROM catalog QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY position) = 1)",
        select="SELECT symbol, element, kind, value, volume, day, diff FROM features JOIN firsts USING (symbol)",
    ),
    "lowercase_columns": with_sql(KEYWORD_WIDE, select="SELECT * EXCLUDE diff FROM keyword_wide"),
    "batch_slice": with_sql(
        CATALOG, FILES,
        """numbered AS (SELECT symbol, regexp_extract(url, '[^/]*$') AS file_name, status,
          row_number() OVER (ORDER BY position) - 1 AS i FROM catalog)""",
        "existing AS (SELECT * FROM numbered WHERE status <> 'P')",
        f"""batches AS (SELECT CAST(n AS INTEGER) AS batch, n * {_BATCH} AS lo, (n + 1) * {_BATCH} AS hi,
          (SELECT min(e.i) FROM existing e WHERE e.i >= (n + 1) * {_BATCH}) AS extra
          FROM range((SELECT CAST(ceil(count(*) / {_BATCH}) AS BIGINT) FROM orders)) t(n))""",
        select="""SELECT batch, symbol, file_name FROM existing, batches
          WHERE (i >= lo AND i < hi) OR i = extra""",
    ),
    "inner_join_symbol": with_sql(
        CATALOG, METRICS,
        "sums AS (SELECT filing AS symbol, CAST(count(*) AS DOUBLE) AS diff FROM metrics GROUP BY ALL)",
        select="SELECT c.symbol, s.diff AS diff_x, c.diff AS diff_y, position FROM sums s JOIN catalog c ON s.symbol = c.symbol",
    ),
    "left_join_multi_key": with_sql(
        CATALOG,
        """l AS (SELECT symbol, CASE WHEN position % 5 <> 0 THEN price_public_total END AS price_public_total,
          public_price_per_share AS public_price_per_share_x, position AS id FROM catalog)""",
        select="""SELECT l.*, c.public_price_per_share AS public_price_per_share_y, c.url, c.ipo_date FROM l LEFT JOIN catalog c
          ON l.symbol = c.symbol AND l.price_public_total IS NOT DISTINCT FROM c.price_public_total""",
    ),
    "coalesce_like_terms": with_sql(
        METRICS,
        select="""SELECT filing, metric, value FROM metrics
          UNION ALL SELECT filing, 'cash_trend', value FROM metrics m WHERE metric = 'cash_and_cash_equivalents_trend'
            AND NOT EXISTS (SELECT 1 FROM metrics x WHERE x.filing = m.filing AND x.metric = 'cash_trend')
          UNION ALL SELECT filing, 'total_shareholders_equity_recent', value FROM metrics m
            WHERE metric = 'total_stockholders_equity_recent'
            AND NOT EXISTS (SELECT 1 FROM metrics x WHERE x.filing = m.filing AND x.metric = 'total_shareholders_equity_recent')""",
    ),
    "union_by_name": with_sql(
        CATALOG,
        select="""SELECT symbol, open, position, NULL::DOUBLE AS close, NULL::DATE AS day FROM catalog WHERE status = 'F'
          UNION ALL SELECT symbol, NULL, position, close, NULL FROM catalog WHERE status = 'O'
          UNION ALL SELECT NULL, NULL, position, NULL, day FROM catalog WHERE status = 'P'""",
    ),
    "hconcat": with_sql(
        CATALOG,
        "l AS (SELECT symbol, position AS order_no, row_number() OVER (ORDER BY position) - 1 AS p FROM catalog WHERE status <> 'O')",
        "r AS (SELECT url, position AS other_no, row_number() OVER (ORDER BY position) - 1 AS p FROM catalog WHERE status = 'O')",
        select="SELECT coalesce(l.p, r.p) AS position, symbol, order_no, url, other_no FROM l FULL JOIN r ON l.p = r.p",
    ),
    "distinct_on": with_sql(
        CATALOG,
        select="""SELECT symbol, url, public_price_per_share, position FROM catalog
          QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY position) = 1""",
    ),
    "largest_diffs": with_sql(CATALOG, select="SELECT symbol, diff, position FROM catalog ORDER BY diff DESC"),
    "top_k": with_sql(
        CATALOG,
        select="""SELECT symbol, open, position, row_number() OVER (PARTITION BY symbol ORDER BY open DESC, position) AS rank
          FROM catalog QUALIFY rank <= 3""",
    ),
}
