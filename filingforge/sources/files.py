"""Files in and out."""

import os
import uuid
from functools import reduce
from itertools import groupby

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingforge.functions.labels import url_basename
from filingforge.operators.staging import listed_in_few_tasks, stage
from filingforge.vocabulary import READER_NULLS

CATALOG_SCHEMA = (
    "symbol string, url string, volume double, day date, ipo_date date, open double, close double, "
    "diff double, public_price_per_share double, price_public_total double"
)


def read_catalog(spark: SparkSession, path: str, schema: str = CATALOG_SCHEMA) -> DataFrame | None:
    """Catalogue CSV with header; None when there is no such file. Tickers such as `NA` stay text."""
    try:
        return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', enforceSchema=False)
    except AnalysisException:
        return None


def _file_columns() -> list[Column]:
    parts = F.split(F.col("_metadata.file_path"), "/")
    return [F.url_decode(F.element_at(parts, -2)).alias("symbol"), F.url_decode(F.element_at(parts, -1)).alias("file_name")]


def read_filings(spark: SparkSession, root: str) -> DataFrame:
    """(symbol, file_name, html) for every `<root>/<symbol>/<file>`, line ends as in text mode."""
    with listed_in_few_tasks(spark):
        pages = spark.read.text(f"{root}/*/*", wholetext=True)
    return pages.select(*_file_columns(), F.regexp_replace("value", "\r\n?", "\n").alias("html"))


def _opened_by_tasks(spark: SparkSession, root: str) -> str | None:
    """`root` as a path that Python opens, where Spark takes it for one of the local or mounted file system; else None."""
    scheme, colon, rest = root.partition(":")
    if not colon or "/" in scheme:
        scheme, rest = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").partition(":")[0], root
    return "/" + rest.lstrip("/") if scheme == "file" and rest.startswith("/") else None


def write_filings(filings: DataFrame, root: str) -> str:
    """Write (symbol, name, html) as one file per symbol and name, each row ended by a line end; gives the root for `read_filings`.

    Spark's writer takes a folder for each file. On local or mounted file systems Hadoop, where its native library is missing,
    starts processes to set the permissions of the two, which takes many times longer than writing a page. There the tasks write
    `<root>/symbol=<symbol>/name=<name>` themselves. A task that runs again replaces its files, each as a whole. In any other store
    Spark writes `<root>/symbol=<symbol>/name=<name>/<file>`.
    """
    folder = _opened_by_tasks(filings.sparkSession, root)
    if folder is None:
        filings.select("symbol", "name", "html").repartition("symbol", "name").write.partitionBy("symbol", "name").text(root)
        return f"{root}/*"

    def write(rows):
        made = set()
        for (symbol, name), same in groupby(rows, lambda row: (row["symbol"], row["name"])):
            if symbol not in made:
                os.makedirs(f"{folder}/symbol={symbol}", exist_ok=True)
                made.add(symbol)
            unfinished = f"{folder}/symbol={symbol}/.{uuid.uuid4().hex}"
            with open(unfinished, "wb") as file:
                for row in same:
                    file.write(row["html"] or b"")
                    file.write(b"\n")
            os.replace(unfinished, f"{folder}/symbol={symbol}/name={name}")

    def as_file_name(c: str) -> Column:
        return F.replace(F.url_encode(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))), F.lit("+"), F.lit("%20"))

    named = filings.select(as_file_name("symbol").alias("symbol"), as_file_name("name").alias("name"), F.col("html").cast("binary").alias("html"))
    named.repartition("symbol", "name").sortWithinPartitions("symbol", "name").foreachPartition(write)
    return root


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(symbol, file_name) of every `<root>/<symbol>/<file>`; contents are not read."""
    with listed_in_few_tasks(spark):
        return spark.read.format("binaryFile").load(f"{root}/*/*").select(*_file_columns())


def candidate_files(spark: SparkSession, base: str, parents: list[str]) -> DataFrame:
    """(parent, priority, symbol, file_name) of the files under `<base>/<parent>`, best parent first."""
    listed = [
        list_files(spark, f"{base}/{parent}").select(F.lit(parent).alias("parent"), F.lit(n).alias("priority"), "symbol", "file_name")
        for n, parent in enumerate(parents)
    ]
    return reduce(DataFrame.union, listed)


def file_semi_join(catalog: DataFrame, files: DataFrame, missing: bool = False) -> DataFrame:
    """Catalogue rows whose (symbol, file_name) exists, or those for which it does not."""
    named = catalog.withColumn("file_name", url_basename(F.col("url")))
    return named.join(files.select("symbol", "file_name"), ["symbol", "file_name"], "left_anti" if missing else "left_semi")


def resolve_first_source(catalog: DataFrame, candidates: DataFrame) -> DataFrame:
    """(symbol, file_name, parent): for each catalogued file the parent of best priority.

    `candidates` is (parent, priority, symbol, file_name). Combined map-side, no sort.
    """
    wanted = catalog.select("symbol", url_basename(F.col("url")).alias("file_name")).distinct()
    best = candidates.groupBy("symbol", "file_name").agg(F.min_by("parent", "priority").alias("parent"))
    return best.join(wanted, ["symbol", "file_name"])


def csv_records(text: Column) -> Column:
    """Array of the records of a CSV text; line ends inside quotes do not split, blank lines go."""
    plain = F.regexp_replace(text, "\r\n?", "\n")
    records = F.regexp_extract_all(plain, F.lit(r'(?:[^"\n]++|"(?:[^"]++|"")*+"|")++'), F.lit(0))
    return F.filter(records, lambda r: ~r.rlike(r"^[ \t]*$"))


def csv_cells(record: Column) -> Column:
    """Array of the cells of a CSV record, unquoted; an empty cell is null."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(r',("(?:[^"]++|"")*+"|[^,]*+)'), F.lit(1))

    def value(c: Column) -> Column:
        inner = F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
        return F.nullif(F.when(c.startswith('"') & (F.length(c) > 1), inner).otherwise(c), F.lit(""))

    return F.transform(raw, value)


def csv_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, row_idx, record) of the records of CSV files, which may be of any size.

    A file is read in byte ranges. A range does not know whether it begins inside quotes, so it works out both cases: the
    quotes before every line, and how many records begin under either. Parities and counts of the ranges of a file, one row
    each, then settle which case holds. Lines of a record that runs over line ends are put together; all others stay where
    they are. Blank records go. A quote that is never closed runs to the end of its file.

    A file that is not valid UTF-8 throughout is read as Latin-1.
    """
    with listed_in_few_tasks(spark):
        lines = spark.read.text(path)
    lines = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"),  # places rise within a range
    )
    quotes = F.octet_length("line") - F.octet_length(F.replace("line", F.lit('"')))
    lines = stage(
        lines.withColumns({"odd": quotes % 2, "blank": F.col("line").rlike(r"^[ \t]*$"), "valid": F.try_validate_utf8("line").isNotNull()}), "lines"
    )
    own = W.partitionBy("file", "range").orderBy("place")
    before = F.coalesce(F.sum("odd").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) % 2
    begins = {f"begun{k}": F.when((F.col("before") == k) & ~F.col("blank"), 1).otherwise(0) for k in (0, 1)}
    lines = lines.withColumn("before", before).withColumns(begins)
    lines = stage(lines.withColumns({f"upto{k}": F.sum(f"begun{k}").over(own) for k in (0, 1)}), "lines")
    ranges = lines.groupBy("file", "range").agg(
        *[F.sum(c).alias(c) for c in ("odd", "begun0", "begun1")], F.bool_and("valid").alias("valid")
    )
    earlier = W.partitionBy("file").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2
    ranges = ranges.withColumn("inside", inside).withColumn("n", F.when(F.col("inside") == 0, F.col("begun0")).otherwise(F.col("begun1")))
    ranges = ranges.select(
        "file", "range", "inside", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("records"),
        F.bool_and("valid").over(W.partitionBy("file")).alias("valid"),
    )
    placed = lines.drop("valid").join(stage(ranges, "ranges"), ["file", "range"])
    upto = F.when(F.col("inside") == 0, F.col("upto0")).otherwise(F.col("upto1"))
    open_ = (F.col("inside") + F.col("before")) % 2 == 1
    text = F.when(F.col("valid"), F.col("line")).otherwise(F.decode(F.col("line").cast("binary"), "ISO-8859-1"))
    placed = placed.select(
        "file", "range", "place", "blank", (F.col("records") + upto - 1).cast("long").alias("row_idx"), text.alias("record"),
        open_.alias("open"), (open_ | (F.col("odd") == 1)).alias("several"),
    )
    alone = placed.where("not several and not blank").select("file", "row_idx", "record")
    parts = placed.where("several").groupBy("file", "row_idx").agg(F.array_sort(F.collect_list(F.struct("range", "place", "record"))).alias("parts"))
    return alone.union(parts.select("file", "row_idx", F.array_join("parts.record", "\n").alias("record")))


def read_grids(spark: SparkSession, path: str) -> DataFrame:
    """(doc, row_idx, cells) of headerless CSV files, one document per file of any size. Cells that spell a null are null."""
    doc = F.regexp_extract(F.url_decode(F.element_at(F.split("file", "/"), -1)), r"^(.*?)(?:\.csv)?$", 1)
    cells = F.transform(csv_cells(F.col("record")), lambda c: F.when(~c.isin(READER_NULLS), c))
    return csv_lines(spark, path).select(doc.alias("doc"), "row_idx", cells.alias("cells"))


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet files of a folder stacked, columns aligned by name, missing ones null."""
    return spark.read.option("mergeSchema", True).parquet(path)


def long_cells(lines: DataFrame) -> DataFrame:
    """(path, file_name, row_no, column, value) of the records (file, row_idx, record) of files with a header each."""
    path = F.regexp_replace(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))), "^[a-z]+:/*", "/")
    lines = lines.select("file", path.alias("path"), "row_idx", csv_cells(F.col("record")).alias("cells"))
    names = lines.where("row_idx = 0").select("file", F.col("cells").alias("names"))
    rows = lines.where("row_idx > 0").join(names, "file")
    cells = F.arrays_zip(F.col("names").alias("column"), F.col("cells").alias("value"))
    file_name = F.element_at(F.split("path", "/"), -1).alias("file_name")
    return rows.select("path", file_name, F.col("row_idx").alias("row_no"), F.inline(cells)).where("column is not null")


def read_folder_long(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, row_no, column, value) of CSV files whose headers differ.

    Aligning by name in long form needs no common schema and no list of headers on the driver.
    """
    return long_cells(csv_lines(spark, path)).drop("path")


def read_word_list(spark: SparkSession, path: str) -> list[str]:
    """Words of a small text file, one per line, for operators that take a list."""
    return [row["value"] for row in spark.read.text(path).where("trim(value) != ''").collect()]


def write_table(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    """Step output as Parquet, partitioned by coarse columns only."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Final export with header; nested columns as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = [
        F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    df.select(*flat).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')
