"""Tables whose writes can be repeated, and folders that are read file by file as they grow.

Data are written under a version of their own and count only once a commit names it; commits are written last. A job that
is killed or run again leaves data that nothing names, never a second copy. One writer at a time.
"""

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingforge.operators.staging import stage
from filingforge.sources.files import csv_lines, long_cells


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/commits")
    except AnalysisException:  # nothing was committed yet
        return None


def _next_number(commits: DataFrame | None) -> int:
    return 1 + ((commits.agg(F.max("number")).first()[0] or 0) if commits is not None else 0)


def write_version(df: DataFrame, path: str, partition_by: list[str] = ()) -> str:
    """Write `df` under a new version, which nothing reads before it is committed. Rows are rebalanced by the partition
    columns: a hot partition gets several files, a small one a single file, of about
    spark.sql.adaptive.advisoryPartitionSizeInBytes before compression."""
    version = uuid.uuid4().hex
    writer = df.hint("rebalance", *partition_by).write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/data/version={version}")
    return version


def commit_version(spark: SparkSession, path: str, version: str, schema: T.StructType, partition_by: list[str] = ()) -> None:
    """From now on `version` stands for the partitions that it holds; without partition columns, for the whole table."""
    if partition_by:
        held = spark.read.schema(schema).parquet(f"{path}/data/version={version}").select(*partition_by).distinct()
    else:
        held = spark.range(1).select()
    number = _next_number(_commits(spark, path))
    entry = held.select("*", F.lit(number).alias("number"), F.lit(version).alias("version"), F.lit(schema.json()).alias("schema"))
    entry.coalesce(1).write.mode("append").parquet(f"{path}/commits")


def write_table_again(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    """Replace the partitions that `df` has rows for; the others stay. Running it again changes nothing."""
    commit_version(df.sparkSession, path, write_version(df, path, partition_by), df.schema, partition_by)


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """Of every partition the rows of the last version committed for it."""
    commits = _commits(spark, path)
    if commits is None:
        raise FileNotFoundError(f"nothing was committed to {path}")
    schema = T.StructType.fromJson(json.loads(commits.agg(F.max_by("schema", "number")).first()[0]))
    keys = [c for c in commits.columns if c not in ("number", "version", "schema")]
    last = commits.groupBy(*keys).agg(F.max_by("version", "number").alias("__version"))
    data = spark.read.schema(T.StructType([*schema.fields, T.StructField("version", T.StringType())])).parquet(f"{path}/data")
    # The version alone tells most; the keys tell which partitions of it still count.
    same = data["version"] == last["__version"]
    for k in keys:
        same = same & data[k].eqNullSafe(last[k])
    return data.join(last, same, "left_semi").select(*schema.names)


def _digests(lines: DataFrame) -> DataFrame:
    """(file, digest) of the contents, whatever their size: records with their places, combined map-side."""
    each = F.xxhash64("row_idx", "record")
    return lines.groupBy("file").agg(F.concat_ws("-", F.count("*"), F.expr("bit_xor(xxhash64(row_idx, record))"), F.sum(each.cast("decimal(20,0)")).cast("string")).alias("digest"))


def add_new_files(spark: SparkSession, source: str, target: str) -> None:
    """Add the CSV files of folder `source` that `target` does not hold yet, aligned by name in long form.

    A manifest (file, size, modified, digest) tells what is held. Only files that are new, or were changed since, are
    read; one that was only touched is left as it is, and one with other contents replaces what it held. Files below
    `target` are never read. The names of new files go to the driver, as those of any scan do.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(source)
    own = "/" + target.split("://")[-1].removeprefix("file:").strip("/") + "/"
    files = listed.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    files = files.where(~F.contains(F.col("file"), F.lit(own)))
    held = _commits(spark, target)
    if held is not None:
        files = files.join(held, ["file", "size", "modified"], "left_anti")
    files = stage(files, "new-files")
    paths = [row["file"] for row in files.select("file").collect()]
    if not paths:
        return
    lines = stage(csv_lines(spark, paths), "new-lines")
    found = files.withColumn("key", F.regexp_replace("file", "^[a-z]+:/*", "/")).join(
        _digests(lines.withColumn("file", F.regexp_replace(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))), "^[a-z]+:/*", "/"))).withColumnRenamed("file", "key"), "key", "left"
    ).drop("key").fillna("", ["digest"])
    number = _next_number(held)
    if held is not None:
        last = held.groupBy("file").agg(F.max_by("digest", "number").alias("digest"))
        touched = found.join(last, ["file", "digest"], "left_semi").select("file")
        found = found.join(touched.withColumn("again", F.lit(True)), "file", "left")
    else:
        found = found.withColumn("again", F.lit(None).cast("boolean"))
    version = uuid.uuid4().hex
    long_cells(lines).write.parquet(f"{target}/data/version={version}")
    before = held.groupBy("file").agg(F.max_by("version", "number").alias("before")) if held is not None else None
    entry = found.join(before, "file", "left") if before is not None else found.withColumn("before", F.lit(None).cast("string"))
    # A touched file keeps the version that holds its rows.
    named = F.when(F.col("again"), F.col("before")).otherwise(F.lit(version))
    entry.select("file", "size", "modified", "digest", F.lit(number).alias("number"), named.alias("version")).coalesce(1).write.mode("append").parquet(f"{target}/commits")


def read_added(spark: SparkSession, target: str) -> DataFrame:
    """(file_name, row_no, column, value) of every file that was added, as it was last."""
    commits = _commits(spark, target)
    last = commits.groupBy("file").agg(F.max_by("version", "number").alias("version"))
    path = F.regexp_replace("file", "^[a-z]+:/*", "/")
    last = last.select(path.alias("path"), "version")
    schema = "path string, file_name string, row_no long, `column` string, value string, version string"
    data = spark.read.schema(schema).parquet(f"{target}/data")
    return data.join(last, ["path", "version"], "left_semi").select("file_name", "row_no", "column", "value")
