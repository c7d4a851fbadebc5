"""Writing an intermediate result once, where every executor can read it again."""

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, one beside the warehouse's
    tables, which all executors share as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder.rstrip("/") if folder else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: the lineage is cut, a lost
    executor costs a re-read and not a re-parse, and later passes read only the columns they use."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def listed_in_few_tasks(spark: SparkSession):
    """Folders opened inside are listed by four tasks a core at most. Spark's own number is a task for every path, up to
    10,000, where starting the tasks takes longer than listing."""
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(max(1, min(int(before), 4 * spark.sparkContext.defaultParallelism))))
    try:
        yield
    finally:
        spark.conf.set(_LISTING, before)


def by_sorted_shuffle(df: DataFrame) -> DataFrame:
    """`df`, to be joined by shuffling and sorting both sides. For small rows that are many: Spark goes by the size of their
    compressed files, where rows that are alike take next to no room, and would send millions of them through the driver."""
    return df.hint("merge")


def with_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`withColumns` for costly expressions that later filters use: a filter is not pushed below a
    generator, so each is computed once per row and not again in every filter."""
    values = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(values)))
