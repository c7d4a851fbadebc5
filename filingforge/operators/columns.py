"""Column-wise operators, on wide frames and on long feature rows (symbol, element, …)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingforge.operators.ordered import carry_forward, number_rows
from filingforge.operators.staging import stage
from filingforge.operators.terms import holds_any


def project_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns)


def drop_columns(df: DataFrame, columns: list[str], ignore_missing: bool = True) -> DataFrame:
    """Without the named columns; a missing one is an error unless ignored."""
    missing = [c for c in columns if c not in df.columns]
    if missing and not ignore_missing:
        raise KeyError(f"no such columns: {missing}")
    return df.drop(*columns)


def drop_listed_elements(features: DataFrame, listed: DataFrame) -> DataFrame:
    """Long form: rows whose element is not in `listed` (column_name)."""
    names = listed.select(F.col("column_name").alias("element"))
    return features.join(names, "element", "left_anti")


def drop_listed_columns(df: DataFrame, listed: DataFrame) -> DataFrame:
    """Wide form: the listed names that are columns here are dropped; only those are fetched."""
    names = listed.where(F.col("column_name").isin(df.columns)).distinct()
    return df.drop(*[row["column_name"] for row in names.collect()])


def drop_elements_containing(features: DataFrame, words: list[str]) -> DataFrame:
    """Long form: elements that contain none of the words (case counts); one pass over a name, however many words."""
    return features.where(~holds_any(F.col("element"), words))


def drop_columns_containing(df: DataFrame, words: list[str]) -> DataFrame:
    """Wide form of `drop_elements_containing`."""
    return df.select(*[f"`{c}`" for c in df.columns if not any(w in c for w in words)])


def add_constants(df: DataFrame, catalog: DataFrame, columns: list[str], key: str = "symbol") -> DataFrame:
    """Attaches catalogue columns of the filing to its rows."""
    return df.join(catalog.select(key, *columns), key)


def lowercase_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def batch_slices(
    rows: DataFrame, existing: DataFrame, batches: list[tuple[int, int]], order: str, keys: list[str]
) -> DataFrame:
    """Existing rows with their `batch` (start, end numbers), by position among all rows.

    A batch takes positions start … end - 1 and the first existing row from end on, so boundary
    rows fall in two batches. Positions are 0-based places in `order`, a BIGINT column. Every batch is part of the plan:
    for a few given ones. `sized_batches` is for as many as the rows make.
    """
    numbered = number_rows(rows, [], order, "position").join(existing.select(*keys).distinct(), keys, "left_semi")
    ends = numbered.agg(
        F.array(
            *[
                F.struct(
                    F.lit(n).alias("batch"), F.lit(start).cast("long").alias("start"),
                    F.lit(end).cast("long").alias("end"),
                    F.min(F.when(F.col("position") >= end, F.col("position"))).alias("extra"),
                )
                for n, (start, end) in enumerate(batches)
            ]
        ).alias("batches")
    )
    place = F.col("position")
    inside = F.filter(
        F.col("__batches"),
        lambda b: ((place >= b["start"]) & (place < b["end"])) | F.coalesce(place == b["extra"], F.lit(False)),
    )
    placed = numbered.withColumn("__batches", ends.scalar()).withColumn("__batch", F.explode(inside))
    return placed.withColumn("batch", F.col("__batch.batch")).drop("__batch", "__batches")


def sized_batches(rows: DataFrame, existing: DataFrame, size: int, order: str, keys: list[str]) -> DataFrame:
    """`batch_slices` for batches of `size` positions that cover all rows, whatever their number.

    The first existing row from a batch's end on is the first one of the next batch that has any: it goes to the batch
    with rows before that, and to all between.
    """
    numbered = number_rows(rows, [], order, "position").join(existing.select(*keys).distinct(), keys, "left_semi")
    placed = stage(numbered.withColumn("batch", F.floor(F.col("position") / size).cast("long")), "batches")
    row = F.struct(*[F.col(f"`{c}`") for c in numbered.columns])
    firsts = placed.groupBy("batch").agg(F.min_by(row, "position").alias("__row")).withColumn("__number", F.col("batch"))
    firsts = carry_forward(firsts, [], "batch", "__number", "__before", exclusive=True).where("batch > 0")
    extra = F.explode(F.sequence(F.coalesce("__before", F.lit(0).cast("long")), F.col("batch") - 1))
    extras = firsts.select("__row", extra.alias("batch")).select("__row.*", "batch")
    return placed.unionByName(extras).withColumn("batch", F.col("batch").cast("int"))
