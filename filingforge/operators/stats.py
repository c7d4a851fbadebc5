"""Counts, profiles and association. All groupings combine map-side; a hot group costs one row
per task."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Relative error of a sketch is one over this; rows of a bracket whose distinct values are fetched.
_ACCURACY, _GATHERED = 10_000, 50_000


def _number(column: str) -> Column:
    """As a double, null for NaN."""
    return F.nanvl(F.col(column).cast("double"), F.lit(None))


def group_sum(word_counts: DataFrame) -> DataFrame:
    """Sum of `count` per `column_name`, smallest first."""
    return word_counts.groupBy("column_name").agg(F.sum("count").alias("count")).orderBy("count", "column_name")


def column_counts(features: DataFrame) -> DataFrame:
    """(element, count): non-null values per element of long rows."""
    return features.groupBy("element").agg(F.count("value").alias("count"))


def with_total_row(df: DataFrame, key: str) -> DataFrame:
    """Wide frame plus a row `Total` in `key` with the non-null count of every other column."""
    others = [c for c in df.columns if c != key]
    totals = df.agg(*[F.count(f"`{c}`").cast("double").alias(c) for c in others])
    rows = df.select(F.col(key).cast("string"), *[F.col(f"`{c}`").cast("double").alias(c) for c in others])
    return rows.unionByName(totals.withColumn(key, F.lit("Total")))


def low_support_columns(features: DataFrame, max_count: int = 6) -> DataFrame:
    """(column_name, count) of the elements with at most `max_count` values, rarest first."""
    counts = column_counts(features).where(F.col("count") <= max_count)
    return counts.select(F.col("element").alias("column_name"), "count").orderBy("count", "column_name")


def unpivot(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """(keep…, column, value): the given columns as long rows of doubles; NaN is no value."""
    pairs = [F.struct(F.lit(c).alias("column"), _number(f"`{c}`").alias("value")) for c in columns]
    return df.select(*keep, F.inline(F.array(*pairs)))


def mean_difference_by_sign(values: DataFrame) -> DataFrame:
    """Per column of (column, value, diff): mean over diff > 0 minus mean over diff < 0, zeros
    being no values; columns without a difference left out; by absolute difference."""
    value = F.when(F.col("value") != 0, _number("value"))
    means = values.groupBy("column").agg(
        F.avg(F.when(F.col("diff") > 0, value)).alias("positive_mean"),
        F.avg(F.when(F.col("diff") < 0, value)).alias("negative_mean"),
        F.count(value).alias("count"),
    )
    result = means.withColumn("difference", F.col("positive_mean") - F.col("negative_mean"))
    return sort_abs(result.where("difference is not null"), "difference")


def feature_correlation(values: DataFrame, min_count: int = 100) -> DataFrame:
    """Per column of (column, value, diff): Pearson correlation with diff and number of values,
    for columns with at least `min_count` values, highest first; null for a constant column."""
    both = _number("value").isNotNull() & _number("diff").isNotNull()
    value, diff = F.when(both, F.col("value")), F.when(both, F.col("diff"))
    spread = F.nullif(F.stddev_pop(value) * F.stddev_pop(diff), F.lit(0.0))
    found = values.groupBy("column").agg(
        (F.covar_pop(value, diff) / spread).alias("correlation"), F.count(_number("value")).alias("count")
    )
    return found.where(F.col("count") >= min_count).orderBy(F.desc("correlation"))


def histogram(df: DataFrame, column: str, bins: int = 200) -> DataFrame:
    """(bin, count) for `bins` bins of equal width, from 1; the maximum falls in the last. NaN is no value."""
    df = df.select(_number(f"`{column}`").alias("value"))
    ends = df.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    place = F.when(lo == hi, 1).otherwise(F.least(F.width_bucket("value", lo, hi, F.lit(bins)), F.lit(bins)))
    return df.where("value is not null").groupBy(place.cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    )


def winners_losers(df: DataFrame, diff: str = "diff") -> DataFrame:
    """(result, count): rows with diff > 0 and the rest; a null diff is no winner."""
    won = F.coalesce(F.col(diff) > 0, F.lit(False))
    return df.groupBy(won.alias("result")).agg(F.count(F.lit(1)).alias("count"))


def profile_info(df: DataFrame) -> DataFrame:
    """(column, type, non_null) for every column."""
    lines = [
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.count(f"`{c}`").alias("non_null"))
        for c, t in df.dtypes
    ]
    return df.agg(F.array(*lines).alias("lines")).select(F.inline("lines"))


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """(column, share, quantile): exact quantiles (linear between neighbours) of numeric columns; NaN is no value.

    A mergeable sketch gives, in one pass over all columns, a narrow bracket of values for every quantile. The next pass
    counts the values below and inside the brackets. A bracket of a single value is an answer; the distinct values of one
    with at most _GATHERED rows are fetched; a fuller one is narrowed by a sketch of its own rows. So three passes do up to
    some 10^8 rows, and two more multiply that by thousands, whatever the spread of the values. No task sorts a column.
    """
    df = df.select(*[_number(f"`{c}`").alias(f"c{n}") for n, c in enumerate(columns)])
    every = (None, None)

    def within(value, ends):
        """Strictly between the ends; all values without them."""
        low, high = ends
        return value.isNotNull() if ends == every else (value > low) & (value < high)

    def sketched(value, positions, margin):
        return F.percentile_approx(value, [min(1.0, max(0.0, p + d)) for p in positions for d in (-margin, margin)], _ACCURACY)

    margin = 2 / _ACCURACY
    about = df.agg(*[F.struct(F.count(c).alias("n"), sketched(F.col(c), shares, margin).alias("at")).alias(c) for c in df.columns]).first()
    size = {c: about[c]["n"] for c in df.columns}
    tried, open_, answers = {}, {}, {}  # all by (column, rank)
    for c in df.columns:
        for k, share in enumerate(shares if size[c] else ()):
            for rank in (math.floor((size[c] - 1) * share), math.ceil((size[c] - 1) * share)):
                tried[c, rank] = tuple(about[c]["at"][2 * k : 2 * k + 2])
    while tried:
        counts = df.agg(*[
            F.struct(
                F.count_if(F.col(c) < low).alias("below"), F.count_if(F.col(c) == low).alias("low"),
                F.count_if(F.col(c) == high).alias("high"), F.count_if(F.col(c).between(low, high)).alias("inside"),
            ).alias(f"p{k}")
            for k, ((c, _), (low, high)) in enumerate(tried.items())
        ]).first()
        for k, ((c, rank), (low, high)) in enumerate(tried.items()):
            below, at_low, at_high, inside = counts[f"p{k}"]
            if not below <= rank < below + inside:
                open_[c, rank] = (every, 0, size[c])
            elif rank < below + at_low:
                answers[c, rank] = low
            elif rank >= below + inside - at_high:
                answers[c, rank] = high
            else:
                open_[c, rank] = ((low, high), below + at_low, inside - at_low - at_high)
        full = {place: x for place, x in open_.items() if place not in answers and x[2] > _GATHERED}
        open_ = {place: x for place, x in open_.items() if place not in full}
        margin = min(margin * 4, 1.0)  # wider each time, should a sketch not keep its word
        tried = {}
        if full:
            found = df.agg(*[
                sketched(F.when(within(F.col(c), ends), F.col(c)), [(rank - below) / inside], margin).alias(f"p{k}")
                for k, ((c, rank), (ends, below, inside)) in enumerate(full.items())
            ]).first()
            tried = {place: tuple(found[f"p{k}"]) for k, place in enumerate(full)}
    if open_:
        places = list(open_)
        inside = [F.when(within(F.col(c), open_[c, rank][0]), F.struct(F.lit(k).alias("place"), F.col(c).alias("at"))) for k, (c, rank) in enumerate(places)]
        rows = df.select(F.inline(F.array_compact(F.array(*inside)))).groupBy("place", "at").agg(F.count(F.lit(1)).alias("k")).collect()
        for k, (c, rank) in enumerate(places):
            upto = open_[c, rank][1]
            for row in sorted((r for r in rows if r["place"] == k), key=lambda r: r["at"]):
                if upto <= rank < upto + row["k"]:
                    answers[c, rank] = row["at"]
                upto += row["k"]
    found = []
    for c, name in zip(df.columns, columns):
        for share in shares if size[c] else ():
            rank = (size[c] - 1) * share
            low, high = answers[c, math.floor(rank)], answers[c, math.ceil(rank)]
            found.append((name, float(share), low if low == high else low + (high - low) * (rank - math.floor(rank))))
    return df.sparkSession.createDataFrame(found, "column string, share double, quantile double")


def profile_describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, std (sample), min, quartiles, max per numeric column."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    values = unpivot(df, columns)
    plain = values.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quartiles = quantiles(df, columns, [0.25, 0.5, 0.75]).groupBy("column").agg(
        *[F.max(F.when(F.col("share") == s, F.col("quantile"))).alias(n) for s, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    )
    return plain.join(quartiles, "column", "left").select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def group_count_desc(df: DataFrame, column: str) -> DataFrame:
    """(column, count), most frequent first."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), column)


def batch_stats(results: DataFrame) -> DataFrame:
    """One row over (status): total_files, successful, failed, success_rate in percent."""
    total = F.count(F.lit(1))
    done = F.count_if(F.col("status") == "success")
    return results.agg(
        total.alias("total_files"), done.alias("successful"), (total - done).alias("failed"),
        F.when(total > 0, done / total * 100).otherwise(0.0).alias("success_rate"),
    )


def _others(df: DataFrame, column: str) -> list[Column]:
    """The other columns that have an order."""
    return [F.col(f"`{f.name}`") for f in df.schema.fields if f.name != column and not isinstance(f.dataType, (T.MapType, T.VariantType))]


def largest_diffs(df: DataFrame, drop: list[str], diff: str = "diff") -> DataFrame:
    """Without the dropped columns, by `diff` from the largest down; the other columns settle ties, so that equal
    differences are not one task's."""
    kept = df.drop(*drop)
    return kept.orderBy(F.col(diff).desc_nulls_last(), *_others(kept, diff))


def sort_abs(df: DataFrame, column: str) -> DataFrame:
    """By absolute value, largest first, then signed; the other columns settle ties."""
    return df.orderBy(F.abs(column).desc(), F.col(column).asc(), *_others(df, column))


def top_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """First k rows per key with their `rank`; Spark keeps k per key in every task before the
    shuffle."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
