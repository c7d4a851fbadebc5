"""Ordered work (carry forward, running totals, row numbers) that holds up on hot keys.

A window over one key runs in one task, however many rows the key has. Here every key is cut
into runs of neighbouring order values (`order >> shift`); the window runs inside a run, one
summary row per run is carried across runs the same way, and the two are joined on (key, run).
With shifts (24, 12) a key of 10^12 dense rows meets no window of more than 60,000 rows. With
(50, 12) the same holds for up to 1,024 * 60,000 small tables (order = table << 40 | row).
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from filingforge.operators.staging import by_sorted_shuffle, stage

ROW_SHIFTS = (24, 12)
TABLE_SHIFTS = (50, 12)
RUN = 12


def _ordered_scan(df, keys, order, shifts, value, out, running, summary, merge, exclusive):
    until = -1 if exclusive else W.currentRow
    if not shifts:
        window = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, until)
        return df.withColumn(out, running(F.col(value)).over(window))
    run = f"__run{len(shifts)}"
    before = f"__before{len(shifts)}"
    df = df.withColumn(run, F.shiftright(order, shifts[-1]))
    window = W.partitionBy(*keys, run).orderBy(order).rowsBetween(W.unboundedPreceding, until)
    sums = summary(df, [*keys, run], order, value)
    coarser = tuple(s - shifts[-1] for s in shifts[:-1])
    carried = _ordered_scan(
        sums, keys, run, coarser, value, before, running, summary, merge, exclusive=True
    ).drop(value)
    return (
        df.withColumn(out, running(F.col(value)).over(window))
        .join(by_sorted_shuffle(carried), [*keys, run])  # dealt and sorted as the window is
        .withColumn(out, merge(F.col(out), F.col(before)))
        .drop(run, before)
    )


def _last_of_run(df: DataFrame, run: list[str], order: str, value: str) -> DataFrame:
    # All runs by a hash distinct, the few values by max_by: no sort of the bulk of the rows.
    ends = df.where(F.col(value).isNotNull()).groupBy(*run).agg(F.max_by(value, order).alias(value))
    return df.select(*run).distinct().join(by_sorted_shuffle(ends), run, "left")


def carry_forward(
    df: DataFrame, keys: list[str], order: str, value: str, out: str,
    exclusive: bool = False, shifts=ROW_SHIFTS,
) -> DataFrame:
    """`out` = the latest non-null `value` at or before (exclusive: before) the row's `order`.

    `order` is a non-negative BIGINT, unique within the keys; keys are not null.
    """
    return _ordered_scan(
        df, keys, order, tuple(shifts), value, out,
        running=lambda v: F.last(v, ignorenulls=True),
        summary=_last_of_run,
        merge=lambda here, before: F.coalesce(here, before),
        exclusive=exclusive,
    )


def running_total(
    df: DataFrame, keys: list[str], order: str, value: str, out: str, shifts=ROW_SHIFTS
) -> DataFrame:
    """`out` = sum of `value` over the rows before this one."""
    return _ordered_scan(
        df, keys, order, tuple(shifts), value, out,
        running=F.sum,
        summary=lambda rows, run, order, value: rows.groupBy(*run).agg(F.sum(value).alias(value)),
        merge=lambda here, before: F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0)),
        exclusive=True,
    ).withColumn(out, F.coalesce(out, F.lit(0)))


def _number_all(df: DataFrame, order: str, out: str) -> DataFrame:
    """Positions in the whole frame, whatever the values of `order`: one shuffle by range, written so that the ranges
    stay, a number within each, and the sizes of the ranges before it. Only these sizes, one row per partition, meet
    in one task."""
    part, before, n = "__part", "__before", "__n"
    parts = stage(df.repartitionByRange(F.col(order)).withColumn(part, F.spark_partition_id()), "ranges")
    sizes = parts.groupBy(part).agg(F.count(F.lit(1)).alias(n))
    upto = F.sum(n).over(W.orderBy(part).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col(n)
    nth = F.row_number().over(W.partitionBy(part).orderBy(order)) - 1
    placed = parts.withColumn(n, nth).join(sizes.select(part, upto.alias(before)), part)
    return placed.withColumn(out, F.col(before) + F.col(n)).drop(part, before, n)


def number_rows(
    df: DataFrame, keys: list[str], order: str, out: str, shifts=ROW_SHIFTS
) -> DataFrame:
    """`out` = position 0, 1, 2, … of the row in `order` within the keys (none = whole frame)."""
    if not keys:
        return _number_all(df, order, out)
    one = "__one"
    numbered = running_total(df.withColumn(one, F.lit(1).cast("long")), keys, order, one, out, shifts)
    return numbered.drop(one)


def attach(df: DataFrame, per_key: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Inner join with a frame of one row per key. That row is first copied to every run of the
    key, and rows meet it on (keys, run): a key with a third of all rows is spread over many
    tasks, and nothing depends on the size of `per_key`. Keys are not null."""
    run = F.shiftright(order, RUN)
    runs = df.select(*keys, run.alias("__run")).distinct().join(per_key, keys)
    return df.withColumn("__run", run).join(runs, [*keys, "__run"]).drop("__run")


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first by `order` (columns). Combined map-side, so no hot task."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(f"`{c}`") for c in rest])
    best = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        F.min_by(packed, F.struct(*order)).alias("__row")
    )
    return best.select(
        *[F.col("__row").getField(c).alias(c) if c in rest else F.col(f"`{c}`") for c in df.columns]
    )
