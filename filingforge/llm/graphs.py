"""Helpers on the cluster side: connected components, bit tables of fixed size, groups of a sorted Arrow stream."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.staging import stage

#: Bits of a table, a power of two: 4 MB, whatever sets them.
TABLE_BITS = 25


def bit_table(hashes: DataFrame) -> np.ndarray:
    """The bits that column `hash` sets. At most 2^TABLE_BITS / 32 small rows reach the driver; a table that is full
    lets everything pass, which costs time and no result."""
    slots = hashes.select(F.shiftrightunsigned("hash", 64 - TABLE_BITS).alias("slot"))
    words = slots.selectExpr("cast(shiftright(slot, 5) as int) as word", "shiftleft(1L, cast(slot % 32 as int)) as bit")
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (TABLE_BITS - 5), np.uint32)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return table


def in_table(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    words = table[(hashes >> np.uint64(69 - TABLE_BITS)).astype(np.int64)]
    bits = ((hashes >> np.uint64(64 - TABLE_BITS)) & np.uint64(31)).astype(np.uint32)
    return (words >> bits) & np.uint32(1) > 0


def of_ids(rows: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """`rows` whose `column` is among `ids`, and few others: a narrow filter by a bit table."""
    table = bit_table(ids.select(F.xxhash64(column).alias("hash")))

    def keep(batches):
        for batch in batches:
            hashes = batch.column("__hash").to_numpy().view(np.uint64)
            yield batch.filter(pa.array(in_table(table, hashes))).drop_columns(["__hash"])

    return rows.withColumn("__hash", F.xxhash64(column)).mapInArrow(keep, rows.schema)


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every node of the links (a, b): root is the smallest node reachable.

    Rounds of large and small stars, each written to the shared folder: only per-node minima and joins, so that a node
    with very many links is combined before the shuffle and its join is split.
    """
    edges = stage(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.distinct(), "large")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(small.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "links")
        state = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def groups_of(batches, columns: list[str]):
    """Runs of equal values in `columns` of a sorted stream of batches, each as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in columns])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        bounds = [0, *cuts.tolist(), len(batch)]
        for a, b in zip(bounds[:-1], bounds[1:]):
            key = tuple(keys[:, a])
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
