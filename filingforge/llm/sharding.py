"""Shards by jump consistent hashing, in DataFrame functions only.

The walk of the hash visits growing shard numbers; the last one below the shard count is the row's shard. One walk
therefore gives the shard for the count and for one shard more, and a row moves only into the new shard.

Null or empty text: size 8, checksum 0. A null key counts as 0. Equal rows are told apart by their slots only. An
empty table gives no rows. Other columns are not read.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed: the generator of the published hash, k -> k * factor + 1 modulo 2^64.
_FACTOR = "2862933555777941757"
_TWO_64 = "18446744073709551616"
_TWO_33 = "8589934592"
#: Groups of a shard's rows that are numbered apart: the top bits of a hash of the row.
_GROUP_BITS = 16


def _wide(text: str):
    return F.lit(text).cast("decimal(20,0)")


def jump_walk(key, shards: int):
    """Struct (shard, grown): the shard of a BIGINT `key` among `shards` and among `shards` + 1."""
    start = F.when(key < 0, key.cast("decimal(20,0)") + _wide(_TWO_64)).otherwise(key.cast("decimal(20,0)"))
    first = F.struct(start.cast("decimal(20,0)").alias("k"), F.lit(0).cast("long").alias("at"), F.lit(0).alias("shard"), F.lit(0).alias("grown"))

    def step(s, _):
        k = ((s["k"] * F.lit(_FACTOR).cast("decimal(19,0)") + F.lit(1)) % _wide(_TWO_64)).cast("decimal(20,0)")
        after = F.struct(k.alias("k"), s["at"].alias("at"), s["shard"].alias("shard"), s["grown"].alias("grown"))
        high = F.floor(after["k"] / _wide(_TWO_33)).cast("double")
        to = F.floor((s["at"] + 1) * (F.lit(2147483648.0) / (high + 1))).cast("long")
        moved = F.struct(
            after["k"].alias("k"), to.alias("at"),
            F.when(to < shards, to.cast("int")).otherwise(s["shard"]).alias("shard"),
            F.when(to <= shards, to.cast("int")).otherwise(s["grown"]).alias("grown"),
        )
        return F.when(s["at"] > shards, s).otherwise(moved)

    # Every step goes up by one shard at least.
    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), first, step, lambda s: F.struct(s["shard"].alias("shard"), s["grown"].alias("grown")))


def shard_rows(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row; slots of a shard run from 0 without gaps.

    Slots: equal rows are counted first, so that copies are one row, then numbered within 2^16 groups per shard by
    hash, and the groups' sizes are added up per shard: no step holds a whole shard.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).cast("long").alias(key), (F.octet_length(whole).cast("long") + 8).alias("size"), F.crc32(whole).alias("text_crc32")
    ).groupBy(key, "size", "text_crc32").agg(F.count("*").alias("copies"))
    walk = jump_walk(F.coalesce(F.col(key), F.lit(0).cast("long")), shards)
    group = F.shiftrightunsigned(F.xxhash64(key, "size", "text_crc32"), 64 - _GROUP_BITS)
    # A generator keeps the walk from being computed once per use.
    rows = rows.select("*", F.inline(F.array(walk)), group.alias("group"))
    inside = W.partitionBy("shard", "group")
    rows = rows.withColumn(
        "slot", F.sum("copies").over(inside.orderBy(key, "size", "text_crc32").rowsBetween(W.unboundedPreceding, 0)) - F.col("copies")
    )
    sizes = rows.groupBy("shard", "group").agg(F.sum("copies").alias("held"))
    sizes = sizes.withColumn("before", F.sum("held").over(W.partitionBy("shard").orderBy("group").rowsBetween(W.unboundedPreceding, 0)) - F.col("held"))
    rows = rows.join(sizes.select("shard", "group", "before"), ["shard", "group"])
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    return rows.select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "before", F.col("grown").alias("grown_shard"), each.alias("copy")
    ).select(key, "size", "text_crc32", "law", "shard", (F.col("before") + F.col("slot") + F.col("copy")).alias("slot"), "grown_shard")
