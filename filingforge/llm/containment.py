"""Benchmark items inside documents: size-partitioned MinHash containment search, verified on exact shingles.

A document holds an item if it has at least `percent` % of the item's distinct shingles (five words, A-Z lowered; an
item of fewer words is one shingle of all its words). Items are partitioned by the power of two of their set size. The
sketch of an item is its u - ceil(u * percent / 100) + 1 lowest shingle hashes, u being the largest size in its
partition: a document that lacks them all lacks too many shingles of any item there, however long the document is, so
the search loses no pair. Documents are read once, against two bit tables of fixed size (sketches; all item shingles).
Only documents that meet a sketch give rows: their distinct shingles that are an item's, from which the exact
containment is counted by joins.

Bands of ordinary MinHash signatures are not used: a 15-shingle item in a 20,000-word document has a Jaccard similarity
under 0.001, which no signature of bearable length finds.

Null or empty texts hold nothing, items without words are never found, rows with a null key are left out, rows that
repeat a key count as one document (their shingles together), and empty tables give no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.staging import stage
from .graphs import bit_table, in_table
from .text_arrays import Hasher, distinct_per_text, flat_bytes, shingles, slices

#: Bytes of text that a task reads at once.
SLICE = 1 << 19


def item_shingles(items: DataFrame, k: int, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, width, hash): the distinct shingles of every item."""

    def cut(batches):
        hasher = Hasher()
        for batch in slices(batches, text, SLICE):
            data, offsets = flat_bytes(batch.column(text))
            words, owner = hasher.words(data, offsets)
            counts = np.bincount(owner, minlength=len(batch))
            hashes, ends = distinct_per_text(*shingles(words, owner, k), len(batch))
            sizes = np.diff(ends)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes), pa.int64()),
                    pa.array(np.repeat(np.minimum(counts, k), sizes), pa.int32()),
                    pa.array(hashes.view(np.int64), pa.int64()),
                ],
                ["item", "width", "hash"],
            )

    rows = items.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("item"), text)
    return rows.mapInArrow(cut, "item long, width int, hash long").distinct()


def sketched(shingled: DataFrame, percent: int) -> DataFrame:
    """Adds `size` (shingles of the item) and `sketch` (is the hash in the item's sketch)."""
    sizes = shingled.groupBy("item").agg(F.count("*").alias("size"))
    top = F.pow(F.lit(2), F.floor(F.log2("size")) + 1).cast("long") - 1  # largest size of the partition
    kept = top - F.ceil(top * percent / 100) + 1
    order = W.partitionBy("item").orderBy("hash")
    return shingled.join(sizes, "item").withColumn("sketch", F.row_number().over(order) <= kept)


def contained_items(
    docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", item_key: str = "item_id", text: str = "text"
) -> DataFrame:
    """(key, item_key, n_item, n_shared, containment): every item that a document holds."""
    shingled = stage(sketched(item_shingles(items, k, item_key, text), percent), "items")
    widths = sorted(r[0] for r in shingled.select("width").distinct().collect())  # at most k values
    every, sketches = bit_table(shingled), bit_table(shingled.where("sketch"))

    def search(batches):
        hasher = Hasher()
        for batch in slices(batches, text, SLICE):
            data, offsets = flat_bytes(batch.column(text))
            words, owner = hasher.words(data, offsets)
            parts = [shingles(words, owner, width, whole=False) for width in widths]
            hashes = np.concatenate([p[0] for p in parts]) if parts else words[:0]
            owners = np.concatenate([p[1] for p in parts]) if parts else owner[:0]
            mine = in_table(every, hashes)
            hashes, owners = hashes[mine], owners[mine]
            met = np.zeros(len(batch), bool)
            met[owners[in_table(sketches, hashes)]] = True
            kept = met[owners]
            hashes, owners = hashes[kept], owners[kept]
            order = np.lexsort((hashes, owners))
            hashes, owners = hashes[order], owners[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
            if new.any():
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[owners[new]], pa.int64()), pa.array(hashes[new].view(np.int64), pa.int64())], ["doc", "hash"]
                )

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), text)
    found = rows.mapInArrow(search, "doc long, hash long").join(shingled.select("item", "size", "hash"), "hash")
    shared = found.groupBy("doc", "item", "size").agg(F.count_distinct("hash").alias("n_shared"))
    return shared.where(F.col("n_shared") * 100 >= F.col("size") * percent).select(
        F.col("doc").alias(key), F.col("item").alias(item_key), F.col("size").alias("n_item"), "n_shared",
        (F.col("n_shared") / F.col("size")).alias("containment"),
    )


def without_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents with all their columns that hold no item. Rows with a null id stay."""
    gone = stage(contained_items(docs, items, k, percent).select("doc_id").distinct(), "held")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
