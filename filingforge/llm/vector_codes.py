"""Compressing vectors to codes of 16 parts by value dictionaries.

Components become integers, floor(scale * x). Each part position has a codebook; a part's code is its nearest entry. No
distance is computed twice: per dimension the distinct integers of a slice of rows form a dictionary, whose squared
differences to all entries are tabulated once; the distance of a part to all entries is then the sum of one gathered
table row per dimension. Tasks return sums and counts per entry, so that codebooks, whose size is fixed, are all that
reaches the driver.

A codebook starts as that part of the vectors of the smallest ids, in order; of rows that share an id the smaller vector
is first, and null ids come last. In each round every part goes to its nearest entry, ties to the lower one, and an
entry becomes the floor of its parts' mean; unused entries stay. With fewer rows than entries there are fewer entries.

A row whose vector is null or holds null or non-finite components is dropped. Shorter vectors, and lengths that the
parts do not divide, count as filled up with zeros. Repeated rows all count. Squares and sums must fit a BIGINT: scaled
components stay under 2^28. Empty tables give no rows; other columns are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.staging import stage

#: Rows whose values form one dictionary.
_ROWS = 4096


def integers(column, dims: int) -> np.ndarray:
    """Rows of an Arrow list array of integers, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def nearest_entries(values: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code of every part and the squared distance of every row, for books (part, entry, place in the part)."""
    parts, entries, width = books.shape
    codes, errors = np.zeros((len(values), parts), np.int64), np.zeros(len(values), np.int64)
    for p in range(parts):
        distances = np.zeros((len(values), entries), np.int64)
        for j in range(width):
            dictionary, places = np.unique(values[:, p * width + j], return_inverse=True)
            table = (dictionary[:, None] - books[p, :, j]) ** 2
            distances += table[places]
        codes[:, p] = distances.argmin(axis=1)  # the first of equal ones
        errors += distances[np.arange(len(values)), codes[:, p]]
    return codes, errors


def _slices(batches, dims: int):
    for batch in batches:
        for at in range(0, len(batch), _ROWS):
            part = batch.slice(at, _ROWS)
            yield part, integers(part.column("v"), dims)


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    parts, entries, width = books.shape

    def gather(batches):
        sums, counts = np.zeros((parts, entries, width + 1), np.int64), 0
        for _, values in _slices(batches, parts * width):
            codes, _ = nearest_entries(values, books)
            counts += len(values)
            for p in range(parts):
                own = np.c_[np.ones(len(values), np.int64), values[:, p * width : (p + 1) * width]]
                order = np.argsort(codes[:, p], kind="stable")
                heads = np.flatnonzero(np.diff(codes[order, p], prepend=-1))
                sums[p, codes[order[heads], p]] += np.add.reduceat(own[order], heads, axis=0)
        if counts:
            used = np.flatnonzero(sums[:, :, 0].ravel())
            flat = sums.reshape(parts * entries, width + 1)[used]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(used, width + 1)), pa.array(np.tile(np.arange(width + 1), len(used))), pa.array(flat.ravel())], ["entry", "place", "total"]
            )

    totals = rows.mapInArrow(gather, "entry long, place long, total long").groupBy("entry", "place").agg(F.sum("total").alias("total"))
    found = totals.toArrow()  # at most one row per number of the codebooks and per entry
    sums = np.zeros((parts * entries, width + 1), np.int64)
    sums[found.column("entry").to_numpy(), found.column("place").to_numpy()] = found.column("total").to_numpy()
    counts = sums[:, :1]
    means = sums[:, 1:] // np.maximum(counts, 1)
    return np.where(counts > 0, means, books.reshape(parts * entries, width)).reshape(books.shape)


def vector_codes(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, key: str = "vec_id",
    vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every row with a whole vector."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", finite)).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("long")))
    rows = stage(rows, "vectors")
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    width = -(-(longest or 0) // parts)
    first = rows.orderBy(F.asc_nulls_last("id"), "v").select("v").limit(entries).toArrow().column("v").combine_chunks()
    books = integers(first, parts * width).reshape(len(first), parts, width).transpose(1, 0, 2)
    if len(first):
        for _ in range(rounds):
            books = _moved(rows, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def code(batches):
        for part, values in _slices(batches, parts * width):
            codes, errors = nearest_entries(values, books)
            texts = [row.tobytes().hex() for row in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array(texts, pa.string()), pa.array(errors)], ["id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    coded = stage(rows.mapInArrow(code, f"id long, label {kind}, code string, error long"), "codes")
    totals = coded.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("same"))).select(
        F.col("id").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
