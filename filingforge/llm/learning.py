"""What the two text classifiers share: folds, bounded samples of rows to learn from, feature counts and rows."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.staging import stage

#: Words that a task keeps with their features; emptied when full, which changes no result.
CACHED_WORDS = 300_000


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo `folds`; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds


def lowest_hashes(rows: DataFrame, most: int) -> DataFrame:
    """At most `most` rows (id, group): those of the lowest hash of the id, the same ones however data are dealt."""
    return rows.orderBy(F.xxhash64("id"), "id").limit(most)


def sample_texts(docs: DataFrame, chosen: DataFrame, name: str) -> DataFrame:
    """(id, group, text) of the chosen ids, written once. `chosen` is bounded by `lowest_hashes`, so it is broadcast."""
    return stage(docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), "id"), name)


def feature_counts(sample: DataFrame, features_of) -> DataFrame:
    """(feature, ones, zeros): documents of either group that have the feature."""

    def count(batches):
        found = {0: Counter(), 1: Counter()}
        for batch in batches:
            for group, text in zip(batch.column("group").to_pylist(), batch.column("text").to_pylist()):
                found[group].update(features_of(text or ""))
        names = list(found[0].keys() | found[1].keys())
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), *(pa.array([found[g][n] for n in part], pa.int64()) for g in (1, 0))], ["feature", "ones", "zeros"]
            )

    parts = sample.mapInArrow(count, "feature string, ones long, zeros long")
    return parts.groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))


def feature_rows(sample: DataFrame, features_of, places: dict[str, int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature places and group of every sampled row, on the driver: the sample is bounded, and so are its features."""

    def place(batches):
        for batch in batches:
            rows = [sorted({places[f] for f in features_of(t or "") if f in places}) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("group"), pa.array(rows, pa.list_(pa.int32()))], ["id", "group", "places"])

    found = sample.mapInArrow(place, "id long, `group` int, places array<int>").orderBy("id", "group").toArrow()
    return [np.array(r, np.int64) for r in found.column("places").to_pylist()], found.column("group").to_numpy().astype(np.int64)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def scored(docs: DataFrame, key: str, text: str, folds: int, out: int, make_score) -> DataFrame:
    """(key, held_out, score, predicted) of every row; make_score() gives a task its function from text to score."""

    def score(batches):
        of = make_score()
        for batch in batches:
            values = np.array([of(t or "") for t in batch.column(text).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column("held_out"), pa.array(values, pa.float64()), pa.array((values >= 0.5).astype(np.int32))],
                [key, "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col(key).cast("long").alias(key), text, (fold(F.col(key), folds) == out).alias("held_out"))
    return rows.mapInArrow(score, f"`{key}` long, held_out boolean, score double, predicted int")
