"""Tokens of every text by a sentencepiece BPE model, counted by rank-synchronous merges over ragged arrays."""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import SentencePieces
from .text_arrays import flat_bytes, slices


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row, counted over the whole text.

    A null or empty text has no bytes and no tokens. Null keys and repeated rows stay. No shuffle: a lost executor
    costs the tasks it ran. Other columns are not read.
    """
    with open(model_path, "rb") as f:
        model = f.read()

    def count(batches):
        pieces = SentencePieces(model)
        for batch in slices(batches, text):
            data, offsets = flat_bytes(batch.column(text))
            sizes = offsets[1:] - offsets[:-1]
            tokens = pieces.counts(batch.column(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit)],
                [key, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(count, f"`{key}` long, n_bytes long, n_tokens long, over_limit boolean")
