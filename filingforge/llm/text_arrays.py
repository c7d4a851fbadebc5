"""Texts of an Arrow batch as flat numpy arrays: words, their hashes, shingles.

All functions treat a null text as empty and never cut a text. Hashes have 64 bits: a polynomial over random byte
values, taken from running sums, then mixed. Nothing here depends on how rows are dealt over batches.
"""

from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once. A longer text is handled alone.
SLICE_BYTES = 2 << 20
#: Bytes of rows in an Arrow batch under `in_small_batches`.
BATCH_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that its powers can be inverted
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches, column: str, most: int = SLICE_BYTES):
    """Parts of the Arrow batches with about `most` bytes of `column` each, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        until = np.cumsum(sizes.astype(np.int64))
        first = 0
        while first < len(sizes):
            before = until[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(until, before + most, "right")))
            yield batch.slice(first, last - first)
            first = last


def in_small_batches(step):
    """`step(spark, ...)` with texts passed to Python in Arrow batches of about `BATCH_BYTES` or one row. Spark's own are of
    10,000 rows, however long their texts are: the JVM and Python hold such a batch several times over, for every task. A
    plan takes the setting when it runs, which may be after the step, so the session keeps it; it changes no result."""

    @wraps(step)
    def stepped(spark, *args):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return step(spark, *args)

    return stepped


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets of the texts in them."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    if ends is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans_of(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All indices of the ranges [first, first + count), one range after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(firsts - (ends - counts), counts)


class Hasher:
    """Hashes of byte ranges; keeps powers, so make one per task."""

    def __init__(self):
        codes = np.arange(1, 257, dtype=np.uint64)
        self.values = mix(codes * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
        self.folded = self.values.copy()
        self.folded[65:91] = self.values[97:123]  # A-Z count as a-z
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            steps = np.full(n + n // 4 + 2, _BASE)
            steps[0] = 1
            self.powers = np.cumprod(steps)
            steps[1:] = _BASE_INVERSE
            self.inverses = np.cumprod(steps)

    def sums(self, data: np.ndarray, fold: bool) -> np.ndarray:
        """Running sums from which `ranges` takes the hash of any range."""
        self._grow(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((self.folded if fold else self.values)[data] * self.powers[: len(data)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self.inverses[starts])

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text index of every word [^\\x20\\x09-\\x0D]+, A-Z lowered, in reading order."""
        if not len(data):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        ink = np.ones(256, bool)
        ink[[32, *range(9, 14)]] = False
        solid = ink[data]
        border = np.zeros(len(data) + 1, bool)
        border[offsets] = True
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1] | border[1:-1]
        last[:-1] &= ~solid[1:] | border[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return self.ranges(self.sums(data, True), starts, ends), np.searchsorted(offsets, starts, "right") - 1


def shingles(words: np.ndarray, text: np.ndarray, k: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of every run of k words; `whole`: a text of fewer words gives all of them as one."""
    prime = np.uint64(0xC2B2AE3D27D4EB4F)
    n = max(0, len(words) - k + 1)
    runs = np.zeros(n, np.uint64)
    for j in range(k):
        runs = mix(runs * prime + words[j : j + n])
    inside = text[:n] == text[k - 1 :]
    hashes, owner = runs[inside], text[:n][inside]
    if whole and len(text):
        heads = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        counts = np.diff(np.r_[heads, len(text)])
        heads, counts = heads[counts < k], counts[counts < k]
        short = np.zeros(len(heads), np.uint64)
        for j in range(k - 1):
            more = j < counts
            short[more] = mix(short[more] * prime + words[heads[more] + j])
        hashes, owner = np.r_[hashes, short], np.r_[owner, text[heads]]
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, owner


def distinct_per_text(hashes: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of every text, sorted within it, and offsets; `owner` ascends."""
    bounds = np.searchsorted(owner, np.arange(texts + 1))
    sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    offsets = np.zeros(texts + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=offsets[1:])
    return np.concatenate(sets) if sets else hashes[:0], offsets


def shingle_sets(hasher: Hasher, column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of every text (see `shingles`) and offsets."""
    data, offsets = flat_bytes(column)
    words, text = hasher.words(data, offsets)
    return distinct_per_text(*shingles(words, text, k), len(column))
