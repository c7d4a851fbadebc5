"""Exact top-k inner products by a three-phase uniform threshold.

The lists of the algorithm are groups of dimensions: a pair's score is the sum of its partial scores. Blocks of queries
meet blocks of vectors in one task each, tile by tile; only what a block has found leaves it.

1. Every block gives, per query, the lowest partial score of every list and, of the pairs that are among the k highest
   of some list, the k highest scores. The k-th highest of these scores is a safe cutoff for the query.
2. The cutoff goes to every block with the query. Counted from the lists' lowest scores, a pair that reaches the cutoff
   has at least 1/lists of it in some list: only such pairs go on.
3. Of these, pairs whose scores reach the cutoff, and lead their block, are ranked.

Components become floor(1024 * x) as integers. A vector that is null or holds null or non-finite components, or has no
id, takes no part. Shorter vectors count as filled up with zeros. Rows equal in id and vector count once; a row with
the query's id is its own. Ties go to the smaller id. Scores must fit a BIGINT. Empty tables give no rows; other
columns are not read.
"""

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.staging import by_sorted_shuffle, stage

#: Most rows of a block, which bound a task's memory. There are BLOCKS of vectors at least where each can have LEAST.
QUERIES_A_BLOCK, VECTORS_A_BLOCK, LEAST_A_BLOCK, BLOCKS = 16384, 65536, 256, 64
#: Pairs that are scored at once: so many queries by so many vectors, fewer in the first tile of a query.
TILE, FIRST = (256, 2048), 512

_LOWEST = np.iinfo(np.int64).min


def _matrix(column, dims: int, kind) -> np.ndarray:
    """Rows of an Arrow list array as a matrix, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims), kind)
    out[np.arange(dims) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _best(owner: np.ndarray, score: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of every owner, in order; of equal ones those with the smaller `other`."""
    order = np.lexsort((other, -score, owner))
    owner = owner[order]
    return order[np.arange(len(owner)) - np.searchsorted(owner, owner) < k]


def _whole_numbers(batches):
    """(id, x) without the vectors that hold nulls or are not finite: the components' floor(1024 * x), and the sum of their squares."""
    for batch in batches:
        sizes, flat = np.diff(batch["x"].offsets.to_numpy()), batch["x"].flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        good = np.bincount(owner[~np.isfinite(flat)], minlength=len(sizes)) == 0  # a null is NaN here
        sizes, flat, owner = sizes[good], flat[good[owner]], owner[good[owner]]
        with np.errstate(over="ignore", invalid="ignore"):
            scaled = np.floor(flat * 1024)
            numbers = np.where(scaled >= 2.0**63, np.iinfo(np.int64).max, np.where(scaled < -(2.0**63), _LOWEST, scaled.astype(np.int64)))
            square = np.bincount(owner, scaled * scaled, len(good))[good].astype(float)
        offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch["id"].filter(pa.array(good)), pa.ListArray.from_arrays(offsets, pa.array(numbers)), pa.array(square)], ["id", "v", "square"])


class _Kept:
    """The k best of every query so far: what another one must reach, and the pairs. Others come in ascending order."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k = least, k  # integers
        self.query, self.other, self.score, self.total = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, query, other, score, total) -> None:
        query, other, score, total = (np.concatenate(x) for x in ((self.query, query), (self.other, other), (self.score, score), (self.total, total)))
        best = _best(query, score, other, self.k)
        self.query, self.other, self.score, self.total = (x[best] for x in (query, other, score, total))
        ends = np.flatnonzero(np.bincount(self.query, minlength=len(self.least)) == self.k)
        lasts = self.score[np.searchsorted(self.query, ends, "right") - 1]
        self.least[ends] = np.maximum(self.least[ends], lasts + 1)  # a tie has a larger number than all before


def _tiles(left: np.ndarray, ids: np.ndarray, right: np.ndarray, others: np.ndarray, bounds: list[int]):
    """Per tile of some queries: the place of its first vector, partial scores of every list, own pairs. `others` ascend."""
    order = np.argsort(ids, kind="stable")
    named = ids[order]
    for c, d in pairwise([0, *range(FIRST, len(right), TILE[1]), len(right)] if len(right) > FIRST else [0, len(right)]):
        first, last = (np.searchsorted(named, others[c:d], side) for side in ("left", "right"))
        own = [(order[n], j) for j in np.flatnonzero(last > first) for n in range(first[j], last[j])]
        own = tuple(np.array(own, np.int64).reshape(-1, 2).T)
        yield c, [left[:, a:b] @ right[c:d, a:b].T for a, b in pairwise(bounds)], own


def _slices(n: int):
    return [slice(at, min(n, at + TILE[0])) for at in range(0, n, TILE[0])]


def _hits(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(np.flatnonzero(mask.ravel()), mask.shape[1])


def _sum_at(parts: list[np.ndarray], at) -> np.ndarray:
    total = parts[0][at].astype(np.int64)
    for part in parts[1:]:
        total += part[at].astype(np.int64)
    return total


def exact_top_k(vectors: DataFrame, k: int = 10, every: int = 100, lists: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, key, score): the k highest scores of every query, a row whose id is divisible by `every`."""
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    rows = rows.mapInArrow(_whole_numbers, "id long, v array<long>, square double").distinct()
    rows = stage(rows.withColumn("row", F.xxhash64("id", "v")), "vectors")
    size = rows.agg(
        F.count("*").alias("rows"), F.count_if(F.col("id") % every == 0).alias("queries"), F.max(F.size("v")).alias("dims"), F.max("square").alias("square"),
    ).first()
    dims = size["dims"] or 0
    # No sum of some products of a pair is larger than this; every number below is at most twice as large. Exact in each.
    peak = size["square"] or 0.0
    kind = np.float32 if peak < 2.0**22 else np.float64 if peak < 2.0**50 else np.int64
    nothing = _LOWEST if kind is np.int64 else -np.inf
    bounds = np.linspace(0, dims, lists + 1).astype(int).tolist()
    count = max(1, -(-size["rows"] // VECTORS_A_BLOCK), min(BLOCKS, -(-size["rows"] // LEAST_A_BLOCK)))
    teams = max(1, -(-size["queries"] // QUERIES_A_BLOCK))
    asked = rows.where(F.col("id") % every == 0).drop("square")

    def every_one(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    def of_hash(n):
        return F.pmod("row", F.lit(n).cast("long"))

    blocks = rows.select("id", "v", of_hash(count).alias("c"), every_one(teams).alias("q"))

    def meet(queries: DataFrame, function, schema: str) -> DataFrame:
        """Every block of queries with every block of vectors, each pair of blocks in one task."""
        sent = queries.withColumn("q", F.pmod(F.shiftright("row", 20), F.lit(teams).cast("long"))).withColumn("c", every_one(count))
        sent = sent.toDF(*sent.columns)  # else its columns are those of the blocks
        return blocks.groupBy("c", "q").cogroup(sent.groupBy("c", "q")).applyInArrow(function, schema)

    def loaded(c: pa.Table, q: pa.Table):
        """Query vectors and ids, then vectors by ascending id and their ids."""
        others = c["id"].to_numpy()
        order = np.argsort(others, kind="stable")
        return _matrix(q["v"], dims, kind), q["id"].to_numpy(), _matrix(c["v"], dims, kind)[order], others[order]

    def gather(c: pa.Table, q: pa.Table) -> pa.Table:
        n = len(q) if len(c) else 0
        lows, found = np.zeros((lists, n), np.int64), [(np.zeros(0, np.int64),) * 2]
        if n:
            left, ids, right, others = loaded(c, q)
        for rows in _slices(n):
            heads = [_Kept(np.full(rows.stop - rows.start, _LOWEST), k) for _ in range(lists)]
            least = np.full((lists, rows.stop - rows.start), np.iinfo(np.int64).max)
            for at, parts, own in _tiles(left[rows], ids[rows], right, others, bounds):
                for g, (part, kept) in enumerate(zip(parts, heads)):
                    least[g] = np.minimum(least[g], part.min(axis=1).astype(np.int64))
                    if at == 0 and k < part.shape[1]:  # nothing is kept yet
                        part = part.copy()
                        part[own] = nothing
                        col = np.argpartition(part, -k, axis=1)[:, -k:].ravel()
                        row = np.repeat(np.arange(len(part)), k)
                        real = part[row, col] != nothing
                        row, col = row[real], col[real]
                    else:
                        mask = part >= kept.least[:, None].astype(kind)
                        mask[own] = False
                        row, col = _hits(mask)
                    if len(row):
                        kept.add(row, col + at, part[row, col].astype(np.int64), _sum_at(parts, (row, col)))
            pairs, first = np.unique(np.concatenate([x.query * len(right) + x.other for x in heads]), return_index=True)
            query, total = pairs // len(right), np.concatenate([x.total for x in heads])[first]
            best = _best(query, total, total, k)
            found.append((query[best] + rows.start, total[best]))
            lows[:, rows] = least
        totals = [np.concatenate(x) for x in zip(*found)]
        ends = np.searchsorted(totals[0], np.arange(n + 1)).astype(np.int32)
        return pa.table({"row": q["row"].slice(0, n)} | {f"low{g}": lows[g] for g in range(lists)} | {"totals": pa.ListArray.from_arrays(pa.array(ends), pa.array(totals[1]))})

    known = meet(asked, gather, "row long, " + ", ".join(f"low{g} long" for g in range(lists)) + ", totals array<long>")
    cutoffs = known.groupBy("row").agg(
        F.array(*[F.min(f"low{g}") for g in range(lists)]).alias("lows"),
        F.get(F.sort_array(F.flatten(F.collect_list("totals")), asc=False), F.lit(k - 1)).alias("cutoff"),
    )
    cutoffs = stage(cutoffs, "cutoffs")

    def resolve(c: pa.Table, q: pa.Table) -> pa.Table:
        n, found = len(q) if len(c) else 0, [(np.zeros(0, np.int64),) * 4]
        if n:
            left, ids, right, others = loaded(c, q)
            low = np.array(q["lows"].to_pylist(), object).T  # integers of any size
            least = np.array([sum(x) if y is None else y for x, y in zip(low.T, q["cutoff"].to_pylist())], object)
            shares = [np.clip(x - (low.sum(axis=0) - least) // lists, -(2**63), 2**63 - 1).astype(np.int64).astype(kind) for x in low]
            least, keys = np.clip(least, -(2**63), 2**63 - 1).astype(np.int64), q["row"].to_numpy()
        for rows in _slices(n):
            kept = _Kept(least[rows], k)
            for at, parts, own in _tiles(left[rows], ids[rows], right, others, bounds):
                survives = parts[0] >= shares[0][rows, None]
                total = parts[0]
                for part, share in zip(parts[1:], shares[1:]):
                    survives |= part >= share[rows, None]
                    total = total + part
                survives &= total >= kept.least[:, None].astype(kind)
                survives[own] = False
                row, col = _hits(survives)
                if len(row):
                    score = total[row, col].astype(np.int64)
                    kept.add(row, col + at, score, score)
            found.append((keys[rows][kept.query], ids[rows][kept.query], others[kept.other], kept.score))
        names = ("row", "query_id", "other", "score")
        return pa.table(dict(zip(names, map(np.concatenate, zip(*found)))))

    found = meet(asked.join(by_sorted_shuffle(cutoffs), "row"), resolve, "row long, query_id long, other long, score long")
    final = W.partitionBy("row").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("other").alias(key), "score"
    )
