"""Byte-pair encoding of many pre-tokens at once, held as ragged numpy arrays.

In every round each sequence merges its lowest-rank pair (the leftmost of equals), all sequences at the same time;
a sequence without a pair that merges leaves. One merge per sequence and round keeps to the order of the
sequential rule even where a merge gives a pair of lower rank. Sequences above LONG symbols take the same merges
from a heap, in n log n steps instead of n rounds over n symbols.
"""

import heapq

import numpy as np

from .text_arrays import spans_of

LONG = 192
_NONE = np.int64(1 << 62)


class PairTable:
    """(left, right) -> (merged symbol, rank), by open addressing."""

    def __init__(self, left, right, merged, rank):
        keys = (np.asarray(left, np.int64) << 20) | np.asarray(right, np.int64)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.merged = np.zeros(1 << self.bits, np.int32)
        self.rank = np.full(1 << self.bits, _NONE)
        merged, rank = np.asarray(merged, np.int32), np.asarray(rank, np.int64)
        todo, shift = np.arange(len(keys)), 0
        while len(todo):  # place what meets a free slot, move the rest on by one
            slots = (self._slot(keys[todo]) + shift) & ((1 << self.bits) - 1)
            order = np.unique(slots, return_index=True)[1]
            order = order[self.keys[slots[order]] == -1]
            at, put = slots[order], todo[order]
            self.keys[at], self.merged[at], self.rank[at] = keys[put], merged[put], rank[put]
            todo, shift = np.delete(todo, order), shift + 1
        self.probes = max(1, shift)

    def _slot(self, keys):
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left, right):
        """Slots of the pairs; a pair that is not there gives a slot without a rank."""
        keys = (left.astype(np.int64) << 20) | right
        slots = self._slot(keys)
        open_ = np.flatnonzero(self.keys[slots] != keys)
        for _ in range(self.probes):
            open_ = open_[self.keys[slots[open_]] != -1]
            if not len(open_):
                break
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            open_ = open_[self.keys[slots[open_]] != keys[open_]]
        return slots

    def pairs(self, left, right):
        slots = self.find(left, right)
        found = self.keys[slots] == ((left.astype(np.int64) << 20) | right)
        return np.where(found, self.rank[slots], _NONE), self.merged[slots]


def _one(symbols: list[int], table: PairTable) -> list[int]:
    """The same merges for one long sequence: a heap of pairs and links between symbols."""
    n = len(symbols)
    symbols, before, after = list(symbols), list(range(-1, n - 1)), [*range(1, n), -1]
    flat = np.array(symbols, np.int64)
    ranks, merged = table.pairs(flat[:-1], flat[1:])
    heap = [(r, i, symbols[i], symbols[i + 1], m) for i, (r, m) in enumerate(zip(ranks.tolist(), merged.tolist())) if r < _NONE]
    heapq.heapify(heap)
    while heap:
        _, i, left, right, new = heapq.heappop(heap)
        j = after[i] if symbols[i] == left else -1
        if j < 0 or symbols[j] != right:
            continue  # one of the two has merged with another since
        symbols[i], symbols[j], after[i] = new, -1, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        near = [a for a in (before[i], i) if a >= 0 and after[a] >= 0]
        if near:
            a = np.array([symbols[x] for x in near])
            b = np.array([symbols[after[x]] for x in near])
            for x, p, q, r, m in zip(near, a.tolist(), b.tolist(), *(y.tolist() for y in table.pairs(a, b))):
                if r < _NONE:
                    heapq.heappush(heap, (r, x, p, q, m))
    return [s for s in symbols if s >= 0]


def encode(symbols: np.ndarray, offsets: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Symbols left after all merges, and their offsets. Symbols are 0 to 2^20 - 1; no sequence is empty."""
    lengths = np.diff(offsets)
    results_at, results = [], []
    for s in np.flatnonzero(lengths > LONG):
        left = _one(symbols[offsets[s] : offsets[s + 1]].tolist(), table)
        results_at.append(np.full(len(left), s))
        results.append(np.array(left, np.int32))
    ids = np.flatnonzero(lengths <= LONG)  # the sequences still at work
    lengths = lengths[ids]
    work = symbols[spans_of(offsets[ids], lengths)].astype(np.int32)
    ranks = np.full(len(work), _NONE)
    merged = np.zeros(len(work), np.int32)
    ends = np.cumsum(lengths)
    inner = np.ones(len(work), bool)
    inner[ends - 1] = False
    at = np.flatnonzero(inner)
    ranks[at], merged[at] = table.pairs(work[at], work[at + 1])
    while len(ids):
        starts = ends - lengths
        key = np.minimum(ranks, 1 << 30) << 32
        key |= np.arange(len(work))
        best = np.minimum.reduceat(key, starts)
        done = best >> 32 == 1 << 30
        if done.any():
            gone = np.repeat(done, lengths)
            results.append(work[gone])
            results_at.append(np.repeat(ids[done], lengths[done]))
            shift = np.cumsum(np.where(done, lengths, 0))
            best = (best & 0xFFFFFFFF) - shift
            kept = ~gone
            work, ranks, merged = work[kept], ranks[kept], merged[kept]
            ids, lengths, best = ids[~done], lengths[~done], best[~done]
        else:
            best &= 0xFFFFFFFF
        if not len(ids):
            break
        work[best] = merged[best]
        kept = np.ones(len(work), bool)
        kept[best + 1] = False
        work, ranks, merged = work[kept], ranks[kept], merged[kept]
        place = best - np.arange(len(best))  # one symbol fewer for every sequence before
        lengths = lengths - 1
        ends = np.cumsum(lengths)
        lasts, firsts = ends - 1, ends - lengths
        ranks[place[place == lasts]] = _NONE
        at = np.r_[place[place < lasts], place[place > firsts] - 1]
        ranks[at], merged[at] = table.pairs(work[at], work[at + 1])
    if not results:
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    owner = np.concatenate(results_at)
    order = np.argsort(owner, kind="stable")
    out = np.zeros(len(offsets), np.int64)
    np.cumsum(np.bincount(owner, minlength=len(offsets) - 1), out=out[1:])
    return np.concatenate(results)[order], out
