"""Lexical retrieval packing: BM25 neighbours fill the window of each seed document.

1. Every text becomes ids (plus an end id). Whole windows of a long text are sequences of their own; the rest, shorter
   than a window, goes on with its ids.
2. Token document frequencies and the mean length are counted over all rests; the vocabulary bounds what is gathered.
3. Rests are dealt over shards of about SHARD_TOKENS tokens by content: a rest's bucket is its token of highest BM25 weight
   among those frequent enough to fill a part of a shard. Buckets follow one another, each near the one that it shares
   most second tokens with, and are cut by size; a hot one is divided by the token of second highest weight, and what is
   still hot (copies, say) evenly. Neighbours in another shard are not seen.
4. A shard builds its inverted index (postings by token, BM25 weights with the corpus statistics) and takes the longest
   unused rest as a seed, again and again: all its tokens are the query, and the unused neighbours fill the window in order
   of score; unused rests in order of length follow only when none is left that shares a token (the end id, which all
   share, is none). The last one is cut to fit, and what is left of it is unused again. So only a shard's last sequence has
   padding.

A null or empty text is its end id alone. Rows with a null id and repeated rows are packed like others (a salt of the
place where they were read deals equal rows over shards). Empty tables give no rows; other columns are not read.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.staging import stage
from .graphs import groups_of
from .pieces import ByteLevel
from .text_arrays import slices, spans_of

SHARD_TOKENS = 1_500_000
#: Bytes of text that a task tokenizes at once.
SLICE = 1 << 19
#: A bucket of more than a shard's PARTS-th is divided; a token counts as a bucket if it is in a PARTS-th of a shard's rests.
PARTS = 4
#: BM25 as usual: how fast repeated tokens saturate, how much the length counts.
K1, B = 1.2, 0.75
#: The index is written anew when less than this part of its rests is unused.
KEEP = 0.6
#: A token in a DENSE-th of the rests is a row of weights, not a list of postings.
DENSE = 8


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _rests(docs: DataFrame, tokenizer: str, window: int, end: int) -> DataFrame:
    """(doc_id, salt, start, length, ids_crc32, doc_tokens, ids): whole windows without ids, rests with them."""

    def cut(batches):
        pieces = ByteLevel(tokenizer)
        task = TaskContext.get()
        salt = (task.partitionId() if task else 0) << 33
        for batch in slices(batches, "text", SLICE):
            ids, offsets = pieces.ids(batch.column("text"))
            rows = []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                mine = np.append(ids[a:b], end).astype("<u4")
                whole = len(mine) // window * window
                for start in range(0, whole, window):
                    rows.append((doc, salt, start, window, _crc(mine[start : start + window]), len(mine), None))
                if whole < len(mine):
                    rest = mine[whole:]
                    rows.append((doc, salt, whole, len(rest), _crc(rest), len(mine), rest.astype("<u2" if rest.max() < 1 << 16 else "<u4").tobytes()))
                salt += 1
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "salt", "start", "length", "ids_crc32", "doc_tokens", "ids"]
            )

    schema = "doc_id long, salt long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def _read(raw: bytes, length: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * length else "<u4")


def _terms(rests: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rest, token and number of occurrences of every distinct token of every rest, in this order."""
    lengths = np.array([len(r) for r in rests])
    line = np.sort(np.repeat(np.arange(len(rests)), lengths) << 32 | np.concatenate(rests).astype(np.int64))
    heads = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    return line[heads] >> 32, line[heads] & 0xFFFFFFFF, np.diff(np.r_[heads, len(line)]).astype(np.float64)


def token_frequencies(rests: DataFrame) -> DataFrame:
    """(token, docs): in how many rests a token occurs."""

    def count(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in _small(batches):
            found = np.bincount(_terms(_ids(batch))[1], minlength=len(total))
            found[: len(total)] += total
            total = found
        tokens = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array(total[tokens], pa.int64())], ["token", "docs"])

    return rests.mapInArrow(count, "token long, docs long").groupBy("token").agg(F.sum("docs").alias("docs"))


def buckets(rests: list[np.ndarray], rarity: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of highest and second highest BM25 weight of every rest; of equal ones the smaller id comes first."""
    lengths = np.array([len(r) for r in rests])
    owner, token, often = _terms(rests)
    weight = rarity[token] * often * (K1 + 1) / (often + K1 * (1 - B + B * lengths[owner] / mean))
    firsts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    found = []
    for _ in range(2):
        at = np.flatnonzero(weight == np.maximum.reduceat(weight, firsts)[owner])
        at = at[np.r_[True, owner[at][1:] != owner[at][:-1]]]
        found.append(token[at])
        weight[at] = -1
    return found[0], found[1]


def linked(first: list[int], partner: list[int]) -> list[int]:
    """Buckets in an order where each stands with those it is linked to: depth first over (first, partner)."""
    near = {t: [] for t in sorted(first)}
    for a, b in sorted(zip(first, partner)):
        if a != b and b in near:
            near[a].append(b)
            near[b].append(a)
    order: dict[int, None] = {}
    for t in near:
        waiting = [t]
        while waiting:
            if (a := waiting.pop()) not in order:
                order[a] = None
                waiting += reversed(near[a])
    return list(order)


class Dealt:
    """Which shard a rest goes to, from the tokens held by its bucket and, in hot buckets, by each of its folds."""

    def __init__(self, shards: int, total: int, held: dict[int, int], partner: dict[int, int]):
        """held: tokens per bucket; partner: the second token most of them have."""
        self.shards, self.share = shards, -(-total // shards)
        order = linked(list(held), [partner[t] for t in held])
        self.place = np.zeros(max(order) + 1, np.int64)
        self.place[order] = np.arange(len(order))
        self.size = np.array([held[t] for t in order], np.int64)
        # 16 folds for every shard that a hot bucket fills: their number grows with the shards alone.
        self.folds = np.where(self.size * PARTS > self.share, 16 * -(-self.size // self.share), 1)
        self.slots = np.cumsum(self.folds) - self.folds
        self.units = self.size.repeat(self.folds)
        self.units[self.folds.repeat(self.folds) > 1] = 0

    def fold(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        place = self.place[first]
        return self.slots[place] + second % self.folds[place]

    def fill(self, slot: np.ndarray, held: np.ndarray) -> None:
        """held: tokens per fold of the hot buckets."""
        self.units[slot] = held

    def shard(self, first: np.ndarray, second: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """spread: uniform in [0, 1), it deals the rests of a fold that is hot itself."""
        slot = self.fold(first, second)
        before = (np.cumsum(self.units) - self.units)[slot]
        inside = np.where(self.units[slot] * PARTS > self.share, (self.units[slot] * spread).astype(np.int64), 0)
        return np.minimum((before + inside) // self.share, self.shards - 1)


def _bucketed(rests: DataFrame, rarity: np.ndarray, mean: float) -> DataFrame:
    """(first, second, length): without the ids, so it is written and read cheaply."""

    def find(batches):
        for batch in _small(batches):
            first, second = buckets(_ids(batch), rarity, mean)
            yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), batch.column("length")], ["first", "second", "length"])

    return stage(rests.select("length", "ids").mapInArrow(find, "first long, second long, length long"), "buckets")


def _small(batches):
    for batch in batches:
        for start in range(0, len(batch), 1000):
            yield batch.slice(start, 1000)


def _ids(batch) -> list[np.ndarray]:
    return [_read(raw, n) for raw, n in zip(batch.column("ids").to_pylist(), batch.column("length").to_pylist())]


def _sharded(made: DataFrame, rests: DataFrame, rarity: np.ndarray, mean: float, shards: int, total: int) -> DataFrame:
    """`made` with its shard. One row per token, and up to 16 for every shard that hot buckets fill, reach the driver."""
    if shards == 1:
        return made.withColumn("shard", F.lit(0).cast("long"))
    found = _bucketed(rests, rarity, mean)
    pairs = found.groupBy("first", "second").agg(F.sum("length").alias("held"))
    partner = F.max_by("second", F.struct("held", "second")).alias("partner")
    sizes = pairs.groupBy("first").agg(F.sum("held").alias("held"), partner).toArrow().to_pydict()
    dealt = Dealt(shards, total, dict(zip(sizes["first"], sizes["held"])), dict(zip(sizes["first"], sizes["partner"])))
    if (dealt.folds > 1).any():

        def fold(batches):
            for batch in batches:
                first = batch.column("first").to_numpy()
                slot = dealt.fold(first, batch.column("second").to_numpy())
                rows = pa.RecordBatch.from_arrays([pa.array(slot), batch.column("length")], ["slot", "length"])
                yield rows.filter(pa.array(dealt.folds[dealt.place[first]] > 1))

        folds = found.mapInArrow(fold, "slot long, length long").groupBy("slot").agg(F.sum("length").alias("held")).toArrow()
        dealt.fill(folds.column("slot").to_numpy(), folds.column("held").to_numpy())

    def deal(batches):
        for batch in _small(batches):
            spread = batch.column("spread").to_numpy()
            shard = (spread * shards).astype(np.int64)  # whole windows: anywhere
            which = np.flatnonzero(batch.column("ids").is_valid().to_numpy(zero_copy_only=False))
            if len(which):
                first, second = buckets(_ids(batch.take(pa.array(which))), rarity, mean)
                shard[which] = dealt.shard(first, second, spread[which])
            yield batch.drop_columns(["spread"]).append_column("shard", pa.array(shard))

    spread = F.pmod(F.xxhash64("doc_id", "salt", "start"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema)
    return made.withColumn("spread", spread).mapInArrow(deal, f"{kinds}, shard long")


def _by_score(near: np.ndarray, values: np.ndarray):
    """`near` in order of score, then place: sorted in growing steps, as most windows are full after a few."""
    step = 64
    while len(near):
        now = np.ones(len(near), bool)
        if len(near) > step:
            now = values >= np.partition(values, len(near) - step)[len(near) - step]
        yield from near[now][np.lexsort((near[now], -values[now]))].tolist()
        near, values, step = near[~now], values[~now], 4 * step


class _Index:
    """Inverted index of the unused rests of a shard. Tokens in a DENSE-th of the rests are rows of a matrix (single precision, at most
    DENSE numbers a posting), the others are postings."""

    def __init__(self, owner: np.ndarray, token: np.ndarray, weight: np.ndarray, n: int):
        """Postings in order of owner; those without weight are left out."""
        self.rests = np.arange(n)
        self.numbers = np.zeros(int(token.max(initial=0)) + 1, np.int64)  # tokens of the shard, numbered
        self.numbers[token] = 1
        self.numbers = np.cumsum(self.numbers) - 1
        token = self.numbers[token]
        order = np.argsort(token, kind="stable")
        order = order[weight[order] > 0]
        owner, token, weight = owner[order], token[order], weight[order]
        held = np.bincount(token, minlength=self.numbers[-1] + 1)
        common = (held * DENSE >= n) & (held > 0)
        self.row = np.where(common, np.cumsum(common) - 1, -1)
        dense = common[token]
        self.matrix = np.zeros((int(common.sum()), n), np.float32)
        self.matrix[self.row[token[dense]], owner[dense]] = weight[dense]
        self._postings(owner[~dense], token[~dense], weight[~dense])

    def _postings(self, owner, token, weight):
        self.owner, self.token, self.weight = owner, token, weight
        self.heads = np.r_[0, np.cumsum(np.bincount(token, minlength=len(self.row)))]

    def keep(self, free: np.ndarray) -> None:
        """Leaves out used rests."""
        kept = free[self.rests]
        place = np.cumsum(kept) - 1
        self.rests = self.rests[kept]
        self.matrix = self.matrix[:, kept]
        left = kept[self.owner]
        self._postings(place[self.owner[left]], self.token[left], self.weight[left])

    def scores(self, query: np.ndarray) -> np.ndarray:
        """Sum of the query's weights for every rest of `rests`."""
        rows = self.row[query]
        query = query[rows < 0]
        at = spans_of(self.heads[query], self.heads[query + 1] - self.heads[query])
        return self.matrix[rows[rows >= 0]].sum(axis=0) + np.bincount(self.owner[at], self.weight[at], len(self.rests))


def pack_shard(rests: list[np.ndarray], rarity: np.ndarray, mean: float, window: int, terms: int | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of (rest, first, last): which part of which rest stands where. A seed asks with its `terms` tokens of
    highest weight, or with all."""
    n = len(rests)
    lengths = np.array([len(r) for r in rests])
    owner, token, often = _terms(rests)
    sizes = np.bincount(owner, minlength=n)
    weight = rarity[token] * often * (K1 + 1) / (often + K1 * (1 - B + B * lengths[owner] / mean))
    ends = np.cumsum(sizes)
    index = _Index(owner, token, np.where(rarity[token] > 0, weight, 0), n)
    token = index.numbers[token]
    free, starts = np.ones(n, bool), np.zeros(n, np.int64)
    by_length = np.argsort(-lengths, kind="stable")
    upcoming, out = 0, []
    unused = n

    def next_free():
        nonlocal upcoming
        while upcoming < n and not free[by_length[upcoming]]:
            upcoming += 1
        return int(by_length[upcoming]) if upcoming < n else -1

    left = []  # cut rests: unused again, and shorter than their place in by_length says
    while True:
        seed = left.pop() if left else next_free()
        if seed < 0:
            break
        unused -= int(free[seed])
        free[seed] = False
        line, room = [(seed, int(starts[seed]), int(lengths[seed]))], window - int(lengths[seed] - starts[seed])
        if room:
            mine = slice(ends[seed] - sizes[seed], ends[seed])
            query = token[mine]
            if terms is not None and len(query) > terms:
                query = query[np.argpartition(-weight[mine], terms)[:terms]]
            if unused < KEEP * len(index.rests):
                index.keep(free)
            scores = index.scores(query)
            at = np.flatnonzero((scores > 0) & free[index.rests])
            near = _by_score(index.rests[at], scores[at])
            while room:
                other = next(near, -1)
                if other < 0 and (other := next_free()) < 0:
                    break
                free[other] = False
                unused -= 1
                first = int(starts[other])
                last = min(int(lengths[other]), first + room)
                line.append((other, first, last))
                room -= last - first
                if last < lengths[other]:
                    starts[other] = last
                    left.append(other)
        out.append(line)
    return out


def packed(docs: DataFrame, tokenizer_path: str, window: int = 2048, end: int = 1, terms: int | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every document."""
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = f.read()
    made = stage(_rests(docs, tokenizer, window, end), "rests")
    rests = made.where("ids is not null")
    size = rests.agg(F.count("*").alias("rests"), F.sum("length").alias("tokens")).first()
    counted = token_frequencies(rests.select("length", "ids")).toArrow()  # one row per token of the vocabulary
    tokens, held = counted.column("token").to_numpy(), counted.column("docs").to_numpy()
    rarity = np.zeros(max(int(tokens.max(initial=0)) + 1, 1 << 16))
    rarity[tokens] = np.log(1 + (size["rests"] - held + 0.5) / (held + 0.5))
    rarity[end] = 0  # all share it
    mean = (size["tokens"] or 0) / max(1, size["rests"])
    shards = max(1, -(-(size["tokens"] or 0) // SHARD_TOKENS))

    def pack(batches):
        for group in groups_of(batches, ["shard"]):
            shard = group.column("shard")[0].as_py() << 32
            docs_, starts, lengths, crcs, totals = (group.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens"))
            raw = group.column("ids").to_pylist()
            rows = [(docs_[i], starts[i], lengths[i], crcs[i], totals[i], shard + n, 0) for n, i in enumerate(i for i, x in enumerate(raw) if x is None)]
            base = shard + len(rows)
            which = [i for i, x in enumerate(raw) if x is not None]
            ids = [_read(raw[i], lengths[i]) for i in which]
            for n, line in enumerate(pack_shard(ids, rarity, mean, window, terms) if ids else []):
                place = 0
                for rest, first, last in line:
                    i = which[rest]
                    crc = crcs[i] if last - first == lengths[i] else _crc(ids[rest][first:last])
                    rows.append((docs_[i], starts[i] + first, last - first, crc, totals[i], base + n, place))
                    place += last - first
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            )

    # Tokens too rare to gather a part of a shard make no bucket.
    common = np.where(np.bincount(tokens, held, len(rarity)) * PARTS * shards >= size["rests"], rarity, 0)
    dealt = _sharded(made, rests, common, mean, shards, size["tokens"] or 0).repartition("shard").sortWithinPartitions("shard", "salt", "start")
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return dealt.mapInArrow(pack, ", ".join(f"{c} long" for c in names))
