"""Bytes of repeated windows, by a depth-limited radix sort of suffixes.

A window is a string of `depth` bytes. It is a repeat if it also starts earlier: in a document of a smaller id, or
earlier in its own. Every byte of a repeat is removed.

Suffixes are ordered only through `depth` bytes, most significant digit first, and a group of one leaves after each
digit. The digits are chosen so that few suffixes need to be moved: of the grams (GRAM bytes) in a window the one with
the lowest hash is its anchor, which depends on the window alone.

1. First digit: the anchor. Windows next to one another share one, so one row stands for all of them (about one in 35
   bytes). The second digit is the hash of all bytes that these windows cover. Rows that agree in both are repeats of
   the first of them, and are found within a slice of the input before anything is shuffled.
2. Where an anchor is left with several coverings, their windows are ordered one by one through all `depth` bytes;
   equal groups are exactly the repeated windows.

Texts of more than _PIECE bytes are taken in pieces that overlap by depth - 1 bytes, each with its own places; a run of
windows that a piece's end divides is two rows with coverings of their own, which step 2 tells apart.

Copies of whole texts are found first, by their digest. Digits are 64-bit hashes of their bytes. Nothing gathers a
group: rows of a group stream past in order, and what is kept is its first row.

A null text counts as empty. Rows with a null id keep all bytes and take no part. Rows of equal id and text are one
document; of equal id and different texts, each is judged on its own, starts being compared. Empty tables give no rows;
other columns are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.staging import stage
from .graphs import bit_table, in_table
from .text_arrays import Hasher, flat_bytes, mix, slices, spans_of

DEPTH, GRAM = 100, 32
#: Bytes of text handled at once: for each, tens of bytes of arrays.
_SLICE = 1 << 19
_EMPTY = hashlib.sha256(b"").hexdigest()
_PLACE = np.uint64((1 << 28) - 1)
#: Window starts whose anchors are sought at once, so that every place fits in _PLACE.
_PIECE = 1 << 24


def anchors(hasher: Hasher, data: np.ndarray, offsets: np.ndarray, depth: int, gram: int):
    """Runs of windows with the same anchor: (anchor hash, covering hash, text, first start, last start)."""
    if len(data) - depth + 1 > _PIECE:
        parts = []
        for a in range(0, len(data) - depth + 1, _PIECE):
            piece = data[a : a + _PIECE + depth - 1]
            h, c, text, first, last = anchors(hasher, piece, np.clip(offsets - a, 0, len(piece)), depth, gram)
            parts.append((h, c, text, first + a, last + a))
        return tuple(map(np.concatenate, zip(*parts)))
    sums = hasher.sums(data, False)
    n = len(data) - depth + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    grams = len(data) - gram + 1
    at = np.arange(grams)
    hashes = hasher.ranges(sums, at, at + gram)
    # The leftmost of the lowest: the place stands in the low bits.
    lowest = (hashes & ~_PLACE) | at.astype(np.uint64)
    span, width = depth - gram + 1, 1
    while 2 * width <= span:
        lowest = np.minimum(lowest[:-width], lowest[width:])
        width *= 2
    if span > width:
        lowest = np.minimum(lowest[: -(span - width)], lowest[span - width :])
    anchor = (lowest[:n] & _PLACE).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    inside = np.arange(n) + depth <= offsets[1:][text]
    starts = np.flatnonzero(inside)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    anchor, text = anchor[starts], text[starts]
    heads = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first, last = starts[heads], starts[np.r_[heads[1:], len(starts)] - 1]
    place, text = anchor[heads], text[heads]
    covering = mix(hasher.ranges(sums, first, last + depth) + (place - first).astype(np.uint64))
    return hashes[place], covering, text, first, last


class _Runs:
    """First rows of groups in a sorted stream, across batches: is a row later than its group's first row?"""

    def __init__(self):
        self.key = self.head = None

    def later(self, keys: list[np.ndarray], doc: np.ndarray, start: np.ndarray):
        """(new group?, later than the first?) for rows sorted by keys, doc, start."""
        n = len(doc)
        new = np.zeros(n, bool)
        new[0] = self.key is None or any(k[0] != x for k, x in zip(keys, self.key))
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        head = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        first_doc, first_start = doc[head], start[head]
        if not new[0]:
            first_doc, first_start = np.where(head < 0, self.head[0], first_doc), np.where(head < 0, self.head[1], first_start)
        self.key, self.head = [k[-1] for k in keys], (first_doc[-1], first_start[-1])
        return new, (doc != first_doc) | (start != first_start)


def _batch(**columns):
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns.values()], list(columns))


_ROW = "h long, c long, doc long, version long, start long, last long"


def _anchor_rows(texts: DataFrame, depth: int, gram: int, firsts: np.ndarray, doubled: np.ndarray) -> DataFrame:
    """Rows of _ROW of the texts (doc, text): one per anchor; c is 0 in rows that are known as repeats already."""

    def run(batches):
        hasher = Hasher()
        for batch in slices(batches, "text", _SLICE):
            ids = batch.column("doc").to_numpy()
            names = batch.column("hash").to_numpy().view(np.uint64)
            kept = in_table(firsts, names)
            batch, ids, names = batch.filter(pa.array(kept)), ids[kept], names[kept]
            data, offsets = flat_bytes(batch.column("text"))
            h, c, text, first, last = anchors(hasher, data, offsets, depth, gram)
            if not len(h):
                continue
            c = np.where(c == 0, np.uint64(1), c)
            versions = np.where(in_table(doubled, names), hasher.ranges(hasher.sums(data, False), offsets[:-1], offsets[1:]), np.uint64(0)).view(np.int64)
            doc, version, base = ids[text], versions[text], offsets[:-1][text]
            first, last = first - base, last - base
            order = np.lexsort((first, doc, c, h))
            h, c, doc, version, first, last = (x[order] for x in (h, c, doc, version, first, last))
            _, again = _Runs().later([h, c], doc, first)
            # Known repeats: later rows of a group seen whole within this slice. They travel with a spread key.
            c = np.where(again, np.uint64(0), c)
            h = np.where(again, mix(doc.astype(np.uint64) ^ first.astype(np.uint64)), h)
            yield _batch(h=h.view(np.int64), c=c.view(np.int64), doc=doc, version=version, start=first, last=last)

    return texts.mapInArrow(run, _ROW)


def _resolve(rows: DataFrame) -> DataFrame:
    """(doc, version, start, last, sure): anchors whose windows are repeats, and those to be looked at one by one."""

    def run(batches):
        groups = _Runs()
        key, pending, several = None, None, False  # of the current anchor: its only row so far, or more than one
        for batch in batches:
            if not len(batch):
                continue
            h, c, doc, version, start, last = (batch.column(i).to_numpy() for i in range(6))
            sure = c == 0
            out = [np.stack([doc, version, start, last])[:, sure]]
            h, c, doc, version, start, last = (x[~sure] for x in (h, c, doc, version, start, last))
            ask: list[np.ndarray] = []
            if len(h):
                new, again = groups.later([h, c], doc, start)
                out.append(np.stack([doc, version, start, last])[:, again])
                at = np.flatnonzero(new)
                rows_, hs = np.stack([doc, version, start, last])[:, at], h[at]
                if len(at):
                    heads = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
                    counts = np.diff(np.r_[heads, len(hs)])
                    many = np.repeat(counts > 1, counts)
                    if key is not None and hs[0] == key:  # goes on from the batch before
                        many[: counts[0]] = True
                        if not several:
                            ask.append(pending)
                        several = True
                    else:
                        several = False
                    if len(heads) > 1 or counts[-1] > 1:
                        several = counts[-1] > 1 or (several and len(heads) == 1)
                    key, pending = hs[-1], rows_[:, heads[-1] : heads[-1] + 1]
                    ask.append(rows_[:, many])
            known, open_ = np.concatenate(out, axis=1), np.concatenate(ask, axis=1) if ask else np.zeros((4, 0), np.int64)
            both = np.concatenate([known, open_], axis=1)
            if both.shape[1]:
                flag = np.r_[np.ones(known.shape[1], np.int64), np.zeros(open_.shape[1], np.int64)]
                yield _batch(doc=both[0], version=both[1], start=both[2], last=both[3], sure=flag)

    rows = rows.repartition("h").sortWithinPartitions("h", "c", "doc", "start")
    return rows.mapInArrow(run, "doc long, version long, start long, last long, sure long")


def _gathered(rows: DataFrame, name: str) -> DataFrame:
    """Ranges (start, last) of every document version in one row; a text bounds them."""
    return rows.groupBy("doc", "version").agg(F.collect_list(F.struct("start", "last")).alias(name))


def _ranges(column, i: int) -> tuple[np.ndarray, np.ndarray]:
    values = column[i].values
    return values.field("start").to_numpy(), values.field("last").to_numpy()


def _window_rows(texts: DataFrame, depth: int) -> DataFrame:
    """(h, doc, version, start) of the windows in question, first ones of a slice; c = 0 marks known repeats."""

    def run(batches):
        hasher = Hasher()
        for batch in slices(batches, "text", _SLICE):
            data, offsets = flat_bytes(batch.column("text"))
            doc, version = batch.column("doc").to_numpy(), batch.column("version").to_numpy()
            starts, owners = [], []
            for i in range(len(batch)):
                a, b = _ranges(batch.column("open"), i)
                starts.append(spans_of(a, b - a + 1) + offsets[i])
                owners.append(np.full(len(starts[-1]), i))
            starts, owners = np.concatenate(starts), np.concatenate(owners)
            h = hasher.ranges(hasher.sums(data, False), starts, starts + depth)
            places, docs_, versions = starts - offsets[owners], doc[owners], version[owners]
            order = np.lexsort((places, docs_, h))
            h, places, docs_, versions = h[order], places[order], docs_[order], versions[order]
            _, again = _Runs().later([h], docs_, places)
            h = np.where(again, mix(docs_.astype(np.uint64) ^ places.astype(np.uint64)), h)
            yield _batch(h=h.view(np.int64), c=(~again).astype(np.int64), doc=docs_, version=versions, start=places)

    return texts.mapInArrow(run, "h long, c long, doc long, version long, start long")


def _later_windows(rows: DataFrame) -> DataFrame:
    """(doc, version, start, last) of windows that start earlier elsewhere."""

    def run(batches):
        groups = _Runs()
        for batch in batches:
            if not len(batch):
                continue
            h, c, doc, version, start = (batch.column(i).to_numpy() for i in range(5))
            found = c == 0
            at = np.flatnonzero(~found)
            if len(at):
                found[at] = groups.later([h[at]], doc[at], start[at])[1]
            if found.any():
                yield _batch(doc=doc[found], version=version[found], start=start[found], last=start[found])

    rows = rows.repartition("h").sortWithinPartitions("h", "doc", "start")
    return rows.mapInArrow(run, "doc long, version long, start long, last long")


def _cut(texts: DataFrame, depth: int) -> DataFrame:
    """(doc, sha, n_removed, n_spans, kept_sha256) of texts with the starts of their repeats; sha is the text's digest."""

    def run(batches):
        for batch in slices(batches, "text", _SLICE):
            data, offsets = flat_bytes(batch.column("text"))
            rows = []
            for i in range(len(batch)):
                a, b = _ranges(batch.column("found"), i)
                text = data[offsets[i] : offsets[i + 1]]
                edges = np.zeros(len(text) + 1, np.int64)
                np.add.at(edges, a, 1)
                np.add.at(edges, b + depth, -1)
                gone = np.cumsum(edges[:-1]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                digests = (hashlib.sha256(part.tobytes()).hexdigest() for part in (text, text[~gone]))
                rows.append((*digests, int(gone.sum()), spans))
            sha, kept, removed, spans = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(sha, pa.string()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())],
                ["doc", "sha", "n_removed", "n_spans", "kept_sha256"],
            )

    return texts.mapInArrow(run, "doc long, sha string, n_removed long, n_spans long, kept_sha256 string")


def _of_docs(texts: DataFrame, ids: DataFrame, doubled: np.ndarray) -> DataFrame:
    """(doc, version, text) of the documents in `ids`, and few others, once each: a narrow filter by a bit table. The
    version is the hash of the text where the id may belong to several texts, and 0 elsewhere."""
    wanted = bit_table(ids.select(F.xxhash64("doc").alias("hash")))

    def run(batches):
        hasher = Hasher()
        for batch in slices(batches, "text", _SLICE):
            batch = batch.filter(pa.array(in_table(wanted, batch.column("hash").to_numpy().view(np.uint64))))
            data, offsets = flat_bytes(batch.column("text"))
            hashes = hasher.ranges(hasher.sums(data, False), offsets[:-1], offsets[1:])
            versions = np.where(in_table(doubled, batch.column("hash").to_numpy().view(np.uint64)), hashes, np.uint64(0)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(versions), batch.column("text")], ["doc", "version", "text"])

    return texts.mapInArrow(run, "doc long, version long, text string").dropDuplicates(["doc", "version"])


def without_repeats(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc"), whole.alias("text"))
    named = rows.where(F.col("doc").isNotNull()).withColumn("hash", F.xxhash64("doc"))
    noted = stage(rows.select("doc", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "digests")
    known = noted.where("doc is not null")
    first = known.groupBy("sha").agg(F.min("doc").alias("first"), F.max("doc").alias("top"))
    doubled = bit_table(known.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("doc").alias("hash")))
    firsts = bit_table(first.select(F.xxhash64("first").alias("hash")))
    copied = stage(first.where("first < top").select("sha", "first"), "copied")
    noted = noted.join(copied, "sha", "left").withColumn("copy", (F.col("doc") > F.col("first")) & (F.col("n_bytes") >= depth))
    found = stage(_resolve(_anchor_rows(named, depth, gram, firsts, doubled)), "anchors")
    open_ = _gathered(found.where("sure = 0").select("doc", "version", "start", "last"), "open")
    open_ = stage(open_, "open")
    asked = _of_docs(named, open_, doubled)
    windows = _later_windows(_window_rows(asked.join(open_, ["doc", "version"]).select("doc", "version", "text", "open"), depth))
    every = stage(_gathered(found.where("sure = 1").select("doc", "version", "start", "last").union(windows), "found"), "found")
    hit = _of_docs(named, every, doubled)
    cut = stage(_cut(hit.join(every, ["doc", "version"]).select("doc", "version", "text", "found"), depth), "cut")
    out = noted.join(cut, ["doc", "sha"], "left")
    pick = lambda name, copy, own: F.when(F.col("copy"), copy).otherwise(F.coalesce(name, own)).alias(name)
    none = F.lit(0).cast("long")
    return out.select(
        F.col("doc").alias(key), "n_bytes", pick("n_removed", F.col("n_bytes"), none), pick("n_spans", F.lit(1).cast("long"), none),
        pick("kept_sha256", F.lit(_EMPTY), F.col("sha")),
    )
