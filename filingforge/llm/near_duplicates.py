"""Near-duplicates by fast similarity sketching: sketch, bands, exact verification, components.

Sketch of a set of shingles: round i places every shingle in a hashed bin with a value in [i, i + 1); a bin keeps its
lowest value; rounds go on until every bin is full, and from round t on, one bin per round takes all shingles. Rows of
a band are joined to one key, and documents that share a key are compared.

1. Documents of equal shingle sets (two 64-bit sums and the size) form a class at once; the smallest id stands for it.
2. In every bucket (documents of one key) the others are compared with the smallest id, on their full sets, unless
   they have come together already.
3. Buckets whose documents still lie in several components are searched in full, in blocks of at most BLOCK documents
   against one another, spread over tasks. Full sets travel with the documents, so that a task compares them itself: pairs
   of different components whose sketches agree well enough (5 standard deviations under the threshold), each pair in the
   first bucket that both share. Only links that join two components leave a task, fewer than it has documents, however
   many pairs it compares. No bucket is capped or skipped.
4. Components run over the verified links only.

At the threshold a pair shares no band with probability (1 - s^6)^42: 2e-9 at 0.85, 3e-6 at 0.8.

A null or blank text has no shingles and is linked with nothing; a text of fewer than k words is one shingle. Rows with
a null id keep their row, without component. Rows that repeat an id are one node, with the links of all their texts.
Empty tables give no rows; other columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.staging import stage
from .graphs import components, groups_of, of_ids
from .text_arrays import Hasher, mix, shingle_sets, slices

ROWS, BANDS = 6, 42
#: Columns of a sketch for each that the bands use: the more, the closer sketches tell similarity.
WIDER = 2
#: Documents of a bucket that one task compares with as many others, and shingles that they have together.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Documents whose sketches are made at once; short texts would else take much memory.
SKETCHED = 1024

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketch(hashes: np.ndarray, offsets: np.ndarray, bins: int) -> np.ndarray:
    """One row of `bins` values per set; a row of an empty set stays full of the highest value."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    table = np.full(n * bins, _FULL)
    active = np.flatnonzero(sizes > 0)
    elements, owners = hashes, np.repeat(np.arange(n), sizes)
    for i in range(2 * bins):
        if not len(active):
            break
        z = mix(elements ^ np.uint64(0xA0761D6478BD642F * (i + 1) & 0xFFFFFFFFFFFFFFFF))
        values = (np.uint64(i) << np.uint64(32)) | (z & np.uint64(0xFFFFFFFF))
        if i < bins:
            at = ((z >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
        else:
            at = np.uint64(i - bins)
        np.minimum.at(table, owners * bins + at.astype(np.int64), values)
        open_ = (table.reshape(n, bins)[active] == _FULL).any(axis=1)
        if not open_.all():
            active = active[open_]
            stays = np.zeros(n, bool)
            stays[active] = True
            kept = stays[owners]
            elements, owners = elements[kept], owners[kept]
    return table.reshape(n, bins)


def band_keys(table: np.ndarray, rows: int) -> np.ndarray:
    """One key per band of `rows` neighbouring columns; the band's number is part of it."""
    parts = table.reshape(len(table), -1, rows)
    keys = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(rows):
        keys = mix(keys * np.uint64(0xC2B2AE3D27D4EB4F) + parts[:, :, j])
    return keys


def sketched(docs: DataFrame, k: int, rows: int, bands: int, whole: bool = False) -> DataFrame:
    """(id, tag, size, sum1, sum2, bands) of every document (id, tag, text); if `whole`, (id, tag, size, bands, sketch, set)
    as bytes: sketch holds the low byte of every value, set the sorted 64-bit shingles."""

    def run(batches):
        hasher = Hasher()
        for batch in (part.slice(at, SKETCHED) for part in slices(batches, "text") for at in range(0, len(part), SKETCHED)):
            hashes, offsets = shingle_sets(hasher, batch.column("text"), k)
            sizes = np.diff(offsets)
            table = sketch(hashes, offsets, WIDER * rows * bands)
            keys = band_keys(table[:, : rows * bands], rows)
            named = [batch.column("id"), batch.column("tag"), pa.array(sizes, pa.int64())]
            if whole:
                low = table.astype(np.uint8)
                columns = [
                    pa.array([row.tobytes() for row in keys], pa.binary()), pa.array([row.tobytes() for row in low], pa.binary()),
                    pa.array([hashes[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([*named, *columns], ["id", "tag", "size", "bands", "sketch", "set"])
                continue
            sums = []
            for salt in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
                total = np.r_[np.uint64(0), np.cumsum(mix(hashes ^ np.uint64(salt)))]
                sums.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
            ends = np.r_[0, np.cumsum((sizes > 0) * bands)]
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[sizes > 0].view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*named, pa.array(sums[0]), pa.array(sums[1]), listed], ["id", "tag", "size", "sum1", "sum2", "bands"])

    kept = "bands binary, sketch binary, set binary" if whole else "sum1 long, sum2 long, bands array<long>"
    return docs.mapInArrow(run, f"id long, tag long, size long, {kept}")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""

    def compare(batches):
        hasher = Hasher()
        for batch in slices(batches, "text_b", 1 << 20):
            # Neighbouring rows mostly have the same a: its set is made once for a run.
            a = batch.column("a").to_numpy()
            heads = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            run = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(a)]))
            ha, oa = shingle_sets(hasher, batch.column("text_a").take(pa.array(heads)), k)
            hb, ob = shingle_sets(hasher, batch.column("text_b"), k)
            linked = np.zeros(len(a), bool)
            for i, r in enumerate(run):
                x, y = ha[oa[r] : oa[r + 1]], hb[ob[i] : ob[i + 1]]
                if not len(x) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                at = np.searchsorted(x, y)
                shared = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                linked[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(linked))

    a, b = (texts.select(F.col("id").alias(c), F.col("tag").alias(f"tag_{c}"), F.col("text").alias(f"text_{c}")) for c in "ab")
    both = pairs.join(b, ["b", "tag_b"]).join(a, ["a", "tag_a"])
    return both.select("a", "tag_a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long")


def _across(open_: DataFrame, texts: DataFrame, k: int, percent: int, rows: int, bands: int) -> DataFrame:
    """Links (a, b) that join components, from buckets (key, id, tag, root) whose documents lie in several."""
    asked = stage(open_.select("id", "tag").distinct(), "asked")
    whole = stage(sketched(texts.join(asked, ["id", "tag"], "left_semi"), k, rows, bands, whole=True), "sets")
    sized = open_.join(whole.select("id", "tag", "size"), ["id", "tag"])
    parts = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("long")
    open_ = open_.join(stage(sized.groupBy("key").agg(parts.alias("parts")), "parts"), "key")
    mine = F.pmod(F.xxhash64("id", "tag"), "parts")
    placed = open_.select("key", "id", "tag", "root", mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    placed = placed.select("key", "id", "tag", "root", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    placed = placed.join(whole, ["id", "tag"])

    def matrix(column, kind):
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)

    def search(batches):
        for group in groups_of(batches, ["key", "i", "j"]):
            ids, roots, mine, sizes = (group.column(c).to_numpy() for c in ("id", "root", "mine", "size"))
            label = np.unique(roots, return_inverse=True)[1]
            if not label.any():
                continue
            marks, keys = matrix(group.column("sketch"), np.uint8), matrix(group.column("bands"), np.int64)
            column = group.column("set").combine_chunks()
            flat = np.frombuffer(column.buffers()[2], np.uint64)  # sets are whole numbers of eight bytes
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(ids) + 1] // 8
            sets = [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            s, bins = percent / 100, marks.shape[1]
            least = (s - 5 * np.sqrt(s * (1 - s) / bins)) * bins
            key, i, j = (group.column(c)[0].as_py() for c in ("key", "i", "j"))
            left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
            links = []
            for x in left:
                y = right[right > x] if i == j else right
                y = y[label[y] != label[x]]
                y = y[100 * np.minimum(sizes[x], sizes[y]) >= percent * np.maximum(sizes[x], sizes[y])]
                y = y[(marks[y] == marks[x]).sum(axis=1) >= least]
                if len(y):
                    y = y[keys[x][(keys[y] == keys[x]).argmax(axis=1)] == key]
                if not len(y):
                    continue
                others = np.concatenate([sets[v] for v in y])
                at = np.minimum(np.searchsorted(sets[x], others), len(sets[x]) - 1)
                shared = np.add.reduceat((sets[x][at] == others).astype(np.int64), np.r_[0, np.cumsum(sizes[y])[:-1]])
                for v in y[100 * shared >= percent * (sizes[x] + sizes[y] - shared)].tolist():
                    if label[v] != label[x]:
                        label[label == label[v]] = label[x]
                        links.append((ids[x], ids[v]))
            if links:
                a, b = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    placed = placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return placed.mapInArrow(search, "a long, b long")


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(id, root) after more links (a, b)."""
    known = links if roots is None else links.union(roots.select(F.col("root").alias("a"), F.col("id").alias("b")))
    return stage(components(known), "roots")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose two documents lie in different components."""
    a, b = (roots.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    both = pairs.join(a, "a", "left").join(b, "b", "left")
    return both.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select(pairs.columns)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row: the smallest id reachable over links of at least `percent`."""
    texts = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("tag"), F.col(text).alias("text"))
    made = stage(sketched(texts, k, rows, bands), "sketches")
    sets = ["sum1", "sum2", "size"]
    named = made.where("size > 0 and id is not null")
    several = named.groupBy(*sets).agg(F.min("id").alias("rep"), F.max("id").alias("top")).where("rep < top").drop("top")
    # Both sides of this join are shuffled as they are read, so that a very large class is split.
    classed = made.join(stage(several, "classes"), sets, "left").withColumn("rep", F.coalesce("rep", "id"))
    made = stage(classed.select("id", "tag", "sum1", "size", "rep", F.when(F.col("id") == F.col("rep"), F.col("bands")).alias("bands")), "classed")
    # An id with several texts may lie in several classes: it joins them.
    named = made.where("id is not null")
    again = named.groupBy("id").agg(F.min("tag").alias("low"), F.max("tag").alias("high")).where("low < high").select("id")
    again = stage(again, "again")
    own_links = stage(named.join(again, "id", "left_semi").select(F.col("rep").alias("a"), F.col("id").alias("b")).where("a < b"), "own-links")

    def tagged(rows: DataFrame) -> DataFrame:
        """Only an id with several texts needs their tags; for all others a tag of 0 takes no room in a shuffle."""
        marked = rows.join(again.withColumn("several", F.lit(True)), "id", "left")
        return marked.withColumn("tag", F.when(F.col("several"), F.col("tag")).otherwise(0)).drop("several")

    keyed = tagged(made.where("bands is not null")).select("id", "tag", F.explode("bands").alias("key"))
    low = F.min(F.struct("id", "tag")).alias("low")
    buckets = keyed.groupBy("key").agg(low, F.max("id").alias("high")).where("low.id < high").drop("high")
    buckets = stage(keyed.join(stage(buckets, "buckets"), "key"), "members")
    pairs = buckets.where("id > low.id").select(F.col("low.id").alias("a"), F.col("low.tag").alias("tag_a"), F.col("id").alias("b"), F.col("tag").alias("tag_b"))
    pairs = stage(pairs.distinct(), "pairs")
    needed = pairs.select(F.col("a").alias("id"), F.col("tag_a").alias("tag")).union(pairs.select("b", "tag_b")).distinct()
    needed = stage(needed, "needed")
    # The bit table spares a shuffle of most texts; where it is too full to, the join stands alone.
    texts = stage(tagged(of_ids(texts.where("id is not null"), needed)).join(needed, ["id", "tag"], "left_semi").dropDuplicates(["id", "tag"]), "texts")
    # One partner for each text, then another for those still apart from it, then all others of these: a large group
    # of near copies has as many smallest ids as buckets, but mostly comes together by the first.
    roots, left = _joined(None, own_links), pairs
    for single in (True, True, False):
        todo = left if single and left is pairs else _apart(left, roots)
        if single:
            todo = todo.groupBy("b", "tag_b").agg(F.min(F.struct("a", "tag_a")).alias("a")).select("a.a", "a.tag_a", "b", "tag_b")
        todo = stage(todo, "todo")
        if todo.isEmpty():
            break
        roots = _joined(roots, stage(verified(todo, texts, k, percent), "verified"))
        left = left.join(todo, todo.columns, "left_anti")
    # Buckets that the smallest id has not brought together.
    marked = buckets.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")).select("key", "id", "tag", "root")
    marked = stage(marked, "marked")
    open_ = stage(marked.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key"), "open")
    if not open_.isEmpty():
        links = _across(marked.join(open_, "key"), texts, k, percent, rows, bands)
        roots = _joined(roots, stage(links, "across"))
    found = made.select("id", "size", "rep").join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left")
    own = F.coalesce("root", "rep")
    return found.select(
        F.col("id").alias(key), F.col("size").alias("n_shingles"), F.when(F.col("id").isNotNull(), own).alias("component_id")
    ).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def without_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents with all their columns, one of each group: that of the smallest id. Of rows equal in all columns one
    stays; other rows that share the kept id all stay, and so do rows with a null id. Empty texts are copies of nothing."""
    gone = near_duplicates(docs, k, percent).where("not kept").select(F.col("doc_id").alias("doc_id")).distinct()
    kept = docs.join(stage(gone, "gone"), "doc_id", "left_anti").select(docs.columns)
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("__n")).where("__n > 1").select("doc_id")
    again = stage(again, "again")
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).union(kept.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates())
