"""The trie of conversation prefixes by the recursion of van Emde Boas.

Sequences of turns are cut at half depth, the cut prefixes are named, and the upper trie and the lower forests, one under
each name, are built in parallel the same way, down to single turns; totals of the lower forests are then grafted upward
onto the upper trie. All pieces of a level are one table, so a trie of depth D takes log2(D) levels of a few joins each.

- Going up, digests of dyadic runs of turns are combined in pairs (only whole runs are needed).
- Going down, a run of 2s turns that begins under a name is cut: its first half begins under the same name, its second
  half under the name made of that name and the digest of the first half. At the end every prefix of every conversation
  has a name, equal exactly where role and text of all its turns are (names are SHA-256 digests).
- Nodes are the groups of equal names. Grafting at run length s adds the totals of every tree whose top lies in a second
  half to those ancestors of it that lie in the first half, found along the smallest member of the cut prefix.

No conversation and no node is collected: rows are (conversation, depth), keys of joins are unique on one side or combined
before the shuffle. Digests of member lists are streamed over lists that tasks have put together from sorted ranges.

Rebuilding: conversation c has the first h turns of conversation c - c % every (c % every has the sign of c), then its own
after its first h; h = crc32(c as text) % heads.

Turns are ordered by turn, null first; equal turn numbers by the digest of role and text, so that their order is fixed, and
repeated rows are turns of their own. Null role or text becomes empty. Rows with a null id belong to no conversation. A
conversation of no turns is a member of the root, which always exists unless the table is empty: then there are no rows.
Other columns are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.staging import stage


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _numbered(rows: DataFrame) -> DataFrame:
    """`rows` (c, turn, token, size) with `pos`, the place of the turn in its conversation.

    Rows are dealt by ranges of (c, turn, token), so that a long conversation lies in many tasks, and written, so that the
    ranges stay; only the sizes of a conversation's ranges meet.
    """
    parts = stage(rows.repartitionByRange("c", "turn", "token").withColumn("part", F.spark_partition_id()), "turns")
    nth = F.row_number().over(W.partitionBy("c", "part").orderBy(F.asc_nulls_first("turn"), "token")) - 1
    sizes = parts.groupBy("c", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("c").orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    return parts.withColumn("nth", nth).join(sizes.select("c", "part", before.alias("before")), ["c", "part"]).select(
        "c", "token", "size", (F.col("nth") + F.col("before")).alias("pos")
    )


def rebuilt(conversations: DataFrame, every: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """(c, pos, token, size) of every turn of the rebuilt conversations, and (c, len) of every conversation."""
    role, text = (F.coalesce(F.col(n), F.lit("")) for n in ("role", "text"))
    token = _digest(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").alias("turn"), token.alias("token"), F.length(text).cast("long").alias("size")
    )
    turns = stage(_numbered(rows), "numbered")
    taken = F.crc32(F.col("c").cast("string")) % heads
    begins = turns.where((F.col("c") % every == 0) & (F.col("pos") < heads - 1))
    base = begins.groupBy("c").agg(F.count("*").alias("n")).withColumnRenamed("c", "base")
    sizes = turns.groupBy("c").agg(F.count("*").alias("own")).withColumns({"base": F.col("c") - F.col("c") % every, "h": taken})
    sizes = sizes.join(base, "base", "left").withColumn("b", F.least("h", F.coalesce("n", F.lit(0))))
    sizes = stage(sizes.select("c", "base", "h", "b", (F.col("b") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len")), "lengths")
    first = begins.withColumnRenamed("c", "base").join(sizes.select("c", "base", "h"), "base").where("pos < h")
    last = turns.where(F.col("pos") >= taken).join(sizes.select("c", "h", "b"), "c").withColumn("pos", F.col("pos") - F.col("h") + F.col("b"))
    columns = ["c", F.col("pos").cast("long").alias("pos"), "token", "size"]
    return stage(first.select(columns).union(last.select(columns)), "rebuilt"), sizes.select("c", "len")


def prefix_names(turns: DataFrame, lengths: DataFrame, levels: int) -> DataFrame:
    """(c, len, d, name) of the first d turns of every conversation, d from 0 to its length; lengths are below 2^levels."""
    runs = [turns.select("c", F.col("pos").alias("i"), F.col("token").alias("digest"))]
    for k in range(1, levels):
        halves = runs[-1].groupBy("c", F.shiftright("i", 1).alias("half")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("digest"))).alias("a"), F.max(F.when(F.col("i") % 2 == 1, F.col("digest"))).alias("b")
        )
        runs.append(stage(halves.where("a is not null and b is not null").select("c", F.col("half").alias("i"), _digest(F.col("a"), F.col("b")).alias("digest")), "runs"))
    trees = lengths.select("c", "len", F.lit(0).cast("long").alias("i"), _digest(F.lit("root")).alias("name"))
    for k in reversed(range(levels)):
        upper = trees.withColumn("i", F.col("i") * 2)
        beyond = upper.where(F.col("len") >= F.shiftleft(F.col("i") + 1, k)).join(runs[k], ["c", "i"])
        lower = beyond.select("c", "len", (F.col("i") + 1).alias("i"), _digest(F.col("name"), F.col("digest")).alias("name"))
        trees = stage(upper.union(lower), "trees")
    return trees.withColumnRenamed("i", "d")


def _grafted(nodes: DataFrame, places: DataFrame, levels: int) -> DataFrame:
    """(name, n_leaves, saved) of whole subtrees, from nodes (name, d, parent, n_leaves, saved) with their own numbers.

    places: (c, d, name) of all prefixes; every node has its smallest member c.
    """
    totals = nodes.select("name", "c", "d", "parent", "n_leaves", "saved")
    pos = F.col("d") - 1
    for k in range(levels):
        s = 1 << k
        tops = totals.where((F.col("d") > 0) & (pos.bitwiseAND(2 * s - 1) == s))
        trees = tops.groupBy("parent").agg(F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("more"))
        cut = trees.join(nodes.select(F.col("name").alias("parent"), "c", F.shiftright(pos, k).alias("run")), "parent").drop("parent")
        ancestors = places.where("d > 0").select("c", "name", F.shiftright(pos, k).alias("run"))
        grown = cut.join(ancestors, ["c", "run"]).groupBy("name").agg(F.sum("leaves").alias("leaves"), F.sum("more").alias("more"))
        totals = _added(totals, grown)
    tops = totals.where("d = 1").groupBy(F.col("parent").alias("name")).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("more"))
    return _added(totals, tops).select("name", "n_leaves", "saved")


def _added(totals: DataFrame, grown: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return stage(
        totals.join(grown, "name", "left").withColumns(
            {"n_leaves": F.col("n_leaves") + F.coalesce("leaves", zero), "saved": F.col("saved") + F.coalesce("more", zero)}
        ).select(*totals.columns),
        "totals",
    )


def _lists(batches):
    """Of rows (name, c), sorted: the ids of every run of a name in a batch as one text, with its first id."""
    for batch in batches:
        if not len(batch):
            continue
        names = batch.column("name")
        heads = np.flatnonzero(np.r_[True, pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False).astype(bool)])
        ids = pa.ListArray.from_arrays(pa.array(np.r_[heads, len(names)].astype(np.int32)), batch.column("c").cast(pa.string()))
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(heads)), batch.column("c").take(pa.array(heads)), pc.binary_join(ids, ",")], ["name", "first", "ids"]
        )


def _streamed(batches):
    """Of rows (name, first, ids), sorted: the digest of all ids of a name, whatever their number."""
    name, state = None, None

    def done(names, digests):
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(digests, pa.string())], ["name", "ends_sha256"])

    for batch in batches:
        names, digests = [], []
        for new, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist()):
            if new == name:
                state.update(b",")
            else:
                if state:
                    names.append(name)
                    digests.append(state.hexdigest())
                name, state = new, hashlib.sha256()
            state.update(ids.encode())
        yield done(names, digests)
    if state:
        yield done([name], [state.hexdigest()])


def prefix_trie(conversations: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, lengths = rebuilt(conversations, every, heads)
    deepest = lengths.agg(F.max("len")).first()[0] or 0
    levels = int(deepest).bit_length()  # depths 0 to deepest
    names = prefix_names(turns, lengths, levels)
    last = turns.select("c", (F.col("pos") + 1).alias("d"), "size")
    places = stage(names.join(last, ["c", "d"], "left").withColumn("d", F.col("d").cast("long")), "places")
    nodes = places.groupBy("name").agg(F.min("c").alias("c"), F.max("d").alias("d"), F.count("*").alias("n_convs"), F.max("size").alias("size"))
    above = places.select("c", (F.col("d") + 1).alias("d"), F.col("name").alias("parent"))
    nodes = stage(nodes.join(above, ["c", "d"], "left"), "nodes")
    children = nodes.where("d > 0").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    own = (F.col("n_convs") - 1) * F.coalesce("size", F.lit(0))
    nodes = stage(nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved": own}), "nodes")
    totals = _grafted(nodes, places, levels)
    ends = places.where("d = len").select("name", "c").repartitionByRange("name", "c").sortWithinPartitions("name", "c")
    lists = ends.mapInArrow(_lists, "name binary, first long, ids string").repartition("name").sortWithinPartitions("name", "first")
    ends = lists.mapInArrow(_streamed, "name binary, ends_sha256 string")
    parents = nodes.select(F.col("name").alias("parent"), F.col("c").alias("parent_conv_id"))
    out = nodes.drop("n_leaves", "saved").join(totals, "name").join(ends, "name", "left").join(parents, "parent", "left")
    return out.select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
