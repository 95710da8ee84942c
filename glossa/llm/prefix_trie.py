"""Conversation prefix trie by whole-sequence collapse.

Turns are numbered in their conversation, conversations are rebuilt (their first turns taken from another conversation, as
``shared_prefix`` says), and identical conversations are collapsed into one weighted sequence with the list of its ends.
Sequences that are proper prefixes of others go by an anti-join; those left are the leaves.  The
prefixes of the sequences, with their weights, are then summed by node.

A prefix is told by its depth and two sums of 64-bit hashes of (place, role, text), so that the prefixes of a sequence are running sums.
Running sums and numbers are taken in two steps (blocks of ``BLOCK`` turns, then sums of blocks): a very long
conversation is spread over many tasks, and conversations are dealt to tasks by ranges of (conv_id, turn), written once.
Texts are read once, for their hash and length; only numbers are shuffled afterwards.

Sums over subtrees: a node's *owner* is the least leaf sequence through it; what a sequence owns is the end of its path.
The sum below a node is that of all that its leaf sequences own, less what its owner owns above it.  No node meets
its descendants, and no list of a node's members is collected.

Defined cases: a null role or text is empty; a null turn comes first; equal turns of a conversation are in the order of
role, then text, and repeated rows are turns of their own; rows without a conv_id belong to no conversation; an empty table gives
no nodes; ``conv_id % 100`` has the sign of conv_id; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import BROADCAST_ROWS, ship, written

#: Turns of one conversation that one window holds.
BLOCK = 4096
#: Nodes with more children than this are looked up by a broadcast (there are fewer than nodes / HOT_PARENT of them).
HOT_PARENT = 10_000
#: Fixed values of the contract: whose first turns a conversation has, and how many.
FAMILY, MOST_SHARED = 100, 6


def running(df: DataFrame, key: str, place: str, sums: dict[str, str]) -> DataFrame:
    """Adds running sums up to and with each row: ``sums`` maps new columns to summed ones.

    ``place`` numbers the rows of a key from 0; blocks of places are summed by themselves, then a window over the few sums of blocks gives
    each block what comes before it."""
    df = df.withColumn("_block", F.floor(F.col(place) / BLOCK))
    total = df.groupBy(key, "_block").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    before = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offset = total.select(key, "_block", *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums])
    inside = W.partitionBy(key, "_block").orderBy(place).rowsBetween(W.unboundedPreceding, 0)
    out = df
    for o, c in sums.items():
        out = out.withColumn(f"_i_{o}", F.sum(c).over(inside))
    out = out.join(offset, [key, "_block"])
    return out.select(*[c for c in df.columns if c != "_block"], *[(F.col(f"_i_{o}") + F.col(f"_o_{o}")).alias(o) for o in sums])


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, place, h1, h2, chars): turns numbered from 0, with hashes of (role, text)."""
    t = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("_turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("_role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    said = F.struct("_role", "_text")
    # ranges of (conversation, turn): equal turns meet in one range, a long conversation has many
    t = written(t.select("conv", "_turn", "_role", "_text", F.xxhash64(said).alias("h1"), F.xxhash64(F.lit(29), said).alias("h2"),
                         F.char_length("_text").cast("long").alias("chars")).repartitionByRange("conv", F.asc_nulls_first("_turn"))
                .withColumn("_part", F.spark_partition_id()), "trie-turns")
    sizes = t.groupBy("conv", "_part").agg(F.count("*").alias("_n"))
    offset = sizes.select("conv", "_part", F.coalesce(F.sum("_n").over(W.partitionBy("conv").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    order = W.partitionBy("conv", "_part").orderBy(F.asc_nulls_first("_turn"), "_role", "_text")
    return t.withColumn("_r", F.row_number().over(order)).join(offset, ["conv", "_part"]).select("conv", (F.col("_before") + F.col("_r") - 1).alias("place"), "h1", "h2", "chars")


def shared_prefix(numbered: DataFrame, family: int = FAMILY, most: int = MOST_SHARED) -> DataFrame:
    """(conv, d, h1, h2, chars) of every conversation rebuilt: the first h turns of conversation conv - conv % family,
    then its own after its first h; h = crc32 of its number in decimal, modulo ``most``.  d counts from 1.

    A conversation without turns keeps one row with d = 0."""
    sizes = numbered.groupBy("conv").agg(F.count("*").alias("n"))
    conv = sizes.select("conv", "n", (F.col("conv") - F.col("conv") % family).alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h"))
    conv = conv.join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base")), "base", "left")
    conv = written(conv.select("conv", "base", "h", "n", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken")), "trie-conversations")
    # at most ``most`` - 1 turns of a base are looked at, by at most ``family`` conversations each way from it
    first = conv.filter("taken > 0").select("conv", "base", "taken", F.explode(F.sequence(F.lit(0), F.col("taken") - 1)).alias("place"))
    of_base = first.join(numbered.filter(F.col("place") < most).withColumnRenamed("conv", "base"), ["base", "place"]).select("conv", (F.col("place") + 1).alias("d"), "h1", "h2", "chars")
    # a conversation's numbers go to each of its blocks, so that a long one is not one key
    blocks = conv.select("conv", "h", "taken", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))).alias("_block"))
    own = (numbered.withColumn("_block", F.floor(F.col("place") / BLOCK)).join(blocks, ["conv", "_block"]).filter(F.col("place") >= F.col("h"))
           .select("conv", (F.col("taken") + F.col("place") - F.col("h") + 1).alias("d"), "h1", "h2", "chars"))
    empty = conv.filter((F.col("taken") == 0) & (F.col("n") <= F.col("h"))).select("conv", F.lit(0).cast("long").alias("d"), *[F.lit(0).cast("long").alias(c) for c in ("h1", "h2", "chars")])
    return of_base.unionByName(own).unionByName(empty)


def _mixed(seed: int, column: str) -> Column:
    """What a turn adds to the fingerprint of a sequence; exact sums, so that order does not matter."""
    return F.when(F.col("d") > 0, F.xxhash64(F.lit(seed), F.col("d").cast("long"), F.col(column))).otherwise(F.lit(0)).cast("decimal(38,0)")


def trie(sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and ends of a table (conv, d, h1, h2, chars) as ``shared_prefix`` gives it.

    Nodes: (depth, p1, p2) tells a node; conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens.
    Ends: (depth, p1, p2, conv): the conversations that end at a node, one row each."""
    s = written(sequences.select("conv", "d", _mixed(1, "h1").alias("m1"), _mixed(2, "h2").alias("m2"), "chars"), "trie-sequences")
    whole = written(s.groupBy("conv").agg(F.max("d").alias("depth"), F.sum("m1").alias("p1"), F.sum("m2").alias("p2")), "trie-whole")
    node = ["depth", "p1", "p2"]
    # identical conversations become one weighted sequence, told by its least conversation
    seqs = written(whole.groupBy(*node).agg(F.count("*").alias("w"), F.min("conv").alias("rep")), "trie-collapsed")
    blocks = lambda df: df.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("depth") / BLOCK))))
    reps = blocks(seqs.filter("depth > 0").select(F.col("rep").alias("conv"), "w", "depth"))
    rows = (s.filter("d > 0").withColumn("_b", F.floor(F.col("d") / BLOCK)).join(reps, ["conv", "_b"])
            .select("conv", "w", F.col("depth").alias("length"), "d", "m1", "m2", "chars", (F.col("d") - 1).alias("place")))
    rows = running(rows, "conv", "place", {"p1": "m1", "p2": "m2"})
    rows = written(rows.select(F.col("conv").alias("rep"), "w", "length", F.col("d").alias("depth"), "p1", "p2", (F.col("p1") - F.col("m1")).alias("q1"),
                               (F.col("p2") - F.col("m2")).alias("q2"), "chars"), "trie-prefixes")
    inner = rows.filter(F.col("depth") < F.col("length")).select(*node).distinct()
    leaves = seqs.filter("depth > 0").join(inner, node, "left_anti").select("rep", F.col("depth").alias("length"))
    leaves = written(leaves, "trie-leaves")
    leaf_blocks = leaves.select("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / BLOCK))).alias("_b"), F.lit(True).alias("leaf"))
    rows = written(rows.withColumn("_b", F.floor(F.col("depth") / BLOCK)).join(leaf_blocks, ["rep", "_b"], "left"), "trie-rows")
    is_leaf = F.col("leaf").isNotNull()
    nodes = rows.groupBy(*node).agg(F.sum("w").alias("n_convs"), F.min("rep").alias("conv_id"), F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("chars").alias("chars"),
                                    F.min(F.when(is_leaf, F.col("rep"))).alias("owner"), F.count(F.when(is_leaf, 1)).alias("n_leaves"))
    nodes = written(nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("chars")), "trie-nodes")
    # what each leaf sequence owns, and owns above each of its nodes; an owner's nodes are the last ones of its path
    owned = nodes.select("owner", "depth", "own")
    totals = written(owned.groupBy("owner").agg(F.sum("own").alias("all_own")), "trie-owned")
    upto = running(owned, "owner", "depth", {"upto": "own"}).select("owner", "depth", (F.col("upto") - F.col("own")).alias("above"))
    of_leaf = leaves.join(totals.select(F.col("owner").alias("rep"), "all_own"), "rep")
    of_leaf = of_leaf.select("rep", "all_own", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / BLOCK))).alias("_b"))
    below = rows.filter(is_leaf).join(of_leaf, ["rep", "_b"]).groupBy(*node).agg(F.sum("all_own").alias("below"))
    # children: counted by parent; a parent of very many children is looked up by a broadcast
    kids = nodes.filter("depth > 1").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    full = nodes.join(kids, node, "left").join(below, node, "left").join(upto, ["owner", "depth"])
    full = written(full.select(*node, "q1", "q2", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", (F.col("below") - F.col("above")).alias("saved_tokens")), "trie-full")
    parents = full.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    up = ["depth", "q1", "q2"]
    hot = written(parents.filter(F.col("n_children") > HOT_PARENT).drop("n_children"), "trie-hot-parents")
    deep = full.filter("depth > 1")
    if 0 < hot.count() <= BROADCAST_ROWS:
        known = deep.join(F.broadcast(hot), up, "left")
        deep = known.filter("parent_conv_id is not null").unionByName(known.filter("parent_conv_id is null").drop("parent_conv_id").join(
            parents.filter((F.col("n_children") > 0) & (F.col("n_children") <= HOT_PARENT)).drop("n_children"), up))
    else:
        deep = deep.join(parents.filter("n_children > 0").drop("n_children"), up)
    # the root: every conversation is its member; it has no text of its own
    top = seqs.agg(F.sum("w").alias("n_convs"), F.min("rep").alias("conv_id")).filter("n_convs > 0")
    ones = full.filter("depth = 1").agg(F.count("*").alias("n_children"))
    sums = leaves.agg(F.count("*").alias("n_leaves")), totals.agg(F.coalesce(F.sum("all_own"), F.lit(0)).alias("saved_tokens"))
    zero = F.lit(0).cast("decimal(38,0)")
    root = top.select(F.lit(0).cast("long").alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
                      ones.scalar().alias("n_children"), F.greatest(sums[0].scalar(), F.lit(1)).alias("n_leaves"), sums[1].scalar().alias("saved_tokens"))
    columns = root.columns
    first = full.filter("depth = 1").withColumn("parent_conv_id", top.select("conv_id").scalar())
    # the node of depth 0 has no text; a trie of turnless conversations is its root, which is then the only leaf
    nodes = reduce(DataFrame.unionByName, [d.select(*[F.col(c).cast("long").alias(c) if c not in ("p1", "p2") else F.col(c).cast("decimal(38,0)").alias(c) for c in columns]) for d in (root, first, deep)])
    return written(nodes, "trie-result"), whole.select(*node, "conv")


def digests(ends: DataFrame, node: list[str]) -> DataFrame:
    """(node..., ends_sha256): SHA-256 of the ends of each node, ascending in decimal, joined by commas.

    Ends are sorted by ranges of (node, conv) and joined to pieces of text where they are; a node's pieces then pass through one running
    SHA-256 in order, so that neither a task nor the driver ever holds a node's list."""
    spark = ends.sparkSession
    ship(spark)
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in node]).alias("node")
    pieces = ends.select(key, F.col("conv").cast("long").alias("conv")).repartitionByRange("node", "conv").sortWithinPartitions("node", "conv")
    pieces = written(pieces.mapInArrow(_pieces, "node string, first long, piece string"), "trie-ends")
    done = pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_sha, "node string, ends_sha256 string")
    return done


def _pieces(batches):
    for batch in batches:
        nodes = np.asarray(batch.column("node").to_pylist(), dtype=object)
        convs = batch.column("conv").to_numpy(zero_copy_only=False)
        if not len(nodes):
            continue
        cut = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]])
        text = [",".join(map(str, convs[a:b].tolist())) for a, b in zip(cut, np.r_[cut[1:], len(nodes)])]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[cut], pa.string()), pa.array(convs[cut], pa.int64()), pa.array(text, pa.string())], names=["node", "first", "piece"])


def _sha(batches):
    now, state = None, None
    for batch in batches:
        nodes, out = [], []
        for node, piece in zip(batch.column("node").to_pylist(), batch.column("piece").to_pylist()):
            if node != now:
                if now is not None:
                    nodes.append(now)
                    out.append(state.hexdigest())
                now, state = node, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(out, pa.string())], names=["node", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])


def report(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations, with the digests of their ends."""
    nodes, ends = trie(shared_prefix(written(turns(conversations), "trie-numbered")))
    node = ["depth", "p1", "p2"]
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in node])
    out = nodes.withColumn("node", key).join(digests(ends, node), "node", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
