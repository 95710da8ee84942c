"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct 5-word shingles (A-Z lower-cased; with fewer words, the whole sequence as one; none
without words).  Two documents link if the Jaccard similarity of their sets is at least 80 %.

* Documents with equal sets are one node, told by a 64-bit hash of the set: copies are never paired.
* In any one order of all shingles (by hash here), two similar sets share at least m shingles among the first
  n - ceil(0.8 n) + m of each, for every m.  With m = 1 + 5 % of n, a grouped minimum and maximum finds the shingles that
  nodes share; nodes with fewer than m shared ones in that prefix have no partner and are done.  (With m = 1, any
  license line would keep its documents in.)
* For the others, m is chosen per node by estimated candidate cost.  Posting lists of more than ``LONG`` nodes are
  passed over; with s of them in a prefix, a partner must be met m - s times in the others, so that about
  hits / (m - s) candidates are left.  The m of least cost is taken: frequent phrases cost their documents a longer
  prefix, not candidates.  Prefixes grow by up to 10 % of the set first; only for nodes that are still held by
  long lists are they grown up to the whole set.  Nodes that no m frees (members of large groups of near copies)
  use the long lists.
* First each node is verified against one leader, the node of most shared prefix that leads most of its lists, so that
  a large group of near copies costs pairs in proportion to its size.
* Then the rest is finished exactly: pairs between different components that are met often enough in the short lists
  are verified.  Long lists that a node cannot pass over are taken together by their largest component, so that a
  set is sent once for all lists of a large group: nodes outside that component are compared with all nodes
  of these lists, in blocks of bounded size that return a spanning forest of their links.

No pair within one component is looked at again, and no candidate is dropped.  Links are complete
up to transitivity: components are exact.

Defined cases: null and empty texts, and texts without words, have an empty set and link with nothing; repeated rows
share a node; component_id is the least non-null doc_id of a component (null if there is none); documents with an empty
set are their own component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import BROADCAST_ROWS, forget, in_arrow, keep_keys, ship, text_of, unused, written
from .components import components

WORDS = 5
#: Similarity as a fraction of integers.
NUM, DEN = 80, 100
#: Shingles (with repeats) of one side of a block; a set counts as ``EACH`` more, so that pairs of small sets are bounded too.
BLOCK = 1 << 20
EACH = 64
#: Pairs of one leader in one group of a join.
SALT = 200
#: Nodes of a posting list beyond which prefixes grow to pass over it.
LONG = 128
#: Passes over the first prefixes, each for the shingles of one remainder, so that only one pass's shuffles lie on disk.
PASSES = 4


def _need(n):
    """The least overlap with any similar set: ceil(0.8 n)."""
    return (NUM * n + DEN - 1) // DEN


def _first(n):
    """m of the first prefix, which all documents have: 1 + 5 % of the set."""
    return 1 + n // 20


def signatures(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """(doc_id, row_key, n, node, prefix): set size, hash of the set, and its first prefix."""
    def run(batch):
        for i, j, data, offsets in K.texts(batch.column("text")):
            g, first, _ = K.shingle_sets(data, offsets, k)
            n = np.diff(first)
            total = np.concatenate([[K.U(0)], np.cumsum(K.mix(g + K.U(77)))])
            node = K.mix(total[first[1:]] - total[first[:-1]] + n.astype(K.U) * K.U(K.BASE))
            take = np.where(n > 0, n - _need(n) + _first(n), 0)
            rank = np.arange(len(g)) - np.repeat(first[:-1], n)
            keep = rank < np.repeat(take, n)
            yield {"doc_id": batch.column("doc_id").slice(i, j - i), "row_key": batch.column("row_key").slice(i, j - i), "n": n,
                   "node": K.signed(node), "prefix": K.per_text(g[keep], np.concatenate([[0], np.cumsum(take)]))}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("row_key"), "text")
    return in_arrow(rows, "doc_id long, row_key long, n long, node long, prefix array<long>", run)


def full_sets(docs: DataFrame, rows: DataFrame, k: int = WORDS) -> DataFrame:
    """(node, n, shingles) of the texts whose row_key is in ``rows`` (row_key, node)."""
    def run(batch):
        for i, j, data, offsets in K.texts(batch.column("text")):
            g, first, _ = K.shingle_sets(data, offsets, k)
            yield {"node": batch.column("node").slice(i, j - i), "n": np.diff(first), "shingles": K.per_text(g, first)}

    side = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
    texts = docs.select(F.xxhash64(text_of()).alias("row_key"), "text").join(side, "row_key")
    return in_arrow(texts, "node long, n long, shingles array<long>", run)


def _choose(long: int, whole: bool):
    """m of least cost per node; ``whole``: prefixes may grow to the whole set."""
    def run(batch):
        lists = batch.column("tokens")
        flat = lists.flatten()
        rank, token, freq = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("rank", "token", "freq"))
        cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        node, n = batch.column("node").to_numpy(), batch.column("n").to_numpy()
        out = {c: [np.zeros(0, np.int64)] for c in ("token", "node", "n", "m", "passed", "weight")}
        for x in range(len(node)):
            a, b = cuts[x], cuts[x + 1]
            order = np.argsort(rank[a:b])
            r, t, f = rank[a:b][order], token[a:b][order], freq[a:b][order]
            m = np.arange(1, (_need(n[x]) if whole else min(_need(n[x]), 1 + -(-n[x] // 10))) + 1)
            end = np.searchsorted(r, n[x] - _need(n[x]) + m)  # shared shingles in the prefix of each m
            if not whole and (end < m).any():  # fewer than m: no partner (all nodes bring prefixes of this length)
                continue
            passed = np.concatenate([[0], np.cumsum(f > long)])[end]
            hits = np.concatenate([[0], np.cumsum(np.where(f > long, 0, f - 1))])[end]
            margin = m - passed
            # candidates left, and the rows that the longer prefix costs
            cost = np.where(margin > 0, hits / np.maximum(margin, 1) + 0.1 * end, np.inf)
            best = int(np.argmin(cost))
            here = int(end[best])
            for c, v in (("token", t[:here]), ("node", node[x]), ("n", n[x]), ("m", m[best]), ("passed", passed[best]), ("weight", f[:here].sum())):
                out[c].append(np.broadcast_to(np.asarray(v, np.int64), here))
        yield {c: np.concatenate(v) for c, v in out.items()}
    return run


def _with_frequency(tokens: DataFrame, freq: DataFrame, whole: bool) -> DataFrame:
    shared = tokens.join(freq.hint("merge"), "token").groupBy("node", "n").agg(F.collect_list(F.struct("rank", "token", "freq")).alias("tokens"))
    return in_arrow(shared, "token long, node long, n long, m long, passed long, weight long", _choose(LONG, whole))


def postings(sets: DataFrame) -> DataFrame:
    """(token, node, n, m, passed, weight): shared prefix shingles of nodes, with m chosen per node.

    ``passed``: shingles of the prefix with long lists.  A node with passed < m need not use them.
    """
    longest = F.expr(f"cast(n - ({NUM} * n + {DEN - 1}) div {DEN} + 1 + least(({NUM} * n + {DEN - 1}) div {DEN}, 1 + (n + 9) div 10) as int)")
    tokens = sets.select("node", "n", F.posexplode(F.slice("shingles", 1, longest)).alias("rank", "token"))
    often = written(tokens.groupBy("token").agg(F.count("*").alias("freq")).filter("freq > 1"), "join-frequencies")
    some = written(_with_frequency(tokens, often, False), "join-postings")
    forget(often)
    # nodes still held by long lists: their prefixes may grow to the whole set
    held = written(some.filter("passed >= m").select("node").distinct(), "join-held")
    free = keep_keys(some, held, "node", "left_anti")
    grown = keep_keys(sets, held, "node").select("node", "n", F.posexplode("shingles").alias("rank", "token"))
    freq = written(free.select("token", F.lit(False).alias("grown")).unionByName(grown.select("token", F.lit(True).alias("grown")))
                   .groupBy("token").agg(F.count("*").alias("freq"), F.max("grown").alias("grown")).filter("grown and freq > 1").drop("grown"), "join-frequencies")
    more = written(_with_frequency(grown, freq, True), "join-grown")
    forget(freq)
    lists = free.unionByName(more).drop("passed")
    # what is long, by the lists as they are now
    long = written(lists.groupBy("token").count().filter(F.col("count") > LONG).select("token"), "join-long")
    passed = written(keep_keys(lists, long, "token").groupBy("node").agg(F.count("*").alias("passed")), "join-passed")
    side = F.broadcast(passed) if passed.count() <= BROADCAST_ROWS else passed
    out = written(lists.join(side, "node", "left").withColumn("passed", F.coalesce("passed", F.lit(0))), "join-postings")
    forget(some, held, more, long, passed)
    return out


def _similar(size_a: str, size_b: str, both: str) -> str:
    return f"{DEN} * {both} >= {NUM} * ({size_a} + {size_b} - {both})"


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar, written.  b may be hot: its pairs are salted, its set repeated for each salt."""
    pairs = written(pairs.distinct(), "join-pairs")
    hot = written(pairs.groupBy("b").count().filter(F.col("count") > SALT).select("b", F.ceil(F.col("count") / SALT).cast("int").alias("salts")), "join-hot")
    side = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    salted = pairs.join(side, "b", "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("a"), F.col("salts")).cast("int")))
    left = keep_keys(sets, pairs.select(F.col("a").alias("node")).distinct(), "node").select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    right = (keep_keys(sets, pairs.select(F.col("b").alias("node")).distinct(), "node").select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
             .join(side, "b", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))).drop("salts"))
    both = salted.select("a", "b", "salt").join(left, "a").join(right, ["b", "salt"])
    both = both.filter(f"{DEN} * least(n_a, n_b) >= {NUM} * greatest(n_a, n_b)").withColumn("both", F.size(F.array_intersect("s_a", "s_b")))
    out = written(both.filter(_similar("n_a", "n_b", "both")).select("a", "b"), "join-links")
    forget(pairs, hot)
    return out


def _block_links(table: pa.Table) -> pa.Table:
    """Links of one block: outsiders against members, as few as join what is similar here."""
    lists = table.column("shingles").combine_chunks()
    node, comp, n, outside = (table.column(c).to_numpy() for c in ("node", "component", "n", "outside"))
    cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    _, code = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    seen = np.zeros(code.max(initial=-1) + 1, np.int64)
    members = np.flatnonzero(~outside)
    spread = np.concatenate([code[cuts[m]:cuts[m + 1]] for m in members]) if len(members) else code[:0]
    first = np.concatenate([[0], np.cumsum(n[members])])[:-1].astype(np.int64)
    _, root = np.unique(comp, return_inverse=True)  # the component of each row, merged as links are found
    a, b = [], []
    for x in np.flatnonzero(outside):
        if not len(members):
            break
        seen[code[cuts[x]:cuts[x + 1]]] = 1
        both = np.add.reduceat(seen[spread], first)
        seen[code[cuts[x]:cuts[x + 1]]] = 0
        ok = np.flatnonzero((DEN * both >= NUM * (n[x] + n[members] - both)) & (root[members] != root[x]))
        joined, lead = np.unique(root[members][ok], return_index=True)
        root[np.isin(root, joined)] = root[x]
        a.append(np.full(len(lead), node[x]))
        b.append(node[members][ok[lead]])
    return pa.table({"a": np.concatenate(a) if a else np.zeros(0, np.int64), "b": np.concatenate(b) if b else np.zeros(0, np.int64)}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def finish(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between different components of posting lists (token, node, n, m, passed, component)."""
    stuck = F.col("passed") >= F.col("m")
    per_comp = lists.groupBy("token", "component").agg(F.count("*").alias("c"), F.max(stuck).alias("stuck"))
    shape = written(per_comp.groupBy("token").agg(F.sum("c").alias("rows"), F.max_by("component", F.struct("c", "component")).alias("top"), F.max_by("stuck", F.struct("c", "component")).alias("top_stuck"),
                                                  F.count("*").alias("parts"), F.max("stuck").alias("stuck"))
                    .filter(f"parts > 1 and (rows <= {LONG} or stuck)").drop("parts", "stuck"), "join-open")
    side = F.broadcast(shape) if shape.count() <= BROADCAST_ROWS else shape
    open_lists = written(lists.join(side, "token"), "join-lists")
    short = open_lists.filter(f"rows <= {LONG}").select("token", "node", "n", "m", "passed", "component")
    x, y = short.alias("x"), short.alias("y")
    met = x.join(y, F.expr(f"x.token = y.token and x.node < y.node and x.component <> y.component and {DEN} * least(x.n, y.n) >= {NUM} * greatest(x.n, y.n)"))
    # similar sets share overlap = ceil(0.8 (n + n') / 1.8) shingles, and at most ceil(0.8 n) - m beyond a prefix
    overlap, beyond = f"((x.n + y.n) * {NUM} + {NUM + DEN - 1}) div {NUM + DEN}", "(({s}.n * %d + %d) div %d - {s}.m)" % (NUM, DEN - 1, DEN)
    met = met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"),
                     F.expr(f"{overlap} - greatest({beyond.format(s='x')}, {beyond.format(s='y')}) - least(x.passed, y.passed)").alias("least"))
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("times"), F.max("least").alias("least")).filter("times >= least").select("a", "b")
    near = verify(pairs, sets)
    # a pair needs a long list only if one of it is stuck
    nodes = written(open_lists.filter(f"rows > {LONG}").groupBy("top", "node").agg(
        F.first("component").alias("component"), F.first("n").alias("n"), F.max((F.col("component") != F.col("top")) & (F.col("top_stuck") | stuck)).alias("outside")), "join-grouped")
    forget(shape, open_lists)
    weight = F.col("n") + EACH
    sizes = written(nodes.groupBy("top").agg(F.ceil(F.sum(weight) / BLOCK).cast("int").alias("all_blocks"), F.ceil(F.sum(F.when(F.col("outside"), weight)) / BLOCK).cast("int").alias("out_blocks"))
                    .filter("out_blocks > 0"), "join-blocks")
    long = nodes.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes, "top")
    where = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    members = long.select("top", "node", "component", F.lit(False).alias("outside"), F.explode(F.sequence(F.lit(0), F.col("out_blocks") - 1)).alias("i"), where("all_blocks").alias("j"))
    outside = long.filter("outside").select("top", "node", "component", "outside", where("out_blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("j"))
    used = written(long.select("node").distinct(), "join-used")
    blocks = members.unionByName(outside).join(keep_keys(sets, used, "node"), "node")
    ship(lists.sparkSession)
    far = written(blocks.groupBy("top", "i", "j").applyInArrow(_block_links, "a long, b long"), "join-far")
    forget(nodes, sizes, used)
    return near.unionByName(far)


def met_often(whole: DataFrame) -> DataFrame:
    """(node, met), written: how many shingles of its prefix a node shares with others, over all its rows."""
    tokens = whole.select("node", F.explode("prefix").alias("token"))
    parts = []
    for i in range(PASSES):
        mine = tokens.filter(F.pmod("token", F.lit(PASSES)) == i)
        shared = written(mine.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("token"), "join-shared")
        # shared shingles grow with the corpus: joined by a shuffle at every size
        parts.append(written(mine.join(shared.hint("merge"), "token", "left_semi").groupBy("node").agg(F.count("*").alias("met")), "join-met"))
        forget(shared)
    met = written(reduce(DataFrame.unionByName, parts).groupBy("node").agg(F.sum("met").alias("met")), "join-met")
    forget(*parts)
    return met


def clusters(docs: DataFrame, k: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """((doc_id, row_key, n, node) for every row, (node, component) for nodes with links).

    Steps are deleted as soon as what reads them is written: what is held beside the sets is narrow.
    """
    whole = written(signatures(docs, k), "join-signatures")
    met = met_often(whole)
    # each copy of a node brings the same shared shingles
    copies = whole.filter("n > 0").groupBy("node").agg(F.count("*").alias("copies"), F.min("row_key").alias("row_key"), F.first("n").alias("n"))
    active = written(copies.join(met, "node").filter("met >= copies * (1 + n div 20)").select("node", "row_key"), "join-active")
    forget(met)
    sig = written(whole.drop("prefix"), "join-nodes")
    forget(whole)
    sets = written(full_sets(docs, active, k).dropDuplicates(["node"]), "join-sets")
    forget(active)
    lists = postings(sets)
    leaders = lists.groupBy("token").agg(F.max_by(F.struct("node", "n"), F.struct("weight", "node")).alias("y"), F.count("*").alias("rows")).filter("rows > 1").select("token", "y")
    led = lists.join(leaders, "token").filter(f"node <> y.node and {DEN} * least(n, y.n) >= {NUM} * greatest(n, y.n)").groupBy("node", F.col("y.node").alias("b")).count()
    pairs = led.groupBy("node").agg(F.max_by("b", F.struct("count", "b")).alias("b")).select(F.col("node").alias("a"), "b")
    links = verify(pairs, sets)
    first = written(components(links, "join-components"), "join-first")
    placed = written(lists.join(first, "node", "left").withColumn("component", F.coalesce("component", "node")), "join-placed")
    forget(lists)
    more = finish(placed, sets)
    forget(placed, sets)
    if not more.isEmpty():
        first = written(components(links.unionByName(more), "join-components"), "join-last")
    return sig, first


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    sig, comp = clusters(docs)
    joined = written(sig.join(comp, "node", "left").withColumn("group", F.when(F.col("n") > 0, F.coalesce("component", "node"))), "join-groups")
    least = written(joined.filter("n > 0").groupBy("group").agg(F.min("doc_id").alias("least")), "join-least")
    out = joined.join(least, "group", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: least doc_id, then least text hash; null ids last.

    Rows without words stay.  Other columns are kept as they are, whatever their names.
    """
    id_, key = unused(docs, "_id"), unused(docs, "_key")
    named = docs.select("doc_id", "text")
    sig, comp = clusters(named)
    joined = sig.join(comp, "node", "left").withColumn("group", F.when(F.col("n") > 0, F.coalesce("component", "node")))
    joined = written(joined.select("doc_id", "row_key", "group"), "join-groups")
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row_key")
    best = joined.filter("group is not null").groupBy("group").agg(F.min(order).alias("b"))
    losers = written(joined.select("group", "doc_id", "row_key").join(written(best, "join-best"), "group")
                     .filter(~(F.col("doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("row_key") == F.col("b.row_key"))))
                     .select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias(id_), F.col("row_key").alias(key)).distinct(), "join-losers")
    side = F.broadcast(losers) if losers.count() <= BROADCAST_ROWS else losers
    kept = docs.withColumn(id_, F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).withColumn(key, F.xxhash64(text_of()))
    kept = kept.join(side, [id_, key], "left_anti")
    # rows that repeat id and text: one of them
    twice = written(joined.filter("group is not null").groupBy("doc_id", "row_key").count().filter("count > 1").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias(id_), F.col("row_key").alias(key)), "join-twice")
    if not twice.isEmpty():
        again = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice
        single = kept.join(again, [id_, key], "left_anti")
        kept = single.unionByName(kept.join(again, [id_, key], "left_semi").dropDuplicates([id_, key]))
    return kept.select(*docs.columns)
