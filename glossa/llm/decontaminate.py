"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingles.

An item is contained in a document if at least ``threshold`` of its distinct 5-word shingles (A-Z lower-cased)
occur there.  Items are partitioned by size (powers of two of their number of shingles).  In the partition with sizes
up to u, an item is represented by its least-hashed shingles, as many as containment ``threshold`` can miss plus
one: a document that contains the item has at least one of them, however long the document is.  (Signatures of equal
length on both sides, compared for Jaccard similarity, lose short items in long documents.)  Documents with a sketch
shingle are candidates, and the exact shingle containment of each candidate pair decides.

Documents are never shuffled: the items' hashes go to the documents, in blocks of about ``block`` hashes, one pass
a block, so that what is sent is bounded whatever the number of items.  All shingles of an item's text are in
one block (an item of more than ``block`` shingles makes its block larger), so that a block alone can tell
the candidates of its items, and the number of blocks does not change the result.

Defined cases: items of 1 to 4 words are one shingle of their own length; items and texts that are null or
without words match nothing; repeated rows and copies are decided by their text; equal items each match;
other columns are ignored; an empty table on either side gives no pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import BROADCAST_ROWS, in_arrow, text_of, unused, written

WORDS, THRESHOLD = 5, 0.8
BLOCK = 2_000_000


def item_shingles(items: DataFrame, k: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, item, text_key, n, need, words, hash, sketch): the shingles of each item; ``item`` tells equal ids apart."""
    def run(batch):
        ids = batch.column("item_id").to_pylist()
        keys = batch.column("item").to_pylist()
        text_keys = batch.column("text_key").to_numpy()
        for i, j, data, offsets in K.texts(batch.column("text")):
            hashes, first, count = K.shingle_sets(data, offsets, k)
            n = np.diff(first)
            need = np.ceil(threshold * n - 1e-9).astype(np.int64)
            # the sketch length of a size partition is that of its largest size
            top = 2 ** np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)
            size = np.maximum(n - need + 1, np.minimum(n, top - np.ceil(threshold * top - 1e-9).astype(np.int64) + 1))
            rank = np.arange(len(hashes)) - np.repeat(first[:-1], n)
            yield {"item_id": np.repeat(np.array(ids[i:j], object), n).tolist(), "item": np.repeat(np.array(keys[i:j], np.int64), n),
                   "text_key": np.repeat(text_keys[i:j], n),
                   "n": np.repeat(n, n), "need": np.repeat(need, n), "words": np.repeat(np.minimum(count, k), n).astype(np.int32),
                   "hash": K.signed(hashes), "sketch": rank < np.repeat(size, n)}

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(F.col("item_id"), text_of()).alias("item"), F.xxhash64(text_of()).alias("text_key"), "text").dropDuplicates(["item"])
    return in_arrow(rows, "item_id long, item long, text_key long, n long, need long, words int, hash long, sketch boolean", run)


class Probe:
    """Which of many hashes are among a block of item hashes."""

    def __init__(self, hashes: np.ndarray, sketch: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.sketch = sketch[order]
        self.bits = max(16, min(26, int(np.ceil(np.log2(max(len(hashes), 1)))) + 6))
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[(self.hashes >> K.U(64 - self.bits)).astype(np.int64)] = True

    def hits(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in g of members, and whether each is a sketch hash."""
        at = np.flatnonzero(self.maybe[(g >> K.U(64 - self.bits)).astype(np.int64)])
        where = np.searchsorted(self.hashes, g[at])
        where[where == len(self.hashes)] = 0
        ok = self.hashes[where] == g[at]
        return at[ok], self.sketch[where[ok]]


def candidates(docs: DataFrame, shingles: DataFrame, k: int = WORDS, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_key, hash): item shingles in the documents that have a sketch shingle."""
    wanted = shingles.groupBy("text_key", "hash", "words").agg(F.max("sketch").alias("sketch"))
    blocks = max(1, -(-wanted.count() // block))
    rows = docs.select(F.col("doc_id"), F.xxhash64(text_of()).alias("text_key"), "text")
    out = None
    spark = docs.sparkSession
    for b in range(blocks):
        mine = wanted.filter(F.pmod(F.xxhash64("text_key"), F.lit(blocks)) == b)  # whole items, about `block` hashes
        part = mine.groupBy("hash", "words").agg(F.max("sketch").alias("sketch")).toArrow()
        hashes = part["hash"].to_numpy().view(np.uint64)
        length, sketch = part["words"].to_numpy(), part["sketch"].to_numpy(zero_copy_only=False)
        shared = spark.sparkContext.broadcast({int(n): Probe(hashes[length == n], sketch[length == n]) for n in np.unique(length)})

        def run(batch, shared=shared):
            ids, keys = batch.column("doc_id"), batch.column("text_key").to_numpy()
            for i, j, data, offsets in K.texts(batch.column("text")):
                starts, ends, first = K.words(data, offsets)
                w = K.spans(data, starts, ends, K.LOWER)
                doc = np.repeat(np.arange(j - i), np.diff(first))
                got = []
                for n, probe in shared.value.items():
                    g = K.runs(w, n) if n == k else _short(w, n)
                    at, is_sketch = probe.hits(g)
                    ok = doc[at] == doc[at + n - 1]
                    got.append((doc[at[ok]], g[at[ok]], is_sketch[ok]))
                if not got:
                    continue
                d, h, s = (np.concatenate(x) for x in zip(*got))
                candidate = np.zeros(j - i, bool)
                candidate[d[s]] = True
                keep = candidate[d]
                d, h = d[keep], h[keep]
                if len(d):
                    order = np.lexsort((h, d))
                    d, h = d[order], h[order]
                    new = np.ones(len(d), bool)
                    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
                    d, h = d[new], h[new]
                    yield {"doc_id": ids.take(d + i), "text_key": keys[d + i], "hash": K.signed(h)}

        found = in_arrow(rows, "doc_id long, text_key long, hash long", run)
        out = found if out is None else out.unionByName(found)
    return out


def _short(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of runs of n words as `shingle_sets` gives them to texts of n words, n below the shingle length."""
    m = len(w) - n + 1
    out = np.zeros(max(m, 0), K.U)
    p = K.powers(K.STEP, n)
    for t in range(n if m > 0 else 0):
        out += w[t:t + m] * p[t]
    return K.mix(out + K.U(n))


def contained(docs: DataFrame, items: DataFrame, k: int = WORDS, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_key, item_id, n_shingles, n_found, containment) for every pair at or above the threshold."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    shingles = written(item_shingles(items, k, threshold), "decon-items")
    found = candidates(docs, shingles, k, block)
    side = shingles.drop("text_key")
    side = F.broadcast(side) if shingles.count() <= BROADCAST_ROWS else side
    # a candidate pair is one with a sketch hit; the count over all of the item's shingles verifies it
    pairs = (found.distinct().join(side, "hash").groupBy("doc_id", "text_key", "item_id", "item", "n", "need")
             .agg(F.count("*").alias("n_found"), F.max("sketch").alias("candidate")))
    return (pairs.filter("candidate and n_found >= need")
            .select("doc_id", "text_key", "item_id", F.col("n").alias("n_shingles"), "n_found", (F.col("n_found") / F.col("n")).alias("containment")))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contained(docs, items).select("doc_id", "item_id", "n_shingles", "n_found", "containment").distinct()


def remove(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that contain an item; rows are told by their text.  Other columns stay as they are, whatever their names."""
    key = unused(docs, "_text_key")
    bad = written(contained(docs.select("doc_id", "text"), items).select(F.col("text_key").alias(key)).distinct(), "decon-texts")
    side = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return docs.withColumn(key, F.xxhash64(text_of())).join(side, key, "left_anti").select(*docs.columns)
