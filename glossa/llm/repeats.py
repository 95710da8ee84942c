"""Repeated strings of a fixed length, found from anchors: the engine of substring and suffix de-duplication.

A document is a sequence of units (words or bytes).  Among the k-unit strings that start in a window of L units the
one with the least hash (leftmost on ties) is the window's anchor.  Equal windows have equal anchors at equal offsets,
so that only anchors whose string repeats need a second look, and a sequence has about 2 / (L - k + 2) anchors a unit.

Repeated anchors are extended both ways, L - k units to each side.  Where the extended string repeats, so do all
windows in it.  What is left is the edges of repeats: there, the offsets of an anchor's windows are
cut into nodes of falling size.  The string common to a node's windows (its core) must repeat for any of them
to; the string that spans them (its reach) repeats if they all do at one place; nodes in between are cut further, down
to single windows.  Every step groups hashes (combined before the shuffle), so that no pair of places is made.  Distinct
extensions of one hot anchor are told apart by a semi join on a written table of anchors, which is a broadcast or a join that
Spark may split, never a group of them in one task.

``ordered``: a window counts only if the same string starts earlier (a smaller place); otherwise if
it starts anywhere else.  A place is (doc_id, row key, position).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import in_arrow, keep_keys, text_of, written

#: Windows of one piece of a long document.
PIECE = 1 << 20
INVERSE = pow(K.STEP, -1, 2**64)


@dataclass(frozen=True)
class Setting:
    length: int
    k: int
    nodes: tuple[int, ...]
    ordered: bool
    by_bytes: bool
    #: windows of one piece of a long document; PIECE if not given
    piece: int | None = None

    @property
    def side(self) -> int:
        return self.length - self.k


def sequences(column: pa.Array, by_bytes: bool):
    """(first row, end row, unit values, index of each text's first unit) for runs of whole texts."""
    for i, j, data, offsets in K.texts(column):
        if by_bytes:
            yield i, j, data, offsets
        else:
            starts, ends, first = K.words(data, offsets)
            yield i, j, K.spans(data, starts, ends), first


def _sums(v: np.ndarray) -> np.ndarray:
    v = K.BYTES[v] if v.dtype == np.uint8 else v
    out = np.zeros(len(v) + 1, K.U)
    np.cumsum(v * K.powers(K.STEP, len(v)), out=out[1:])
    return out


def _hash(sums: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return K.mix((sums[e] - sums[s]) * K.powers(INVERSE, len(sums))[s] + (e - s).astype(K.U) * K.U(K.BASE))


def _pieces(v: np.ndarray, first: np.ndarray, length: int, piece: int | None = None):
    """(values, first, text of each segment, start of each segment in its text): long texts in pieces that overlap by length - 1."""
    piece = piece or PIECE
    n = np.diff(first)
    if not len(n):
        return
    if n.max() <= 2 * piece:
        yield v, first, np.arange(len(n)), np.zeros(len(n), np.int64)
        return
    for i, size in enumerate(n.tolist()):
        for at in range(0, size - length + 1, piece):
            part = v[first[i] + at:min(first[i] + at + piece + length - 1, first[i + 1])]
            yield part, np.array([0, len(part)]), np.array([i]), np.array([at])


ROW = "core long, reach long, doc_id long, row_key long, pos long, meta long"


def _meta(before, after, lo, hi):
    """What lies before and after the place, and the offsets of the windows to judge, in one number."""
    return (before << 30) | (after << 20) | (lo << 10) | hi


def anchors(rows: DataFrame, s: Setting) -> DataFrame:
    """Anchors as (core, reach, doc_id, row_key, pos, meta): the anchor's hash, and that of its extension to both sides."""
    def run(batch):
        ids, keys = batch.column("doc_id"), batch.column("row_key").to_numpy()
        for i, j, values, start in sequences(batch.column("text"), s.by_bytes):
            for v, first, text, base in _pieces(values, start, s.length, s.piece):
                if len(v) < s.length:
                    continue
                sums = _sums(v)
                at = np.arange(len(v) - s.k + 1)
                seeds = _hash(sums, at, at + s.k)
                best, ok = K.minimizers(seeds, s.side + 1, first[:-1], np.maximum(np.diff(first) - s.k + 1, 0))
                windows = np.flatnonzero(ok)
                if not len(windows):
                    continue
                p = best[windows]
                new = np.ones(len(p), bool)
                new[1:] = p[1:] != p[:-1]
                lead = np.flatnonzero(new)
                p, hi = p[lead], p[lead] - windows[lead]
                lo = p - windows[np.append(lead[1:], len(windows)) - 1]
                seg = np.searchsorted(first, p, "right") - 1
                left = np.maximum(p - s.side, first[seg])
                right = np.minimum(p + s.length, first[seg + 1])
                reach = K.mix(_hash(sums, left, right) + (p - left).astype(K.U) * K.U(0x9E3779B97F4A7C15))
                yield {"core": K.signed(seeds[p]), "reach": K.signed(reach), "doc_id": ids.take(i + text[seg]), "row_key": keys[i + text[seg]],
                       "pos": p - first[seg] + base[seg], "meta": _meta(p - left, right - p, lo, hi)}

    return in_arrow(rows, ROW, run)


def nodes(spots: DataFrame, s: Setting, size: int) -> DataFrame:
    """The nodes of ``size`` offsets of (doc_id, row_key, text, spots): hashes of their cores and reaches.

    Nodes are cut at multiples of ``size`` whatever the windows of a place are, so that equal windows are in
    equal nodes.  A reach that leaves its document is null: it stands for itself alone.
    """
    def run(batch):
        ids, keys = batch.column("doc_id"), batch.column("row_key").to_numpy()
        lists = batch.column("spots")
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        for i, j, v, first in sequences(batch.column("text"), s.by_bytes):
            sums = _sums(v)
            mine = flat[cuts[i]:cuts[j]]
            text = np.repeat(np.arange(j - i), np.diff(cuts[i:j + 1]))
            pos, lo, hi = mine >> 20, (mine >> 10) & 1023, mine & 1023
            count = hi // size - lo // size + 1
            row = np.repeat(np.arange(len(mine)), count)
            node = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + lo[row] // size
            least, most = node * size, node * size + size - 1
            low, high = np.maximum(least, lo[row]), np.minimum(most, hi[row])
            text = text[row]
            p = pos[row] + first[text]
            mark = node.astype(K.U) * K.U(0xA0761D6478BD642F)
            core = K.mix(_hash(sums, p - least, p - most + s.length) + mark)
            inside = (p - most >= first[text]) & (p - least + s.length <= first[text + 1])
            reach = np.zeros(len(p), K.U)
            reach[inside] = K.mix(_hash(sums, (p - most)[inside], (p - least)[inside] + s.length) + mark[inside])
            yield {"core": K.signed(core), "reach": pa.array(K.signed(reach), mask=~inside), "doc_id": ids.take(i + text), "row_key": keys[i + text],
                   "pos": pos[row], "meta": _meta(most, s.length - least, low, high)}

    return in_arrow(spots, ROW, run)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, text): repeated rows share a key and are one document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text_of()).alias("row_key"), "text")


def covered(rows: DataFrame, s: Setting) -> DataFrame:
    """(doc_id, row_key, start, end): strings all of whose windows count as repeated; they overlap.

    ``rows`` is what ``keyed`` gives.
    """
    place = F.struct("doc_id", "row_key", "pos")
    # A place next to the cut of a long text has two entries with parts of its windows: its range is the one that spans
    # both.  All else in meta is equal for a kind.
    bits = lambda shift: F.shiftright("meta", shift).bitwiseAND(1023)
    from_lo, to_hi = (F.min(F.struct("doc_id", "row_key", "pos", w.alias("w")))["w"] for w in (bits(10), -bits(0)))
    meta = F.shiftleft(F.shiftrightunsigned(F.min_by("meta", place), 20), 20) + F.shiftleft(from_lo, 10) - to_hi
    level = written(anchors(rows, s), "repeat-anchors")
    twice = written(level.groupBy("core").count().filter("count > 1").select("core"), "repeat-cores")
    level = written(keep_keys(level, twice, "core"), "repeat-level")
    out = None
    for size in (0, *s.nodes):
        if size:
            spots = left_over.groupBy("doc_id", "row_key").agg(F.collect_list(
                F.shiftleft("pos", 20) + F.col("meta").bitwiseAND((1 << 20) - 1)).alias("spots"))
            spots = written(spots.withColumnRenamed("doc_id", "_d"), "repeat-spots")
            here = rows.join(spots, "row_key").filter(F.col("doc_id").eqNullSafe(F.col("_d"))).select("doc_id", "row_key", "text", "spots")
            level = nodes(here, s, size)
            level = written(level, "repeat-nodes")
        alone = F.xxhash64("core", "doc_id", "row_key", "pos")
        level = level.withColumn("kind", F.coalesce("reach", alone))
        same = written(level.groupBy("core", "kind").agg(F.min(place).alias("first"), F.max(place).alias("last"), meta.alias("meta"),
                                                         F.max(F.col("reach").isNotNull()).alias("real")), "repeat-kinds")
        repeat = same.filter("real and first <> last").select(F.col("kind").alias("k2"), F.col("core").alias("c2"), "first")
        hit = level.join(written(repeat, "repeat-hits"), (F.col("core") == F.col("c2")) & (F.col("kind") == F.col("k2")))
        if s.ordered:
            hit = hit.filter(place != F.col("first"))
        part = hit.select("doc_id", "row_key", (F.col("pos") - F.shiftrightunsigned("meta", 30)).alias("start"),
                          (F.col("pos") + F.shiftright("meta", 20).bitwiseAND(1023)).alias("end"))
        part = written(part, "repeat-covered")
        out = part if out is None else out.unionByName(part)
        if size != 1:
            edges = written(same.groupBy("core").count().filter("count > 1").select("core"), "repeat-edge-cores")
            left_over = written(keep_keys(same, edges, "core").select("first.*", "meta"), "repeat-edges")
    return out


def merged(spans: DataFrame) -> DataFrame:
    """(doc_id, row_key, spans): covered strings merged to maximal runs, in order."""
    lists = spans.groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))

    def run(batch):
        col = batch.column("spans")
        flat = col.flatten()
        start, end = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("start", "end"))
        cuts = col.offsets.to_numpy() - col.offsets[0].as_py()
        out = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            top = np.maximum.accumulate(end[a:b])
            lead = np.flatnonzero(np.append(True, start[a + 1:b] > top[:-1]))
            out.append([{"start": int(x), "end": int(y)} for x, y in zip(start[a:b][lead], top[np.append(lead[1:], b - a) - 1])])
        yield {"doc_id": batch.column("doc_id"), "row_key": batch.column("row_key"), "spans": out}

    return in_arrow(lists, "doc_id long, row_key long, spans array<struct<start:long,end:long>>", run)


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` (doc_id, row_key, text) with their maximal runs, empty where there are none."""
    side = spans.withColumnRenamed("doc_id", "_d").withColumnRenamed("row_key", "_k")
    on = (F.col("row_key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    return docs.join(side, on, "left").select("doc_id", "row_key", "text", "spans")
