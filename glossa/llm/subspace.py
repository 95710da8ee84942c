"""Embedding near-duplicates by a subspace pigeonhole join.

Two unit vectors of cosine t are at squared distance 2 - 2 t.  Vectors are turned by fast Hadamard pseudo-rotations (random signs and a Hadamard
transform, three rounds), which spread every difference evenly, and cut into ``blocks`` blocks of equal dimension.  If two vectors are within the
squared distance r2, then in some block they are within r2 times that block's share of the dimensions (pigeonhole), so
that joining each block under its share of the budget misses no pair.

The range join of a block: the block's space is cut along its first ``grid`` coordinates into cells as wide as the block's radius.  A vector
lives in its own cell and visits the cells after it that its ball reaches, so that each pair within the radius meets in exactly one
cell of the block.  There, pairs within the block's budget are candidates; they are narrowed by the nested budgets of the
blocks around it (some half of the vector holds half the budget, some quarter of that half a quarter, ...), then verified by the cosine of the
whole vectors in double precision.  A true pair counts only in the first block that finds it, so that pairs need not be brought together to be
told apart: a task gives each vector the number of its links and the edges of a spanning forest, never a list of pairs.

A cell of more than ``CELL`` vectors is dealt to several tasks as blocks of vectors and of visitors; every pair still meets once.
The number of grid coordinates grows with the logarithm of the number of vectors (``grid_of``); the result does not depend on it.

What the method can do: near pairs are few in spread data, and its work is a part of all comparisons.  In 64 dimensions at 0.95 a
radius is as wide as a coordinate's spread, so that the part is a constant one (see the README for counts), not a vanishing one.

Defined cases: vectors that are null or zero, or hold null or non-finite components, link with nothing (an empty one is zero), but
are returned; vectors of different lengths are not compared; rows that repeat id and vector are one; rows of one id and several
vectors are each returned; -0.0 is 0.0; a null vec_id takes no part, with a null component; an empty table gives no rows; other columns
are ignored.  Equal vectors are one point whose copies count as links.  Vectors are told by two 64-bit hashes.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, written
from .components import components

COSINE, BLOCKS = 0.95, 8
#: Vectors, and vectors and visitors, of one cell that meet in one task: at most CELL, fewer where they are long.
CELL, CELL_BYTES = 32_768, 1 << 27
#: Rounding slack of squared distances that only decide what is verified.
SLACK = 1e-9
#: That of the first test of a block, which is done in single precision.
LOOSE = 1e-5
#: Copies of (key, result) rows by which rows of one vector are spread when ids are joined back.
SALT = 8
#: Rows of both sides that are compared at a time, and pairs that are verified at a time.
STRIP, WIDE, BATCH = 128, 16_384, 65_536


class Subspaces:
    """The rotation of vectors of one length, their blocks and cells."""

    def __init__(self, dim: int, cosine: float, blocks: int, grid: int, seed: int = 17):
        self.dim, self.cosine = dim, cosine
        self.size = 1 << (dim - 1).bit_length() if dim > 1 else 1
        self.blocks = min(1 << (blocks.bit_length() - 1), self.size)
        self.width = self.size // self.blocks
        self.grid = min(grid, self.width)
        self.r2 = 2.0 - 2.0 * cosine + SLACK
        # a little wider than the budgets that decide (``_first_block``), as are the looser tests before them
        self.radius = math.sqrt(self.r2 / self.blocks + 4 * SLACK)
        self.signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (3, self.size))
        # cells after one's own: each pair of neighbouring cells is visited from one side only
        self.steps = [s for s in itertools.product((-1, 0, 1), repeat=self.grid) if s > (0,) * self.grid]

    def unit(self, v: np.ndarray) -> np.ndarray:
        """Unit vectors; scaled by the largest component first, so that nothing overflows."""
        v = v / np.abs(v).max(1)[:, None]
        return v / np.sqrt((v * v).sum(1))[:, None]

    def rotated(self, unit: np.ndarray) -> np.ndarray:
        """Sums of fixed order, alike in every task: a vector's coordinates do not depend on its batch."""
        y = np.zeros((len(unit), self.size))
        y[:, :self.dim] = unit
        for signs in self.signs:
            y = y * signs
            h = 1
            while h < self.size:
                z = y.reshape(len(y), self.size // (2 * h), 2, h)
                y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], 2).reshape(len(y), self.size)
                h *= 2
            y = y / math.sqrt(self.size)
        return y

    def cells(self, rotated: np.ndarray, block: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """(own cells, [(rows, cells they visit)]) of one block."""
        x = rotated[:, block * self.width:block * self.width + self.grid]
        own = np.floor(x / self.radius).astype(np.int64)
        visits = []
        for step in self.steps:
            s = np.array(step)
            # how far the ball's centre is from that cell, along each coordinate
            gap = np.where(s > 0, (own + 1) * self.radius - x, np.where(s < 0, x - own * self.radius, 0.0))
            rows = np.flatnonzero((gap * gap).sum(1) <= self.radius ** 2 + SLACK)
            visits.append((rows, own[rows] + s))
        return own, visits

    def name(self, cells: np.ndarray) -> np.ndarray:
        """One number for each cell; coordinates of unit vectors are within 1."""
        half = int(1 / self.radius) + 2
        out = np.zeros(len(cells), np.int64)
        for c in cells.T:
            out = out * (2 * half + 1) + (c + half)
        return out


def grid_of(vectors: int) -> int:
    """Grid coordinates: one up to a million vectors, and one more for each factor of ten beyond, four at most."""
    return min(4, 1 + max(0, math.ceil(math.log10(max(vectors, 1) / 1e6))))


def points(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((vec_id, k1, k2), (k1, k2, point, copies, v)): the rows, and distinct vectors that take part with their least id."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e"))
    kind = "float" if "float" in vectors.schema["embedding"].dataType.simpleString() else "double"
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("e", lambda x: x != 0)
    v = F.when(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)), F.transform(F.col("e").cast(f"array<{kind}>"), lambda x: x + F.lit(0.0).cast(kind)))
    rows = rows.select("vec_id", v.alias("v"), F.xxhash64("e").alias("_e"))
    rows = rows.select("vec_id", "v", "_e", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("k1"), F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(31), "v")).alias("k2"))
    # one row of each id and vector; the same id may have several vectors
    one = rows.groupBy("vec_id", "k1", "k2", F.when(F.col("v").isNull(), F.col("_e")).alias("_e")).agg(F.first("v").alias("v"))
    one = written(one.drop("_e"), "subspace-rows")
    pts = one.filter("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("point"), F.count("*").alias("copies"), F.first("v").alias("v"))
    return one.drop("v"), written(pts, "subspace-points")


def links(pts: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, grid: int | None = None, cell: int = CELL) -> DataFrame:
    """(k1, k2, n, to_k1, to_k2) of points: numbers of linked vectors, and edges of a spanning forest, of all cells.

    Equal points and rows of several cells are summed by the caller."""
    spark = pts.sparkSession
    ship(spark)
    grid = grid or grid_of(pts.count())

    def place(batches):
        known: dict[int, Subspaces] = {}
        for batch in batches:
            v = batch.column("v")
            lengths = np.diff(v.offsets.to_numpy())
            for dim in np.unique(lengths):
                rows = np.flatnonzero(lengths == dim)
                space = known.setdefault(int(dim), Subspaces(int(dim), cosine, blocks, grid))
                part = batch.take(pa.array(rows))
                turned = space.rotated(space.unit(_matrix(part.column("v"))))
                for block in range(space.blocks):
                    own, visits = space.cells(turned, block)
                    for home, at, cells in [(True, np.arange(len(rows)), own), *[(False, r, c) for r, c in visits]]:
                        if len(at):
                            got = part.select(["k1", "k2", "copies", "v"]).take(pa.array(at))
                            n = len(at)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, block, np.int32)), pa.array(space.name(cells)), pa.array(np.full(n, home)),
                                 *got.columns], names=["dim", "block", "cell", "home", "k1", "k2", "copies", "v"])

    kind = pts.schema["v"].dataType.simpleString()
    placed = written(pts.mapInArrow(place, f"dim int, block int, cell long, home boolean, k1 long, k2 long, copies long, v {kind}"), "subspace-cells")
    key = ["dim", "block", "cell"]
    # a cell of many vectors: blocks of those that live there, each met by blocks of all that are there
    most = F.greatest(F.lit(min(cell, 256)), F.least(F.lit(cell), F.floor(F.lit(CELL_BYTES) / (20 * F.col("dim")))))
    shape = placed.groupBy(*key).agg(F.ceil(F.count(F.when(F.col("home"), 1)) / most).cast("int").alias("across"), F.ceil(F.count("*") / most).cast("int").alias("down"))
    shape = written(shape.filter("across > 0"), "subspace-shape")
    at = placed.join(shape, key)
    part = lambda c: F.pmod(F.xxhash64("k1", "k2"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    cols = ["k1", "k2", "copies", "v"]
    # in a cell of one task a vector is sent once, as both sides
    single = (F.col("across") == 1) & (F.col("down") == 1)
    both = at.filter(single).select(*key, F.lit(0).alias("i"), F.lit(0).alias("j"), F.when(F.col("home"), 2).otherwise(0).alias("side"), *cols)
    live = at.filter(~single & F.col("home")).select(*key, part("across").alias("i"), every("down").alias("j"), F.lit(1).alias("side"), *cols)
    # visitors are side 0; a vector that lives in the cell is compared there as side 3, once with each other one
    come = at.filter(~single).select(*key, every("across").alias("i"), part("down").alias("j"), F.when(F.col("home"), 3).otherwise(0).alias("side"), *cols)
    met = both.unionByName(live).unionByName(come)

    def compare(keys, table):
        dim, block = keys[0].as_py(), keys[1].as_py()
        return _compare(Subspaces(dim, cosine, blocks, grid), block, table)

    return met.groupBy(*key, "i", "j").applyInArrow(compare, "k1 long, k2 long, n long, to_k1 long, to_k2 long")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _compare(space: Subspaces, block: int, table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    side = table.column("side").to_numpy()
    k1, k2, copies = (table.column(c).to_numpy() for c in ("k1", "k2", "copies"))
    unit = space.unit(_matrix(table.column("v").combine_chunks()))
    turned = space.rotated(unit)
    stored = np.flatnonzero((side == 1) | (side == 2))
    asking = np.flatnonzero(side != 1)
    split = bool((side == 3).any() or (side == 1).any())
    # a vector that is here on both sides is one node of the forest
    same = {}
    first_of = np.arange(len(side))
    for row in np.flatnonzero((side == 1) | (side == 3)):
        first_of[row] = same.setdefault((k1[row], k2[row]), row)
    linked = np.zeros(len(side), np.int64)
    up = np.arange(len(side))
    x = turned[:, block * space.width:(block + 1) * space.width]
    # half the squared distance less the asking side's norm is one matrix product of lengthened rows; single precision is enough for a
    # test that is only looser than the budget
    ones, half = np.ones(len(x)), (x * x).sum(1) / 2
    limit = space.r2 / space.blocks / 2 + LOOSE
    ask, have = np.column_stack([x, ones]).astype(np.float32), np.column_stack([x, -half]).astype(np.float32)
    # rows in the order of the first coordinate that is no grid coordinate: partners lie in a window of it
    line = x[:, min(space.grid, space.width - 1)]
    stored = stored[np.argsort(line[stored], kind="stable")]
    asking = asking[np.argsort(line[asking], kind="stable")]
    right, at_right = have[stored], line[stored]
    reach = space.radius + SLACK
    for lives in (True, False):
        rows_of = asking[(side[asking] != 0) == lives]
        for at in range(0, len(rows_of), STRIP):
            rows = rows_of[at:at + STRIP]
            low = np.searchsorted(at_right, line[rows[0]] - reach, "left")
            high = np.searchsorted(at_right, line[rows[-1]] + reach, "right")
            if lives and not split:
                low = at  # both sides are the same rows in the same order: those before have met these already
            for start in range(low, high, WIDE):
                cols = slice(start, min(high, start + WIDE))
                a, b = np.nonzero(ask[rows] @ right[cols].T >= (half[rows] - limit).astype(np.float32)[:, None])
                if lives and not split:
                    later = b + start > a + at
                    a, b = a[later], b[later]
                a, b = rows[a], stored[cols][b]
                if lives and split:
                    # two blocks of one cell meet twice, so that the keys' order decides
                    later = (k1[a] < k1[b]) | ((k1[a] == k1[b]) & (k2[a] < k2[b]))
                    a, b = a[later], b[later]
                for cut in range(0, len(a), BATCH):
                    p, q = _verified(space, block, unit, turned, a[cut:cut + BATCH], b[cut:cut + BATCH])
                    if len(p):
                        np.add.at(linked, p, copies[q])
                        np.add.at(linked, q, copies[p])
                        _hook(up, first_of[p], first_of[q])
    root = _roots(up)
    root = root[first_of]
    out = np.flatnonzero(linked > 0)
    return pa.table({"k1": k1[out], "k2": k2[out], "n": linked[out], "to_k1": k1[root[out]], "to_k2": k2[root[out]]})


def _verified(space: Subspaces, block: int, unit: np.ndarray, turned: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The candidate pairs that are links and that no earlier block finds."""
    lo, n = block, 1
    while n < space.blocks:  # the halves, quarters, ... that hold this block, the smallest first
        n *= 2
        lo -= lo % n
        d = turned[a, lo * space.width:(lo + n) * space.width] - turned[b, lo * space.width:(lo + n) * space.width]
        ok = (d * d).sum(1) <= space.r2 * n / space.blocks + 2 * SLACK
        a, b = a[ok], b[ok]
        if not len(a):
            return a, b
    ok = (unit[a] * unit[b]).sum(1) >= space.cosine
    a, b = a[ok], b[ok]
    if not len(a):
        return a, b
    return _first_block(space, block, turned, a, b)


def _first_block(space: Subspaces, block: int, turned: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of which ``block`` is the first that passes all its nested budgets."""
    parts = ((turned[a] - turned[b]) ** 2).reshape(len(a), space.blocks, space.width).sum(2)
    passes = np.ones((len(a), space.blocks), bool)
    n, sums = 1, parts
    while True:
        passes &= np.repeat(sums <= space.r2 * n / space.blocks + SLACK, n, axis=1)
        if n == space.blocks:
            break
        sums, n = sums.reshape(len(a), -1, 2).sum(2), n * 2
    first = passes.argmax(1)
    keep = passes.any(1) & (first == block)
    return a[keep], b[keep]


def _roots(up: np.ndarray) -> np.ndarray:
    while True:
        above = up[up]
        if np.array_equal(above, up):
            return up
        up[:] = above


def _hook(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of all pairs (a, b); a root is the least of its tree."""
    while True:
        _roots(up)
        x, y = up[a], up[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))


def report(vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, grid: int | None = None, cell: int = CELL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    if not 0.0 < cosine < 1.0:
        raise ValueError("cosine must lie between 0 and 1")
    rows, pts = points(vectors)
    found = written(links(pts, cosine, blocks, grid, cell), "subspace-links")
    number = found.groupBy("k1", "k2").agg(F.sum("n").alias("n"))
    # edges between the least ids of points
    ids = pts.select("k1", "k2", "point")
    edges = found.filter("k1 <> to_k1 or k2 <> to_k2").select("k1", "k2", "to_k1", "to_k2").distinct()
    edges = edges.join(ids, ["k1", "k2"]).select(F.col("point").alias("a"), F.col("to_k1").alias("k1"), F.col("to_k2").alias("k2")).join(ids.withColumnRenamed("point", "b"), ["k1", "k2"])
    near = components(edges.select("a", "b"), "subspace-components")
    result = pts.select("k1", "k2", "point", "copies").join(number, ["k1", "k2"], "left").join(near, F.col("point") == F.col("node"), "left")
    result = result.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "point").alias("component_id"))
    # rows of one vector may be a third of all: they are spread by id, and the few numbers of a vector are copied
    spread = result.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    rows = rows.withColumn("s", F.pmod(F.xxhash64("vec_id"), F.lit(SALT)).cast("int"))
    taking = rows.filter("k1 is not null").join(spread, ["k1", "k2", "s"]).select("vec_id", "n_links", "component_id")
    rest = rows.filter("k1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return taking.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
