"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are mapped to the unit sphere so that the order of inner products is that of cosines (an
extra coordinate takes up what a vector lacks to the largest norm; for queries it is zero), padded to a power of two,
and turned by fast Hadamard pseudo-rotations (three rounds of random signs and a Hadamard transform).
A vector's bucket in a table is its nearest signed axis.  Queries probe, in every table, the ``probes`` signed axes
nearest to them; the candidates of all tables are ranked by exact inner products of the original vectors.

Every vector is indexed in every table.  Only ``probes`` is fitted, on at most ``SAMPLE`` vectors (the first by a hash
of vec_id): the least number that finds ``RECALL`` of the true neighbours there.  It can grow to all buckets of a
table, which finds every neighbour, so that the recall is always reached; a bucket is one signed axis at every size of the index.
A larger index has nearer neighbours, so that its recall is higher.  Buckets are cut into blocks of vectors and of
queries; a block returns its best ``k + 1`` vectors for each query, ties included in order, which loses none of the
best k of all candidates.

Equal vectors are one point with its ``k + 1`` smallest ids (no more of them can be among a query's k nearest).

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, take no part, neither as
queries nor as candidates; vectors of another length than the most frequent one take no part; rows that
repeat id and vector are one; a null vec_id takes no part; with fewer than k candidates, all found are returned;
ties go to the smaller vec_id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import in_arrow, ship, written

TABLES, RECALL, SAMPLE, SAMPLE_QUERIES = 8, 0.95, 10_000, 100
BLOCK, QUERY_BLOCK = 4096, 1024


class Hasher:
    """Pseudo-rotations of ``tables`` tables."""

    def __init__(self, dim: int, largest: float, tables: int = TABLES, seed: int = 11):
        self.dim, self.largest, self.tables = dim, largest, tables
        self.size = 1 << (dim).bit_length()  # at least dim + 1
        rng = np.random.default_rng(seed)
        self.signs = rng.choice(np.array([-1.0, 1.0]), (tables, 3, self.size))

    def place(self, x: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((len(x), self.size))
        norm = np.linalg.norm(x, axis=1)
        if query:
            out[:, :self.dim] = x / norm[:, None]
        else:
            out[:, :self.dim] = x / self.largest
            out[:, self.dim] = np.sqrt(np.maximum(0, 1 - (norm / self.largest) ** 2))
        return out

    def rotated(self, placed: np.ndarray, table: int) -> np.ndarray:
        y = placed
        for signs in self.signs[table]:
            y = hadamard(y * signs)
        return y

    def bucket(self, placed: np.ndarray, table: int) -> np.ndarray:
        y = self.rotated(placed, table)
        best = np.abs(y).argmax(1)
        return 2 * best + (y[np.arange(len(y)), best] < 0)

    def probed(self, placed: np.ndarray, table: int, probes: int) -> np.ndarray:
        """(rows, probes) buckets, nearest first."""
        y = self.rotated(placed, table)
        order = np.argsort(-np.concatenate([y, -y], 1), axis=1, kind="stable")[:, :probes]
        return 2 * (order % self.size) + (order >= self.size)


def hadamard(a: np.ndarray) -> np.ndarray:
    rows, n = a.shape
    h = 1
    while h < n:
        a = a.reshape(rows, n // (2 * h), 2, h)
        a = np.stack([a[:, :, 0] + a[:, :, 1], a[:, :, 0] - a[:, :, 1]], 2).reshape(rows, n)
        h *= 2
    return a / np.sqrt(n)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def points(vectors: DataFrame, k: int) -> tuple[DataFrame, int]:
    """((point, v, ids), dimension): distinct vectors that take part, with their k + 1 smallest ids."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    v = written(v.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(fine), "ann-vectors")
    common = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return v.select(F.col("vec_id").alias("point"), "v", F.array("vec_id").alias("ids")).limit(0), 0
    v = v.filter(F.size("v") == common["n"]).withColumn("v", F.transform("v", lambda x: x + 0.0))
    # the rank limit is applied before the shuffle too, so that a vector of very many rows does not meet in one task
    few = v.distinct().withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    return written(few.groupBy("v").agg(F.min("vec_id").alias("point"), F.array_sort(F.collect_list("vec_id")).alias("ids")).select("point", "v", "ids"), "ann-points"), common["n"]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row, the columns of the k highest scores; ties to the smaller id."""
    out = []
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
    for row, low in zip(scores, least):
        at = np.flatnonzero(row >= low - 1e-9)
        out.append(at)
    return out


def fit_probes(sample: np.ndarray, hasher: Hasher, k: int) -> int:
    """The least number of probes that finds RECALL of the k nearest in the sample."""
    n, q = len(sample), min(SAMPLE_QUERIES, len(sample))
    most = 2 * hasher.size
    if n <= k + 1:
        return most
    scores = sample[:q] @ sample.T
    scores[np.arange(q), np.arange(q)] = -np.inf
    true = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    rank = np.full((q, k), most, np.int64)  # the probe that first finds each neighbour
    stored, asked = hasher.place(sample, False), hasher.place(sample[:q], True)
    for table in range(hasher.tables):
        bucket = hasher.bucket(stored, table)
        probes = hasher.probed(asked, table, most)
        same = bucket[true][:, :, None] == probes[:, None, :]
        rank = np.minimum(rank, np.where(same.any(2), same.argmax(2), most))
    # ``most`` probes are all buckets, so that the last turn finds every neighbour
    return next(probes for probes in range(1, most + 1) if (rank < probes).mean() >= RECALL)


def _search(k: int):
    def run(table: pa.Table) -> pa.Table:
        asked = table.column("query").to_numpy(zero_copy_only=False)
        v = _matrix(table.column("v").combine_chunks())
        point = table.column("point").to_numpy()
        is_q = asked.astype(bool)
        q, x, q_id, x_id = v[is_q], v[~is_q], point[is_q], point[~is_q]
        a, b, s = [], [], []
        if len(x):
            for at in range(0, len(q), 128):
                for i, cols in enumerate(_best(q[at:at + 128] @ x.T, x_id, k + 1), at):
                    exact = (x[cols] * q[i]).sum(1)
                    order = np.lexsort((x_id[cols], -exact))[:k + 1]
                    a.append(np.full(len(order), q_id[i]))
                    b.append(x_id[cols][order])
                    s.append(exact[order])
        join = lambda z, t: np.concatenate(z) if z else np.zeros(0, t)
        return pa.table({"q": join(a, np.int64), "point": join(b, np.int64), "score": join(s, np.float64)})
    return run


def nearest(vectors: DataFrame, queries_mod: int = 20, k: int = 20, tables: int = TABLES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each vector whose id is divisible by ``queries_mod``."""
    spark = vectors.sparkSession
    pts, dim = points(vectors, k)
    if not dim:
        return pts.select(F.col("point").alias("query_id"), F.lit(1).alias("rank"), F.col("point").alias("vec_id"), F.lit(0.0).alias("score"))
    largest = pts.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    hasher = Hasher(dim, largest * (1 + 1e-12), tables)
    sample = pts.select("v", F.xxhash64("point").alias("h")).orderBy("h").limit(SAMPLE).select("v").toArrow()
    probes = fit_probes(_matrix(sample.column("v").combine_chunks()), hasher, k)
    ship(spark)
    shared = spark.sparkContext.broadcast(hasher)  # signs of the rotations: a fixed size

    def index(batch):
        placed = shared.value.place(_matrix(batch.column("v")), False)
        for t in range(tables):
            yield {"t": np.full(len(placed), t, np.int32), "bucket": shared.value.bucket(placed, t), "point": batch.column("point"), "v": batch.column("v")}

    def probe(batch):
        placed = shared.value.place(_matrix(batch.column("v")), True)
        rows = np.repeat(np.arange(len(placed)), probes)
        for t in range(tables):
            yield {"t": np.full(len(rows), t, np.int32), "bucket": shared.value.probed(placed, t, probes).ravel(), "point": batch.column("point").take(pa.array(rows)),
                   "v": batch.column("v").take(pa.array(rows))}

    schema = "t int, bucket long, point long, v array<double>"
    stored = written(in_arrow(pts.select("point", "v"), schema, index), "ann-index")
    # every row of a queried id is a query, whether or not it is among the smallest ids of its point
    more = (vectors.select(F.col("vec_id").cast("long").alias("query_id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x + 0.0).alias("v"))
            .filter(F.pmod("query_id", F.lit(queries_mod)) == 0).distinct())
    asked = written(more.join(pts.select("point", "v"), "v").select("query_id", "point"), "ann-queries")
    ask = pts.join(asked.select("point").distinct(), "point", "left_semi").select("point", "v")
    probed = written(in_arrow(ask, schema, probe), "ann-probes")
    blocks = stored.groupBy("t", "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    q_blocks = probed.groupBy("t", "bucket").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("q_blocks"))
    shape = written(blocks.join(q_blocks, ["t", "bucket"]), "ann-blocks")
    where = lambda c: F.pmod(F.xxhash64("point"), F.col(c)).cast("int")
    left = (stored.join(shape, ["t", "bucket"]).select("t", "bucket", "point", "v", F.lit(False).alias("query"), where("blocks").alias("i"),
                                                      F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("j")))
    right = (probed.join(shape, ["t", "bucket"]).select("t", "bucket", "point", "v", F.lit(True).alias("query"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"),
                                                       where("q_blocks").alias("j")))
    found = left.unionByName(right).groupBy("t", "bucket", "i", "j").applyInArrow(_search(k), "q long, point long, score double")
    per_point = found.groupBy("q", "point").agg(F.max("score").alias("score"))
    top = W.partitionBy("q").orderBy(F.desc("score"), "point")
    per_point = per_point.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= k + 1).drop("r")
    ids = per_point.join(pts.select("point", "ids"), "point").select("q", "score", F.explode("ids").alias("vec_id"))
    own = written(ids, "ann-found").join(asked.select("query_id", F.col("point").alias("q")), "q").filter("vec_id <> query_id")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return own.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
