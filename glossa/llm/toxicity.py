"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of the n-grams (3 to 5 bytes of lower-cased UTF-8) of ``<word>``; a text is the
average of its words' average n-gram embeddings; a linear softmax reads the label from it.  The
embeddings and the softmax are trained together on a bounded sample of labelled rows
(``sample_rows``, the only bound here; chosen by a hash of doc_id).  Unseen misspellings share
n-grams with words seen in training.

As the model is linear in the averages, scoring needs one number per n-gram bucket: the model is a
vector of ``BUCKETS`` floats of fixed size, whatever the corpus.  Every whole text is scored.

Defined cases: null and empty texts have an average of zero and get the score of the bias; a label
other than 0 or 1, or null, is not learned from; documents without a label are scored like all
others; repeated rows are scored row by row; without any usable label the score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import in_arrow, ship

BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
PRIOR = 40
SAMPLE_ROWS = 5000
LEAST_STEPS = 1000


@dataclass
class Model:
    weights: np.ndarray  # one number per bucket: (softmax row 1 - row 0) . embedding
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for i, j, data, offsets in K.texts(column, 1 << 20):
            doc, starts, ends, share = _bag(data, offsets)
            total, count = np.zeros(len(starts)), np.zeros(len(starts))
            for word, bucket in _grams(data, starts, ends):
                total += np.bincount(word, self.weights[bucket], len(starts))
                count += np.bincount(word, minlength=len(starts))
            mean = np.bincount(doc, total / np.maximum(count, 1) * share, j - i)
            out[i:j] = 1 / (1 + np.exp(-np.clip(mean + self.bias, -50, 50)))
        return out


def _bag(data: np.ndarray, offsets: np.ndarray):
    """The distinct words of each text (text index, start, end of the first one) and their shares in its average.

    A word that occurs n times weighs log2(1 + n), so that one repeated word does not drown the rest;
    the average has ``PRIOR`` further words of zero, so that a text of few words is judged with care.
    """
    starts, ends, first = K.words(data, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    h = K.spans(data, starts, ends, K.LOWER)
    order = np.lexsort((h, doc))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    at = np.flatnonzero(new)
    weight = np.log2(1 + np.diff(np.append(at, len(order))))
    pick = order[at]
    total = np.bincount(doc[pick], weight, len(offsets) - 1) + PRIOR
    return doc[pick], starts[pick], ends[pick], weight / total[doc[pick]]


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(word index, bucket) pieces: the n-grams of each ``<word>``, one n at a time."""
    size = ends - starts + 2
    first = np.concatenate([[0], np.cumsum(size)])
    packed = np.full(first[-1], K.U(0x5851F42D4C957F2D))
    word = np.repeat(np.arange(len(starts)), size)
    at = np.arange(first[-1]) - first[:-1][word]
    body = (at > 0) & (at < size[word] - 1)
    packed[body] = K.LOWER[data[(starts[word] + at - 1)[body]]]
    for n in GRAMS:
        m = len(packed) - n + 1
        if m <= 0:
            continue
        h = np.full(m, K.U(n))
        for t in range(n):
            h = (h ^ packed[t:t + m]) * K.U(K.STEP)
            h ^= h >> K.U(29)
        ok = word[:m] == word[n - 1:]
        yield word[:m][ok], (h[ok] >> K.U(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _features(batch: pa.RecordBatch):
    """Per text: buckets and their weights in the average of words."""
    at, label = batch.schema.get_field_index("text"), batch.column("label").to_pylist()
    for i, j, data, offsets in K.texts(batch.column(at), 1):
        _, starts, ends, share_of = _bag(data, offsets)
        parts = list(_grams(data, starts, ends))
        word = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        bucket = np.concatenate([p[1] for p in parts]) if parts else word
        share = share_of / np.maximum(np.bincount(word, minlength=len(starts)), 1)
        used, inv = np.unique(bucket, return_inverse=True)
        yield {"label": label[i:j], "bucket": [used.astype(np.int32)], "weight": [np.bincount(inv, share[word], len(used)).astype(np.float32)]}


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, dim: int = 4, epochs: int = 8, rate: float = 3.0, seed: int = 7) -> Model:
    """Train on (doc_id, text, label) rows.

    At most ``sample_rows`` rows are learned from, the first by a hash of doc_id, each with its whole text.  Executors
    make their bags; these reach the driver, at most ``BUCKETS`` entries a row.
    """
    sample = (labelled.filter("label in (0, 1) and doc_id is not null")
              .select("text", F.col("label").cast("int").alias("label"), F.xxhash64("doc_id").alias("_h"), "doc_id")
              .orderBy("_h", "doc_id", "label").limit(sample_rows))
    sample = in_arrow(sample.select("text", "label").repartition(12), "label int, bucket array<int>, weight array<float>", _features)
    rows = sample.toArrow()
    label = rows["label"].to_numpy()
    sizes = np.array([len(x) for x in rows["bucket"]], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    bucket = rows["bucket"].combine_chunks().flatten().to_numpy() if len(label) else np.zeros(0, np.int32)
    weight = rows["weight"].combine_chunks().flatten().to_numpy() if len(label) else np.zeros(0, np.float32)
    if not len(label) or label.min() == label.max():
        return Model(np.zeros(BUCKETS), -50.0 if not len(label) or label.max() == 0 else 50.0)
    # a fixed order of rows, as they come back in any order
    rank = np.lexsort((np.array([float(weight[a:b] @ np.sqrt(bucket[a:b] + 1)) for a, b in zip(first[:-1], first[1:])]), sizes, label))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.01, (BUCKETS, dim)).astype(np.float32)
    soft = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    bias = np.log(np.array([np.mean(label == 0), np.mean(label == 1)]))
    emb_sq = np.full((BUCKETS, dim), 1e-3, np.float32)
    soft_sq, bias_sq = np.full((dim, 2), 1e-4), np.full(2, 1e-4)
    # few labels get as many steps as a sample of a few thousand does
    for _ in range(max(epochs, -(-LEAST_STEPS * 64 // len(rank)))):
        order = rank[rng.permutation(len(rank))]
        for at in range(0, len(order), 64):
            rows_at = order[at:at + 64]
            idx = np.concatenate([np.arange(first[r], first[r + 1]) for r in rows_at])
            who = np.repeat(np.arange(len(rows_at)), sizes[rows_at])
            used, inv = np.unique(bucket[idx], return_inverse=True)
            bag = np.zeros((len(rows_at), len(used)), np.float32)
            bag[who, inv] = weight[idx]
            hidden = bag @ emb[used]
            logits = hidden @ soft + bias
            err = np.exp(logits - logits.max(1, keepdims=True))
            err /= err.sum(1, keepdims=True)
            err[np.arange(len(rows_at)), label[rows_at]] -= 1
            g_emb = bag.T @ (err @ soft.T).astype(np.float32)
            g_soft, g_bias = hidden.T @ err, err.sum(0)
            emb_sq[used] += g_emb ** 2
            soft_sq += g_soft ** 2
            bias_sq += g_bias ** 2
            emb[used] -= rate * g_emb / np.sqrt(emb_sq[used])
            soft -= (0.1 * rate * g_soft / np.sqrt(soft_sq)).astype(np.float32)
            bias -= 0.1 * rate * g_bias / np.sqrt(bias_sq)
    return Model((emb @ (soft[:, 1] - soft[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """The rows of ``docs`` with the probability of label 1 of their whole text; a column named ``column`` is replaced."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers: a fixed size
    rest = [c for c in docs.columns if c != column]
    schema = docs.select(*rest).withColumn(column, F.lit(0.0))
    ddl = schema.schema
    from pyspark.sql.pandas.types import to_arrow_schema
    to = to_arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                s = shared.value.scores(batch.column(batch.schema.get_field_index("text")))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).cast(to.field(i).type) for i in range(len(rest))), pa.array(s)], schema=to)

    return docs.select(*rest).mapInArrow(run, ddl)


def fold(column: str = "doc_id"):
    """crc32(doc_id as text) mod 4; the rows at 2 are held out from learning."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4


def labelled_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows to learn from: labelled, not held out, the first ``sample_rows`` labels by a hash of doc_id.

    The sample is drawn from the narrow label table, so that no text is shuffled; its size bounds the broadcast.
    """
    known = labels.filter("toxic in (0, 1) and doc_id is not null").filter(fold() != 2).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
