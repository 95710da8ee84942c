"""Suffix-array de-duplication of byte strings, by induction from sampled suffixes.

Induced sorting orders a sample of suffixes, names them, recurses on the names, and induces the rest from the
sample, with common-prefix values on the way; the work lies in external queues of suffix tuples.  A tuple for
every suffix of the corpus is many times the corpus, though, and all that is asked of the order is
which 400-byte prefixes have an equal neighbour.  So the recursion here goes on only where that is open:

* sample: the suffixes at anchors, one for each 400-byte string, about one in 100 bytes, named by their 200-byte
  prefix.  Spark's spilling shuffles take the part of the disk-backed queues;
* names that occur once have no equal neighbour, and neither has any suffix induced from them;
* suffixes whose sample suffix has a common prefix of 400 bytes and a common left context of 200 with
  another one are settled together;
* the rest is induced to the left of the sample suffix, in nodes of 25, 5 and 1 offsets.

See ``repeats`` for the steps and README for the figures that speak against a full suffix order.  Every byte in a
400-byte string that also starts anywhere else, in the same document or another, is removed.

Defined cases: null and empty texts have no bytes; texts shorter than 400 bytes lose none; overlapping occurrences
count; rows that repeat both doc_id and text are one document; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import in_arrow, written
from .repeats import Setting, covered, keyed, merged, with_spans

LENGTH, SAMPLE = 400, 200


def setting(length: int = LENGTH, sample: int = SAMPLE) -> Setting:
    return Setting(length, sample, (25, 5, 1), ordered=False, by_bytes=True)


def repeats(docs: DataFrame, length: int = LENGTH, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, row_key, spans): maximal runs of repeated bytes, end exclusive."""
    return merged(covered(keyed(docs), setting(length, sample)))


def _cut(batch):
    lists = batch.column("spans")
    flat = lists.flatten()
    start, end = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("start", "end"))
    cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    null = lists.is_null().to_numpy(zero_copy_only=False)
    for i, j, data, offsets in K.texts(batch.column("text")):
        removed, runs, kept = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64), []
        for d in range(i, j):
            raw, at = data[offsets[d - i]:offsets[d - i + 1]].tobytes(), 0
            parts = []
            if not null[d]:
                for a, b in zip(start[cuts[d]:cuts[d + 1]].tolist(), end[cuts[d]:cuts[d + 1]].tolist()):
                    parts.append(raw[at:a])
                    removed[d - i] += b - a
                    runs[d - i] += 1
                    at = b
            kept.append(b"".join([*parts, raw[at:]]))
        yield {"doc_id": batch.column("doc_id").slice(i, j - i), "n_bytes": np.diff(offsets), "n_removed": removed, "n_spans": runs, "kept": kept}


def remove(docs: DataFrame, length: int = LENGTH, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): the remaining bytes, for every row."""
    spans = written(repeats(docs, length, sample), "suffix-spans")
    return in_arrow(with_spans(keyed(docs), spans), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", _cut)


def report(docs: DataFrame) -> DataFrame:
    return remove(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
