"""Substring de-duplication by seed and extend, on words.

Seeds are winnowed anchors: among the 8-word strings of every 20-word window, the one of least hash.  Documents are
joined on repeated seeds, seeds are extended both ways, and the maximal repeats of at least 20 words are kept; see
``repeats`` for how edges of repeats are settled exactly.  Every word in a 20-word string that also starts earlier
(smaller doc_id, or the same document, earlier) is removed.

Defined cases: null and empty texts have no words; texts of fewer than 20 words lose none; a null doc_id comes before
all others; rows that repeat both doc_id and text are one document; documents with equal doc_id and different texts
are ordered by a hash of the text; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import in_arrow, written
from .repeats import Setting, covered, keyed, merged, with_spans

LENGTH, SEED = 20, 8


def setting(length: int = LENGTH, seed: int = SEED) -> Setting:
    return Setting(length, seed, (1,), ordered=True, by_bytes=False)


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, row_key, spans): maximal runs of repeated words, as word positions, end exclusive."""
    return merged(covered(keyed(docs), setting(length, seed)))


def _cut(batch):
    lists = batch.column("spans")
    flat = lists.flatten()
    start, end = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("start", "end"))
    cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    null = lists.is_null().to_numpy(zero_copy_only=False)
    for i, j, data, offsets in K.texts(batch.column("text")):
        starts, ends, first = K.words(data, offsets)
        n, removed, kept = np.diff(first), np.zeros(j - i, np.int64), []
        for d in range(i, j):
            s, e = starts[first[d - i]:first[d - i + 1]], ends[first[d - i]:first[d - i + 1]]
            keep = np.ones(len(s), bool)
            if not null[d]:
                for a, b in zip(start[cuts[d]:cuts[d + 1]], end[cuts[d]:cuts[d + 1]]):
                    keep[a:b] = False
            at = offsets[d - i]
            raw = data[at:offsets[d - i + 1]].tobytes()
            kept.append(b" ".join([raw[x:y] for x, y in zip((s[keep] - at).tolist(), (e[keep] - at).tolist())]))
            removed[d - i] = len(s) - keep.sum()
        yield {"doc_id": batch.column("doc_id").slice(i, j - i), "n_words": n, "n_removed": removed, "kept": kept}


def remove(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept words joined by one space (UTF-8), for every row."""
    spans = written(repeats(docs, length, seed), "substring-spans")
    return in_arrow(with_spans(keyed(docs), spans), "doc_id long, n_words long, n_removed long, kept binary", _cut)


def report(docs: DataFrame) -> DataFrame:
    return remove(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
