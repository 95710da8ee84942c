"""Vectorised hashing of words, word runs and byte strings over Arrow text columns.

All functions work on the UTF-8 buffer of many texts at once.  Word hashes are
polynomial hashes modulo 2**64 over a random table of byte values, taken from
prefix sums, so that the cost does not depend on word or string length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20260701))
BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
LOWER = BYTES.copy()
LOWER[65:91] = BYTES[97:123]
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
STEP = 0xD1342543DE82EF95
PIECE = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (kept for the worker's lifetime up to the piece size)."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, PIECE + 1 if have is None else n), U(base))
        out[0] = 1
        have = np.multiply.accumulate(out)
        if len(have) <= 4 * PIECE:
            _POWERS[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def texts(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of whole texts of about ``most`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in ``data``, and the index of each text's first word (one more entry at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    edge = offsets[(offsets > 0) & (offsets < n)]
    before[edge] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    after[edge - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_sums(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, U)
    np.cumsum(table[data] * powers(BASE, len(data)), out=out[1:])
    return out


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTES) -> np.ndarray:
    """A 64-bit hash of data[start:end] for ascending starts and ends; pieces of the buffer at a time."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        sums = prefix_sums(data[lo:hi], table)
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * powers(INVERSE, hi - lo + 1)[s]
        out[i:j] += (e - s).astype(U) * U(STEP)
        i = j
    return mix(out)


def runs(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words (over all texts; the caller drops runs that cross texts)."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    p = powers(STEP, k)
    out = np.full(n, U(k))
    for i in range(k):
        out += w[i:i + n] * p[i]
    return mix(out)


def inside(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the ``n`` runs of k words stay inside one text."""
    ok = np.ones(n, bool)
    for t in range(1, k):
        at = first[1:-1] - t
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5, table: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes per text, ascending, as (hashes, first index per text, words per text).

    A text of fewer than k words has its whole sequence as its one shingle; one without words has none.
    """
    starts, ends, first = words(data, offsets)
    w = spans(data, starts, ends, table)
    count = np.diff(first)
    g = runs(w, k)
    doc = np.repeat(np.arange(len(count)), count)
    ok = inside(first, k, len(g))
    # a text's last k-1 words start no full run; texts are ascending, so the run's first word names its text
    g_doc, g = doc[:len(g)][ok], g[ok]
    full = count[g_doc] >= k
    g_doc, g = g_doc[full], g[full]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.zeros(len(short), U)
        p = powers(STEP, k)
        for t in range(k - 1):
            has = count[short] > t
            extra[has] += w[first[short[has]] + t] * p[t]
        extra = mix(extra + count[short].astype(U))
        g_doc, g = np.concatenate([g_doc, short]), np.concatenate([g, extra])
    order = np.lexsort((g, g_doc))
    g_doc, g = g_doc[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (g_doc[1:] != g_doc[:-1])
    g_doc, g = g_doc[new], g[new]
    return g, np.searchsorted(g_doc, np.arange(len(count) + 1)), count


def minimizers(h: np.ndarray, w: int, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions that are the leftmost least hash of some w consecutive ones inside one text.

    ``first`` and ``lengths``: where each text's hashes begin and how many it has.  A text with
    fewer than w hashes has no window and no position.
    """
    n = len(h)
    if n < w:
        return np.zeros(0, np.int64)
    best, at, span = h.copy(), np.arange(n), 1
    while span < w:  # leftmost minimum of h[i:i+span], doubled up to w
        step = min(span, w - span)
        m = len(best) - step
        take = best[step:step + m] < best[:m]
        best = np.where(take, best[step:step + m], best[:m])
        at = np.where(take, at[step:step + m], at[:m])
        span += step
    ok = np.zeros(len(at) + 1, np.int64)
    has = lengths >= w
    np.add.at(ok, first[has], 1)
    np.add.at(ok, first[has] + lengths[has] - w + 1, -1)
    return at, np.cumsum(ok[:-1]) > 0


def per_text(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Values cut at ``first`` as a list column."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(signed(values)))
