"""Text cleaning, gram sums and word counts over Arrow batches of UTF-8 text.

Each helper takes a string column and gives a column, evaluated by numpy over the bytes of many texts at once, so that a
text costs a few passes over its bytes.  They serve classes of letters below U+0800 whose two cases take as many bytes; ``Letters.of``
gives None for others, and callers then use patterns, with the same result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Bytes of text that are worked on at once (whole texts): small enough that a piece's arrays stay in the cache.
PIECE = 1 << 18

# What ``blanked`` looks for, in bytes; the patterns of ``answers`` say the same of text.
_BOXED = re.compile(rb"\\boxed\s*\{[^}]*+\}")
_COMMAND = re.compile(rb"\\[a-zA-Z]+")
_BOXED_LINE = re.compile(rb"[ \t\x0b\f\r]*\\boxed\{")
_BOXED_AFTER_RETURN = re.compile(rb"\r[^\S\n]*\\boxed\{[^\n]*\}[^\S\n]*\n?\Z")


def pieces(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of whole texts of about ``most`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1))
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each text's values (0 for an empty text)."""
    out = np.zeros(len(offsets) - 1, values.dtype if values.dtype != bool else np.int64)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some] = np.add.reduceat(values, offsets[some], dtype=out.dtype)
    return out


def _final_line(text: bytearray, start: int, end: int) -> int:
    """Where a last line that is a boxed answer begins, with the line break before it; ``end`` if there is none."""
    last = end - (text[end - 1] == 10)
    while last > start and text[last - 1] in b" \t\x0b\f\r":
        last -= 1
    if last == start or text[last - 1] != 125:
        return end
    line = max(text.rfind(b"\n", start, last) + 1, start)
    if _BOXED_LINE.match(text, line, last):
        at = max(line - 1, start)
        return at - (at > start and line > start and text[at - 1] == 13)
    if text.find(b"\r", line, last) >= 0 and (found := _BOXED_AFTER_RETURN.search(text, line, end)):
        return found.start()
    return end


def blanked(data: np.ndarray, offsets: np.ndarray, final_line: bool) -> np.ndarray:
    """The bytes with spaces in place of boxed answers and LaTeX commands, and before that, if ``final_line``, of a last line
    that is a boxed answer.  Only texts with a backslash are looked at, from the first one on."""
    signs = np.flatnonzero(data == 92)
    if not len(signs):
        return data
    text = bytearray(data)
    rows, first = np.unique(np.searchsorted(offsets, signs, "right") - 1, return_index=True)
    for start, at, end in zip(offsets[rows].tolist(), signs[first].tolist(), offsets[rows + 1].tolist()):
        if final_line:
            cut = _final_line(text, start, end)
            text[cut:end] = b" " * (end - cut)
        # behind the last brace no box is closed
        for found in [m.span() for m in _BOXED.finditer(text, at, max(at, text.rfind(b"}", at, end) + 1))]:
            text[found[0]:found[1]] = b" " * (found[1] - found[0])
        for found in [m.span() for m in _COMMAND.finditer(text, at, end)]:
            text[found[0]:found[1]] = b" " * (found[1] - found[0])
    return np.frombuffer(text, np.uint8)


def characters(letters: str) -> set[str] | None:
    """The characters of a class like ``A-Za-zæ``; None for other syntax than characters and ranges."""
    chars, i = set(), 0
    while i < len(letters):
        if letters[i] in "\\[]^&-":
            return None
        a_range = letters[i + 1:i + 2] == "-" and i + 2 < len(letters)
        last = letters[i + 2] if a_range else letters[i]
        chars.update(chr(c) for c in range(ord(letters[i]), ord(last) + 1))
        i += 3 if a_range else 1
    return chars


@dataclass(frozen=True)
class Letters:
    """A class of letters; symbol i + 1 is ``symbols[i]``, the space one of them, and symbol 0 a letter without a lower-case symbol."""

    symbols: tuple[str, ...]
    upper: tuple[tuple[str, int], ...]  # every character of the class and the symbol of its lower case

    @staticmethod
    def of(letters: str) -> Letters | None:
        chars = characters(letters)
        if chars is None or any(ord(c) >= 0x800 or len(c.lower()) != 1 or len(c.encode()) != len(c.lower().encode()) for c in chars):
            return None
        symbols = sorted({c for c in chars if c.lower() == c} | {" "})
        if len(symbols) > 250:
            return None
        at = {c: i for i, c in enumerate(symbols, 1)}
        return Letters(tuple(symbols), tuple((c, at.get(c.lower(), 0)) for c in sorted({*chars, " "})))

    @property
    def space(self) -> int:
        return self.symbols.index(" ") + 1

    def _tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol by code point, whether it is of the class, and the lower case's code point."""
        code, known, lower = np.full(0x800, self.space, np.uint8), np.zeros(0x800, bool), np.arange(0x800)
        for c, at in self.upper:
            code[ord(c)], known[ord(c)], lower[ord(c)] = at, True, ord(c.lower())
        return code, known, lower

    def kernel(self) -> Kernel:
        return Kernel(self)


class Kernel:
    """Texts as symbols: every run of characters outside the class, and of spaces, is one space."""

    def __init__(self, letters: Letters):
        self.space = letters.space
        self.code, self.known, self.lower = letters._tables()
        self.ascii = np.full(256, self.space, np.uint8)
        self.ascii[:128] = self.code[:128]
        self.ascii_lower = np.full(256, 32, np.uint8)
        self.ascii_lower[:128] = np.where(self.known[:128], self.lower[:128], 32)
        self.wide = bool(self.known[128:].any())

    def symbols(self, data: np.ndarray, offsets: np.ndarray, trim: bool, text: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(symbols, offsets of the texts in them, lower-cased bytes if ``text``); then offsets are those of the bytes.

        ``trim``: without a space at either end."""
        raw = data.tobytes()
        sym = np.frombuffer(bytearray(raw.translate(self.ascii.tobytes())), np.uint8)
        low = np.frombuffer(bytearray(raw.translate(self.ascii_lower.tobytes())), np.uint8) if text else None
        drop = None
        if self.wide:
            lead = np.flatnonzero(data >= 0xC2)
            lead = lead[(data[lead] <= 0xDF) & (lead + 1 < len(data))]
            if len(lead):
                point = ((data[lead] & 0x1F).astype(np.int64) << 6) | (data[lead + 1] & 0x3F)
                ok = self.known[point]
                lead, point = lead[ok], point[ok]
                sym[lead] = self.code[point]
                sym[lead + 1] = 0
                drop = lead + 1
                if text:
                    low[lead] = 0xC0 | (self.lower[point] >> 6)
                    low[lead + 1] = 0x80 | (self.lower[point] & 0x3F)
        blank = sym == self.space
        # a space after a space goes; so does one at a text's start when trimmed
        keep = np.empty(len(sym), bool)
        if len(sym):
            keep[0] = True
            np.logical_and(blank[1:], blank[:-1], out=keep[1:])
            np.logical_not(keep[1:], out=keep[1:])
            starts = offsets[:-1][np.diff(offsets) > 0]
            keep[starts] = ~blank[starts] if trim else True
            if drop is not None and not text:
                keep[drop] = False
        if len(offsets) * 64 < len(keep):
            kept = [np.count_nonzero(keep[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            out = np.concatenate([np.zeros(1, np.int64), np.cumsum(kept, dtype=np.int64)])
        else:
            out = offsets - np.searchsorted(np.flatnonzero(~keep), offsets)
        sym = (low if text else sym)[keep]
        if trim:
            # at most one space is left at a text's end
            last = out[1:][np.diff(out) > 0] - 1
            last = last[sym[last] == (32 if text else self.space)]
            if len(last):
                out = out - np.searchsorted(last, out)
                sym = np.delete(sym, last)
        return sym, out

    def cleaned(self, column: pa.Array, bare: bool = False) -> pa.Array:
        """Letters and single spaces, trimmed, lower case; null stays null.  ``bare``: without boxed answers and commands."""
        parts, ends, base = [], [np.zeros(1, np.int64)], 0
        for _, _, data, offsets in pieces(column):
            data = blanked(data, offsets, False) if bare else data
            low, out = self.symbols(data, offsets, True, text=True)
            parts.append(low)
            ends.append(out[1:] + base)
            base += len(low)
        valid = None
        if column.null_count:
            valid = column.is_valid()
            valid = pa.array(np.packbits(valid.to_numpy(zero_copy_only=False), bitorder="little")).buffers()[1]
        body = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(np.concatenate(ends)), pa.py_buffer(body), valid)

    def sums(self, column: pa.Array, n: int, tables: Sequence[np.ndarray], base: int, trim: bool,
             bare: bool = False, final_line: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Per text the number of symbols, and for each table the sum of its entries over the text's grams.

        ``bare``, ``final_line``: of what is left by ``blanked``; with ``trim`` alone, as spaces at the ends are left by it."""
        length, totals = np.zeros(len(column), np.int64), [np.zeros(len(column)) for _ in tables]
        for i, j, data, offsets in pieces(column):
            data = blanked(data, offsets, final_line) if bare else data
            sym, at = self.symbols(data, offsets, trim)
            length[i:j] = np.diff(at)
            if len(sym) < n:
                continue
            gram = sym[:len(sym) - n + 1].astype(np.int32)
            for k in range(1, n):
                gram *= base
                gram += sym[k:len(sym) - n + 1 + k]
            # grams that reach into the next text count nothing: index 0 is no gram
            for k in range(1, n):
                over = at[1:] - k
                over = over[(over >= at[:-1]) & (over < len(gram))]
                gram[over] = 0
            ends = np.minimum(at, len(gram))
            for total, table in zip(totals, tables):
                total[i:j] = _per_text(table[gram], ends)
        return length, totals


def _result(column: Column, fn: Callable, returns: str) -> Column:
    ship(SparkSession.active())
    return F.arrow_udf(fn, returns)(column)


def lowered(text: Column, letters: Letters) -> Column:
    """``lower(text)`` as far as the kernel, which lower-cases its letters itself, can tell."""
    chars = {c for c, _ in letters.upper}
    if any(c.lower() not in chars for c in chars):
        return F.lower(text)
    # other characters whose lower case holds such a letter, like the Kelvin sign
    odd = [chr(c) for c in range(128, 0x10000) if chr(c) not in chars and not chars.isdisjoint(chr(c).lower())]
    if len(odd) > 8:
        return F.lower(text)
    some = F.lit(False)
    for c in odd:
        some = some | text.contains(c)
    return F.when(some, F.lower(text)).otherwise(text)


def cleaned_letters(text: Column, letters: Letters, bare: bool = False) -> Column:
    """``lower(trim(letters_only(text)))``; ``bare``: of the text without boxed answers and commands."""
    made = []

    def clean(column: pa.Array) -> pa.Array:
        if not made:
            made.append(letters.kernel())
        return made[0].cleaned(column, bare).cast(pa.string())

    return _result(text, clean, "string")


def gram_sums(text: Column, letters: Letters, n: int, tables: dict[str, Sequence[float]], trim: bool, bare: bool = False,
              final_line: bool = False) -> Column:
    """A struct of the length of the cleaned text (``length``) and a sum for each table; null where ``text`` is null.

    ``bare``: of the text without boxed answers and commands, and if ``final_line`` without a last line that is a boxed answer.

    The tables are as small as the alphabet, whatever the data; they go to the executors once."""
    spark = SparkSession.active()
    names, base = list(tables), len(letters.symbols) + 1
    shared = spark.sparkContext.broadcast([np.asarray(tables[k], np.float64) for k in names])
    made = []

    def score(column: pa.Array) -> pa.Array:
        if not made:
            made.append(letters.kernel())
        length, totals = made[0].sums(column, n, shared.value, base, trim, bare, final_line)
        null = pa.array(column.is_null().to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(length.astype(np.int32)), *map(pa.array, totals)], ["length", *names], mask=null)

    return _result(text, score, ", ".join(["length int", *[f"`{k}` double" for k in names]]))


def _count_words(column: pa.Array) -> pa.Array:
    out = np.zeros(len(column), np.int32)
    for i, j, data, offsets in pieces(column):
        # 9 to 13 and 32; wrapping makes the first test one comparison
        space = (data - np.uint8(9)) < 5
        space |= data == 32
        begins = np.empty(len(data), bool)
        np.greater(space[:-1], space[1:], out=begins[1:])
        starts = offsets[:-1][np.diff(offsets) > 0]
        begins[starts] = ~space[starts]
        out[i:j] = np.diff(np.searchsorted(np.flatnonzero(begins), offsets))
    return pa.array(out)


def words(text: Column) -> Column:
    """The number of runs of other characters than ASCII whitespace (null: 0)."""
    def count(column: pa.Array) -> pa.Array:
        return _count_words(column)

    return _result(text, count, "int")
