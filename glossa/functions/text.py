"""Text column helpers (native Spark expressions, but for ``word_count``).

Regex dialect notes: Spark runs Java regexes. ``\\s`` and ``\\d`` are ASCII
classes (Python's are Unicode); we keep ASCII semantics so the same patterns
also run on RE2 (DuckDB) for the oracle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kernels import words

# The number pattern used for every answer parse.
SPACES = " \t\n\x0b\f\r"
NUMBER = r"-?\d+(?:[.,]\d+)?"


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace (ASCII)."""
    ws = F.lit(SPACES)
    # a trim on the right counts the characters of the whole text, the last byte tells whether one is needed
    return bound(col_(c), lambda v: F.when(reduce(or_, [v.endswith(s) for s in SPACES]), F.btrim(v, ws)).otherwise(F.ltrim(v, ws)))


def bound(c: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` names it."""
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def replace_if(c: Column, sign: str, pattern: str, by: str) -> Column:
    """``regexp_replace`` of a pattern whose matches hold ``sign``; looking for a sign costs far less than a pattern."""
    return bound(c, lambda v: F.when(v.contains(sign), F.regexp_replace(v, pattern, by)).otherwise(v))


def nonblank(c: str | Column) -> Column:
    """Not null and not only whitespace."""
    return col_(c).isNotNull() & (strip(c) != "")


def to_number(text: Column) -> Column:
    """Number text -> double; a comma is always a decimal point."""
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def one_break(c: str | Column) -> Column:
    """The text with \\n for \\r\\n and \\r."""
    return F.replace(F.replace(col_(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def split_lines(c: str | Column) -> Column:
    """Python ``str.splitlines()`` for \\n, \\r\\n and \\r: no trailing empty line,
    and an empty string gives an empty array."""
    # what follows a last line break, and the only piece of an empty string, is empty and no line
    return bound(F.split(one_break(c), "\n", -1), lambda v: F.when(F.element_at(v, -1) == "", F.slice(v, F.lit(1), F.size(v) - 1)).otherwise(v))


def word_count(c: str | Column) -> Column:
    """``len(text.split())`` of ASCII whitespace."""
    return words(col_(c))
