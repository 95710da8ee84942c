"""Splits, repeatable order, sampling and row gates.

Spark rows have no order, so every positional rule is stated on an explicit
key column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written


def order_key(key: Column, seed: int) -> Column:
    """B4 key: md5 of '<key>:<seed>' -- a repeatable, uniform permutation."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def seeded_order(df: DataFrame, key: str = "pid", seed: int = 42) -> DataFrame:
    """Adds ``order_key``; sort on (order_key, key) only where order is written."""
    return df.withColumn("order_key", order_key(F.col(key), seed))


def with_position(df: DataFrame, key: str = "pid") -> DataFrame:
    """Exact 0-based rank of every row by ``key``, of any type that has an order; nulls come first.

    One range exchange sorts the rows, and each row is numbered where it lies; the table is written, the rows of
    each part are counted, and the running sum of these few counts is what comes before a part.  No window over
    all rows, and no key passes through the driver beyond the exchange's own sample.

    Rows of equal keys are ranked by a hash of the whole row, so that a key that very many
    rows share is spread over several parts too, and ranks do not depend on the input's order."""
    hashed = df.withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    sorted_ = hashed.repartitionByRange(F.asc_nulls_first(key), "_tie").sortWithinPartitions(F.asc_nulls_first(key), "_tie")
    # the id holds the number of the part above 33 bits, and the row's number in it below
    rows = written(sorted_.withColumn("_row", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("_row", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")) \
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # as many rows as the exchange has parts
    ranked = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return ranked.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col("_row").bitwiseAND((1 << 33) - 1)).alias("position"))


def split_by_position(df: DataFrame, key: str = "pid", n: int = 7473,
                      part: str | None = None) -> DataFrame:
    """B1: the first ``n`` rows by ``key`` are 'train', the rest 'test'.  Adds
    ``position`` and ``part``; with ``part`` given, keeps only that part."""
    out = with_position(df, key).withColumn(
        "part", F.when(F.col("position") < n, "train").otherwise("test"))
    return out.where(F.col("part") == part) if part else out


def head_subset(df: DataFrame, key: str = "pid", k: int = 2000) -> DataFrame:
    """B2: the first ``k`` rows by key (not shuffled).  A bounded top-k."""
    return df.orderBy(key).limit(k)


def sample_k(df: DataFrame, key: str = "pid", k: int = 1000, seed: int = 42) -> DataFrame:
    """Seeded shuffle, then the first ``k``.  Repeatable and uniform; not the
    same permutation as any other library's shuffle."""
    return seeded_order(df, key, seed).orderBy("order_key", key).limit(k)


class EmptyResultError(RuntimeError):
    pass


def require_rows(df: DataFrame, name: str) -> DataFrame:
    """Fail when a derived set is empty (reads at most one row)."""
    if not df.take(1):
        raise EmptyResultError(f"{name} is empty")
    return df
