"""Spans of regular expressions in whole texts, by Spark's own functions: code points, end exclusive.

Spark returns the matches of a pattern but not where they are.  Here every match is put between marks, the
text is split at the marks, and the running sum of the pieces' lengths gives the places.  Time is linear
in the text and its matches.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

MARK, STAND_IN = "\u0001", "\u0002"
#: Characters of context on each side of a match, by definition of a context.
CONTEXT = 80


@dataclass(frozen=True)
class Kind:
    """A pattern, and which of its matches count.  The pattern must not match the marks (U+0001, U+0002)."""
    name: str
    pattern: str
    holds: Callable[[Column], Column] = lambda value: F.lit(True)


def pieces(text: Column, pattern: str) -> Column:
    """The text cut at the matches: outside, match, outside, ..., outside."""
    return F.split(F.regexp_replace(F.translate(text, MARK, STAND_IN), pattern, MARK + "$0" + MARK), MARK, -1)


def find(blobs: DataFrame, kinds: list[Kind], context: bool = False) -> DataFrame:
    """(blob, kind, ord, start, end, value[, left, right]) for the matches that hold, of distinct blobs (blob, text).

    ``ord`` is the kind's place in ``kinds``; left and right are the ``CONTEXT`` characters (fewer at the
    ends of a text) before and after the match, whatever other matches lie in them.
    """
    cut = blobs.select("blob", F.explode(F.array(*[
        F.struct(F.lit(i).alias("ord"), pieces(F.col("text"), k.pattern).alias("pieces")) for i, k in enumerate(kinds)])).alias("k"))
    cut = cut.select("blob", F.col("k.ord").alias("ord"), F.col("k.pieces").alias("pieces")).filter(F.size("pieces") > 1)
    if context:
        cut = cut.withColumn("tails", F.transform("pieces", lambda x: F.right(x, F.lit(CONTEXT)))).withColumn(
            "heads", F.transform("pieces", lambda x: F.left(x, F.lit(CONTEXT))))
    # every second piece is a match of a character or more: so many pieces hold the context
    reach = 2 * CONTEXT

    def piece(x, i):
        match = i % 2 == 1
        fields = [F.char_length(x).cast("long").alias("n"), F.when(match, x).alias("value")]
        if context:
            before = F.slice(F.col("tails"), F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach)))
            after = F.slice(F.col("heads"), i + 2, F.lit(reach))
            fields += [F.when(match, F.right(F.array_join(before, ""), F.lit(CONTEXT))).alias("left"),
                       F.when(match, F.left(F.array_join(after, ""), F.lit(CONTEXT))).alias("right")]
        return F.struct(*fields)

    rows = cut.select("blob", "ord", F.posexplode(F.transform("pieces", piece)).alias("at", "p"))
    rows = rows.select("blob", "ord", "at", "p.*")
    order = W.partitionBy("blob", "ord").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum("n").over(order)).filter(F.col("value").isNotNull())
    holds = F.lit(False)
    for i, k in enumerate(kinds):
        holds = F.when(F.col("ord") == i, k.holds(F.col("value"))).otherwise(holds)
    names = F.element_at(F.array(*[F.lit(k.name) for k in kinds]), F.col("ord") + 1)
    return (rows.filter(holds)
            .select("blob", names.alias("kind"), "ord", (F.col("end") - F.col("n")).alias("start"), "end", "value",
                    *(["left", "right"] if context else [])))


def per_blob(spans: DataFrame) -> DataFrame:
    """(blob, spans): the spans of each blob as an array, by start, then kind."""
    return spans.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "ord", "end", "kind"))).alias("spans"))


def shown(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(spans: Column) -> Column:
    return F.sha2(shown(spans).cast("binary"), 256)
