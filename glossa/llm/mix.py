"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts.

Each source gets a target number of words.  Its documents are put in a hash-random order (range-sorted
by key within the source), their word counts are summed up along that order, and the source is cut where
its budget ends: whole passes over the source first (epochs), then documents in order until the budget is
used up, the last one in part.  The sum of taken words of a source is its target, rounded.

The order is cut into ranges of the hash key, as many as the source's rows ask for, so that no
window holds more than about ``range_rows`` rows, however much of the data one source holds; the offsets of the ranges
are prefix sums over ranges.  The key is a hash of doc_id and text, so that rows that share an id (or have none) are spread too;
rows equal in both are one row with a number of copies until the sums are taken.

Defined cases: null and empty texts have size 0 and take 0; a null source is a source of its own,
last in order; repeated rows are counted and taken as often as they occur (equal rows are
interchangeable); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import text_of, written

WORD = r"[^\x20\x09-\x0D]+"
#: Copies of one row that are written out at a time.
COPIES = 10_000


def word_count(column: str = "text") -> Column:
    return F.size(F.split(F.concat(F.lit(" "), text_of(column), F.lit(" ")), r"[\x20\x09-\x0D]+")).cast("long") - 2


def targets(sources: DataFrame, cycle: int = 3, most_epochs: int = 3, range_rows: int = 20_000) -> DataFrame:
    """(source, source_size, rows) -> the same with target.

    Sources in code point order, null last, weigh 1 .. cycle, repeating.  They share the sum of
    all sizes by weight; a target stops at ``most_epochs`` times its source's size and what is over is shared
    again by weight among the others.  That is a water level: with sources ordered by cap / weight, the
    capped ones are a prefix, found from prefix sums.
    """
    named = F.coalesce("source", F.lit(""))
    ranked = _prefix(sources.withColumn("_null", F.col("source").isNull()).withColumn("_name", named)
                     .withColumn("_one", F.lit(1).cast("decimal(38,0)")), ["_null", "_name"], {"_rank": "_one"}, range_rows)
    weighed = (ranked.withColumn("weight", ((F.col("_rank") - 1) % cycle + 1).cast("long"))
               .withColumn("_cap", F.col("source_size") * most_epochs)
               .withColumn("_ratio", F.col("_cap") / F.col("weight")))
    level = _prefix(weighed.withColumn("_c", F.col("_cap").cast("decimal(38,0)")).withColumn("_w", F.col("weight").cast("decimal(38,0)")),
                    ["_ratio", "_null", "_name"], {"_caps": "_c", "_weights": "_w"}, range_rows)
    level = written(level, "mix-sources")
    total, weights = level.agg(F.sum("source_size"), F.sum("weight")).first()
    # a source is capped if the level that is left for it and those after it is above its ratio
    left = ((F.lit(total or 0) - (F.col("_caps") - F.col("_c"))).cast("double")
            / (F.lit(weights or 0) - (F.col("_weights") - F.col("_w"))).cast("double"))
    marked = level.withColumn("_capped", left >= F.col("_ratio"))
    closed, open_weights = marked.agg(F.sum(F.when(F.col("_capped"), F.col("_cap"))),
                                      F.sum(F.when(~F.col("_capped"), F.col("weight")))).first()
    share = F.lit(float((total or 0) - (closed or 0))) * F.col("weight") / F.lit(float(open_weights or 1))
    return marked.select("source", "source_size", "rows", "weight",
                         F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(share).alias("target"))


def _prefix(df: DataFrame, order: list[str], sums: dict[str, str], range_rows: int) -> DataFrame:
    """Running sums over the whole table in ``order``: sums within ranges, plus the sums of the ranges before.

    Used for tables of sources.  Ranges are found from the data by sampled quantiles of a row's
    order key; up to ``range_rows`` rows there is one range.
    """
    spark = df.sparkSession
    df = written(df, "mix-order")
    n = df.count()
    parts = max(1, -(-n // range_rows))
    if parts == 1:
        piece = df.withColumn("_part", F.lit(0))
    else:
        ranged = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
        piece = written(ranged, "mix-ranges")
    inner = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    running = piece.select("*", *[F.sum(c).over(inner).alias(name) for name, c in sums.items()])
    if parts == 1:
        return running.drop("_part")
    offsets = piece.groupBy("_part").agg(*[F.sum(c).alias(f"{name}_p") for name, c in sums.items()])
    before = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    offsets = offsets.select("_part", *[F.coalesce(F.sum(f"{name}_p").over(before), F.lit(0)).alias(f"{name}_o") for name in sums])
    joined = running.join(F.broadcast(offsets), "_part")
    for name in sums:
        joined = joined.withColumn(name, F.col(name) + F.col(f"{name}_o")).drop(f"{name}_o")
    return joined.drop("_part")


def mix(docs: DataFrame, cycle: int = 3, most_epochs: int = 3, range_rows: int = 20_000) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs``."""
    hashed = docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64(F.lit("mix"), F.col("doc_id"), text_of()).alias("_key"))
    sized = written(hashed.groupBy("doc_id", "source", "size", "_key").agg(F.count("*").alias("_copies")), "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("_copies")).alias("source_size"), F.count("*").alias("rows"))
    goal = written(targets(written(per_source, "mix-totals"), cycle, most_epochs, range_rows)
                   .withColumn("budget", F.round("target").cast("long"))
                   .withColumn("ranges", F.ceil(F.col("rows") / range_rows)), "mix-targets")
    keyed = (sized.withColumn("_all", F.col("size") * F.col("_copies"))
             .withColumn("_u", F.shiftrightunsigned("_key", 11) / F.lit(float(1 << 53)))
             .join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
             .withColumn("_range", F.floor(F.col("_u") * F.col("ranges"))))
    ranges = keyed.groupBy("source", "_range").agg(F.sum("_all").alias("_n"))
    along = W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = written(ranges.withColumn("_before", F.coalesce(F.sum("_n").over(along), F.lit(0))).drop("_n")
                      .withColumnRenamed("source", "_s").withColumnRenamed("_range", "_r"), "mix-offsets")
    inner = W.partitionBy("source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    summed = keyed.withColumn("_end", F.sum("_all").over(inner))
    placed = summed.join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("budget") - epochs * F.col("source_size")
    # the copies of a row follow each other
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_copies - 1) div {COPIES}")))
    placed = placed.withColumn("_chunk", chunk).withColumn(
        "_copy", F.explode(F.sequence(F.col("_chunk") * COPIES, F.least((F.col("_chunk") + 1) * COPIES, F.col("_copies")) - 1)))
    start = F.col("_before") + F.col("_end") - F.col("_all") + F.col("_copy") * F.col("size")
    part = F.least(F.greatest(rest - start, F.lit(0).cast("long")), F.col("size"))
    return placed.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).alias("taken"))
