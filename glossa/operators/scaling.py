"""Best-of-N and majority vote over sample prefixes.

Query shapes (all distributed, no per-item Python):

* Best-of-N (G6, G7): one grouped pass gives each item's *first hit* index per
  flag; a histogram of first hits is then spread over n = idx+1..max_n.  The
  fan-out happens on the histogram (a few rows per model/mode), not on samples.
* Majority (G8): every sample feeds the prefixes n = idx+1..max_n (at most
  max_n*(max_n+1)/2 rows per item), votes are counted per (item, n, answer),
  and the winner is the first row of a window ordered by the tie-break rules.
* Sample language mix (G11): pre-aggregated per sample index, then spread.

Each of them is split in two: a small table that can be merged (``first_hits``, ``vote_groups``, ``sample_counts``; a merger is a
minimum or a sum by key, so that it may be taken in any order and in parts), and the rates read from it.
Batch results take the table of all samples, running results (``streaming.scaling``) the merger of the arrivals' tables.

Scored rows are clustered once by (pid, model, mode); the per-item steps reuse
that clustering, so only tiny per-(model, mode, n) aggregates shuffle afterwards.
A (pid, model, mode) group holds at most ``max_n`` samples after the prefix
filter (sample_idx is unique within a group), so clustering on it cannot skew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.answers import vote_key
from .language import LABEL_MIXED, LABEL_OTHER, LABEL_TARGET, LABEL_UNCLEAR
from .scoring import TARGET_MODES_SCALING

ITEM = ["pid", "model", "mode"]
NS = tuple(range(1, 11))

BEST_BASE = ["oracle_accuracy", "oracle_boxed_rate"]
BEST_TARGET = ["oracle_strict_accuracy", "oracle_correct_but_not_target_rate",
               "oracle_any_correct_rate", "oracle_any_correct_target_rate",
               "oracle_any_correct_other_rate"]
SAMPLE_MIX = ["sample_target_rate", "sample_other_rate", "sample_mixed_rate",
              "sample_unclear_rate", "sample_avg_target_minus_other"]
MAJ_BASE = ["accuracy", "boxed_rate", "parsed_rate"]
MAJ_TARGET = ["strict_accuracy", "correct_but_not_target_rate", "selected_target_rate",
              "selected_other_rate", "selected_mixed_rate", "selected_unclear_rate",
              "selected_avg_target_minus_other"]

_LABEL_CODE = {LABEL_TARGET: 0, LABEL_OTHER: 1, LABEL_MIXED: 2, LABEL_UNCLEAR: 3}


def prefix_samples(scored: DataFrame, max_n: int, partitions: int | None = None) -> DataFrame:
    """Samples that can be in some prefix (sample_idx < max_n), clustered by item."""
    base = scored.where(F.col("sample_idx") < max_n)
    cols = [F.col(c) for c in ITEM]
    return base.repartition(partitions, *cols) if partitions else base.repartition(*cols)


#: Samples whose votes one task counts: each is a row for up to ``max_n`` prefixes.
SAMPLES_PER_TASK = 100_000


def voters(scored: DataFrame, max_n: int) -> DataFrame:
    """``prefix_samples`` of a written table in parts by number of samples.  Spark would size parts by the bytes of the samples, and
    the votes of all prefixes that they become would not fit the memory of a task, and be sorted on disk."""
    least = 3 * scored.sparkSession.sparkContext.defaultParallelism
    return prefix_samples(scored, max_n, max(least, -(-scored.count() // SAMPLES_PER_TASK)))


def item_total(items: DataFrame):
    """The number of items (denominator of every per-item rate) as a scalar
    subquery column: computed once, no join."""
    return items.select(F.count(F.lit(1))).scalar()


def _grid(samples: DataFrame, ns: Sequence[int]) -> DataFrame:
    """(model, mode, n) for every model/mode seen and every n; ``samples`` are scored
    rows or a table made of them."""
    if "sample_idx" in samples.columns:
        samples = samples.where(F.col("sample_idx") < max(ns))
    return samples.select("model", "mode").distinct().select(
        "model", "mode", F.explode(F.array(*[F.lit(n) for n in ns])).alias("n"))


def _with_total(df: DataFrame, items: DataFrame) -> DataFrame:
    return df.withColumn("total", item_total(items))


HITS = ["oracle_accuracy", "oracle_boxed_rate", "oracle_strict_accuracy", "oracle_correct_but_not_target_rate",
        "oracle_any_correct_target_rate", "oracle_any_correct_other_rate"]


def first_hits(samples: DataFrame, max_n: int) -> DataFrame:
    """Per item the index of the first sample that hits, for every flag of ``HITS`` (null: none)."""
    lab, idx = F.col("lang_label"), F.col("sample_idx")
    correct, boxed = F.col("correct"), F.col("boxed")
    hits = [correct, boxed, correct & boxed & (lab == LABEL_TARGET), correct & (lab != LABEL_TARGET),
            correct & (lab == LABEL_TARGET), correct & (lab == LABEL_OTHER)]
    return samples.where(idx < max_n).groupBy(*ITEM).agg(
        *[F.min(F.when(c, idx)).alias(k) for k, c in zip(HITS, hits)])


def merge_first_hits(tables: DataFrame) -> DataFrame:
    return tables.groupBy(*ITEM).agg(*[F.min(k).alias(k) for k in HITS])


def best_of_n(samples: DataFrame, items: DataFrame, ns: Sequence[int] = NS,
              target_modes: Sequence[str] = TARGET_MODES_SCALING) -> DataFrame:
    """G6 + G7: per (model, mode, n) the share of items with a hit in the first n
    samples.  Target-language rates are null for other modes."""
    return best_of_hits(first_hits(samples, max(ns)), _grid(samples, ns), items, ns, target_modes)


def best_of_hits(first: DataFrame, grid: DataFrame, items: DataFrame, ns: Sequence[int] = NS,
                 target_modes: Sequence[str] = TARGET_MODES_SCALING) -> DataFrame:
    """G6 + G7 from the first hits of every item, which may be those of longer prefixes."""
    max_n = max(ns)
    hits = HITS
    # Histogram of first hits per (model, mode, metric, first index).
    stacked = first.select("model", "mode", F.explode(F.array(*[
        F.struct(F.lit(k).alias("metric"), F.col(k).alias("f")) for k in hits])).alias("h")) \
        .select("model", "mode", "h.metric", "h.f").where(F.col("f") < max_n)
    hist = stacked.groupBy("model", "mode", "metric", "f").agg(F.count(F.lit(1)).alias("c"))
    spread = hist.select("model", "mode", "metric", "c",
                         F.explode(F.sequence(F.col("f") + 1, F.lit(max_n))).alias("n")) \
        .groupBy("model", "mode", "n").pivot("metric", list(hits)).agg(F.sum("c"))
    out = _with_total(grid, items).join(spread, ["model", "mode", "n"], "left")
    is_t = F.col("mode").isin(*target_modes)

    def rate(k):
        return F.coalesce(F.col(k), F.lit(0)) / F.col("total")

    cols = [rate(k).alias(k) for k in BEST_BASE]
    cols += [F.when(is_t, rate(k)).alias(k) for k in
             ["oracle_strict_accuracy", "oracle_correct_but_not_target_rate"]]
    cols += [F.when(is_t, rate("oracle_accuracy")).alias("oracle_any_correct_rate")]
    cols += [F.when(is_t, rate(k)).alias(k) for k in
             ["oracle_any_correct_target_rate", "oracle_any_correct_other_rate"]]
    return out.select("model", "mode", "n", *cols)


def sample_counts(samples: DataFrame, max_n: int, target_modes: Sequence[str] = TARGET_MODES_SCALING) -> DataFrame:
    """Label counts and contrast sum by (model, mode, sample_idx) of the target modes."""
    lab = F.col("lang_label")
    return samples.where(F.col("mode").isin(*target_modes) & (F.col("sample_idx") < max_n)) \
        .groupBy("model", "mode", "sample_idx").agg(
            F.sum(F.when(lab == LABEL_TARGET, 1).otherwise(0)).alias("t"),
            F.sum(F.when(lab == LABEL_OTHER, 1).otherwise(0)).alias("o"),
            F.sum(F.when(lab == LABEL_MIXED, 1).otherwise(0)).alias("m"),
            F.sum(F.when(lab == LABEL_UNCLEAR, 1).otherwise(0)).alias("u"),
            F.sum("lang_score").alias("s"))


def merge_sample_counts(tables: DataFrame) -> DataFrame:
    return tables.groupBy("model", "mode", "sample_idx").agg(*[F.sum(c).alias(c) for c in "tomus"])


def sample_language_mix(samples: DataFrame, items: DataFrame, ns: Sequence[int] = NS,
                        target_modes: Sequence[str] = TARGET_MODES_SCALING) -> DataFrame:
    """Label rates and mean contrast over the first n samples of every item;
    denominator total * n (short lists included)."""
    return mix_of_counts(sample_counts(samples, max(ns), target_modes), items, ns)


def mix_of_counts(per_idx: DataFrame, items: DataFrame, ns: Sequence[int] = NS) -> DataFrame:
    """G11 from the counts by sample index, which may be those of longer prefixes."""
    max_n = max(ns)
    spread = per_idx.where(F.col("sample_idx") < max_n).select(
        "*", F.explode(F.sequence(F.col("sample_idx") + 1, F.lit(max_n))).alias("n")) \
        .groupBy("model", "mode", "n").agg(*[F.sum(c).alias(c) for c in "tomus"])
    grid = _with_total(_grid(per_idx, ns), items)
    out = grid.join(spread, ["model", "mode", "n"], "left")
    d = F.col("total") * F.col("n")
    names = dict(zip("tomus", SAMPLE_MIX))
    return out.select("model", "mode", "n", *[
        (F.coalesce(F.col(c), F.lit(0)) / d).alias(names[c]) for c in "tomus"])


def vote_groups(samples: DataFrame, max_n: int, decimals: int = 6) -> DataFrame:
    """Per (item, n, answer), n = 1..max_n: the number of its votes, the sum of their indexes, and the earliest supporter."""
    label_code = F.coalesce(*[F.when(F.col("lang_label") == k, F.lit(v))
                              for k, v in _LABEL_CODE.items()])
    idx = F.col("sample_idx")
    votes = samples.where((idx < max_n) & F.col("pred").isNotNull()).select(
        *ITEM, "sample_idx", vote_key("pred", decimals).alias("vkey"), "pred", "correct", "boxed",
        label_code.alias("lcode"), "lang_score",
        F.explode(F.sequence(idx + 1, F.lit(max_n))).alias("n"))
    return votes.groupBy(*ITEM, "n", "vkey").agg(
        F.count(F.lit(1)).alias("votes"), F.sum(idx).alias("idx_sum"), F.min(idx).alias("first_idx"),
        *[F.min_by(c, idx).alias(c) for c in VOTE_FIRST])


#: What is kept of an answer's earliest supporter.
VOTE_FIRST = ["pred", "correct", "boxed", "lcode", "lang_score"]


def merge_vote_groups(tables: DataFrame) -> DataFrame:
    return tables.groupBy(*ITEM, "n", "vkey").agg(
        F.sum("votes").alias("votes"), F.sum("idx_sum").alias("idx_sum"), F.min("first_idx").alias("first_idx"),
        *[F.min_by(c, "first_idx").alias(c) for c in VOTE_FIRST])


def majority_winner(samples: DataFrame, ns: Sequence[int] = NS, decimals: int = 6) -> DataFrame:
    """The majority-vote winner of every (item, n) prefix.

    Null predictions do not vote; most votes wins, then the lower mean index,
    then the lower first index; the winner row is the earliest supporter, and its
    own prediction (not the rounded vote key) is returned.
    Items whose prefix has no prediction get no row."""
    return winner_of_votes(vote_groups(samples, max(ns), decimals), ns)


def winner_of_votes(groups: DataFrame, ns: Sequence[int] = NS) -> DataFrame:
    """G8 from the votes of every (item, n, answer), which may be those of longer prefixes."""
    groups = groups.where(F.col("n") <= max(ns)).withColumn("avg_idx", F.col("idx_sum") / F.col("votes"))
    w = Window.partitionBy(*ITEM, "n").orderBy(F.col("votes").desc(), "avg_idx", "first_idx")
    best = groups.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
    decode = F.coalesce(*[F.when(F.col("lcode") == v, F.lit(k)) for k, v in _LABEL_CODE.items()])
    return best.select(*ITEM, "n", "pred", "votes",
                       F.col("first_idx").alias("winner_idx"), "correct", "boxed",
                       decode.alias("lang_label"), "lang_score")


def majority_metrics(winners: DataFrame, samples: DataFrame, items: DataFrame,
                     ns: Sequence[int] = NS,
                     target_modes: Sequence[str] = TARGET_MODES_SCALING) -> DataFrame:
    """G9 + G10: per (model, mode, n): winner accuracy, boxed, parsed rates over
    all items (items without a winner count as misses); target-language rates;
    mean contrast of winners over parsed winners (0.0 when none)."""
    lab, c, b = F.col("lang_label"), F.col("correct"), F.col("boxed")

    def cnt(e):
        return F.sum(F.when(e, 1).otherwise(0))

    agg = winners.groupBy("model", "mode", "n").agg(
        cnt(c).alias("accuracy"), cnt(b).alias("boxed_rate"),
        F.count(F.lit(1)).alias("parsed_rate"),
        cnt(c & b & (lab == LABEL_TARGET)).alias("strict_accuracy"),
        cnt(c & (lab != LABEL_TARGET)).alias("correct_but_not_target_rate"),
        cnt(lab == LABEL_TARGET).alias("selected_target_rate"),
        cnt(lab == LABEL_OTHER).alias("selected_other_rate"),
        cnt(lab == LABEL_MIXED).alias("selected_mixed_rate"),
        cnt(lab == LABEL_UNCLEAR).alias("selected_unclear_rate"),
        F.sum("lang_score").alias("_score_sum"))
    grid = _with_total(_grid(samples, ns), items)
    out = grid.join(agg, ["model", "mode", "n"], "left")
    is_t = F.col("mode").isin(*target_modes)

    def rate(k):
        return F.coalesce(F.col(k), F.lit(0)) / F.col("total")

    parsed = F.coalesce(F.col("parsed_rate"), F.lit(0))
    contrast = F.coalesce(F.try_divide(F.col("_score_sum"), parsed.cast("double")), F.lit(0.0))
    cols = [rate(k).alias(k) for k in MAJ_BASE]
    cols += [F.when(is_t, rate(k)).alias(k) for k in MAJ_TARGET[:-1]]
    cols += [F.when(is_t, contrast).alias("selected_avg_target_minus_other")]
    return out.select("model", "mode", "n", *cols)


def scaling_long(best: DataFrame, mix: DataFrame, majority: DataFrame) -> DataFrame:
    """(model, mode, n, metric, value) with reference-style metric names
    ``best_of_{n}_*`` and ``majority_of_{n}_*``; null metrics are left out."""
    def unpivot(df, names, prefix):
        return df.select("model", "mode", "n", F.explode(F.array(*[
            F.struct(F.lit(k).alias("k"), F.col(k).cast("double").alias("value")) for k in names]))
            .alias("x")).select("model", "mode", "n",
                                F.concat(F.lit(prefix), F.col("n").cast("string"), F.lit("_"),
                                         F.col("x.k")).alias("metric"), "x.value") \
            .where(F.col("value").isNotNull())
    return unpivot(best, BEST_BASE + BEST_TARGET, "best_of_") \
        .unionByName(unpivot(mix, SAMPLE_MIX, "best_of_")) \
        .unionByName(unpivot(majority, MAJ_BASE + MAJ_TARGET, "majority_of_"))
