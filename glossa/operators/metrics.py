"""Evaluation aggregates, wide result rows and scaling series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count
from .language import LABEL_MIXED, LABEL_OTHER, LABEL_TARGET, LABEL_UNCLEAR
from .scoring import TARGET_MODES_EVAL

EVAL_BASE = ["accuracy", "boxed_rate"]
EVAL_TARGET = ["target_rate", "other_rate", "mixed_rate", "unclear_rate", "strict_accuracy",
               "correct_but_not_target_rate", "avg_target_minus_other"]


def eval_metrics(scored: DataFrame, items: DataFrame,
                 target_modes: Sequence[str] = TARGET_MODES_EVAL) -> DataFrame:
    """G1-G4 per (model, mode): accuracy, boxed rate; for target modes the four
    label rates, strict accuracy, correct-but-not-target and mean contrast
    (unclear counts as 0).  One hash aggregation.

    A model is asked once for each item and mode: its first sample counts, and
    the rates are shares of all items, so a missing answer is a miss."""
    lab, c, b = F.col("lang_label"), F.col("correct"), F.col("boxed")
    is_t = F.col("mode").isin(*target_modes)
    total = items.select(F.count(F.lit(1))).scalar()

    def _rate(e):
        return F.sum(F.when(e, 1.0).otherwise(0.0)) / F.max("_total")

    return scored.where(F.col("sample_idx") == 0).withColumn("_total", total).groupBy("model", "mode").agg(
        _rate(c).alias("accuracy"), _rate(b).alias("boxed_rate"),
        F.when(is_t, _rate(lab == LABEL_TARGET)).alias("target_rate"),
        F.when(is_t, _rate(lab == LABEL_OTHER)).alias("other_rate"),
        F.when(is_t, _rate(lab == LABEL_MIXED)).alias("mixed_rate"),
        F.when(is_t, _rate(lab == LABEL_UNCLEAR)).alias("unclear_rate"),
        F.when(is_t, _rate(c & b & (lab == LABEL_TARGET))).alias("strict_accuracy"),
        F.when(is_t, _rate(c & (lab != LABEL_TARGET))).alias("correct_but_not_target_rate"),
        F.when(is_t, F.sum(F.coalesce(F.col("lang_score"), F.lit(0.0))) / F.max("_total")).alias("avg_target_minus_other"),
    )


def length_summary(completions: DataFrame) -> DataFrame:
    """Words per completion by (model, mode): mean, max and median."""
    w = word_count("text")
    return completions.select("model", "mode", w.alias("w")).groupBy("model", "mode").agg(
        F.avg("w").alias("avg_words"), F.max("w").cast("long").alias("max_words"),
        F.percentile(F.col("w"), F.lit(0.5)).alias("p50_words"))


def metrics_long(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(keys..., metric, value) for the non-null metrics of a wide frame."""
    return wide.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value"))
        for k in metrics])).alias("x")).select(*keys, "x.metric", "x.value") \
        .where(F.col("value").isNotNull())


def pivot_metrics(long: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per model, one column per ``{mode}_{metric}``.  The column
    list is given, so the pivot needs no extra pass to find its values."""
    keyed = long.select("model", F.concat_ws("_", "mode", "metric").alias("k"), "value")
    return keyed.groupBy("model").pivot("k", list(columns)).agg(F.first("value"))


def eval_columns(modes: Sequence[str], target_modes: Sequence[str] = TARGET_MODES_EVAL):
    cols = []
    for m in modes:
        cols += [f"{m}_{k}" for k in EVAL_BASE]
        if m in target_modes:
            cols += [f"{m}_{k}" for k in EVAL_TARGET]
    return cols


def eval_wide(scored: DataFrame, items: DataFrame, modes: Sequence[str] = ("da", "en"),
              target_modes: Sequence[str] = TARGET_MODES_EVAL) -> DataFrame:
    """G1-G4 then G12: the evaluation result row of every model."""
    long = metrics_long(eval_metrics(scored, items, target_modes), ["model", "mode"],
                        EVAL_BASE + EVAL_TARGET)
    return pivot_metrics(long, eval_columns(modes, target_modes))


# Display names of prompt modes and series labels of the figures.
MODE_NAMES = {"en": "English", "da": "Danish", "da_en": "Danish + English"}
FIGURES = [
    # (figure, series label, metric suffix, prefix)
    ("best_vs_majority", "Oracle best-of-n", "oracle_accuracy", "best_of_"),
    ("best_vs_majority", "Majority@n", "accuracy", "majority_of_"),
    ("best_vs_majority", "Strict Danish majority@n", "strict_accuracy", "majority_of_"),
    ("best_detail", "Strict Danish accuracy", "oracle_strict_accuracy", "best_of_"),
    ("best_detail", "Any correct Danish", "oracle_any_correct_target_rate", "best_of_"),
    ("best_detail", "Any correct English", "oracle_any_correct_other_rate", "best_of_"),
    ("best_language_mix", "Sample Danish rate", "sample_target_rate", "best_of_"),
    ("best_language_mix", "Sample English rate", "sample_other_rate", "best_of_"),
    ("best_language_mix", "Sample unclear rate", "sample_unclear_rate", "best_of_"),
    ("majority_language", "Selected Danish rate", "selected_target_rate", "majority_of_"),
    ("majority_language", "Selected English rate", "selected_other_rate", "majority_of_"),
    ("majority_language", "Selected unclear rate", "selected_unclear_rate", "majority_of_"),
]
# The metric whose presence enables each target-mode figure.
FIGURE_GATE = {"best_vs_majority": "oracle_accuracy", "best_detail": "oracle_strict_accuracy",
               "best_language_mix": "sample_target_rate",
               "majority_language": "selected_target_rate"}


def safe_name(c):
    """File-safe model name: runs of other characters -> '_', trimmed of '_'."""
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def scaling_series(long: DataFrame, modes: Sequence[str] = ("en", "da"),
                   target_mode: str = "da", ns: Sequence[int] = tuple(range(1, 11))) -> DataFrame:
    """(model, safe_model, figure, series, n, percent) = 100 x rate.

    Per-mode figures keep only the present points; the target-mode figures list
    every n and give NaN where a metric is missing (when the figure is enabled).
    ``long`` is (model, mode, n, metric, value) with ``best_of_{n}_*`` names."""
    base = long.withColumn("suffix", F.regexp_replace("metric", r"^(best_of|majority_of)_\d+_", "")) \
        .withColumn("prefix", F.regexp_extract("metric", r"^(best_of_|majority_of_)", 1))
    name_map = F.create_map(*[x for k, v in MODE_NAMES.items() for x in (F.lit(k), F.lit(v))])
    pretty = F.coalesce(F.element_at(name_map, F.col("mode")), F.col("mode"))
    per_mode = base.where(F.col("mode").isin(*modes) & (
        ((F.col("prefix") == "best_of_") & (F.col("suffix") == "oracle_accuracy")) |
        ((F.col("prefix") == "majority_of_") & (F.col("suffix") == "accuracy")))).select(
        "model", F.when(F.col("prefix") == "best_of_", "best_of_accuracy")
        .otherwise("majority_accuracy").alias("figure"), pretty.alias("series"), "n",
        (F.col("value") * 100.0).alias("percent"))
    spec = F.array(*[F.struct(F.lit(f).alias("figure"), F.lit(s).alias("series"),
                              F.lit(m).alias("suffix"), F.lit(p).alias("prefix"))
                     for f, s, m, p in FIGURES])
    tgt = base.where(F.col("mode") == target_mode)
    models = long.select("model").distinct()
    gates = tgt.groupBy("model").agg(*[
        F.max(F.when((F.col("suffix") == m) & (F.col("prefix") == (
            "majority_of_" if m == "selected_target_rate" else "best_of_")), 1)).alias(f"g_{f}")
        for f, m in FIGURE_GATE.items()])
    grid = models.select("model", F.explode(spec).alias("s")) \
        .select("model", "s.*", F.explode(F.array(*[F.lit(n) for n in ns])).alias("n"))
    enabled = grid.join(gates, "model").where(F.coalesce(*[
        F.when(F.col("figure") == f, F.col(f"g_{f}")) for f in FIGURE_GATE]) == 1)
    fixed = enabled.join(tgt.select("model", "n", "suffix", "prefix", "value"),
                         ["model", "n", "suffix", "prefix"], "left").select(
        "model", F.concat(F.lit("target_"), F.col("figure")).alias("figure"), "series", "n",
        F.coalesce(F.col("value") * 100.0, F.lit(float("nan"))).alias("percent"))
    out = per_mode.unionByName(fixed)
    return out.select("model", safe_name(F.col("model")).alias("safe_model"),
                      "figure", "series", F.col("n").cast("long").alias("n"), "percent")
