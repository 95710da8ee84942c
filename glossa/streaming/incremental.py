"""Incremental jobs over arriving completion files.

S1 scores every micro-batch with the batch job (the language score needs a
per-text aggregation, which ``foreachBatch`` runs as a plain batch job) and
overwrites that batch's own ``batch_id=`` folder, so a replay after a failure
rewrites the same files: the sink stays exactly-once although
``foreachBatch`` is at-least-once.

S2 keeps running sums and counts (never ratios) in streaming state
(``complete`` mode), and adds up the language sums that each batch of S1 leaves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.answers import boxed_flag, boxed_number
from ..operators.language import LABEL_MIXED, LABEL_OTHER, LABEL_TARGET, LABEL_UNCLEAR
from ..operators.scoring import TARGET_MODES_SCALING, attach_gold, correct_expr, score_completions
from ..sources.io import COMPLETIONS_SCHEMA


def stream_score(spark: SparkSession, src_dir: str, sink_dir: str, checkpoint: str,
                 items: DataFrame, profile: DataFrame, target: str, other: str,
                 target_modes: Sequence[str] = TARGET_MODES_SCALING,
                 counters_dir: str | None = None) -> None:
    """Score all completion files that arrived since the last run, then stop
    (``availableNow``); the checkpoint makes a restart skip finished files.

    With ``counters_dir``, each batch also leaves its own language sums there (S2)."""
    sink = sink_dir.rstrip("/")

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        scored = score_completions(batch, items, profile, target, other, target_modes)
        path = f"{sink}/batch_id={batch_id}"
        scored.write.mode("overwrite").parquet(path)
        if counters_dir:
            sums = language_counters(spark.read.schema(scored.schema).parquet(path))
            sums.write.mode("overwrite").parquet(f"{counters_dir.rstrip('/')}/batch_id={batch_id}")

    q = (spark.readStream.schema(COMPLETIONS_SCHEMA).parquet(src_dir)
         .writeStream.foreachBatch(score_batch)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def read_scored(spark: SparkSession, sink_dir: str) -> DataFrame:
    return spark.read.parquet(sink_dir).drop("batch_id")


def stream_metrics(spark: SparkSession, src_dir: str, sink_dir: str, checkpoint: str,
                   items: DataFrame) -> None:
    """Running (rows, correct, boxed) per (model, mode) as streaming state;
    each trigger writes the complete current table as a version of its own, so that
    a failure leaves the version before (``read_metrics`` takes the last)."""
    sink = sink_dir.rstrip("/")
    rows = attach_gold(spark.readStream.schema(COMPLETIONS_SCHEMA).parquet(src_dir), items)
    text = F.coalesce(F.col("text"), F.lit(""))
    counts = rows.select("model", "mode", boxed_flag(text).alias("boxed"),
                         correct_expr(boxed_number(text), F.col("gold")).alias("correct")) \
        .groupBy("model", "mode").agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(F.col("correct").cast("long")).alias("correct"),
            F.sum(F.col("boxed").cast("long")).alias("boxed"))

    def save(batch: DataFrame, batch_id: int) -> None:
        # one row per (model, mode): one small file, which appears as a whole
        batch.coalesce(1).write.mode("overwrite").parquet(f"{sink}/version={batch_id}")

    q = (counts.writeStream.outputMode("complete").foreachBatch(save)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def read_metrics(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The last version of S2's running table."""
    versions = spark.read.parquet(sink_dir)
    last = versions.select(F.max("version")).scalar()
    return versions.where(F.col("version") == last).drop("version")


def running_language(spark: SparkSession, counters_dir: str) -> DataFrame:
    """The language sums of all batches so far, from each batch's own sums."""
    sums = spark.read.parquet(counters_dir)
    return sums.groupBy("model", "mode").agg(
        *[F.sum(c).alias(c) for c in ("target", "other", "mixed", "unclear", "score_sum")])


def rates(counts: DataFrame, language: DataFrame) -> DataFrame:
    """Running rates per (model, mode), from the sums (never kept as ratios)."""
    rows = F.col("rows")
    return counts.join(language, ["model", "mode"], "left").select(
        "model", "mode", "rows", (F.col("correct") / rows).alias("accuracy"), (F.col("boxed") / rows).alias("boxed_rate"),
        *[(F.col(c) / rows).alias(f"{c}_rate") for c in ("target", "other", "mixed", "unclear")],
        (F.col("score_sum") / rows).alias("mean_score"))


def language_counters(scored: DataFrame) -> DataFrame:
    """Label counts and contrast sum per (model, mode) from S1's scored rows."""
    lab = F.col("lang_label")

    def cnt(v):
        return F.sum(F.when(lab == v, 1).otherwise(0)).cast("long")

    return scored.groupBy("model", "mode").agg(
        cnt(LABEL_TARGET).alias("target"), cnt(LABEL_OTHER).alias("other"),
        cnt(LABEL_MIXED).alias("mixed"), cnt(LABEL_UNCLEAR).alias("unclear"),
        F.sum(F.coalesce(F.col("lang_score"), F.lit(0.0))).alias("score_sum"))
