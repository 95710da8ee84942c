"""Scoring joins and rewards."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.answers import DEFAULT_LETTERS, boxed_flag, boxed_number, gold_number, gold_text
from .language import MIN_CHARS, THRESHOLD, language_reward, with_signal

# Tolerance of a correct answer, and the modes whose gold is the
# source-language answer.
TOLERANCE = 1e-3
SOURCE_MODES = ("en",)
TARGET_MODES_EVAL = ("da", "da_en")
TARGET_MODES_SCALING = ("da",)

KEY = ["pid", "model", "mode", "sample_idx"]


def gold_table(items: DataFrame) -> DataFrame:
    """Per item: gold number of the source answer and of the target answer."""
    return items.select("pid", gold_number("answer").alias("gold_src"),
                        gold_number("da_answer").alias("gold_tgt"))


def attach_gold(completions: DataFrame, items: DataFrame) -> DataFrame:
    """completions joined to their item; ``gold`` picked by the prompt mode
    (source answer for 'en', target answer otherwise).  Orphans are dropped;
    ``orphans`` reports them."""
    g = gold_table(items)
    return completions.join(g, "pid").select(
        *completions.columns,
        F.when(F.col("mode").isin(*SOURCE_MODES), F.col("gold_src"))
        .otherwise(F.col("gold_tgt")).alias("gold"))


def orphans(completions: DataFrame, items: DataFrame) -> DataFrame:
    """Completions whose pid has no item."""
    return completions.join(items.select("pid"), "pid", "left_anti")


def correct_expr(pred, gold):
    return pred.isNotNull() & gold.isNotNull() & (F.abs(pred - gold) < TOLERANCE)


def score_completions(completions: DataFrame, items: DataFrame, profile: DataFrame,
                      target: str, other: str,
                      target_modes: Sequence[str] = TARGET_MODES_SCALING,
                      min_chars: int = MIN_CHARS, threshold: float = THRESHOLD,
                      letters: str = DEFAULT_LETTERS) -> DataFrame:
    """F2: boxed, pred, correct for every completion, plus lang_label / lang_score
    for rows whose mode is a target mode (null otherwise).  A null text is ''.

    Parsing and language scoring are projections of the completion row; only their
    narrow results are joined to the items, and columns that a caller does not
    read are not computed."""
    is_target = F.col("mode").isin(*target_modes)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = completions.select(*KEY, boxed_flag(text).alias("boxed"), boxed_number(text).alias("pred"),
                              F.when(is_target, text).alias("_signal"))
    rows = with_signal(rows, F.col("_signal"), profile, target, other, min_chars, threshold, letters=letters)
    rows = attach_gold(rows.select(*KEY, "boxed", "pred", "lang_label", "lang_score"), items)
    return rows.select(*KEY, "gold", "boxed", "pred",
                       correct_expr(F.col("pred"), F.col("gold")).alias("correct"),
                       "lang_label", "lang_score")


def rl_solutions(items: DataFrame, modes: Sequence[str] = ("en", "da")) -> DataFrame:
    """(pid, mode, solution = \\boxed{gold text}) for each item and mode."""
    return items.select("pid", F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"),
                        "answer", "da_answer").select(
        "pid", "mode",
        F.concat(F.lit("\\boxed{"),
                 gold_text(F.when(F.col("mode").isin(*SOURCE_MODES), F.col("answer"))
                           .otherwise(F.col("da_answer"))),
                 F.lit("}")).alias("solution"))


def accuracy_reward(df: DataFrame, completion: str = "text", solution: str = "solution",
                    solutions: DataFrame | None = None, on: Sequence[str] = ("pid", "mode")) -> DataFrame:
    """1.0 when the boxed numbers of completion and solution agree, else 0.0.

    With ``solutions`` (columns ``on`` and the solution) rows are joined to them here: completions are parsed in
    their rows and dropped, so that no text is shuffled."""
    g = boxed_number(solution)
    if solutions is None:
        p = boxed_number(completion)
    else:
        kept = [c for c in df.columns if c != completion]
        df = df.select(*kept, boxed_number(completion).alias("_pred")).join(solutions, list(on))
        p = F.col("_pred")
    return df.withColumn("accuracy_reward",
                         F.when(correct_expr(p, g), F.lit(1.0)).otherwise(F.lit(0.0))).drop("_pred")


RewardFn = Callable[[DataFrame], DataFrame]


def total_reward(df: DataFrame, rewards: Sequence[tuple[str, RewardFn, float]]) -> DataFrame:
    """apply each reward job (adding column ``name``) and sum them with weights."""
    out = df
    for _, fn, _ in rewards:
        out = fn(out)
    total = sum((F.lit(w) * F.col(name) for name, _, w in rewards), F.lit(0.0))
    return out.withColumn("total_reward", total)


def default_rewards(profile: DataFrame, target: str, other: str,
                    weights: tuple[float, float] = (1.0, 0.2), solutions: DataFrame | None = None):
    """The accuracy + language reward pair with the source weights 1.0 / 0.2.  With ``solutions`` the language
    comes first, as the accuracy then drops the texts."""
    pair = [
        ("accuracy_reward", lambda d: accuracy_reward(d, solutions=solutions), weights[0]),
        ("language_reward", lambda d: language_reward(d, "text", profile, target, other), weights[1]),
    ]
    return pair if solutions is None else pair[::-1]
