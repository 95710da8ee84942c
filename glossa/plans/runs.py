"""End-to-end runs, as a user of the evaluation and scaling scripts runs them.

* ``evaluation_run``: test split -> score -> rates per (model, mode) -> one wide
  row per model -> JSON + CSV.
* ``scaling_run``: test split -> score once -> best-of-N, majority, language mix
  for N = 1..10 -> wide row per model, long series for figures -> JSON + CSV.
* ``*_training_set``: the paired, target-only, unpaired, RL and English sets, rendered.
* ``translation_run``, ``review_run``: replies to accepted translations, and to the issue report.
* ``TranslationLog``: accepted translations appended run by run, with what is still pending.

Scored rows are written once below the shared scratch folder and read back, so
the metric jobs do not recompute the language scores and a lost executor only
costs the stage it was running.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import metrics as M
from ..operators import prompts as D
from ..operators import review as H
from ..operators import scaling as G
from ..operators import scoring as S
from ..operators import splits as B
from ..session import scratch_dir
from ..sources import io as IO
from ..sources.ledger import Ledger


def _test_items(items: DataFrame, train_rows: int) -> DataFrame:
    return B.split_by_position(items, "pid", train_rows, "test").drop("position", "part")


def _persist(df: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def evaluation_run(items: DataFrame, completions: DataFrame, profile: DataFrame,
                   target: str, other: str, out_dir: str, train_rows: int = 7473,
                   modes: Sequence[str] = ("da", "en")) -> DataFrame:
    test = _test_items(items, train_rows)
    comp = completions.join(test.select("pid"), "pid", "left_semi")
    scored = _persist(S.score_completions(comp, test, profile, target, other,
                                          S.TARGET_MODES_EVAL), "eval-scored")
    wide = M.eval_wide(scored, test, modes)
    IO.write_metrics(wide, out_dir)
    return wide


def scaling_run(items: DataFrame, completions: DataFrame, profile: DataFrame,
                target: str, other: str, out_dir: str, train_rows: int = 7473,
                modes: Sequence[str] = ("en", "da"), ns: Sequence[int] = G.NS) -> tuple[DataFrame, DataFrame]:
    test = _test_items(items, train_rows)
    comp = completions.join(test.select("pid"), "pid", "left_semi")
    scored = _persist(S.score_completions(comp, test, profile, target, other,
                                          S.TARGET_MODES_SCALING), "scaling-scored")
    best = G.best_of_n(scored, test, ns)
    mix = G.sample_language_mix(scored, test, ns)
    maj = G.majority_metrics(G.majority_winner(G.voters(scored, max(ns)), ns), scored, test, ns)
    long = _persist(G.scaling_long(best, mix, maj), "scaling-long")
    wide = M.pivot_metrics(long, scaling_columns(modes, ns))
    IO.write_metrics(wide, out_dir)
    series = M.scaling_series(long, modes, "da", ns)
    series.write.mode("overwrite").json(f"{out_dir.rstrip('/')}/series")
    return wide, series


def scaling_columns(modes: Sequence[str], ns: Sequence[int],
                    target_modes: Sequence[str] = S.TARGET_MODES_SCALING) -> list[str]:
    """The wide column names, known up front (the pivot needs no extra pass)."""
    cols = []
    for m in modes:
        t = m in target_modes
        for n in ns:
            best = G.BEST_BASE + (G.BEST_TARGET + G.SAMPLE_MIX if t else [])
            maj = G.MAJ_BASE + (G.MAJ_TARGET if t else [])
            cols += [f"{m}_best_of_{n}_{k}" for k in best]
            cols += [f"{m}_majority_of_{n}_{k}" for k in maj]
    return cols


def _train_items(items: DataFrame, train_rows: int) -> DataFrame:
    # the first rows by id: a bounded top-k, no ranks needed
    return items.orderBy("pid").limit(train_rows)


def _chat(family: str, lang: str, reasoning: bool) -> Column:
    """System, user and assistant turn of (q, a) columns as one chat text."""
    system, user = D.template(family, lang, reasoning)
    asked = D.fill(user, {k: F.col("q") for k in D.question_columns(lang)})
    return D.render_messages(D.messages(F.lit(system), asked, F.col("a")))


def _with_chat(rows: DataFrame, family: str, reasoning: bool) -> DataFrame:
    """Adds the chat ``text`` of (lang, q, a) rows."""
    return rows.withColumn("text", F.when(F.col("lang") == "da", _chat(family, "da", reasoning))
                           .otherwise(_chat(family, "en", reasoning)))


def paired_training_set(items: DataFrame, seed: int = 42, train_rows: int = 7473,
                        reasoning: bool = True) -> DataFrame:
    """Both languages of every training item, with the chat text."""
    return _with_chat(D.expand_paired(_train_items(items, train_rows), seed), "sft_paired", reasoning)


def target_training_set(items: DataFrame, seed: int = 42, train_rows: int = 7473,
                        reasoning: bool = True) -> DataFrame:
    """The target language of every training item, with the chat text."""
    rows = D.expand_single(_train_items(items, train_rows), seed)
    return rows.withColumn("text", _chat("sft_da", "da", reasoning))


def unpaired_training_set(items: DataFrame, seed: int = 42, train_rows: int = 7473,
                          reasoning: bool = True) -> DataFrame:
    """Each language in its own order, blank rows left out, with the chat text; all
    three row gates hold."""
    rows = D.expand_unpaired(_train_items(items, train_rows), seed)
    B.require_rows(rows.where(F.col("lang") == "da"), "target-language examples")
    B.require_rows(rows.where(F.col("lang") == "en"), "source-language examples")
    return B.require_rows(_with_chat(rows, "sft_unpaired", reasoning), "training set")


def rl_training_set(items: DataFrame, mode: str = "da_en", reasoning: bool = True,
                    train_rows: int = 7473, subset: int | None = 2000) -> DataFrame:
    """Prompts and boxed solutions of the first ``subset`` training items (all if None)."""
    train = _train_items(items, min(train_rows, subset) if subset else train_rows)
    return D.to_rl_set(train, mode, reasoning)


def english_training_set(items: DataFrame) -> DataFrame:
    """The source language of all items, with the chat text."""
    rows = D.to_messages_en(items)
    return rows.select("pid", "messages", D.render_messages("messages").alias("text"))


def evaluation_subset(items: DataFrame, k: int, seed: int = 42, train_rows: int = 7473) -> DataFrame:
    """``k`` test items of a seeded shuffle."""
    return B.sample_k(_test_items(items, train_rows), "pid", k, seed)


def translation_run(source: DataFrame, attempts: DataFrame, done: DataFrame | None, profile: DataFrame,
                    target: str, languages: Sequence[str]) -> DataFrame:
    """Items translated so far and those of ``source`` (pid, question, answer) still
    pending, each with its first accepted attempt or empty target texts."""
    cols = ["id", "question", "answer", "da_question", "da_answer"]
    if done is None:
        return H.first_accepted(source, attempts, profile, target, languages).select(*cols)
    open_items = H.pending_items(source.withColumn("id", F.col("pid")), done)
    todo = attempts.join(open_items.select("id"), "id", "left_semi")
    return done.select(*cols).unionByName(
        H.first_accepted(open_items, todo, profile, target, languages).select(*cols))


TRANSLATED = ["id", "question", "answer", "da_question", "da_answer"]
#: Ids of pending items up to which they are sent to the replies (some 50 bytes each in a task's process).
BROADCAST_IDS = 4_000_000


def replies_of(attempts: DataFrame, todo: DataFrame) -> DataFrame:
    """The attempts at the items of ``todo``, a written table; whole replies are not shuffled to find them.

    With more ids than ``BROADCAST_IDS`` all attempts are given, to be judged where they lie: ``first_accepted`` drops those of other
    items, by their ids alone but for accepted parts."""
    if todo.count() > BROADCAST_IDS:
        return attempts
    return attempts.join(F.broadcast(todo.select("id")), "id", "left_semi")


class TranslationLog:
    """H3, H4 over many runs: what was translated is appended run by run, and never written again.

    A run translates the items that no published run holds.  Its rows appear at once when all of them are written; a
    run that fails in between leaves nothing to see, and the same or another run takes its items up again.  An item whose
    attempts were all rejected is written with empty target texts, as one that is accepted is, and is not asked for again;
    an item without an attempt stays pending."""

    def __init__(self, spark: SparkSession, root: str):
        self._log = Ledger(spark, root)
        self._schema = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(c, T.StringType()) for c in TRANSLATED[1:]]])

    def translated(self) -> DataFrame:
        """All items written so far, one row each."""
        return self._log.read(self._schema)

    def pending(self, source: DataFrame) -> DataFrame:
        """The items of ``source`` (pid, question, answer) that no run has written; only ids are read of the log."""
        return H.pending_items(source.withColumn("id", F.col("pid").cast("long")), self.translated())

    def run(self, name: str, source: DataFrame, attempts: DataFrame, profile: DataFrame, target: str, languages: Sequence[str]) -> bool:
        """Append the pending items that have attempts; False if a run of this name was published before."""
        if self._log.has(name):
            return False
        tried = attempts.select("id").distinct()
        todo = _persist(self.pending(source).join(tried, "id", "left_semi"), "translation-todo")
        rows = H.first_accepted(todo, replies_of(attempts, todo), profile, target, languages)
        return self._log.commit(name, rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self._schema]))


def review_run(items: DataFrame, attempts: DataFrame, out_dir: str) -> DataFrame:
    """The issue report of all items, written as CSV."""
    report = _persist(H.issue_report(items, H.first_parseable(attempts, items)), "issues")
    IO.write_items(report, out_dir)
    return report
