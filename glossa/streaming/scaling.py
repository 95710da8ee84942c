"""Best-of-N, majority vote and language mix while completions arrive (S3; G6-G11 at any time).

Each arrival leaves three small tables made of its own samples: the first hit of every item it touches, the votes of every
(item, n, answer), and the label counts of every sample index.  They merge by minima and sums, so an item's samples may come in any
order and in any number of arrivals.  The results read the merger of all arrivals so far; they are those of a batch job over the same samples.

Arrivals are runs of append-only ledgers: a batch that is replayed after a failure finds its run published and adds
nothing, so that no vote counts twice.  An arrival writes in proportion to itself; ``compact`` merges the tables of past arrivals when they are many.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators import scaling as G
from ..operators.language import written
from ..operators.scoring import TARGET_MODES_SCALING, score_completions
from ..sources.io import COMPLETIONS_SCHEMA
from ..sources.ledger import Ledger


class RunningScaling:
    """The running state below ``root``: samples with an index below ``max_n``."""

    def __init__(self, spark: SparkSession, root: str, max_n: int = max(G.NS),
                 target_modes: Sequence[str] = TARGET_MODES_SCALING):
        self.root, self.max_n, self.target_modes = root.rstrip("/"), max_n, tuple(target_modes)
        self._ledgers = {k: Ledger(spark, f"{self.root}/{k}") for k in ("hits", "votes", "counts")}
        self._merge = {"hits": G.merge_first_hits, "votes": G.merge_vote_groups, "counts": G.merge_sample_counts}

    def add(self, run: str, scored: DataFrame) -> None:
        """Take in the scored samples of one arrival, once; after a failure in between, the same call finishes the run."""
        if all(ledger.has(run) for ledger in self._ledgers.values()):
            return
        # a batch's votes of one item are counted where its samples are, before anything is written
        scored = written(G.prefix_samples(scored, self.max_n), "arrival")
        self._ledgers["hits"].commit(run, G.first_hits(scored, self.max_n))
        self._ledgers["votes"].commit(run, G.vote_groups(scored, self.max_n))
        self._ledgers["counts"].commit(run, G.sample_counts(scored, self.max_n, self.target_modes))

    def compact(self, run: str) -> None:
        for k, ledger in self._ledgers.items():
            ledger.compact(run, self._merge[k])

    def _state(self, kind: str) -> DataFrame:
        rows = self._ledgers[kind].read()
        if rows is None:
            raise ValueError(f"no arrival yet below {self.root}")
        return self._merge[kind](rows)

    def best_of_n(self, items: DataFrame, ns: Sequence[int] = G.NS) -> DataFrame:
        """G6, G7 so far."""
        hits = self._state("hits")
        return G.best_of_hits(hits, G._grid(hits, ns), items, ns, self.target_modes)

    def winners(self, ns: Sequence[int] = G.NS) -> DataFrame:
        """G8 so far."""
        return G.winner_of_votes(self._state("votes"), ns)

    def majority(self, items: DataFrame, ns: Sequence[int] = G.NS) -> DataFrame:
        """G9, G10 so far."""
        return G.majority_metrics(self.winners(ns), self._state("hits"), items, ns, self.target_modes)

    def language_mix(self, items: DataFrame, ns: Sequence[int] = G.NS) -> DataFrame:
        """G11 so far."""
        return G.mix_of_counts(self._state("counts"), items, ns)


def stream_scaling(spark: SparkSession, src_dir: str, state: RunningScaling, items: DataFrame, profile: DataFrame,
                   target: str, other: str) -> None:
    """Take in all completion files that arrived since the last run, then stop.

    The checkpoint lies beside the state, as the names of runs are those of its batches."""

    def take(batch: DataFrame, batch_id: int) -> None:
        batch = batch.where(batch["sample_idx"] < state.max_n)
        state.add(f"batch-{batch_id:09d}", score_completions(batch, items, profile, target, other, state.target_modes))

    (spark.readStream.schema(COMPLETIONS_SCHEMA).parquet(src_dir)
     .writeStream.foreachBatch(take).option("checkpointLocation", f"{state.root}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
