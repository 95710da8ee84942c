"""Best-of-N, majority and language mix while completions arrive, against the batch jobs."""

import pytest
from pyspark.sql import functions as F

from glossa.operators import scaling as G
from glossa.session import scratch_dir
from glossa.sources.ledger import Ledger
from glossa.streaming.scaling import RunningScaling

from .test_scaling import NS, make_rows

SCHEMA = ("pid long, model string, mode string, sample_idx long, boxed boolean, pred double, "
          "correct boolean, lang_label string, lang_score double")


def table(df, keys):
    return {tuple(r[k] for k in keys): [None if r[c] is None else round(r[c], 9) if isinstance(r[c], float) else r[c] for c in sorted(df.columns) if c not in keys]
            for r in df.collect()}


def same_as_batch(state, samples, items):
    keys = ["model", "mode", "n"]
    assert table(state.best_of_n(items, NS), keys) == table(G.best_of_n(samples, items, NS), keys)
    winners = G.majority_winner(samples, NS)
    assert table(state.winners(NS), G.ITEM + ["n"]) == table(winners, G.ITEM + ["n"])
    assert table(state.majority(items, NS), keys) == table(G.majority_metrics(winners, samples, items, NS), keys)
    assert table(state.language_mix(items, NS), keys) == table(G.sample_language_mix(samples, items, NS), keys)


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(make_rows(seed=11, items=25), SCHEMA).withColumn("part", F.pmod(F.xxhash64("pid", "model", "sample_idx"), F.lit(3)))


def test_arrivals_merge_to_the_batch_result(spark, samples):
    items = spark.range(25).withColumnRenamed("id", "pid")
    root = scratch_dir(spark, "test-running")
    # the samples of one prompt are spread over all arrivals, and come in any order
    for i in (2, 0):
        RunningScaling(spark, root).add(f"run-{i}", samples.where(F.col("part") == i).drop("part"))
    same_as_batch(RunningScaling(spark, root), samples.where("part <> 1").drop("part"), items)
    again = RunningScaling(spark, root)
    again.add("run-0", samples.where("part = 0").drop("part"))  # replayed: counts once
    again.compact("merged-1")
    again.add("run-1", samples.where("part = 1").drop("part"))
    again.add("run-2", samples.where("part = 2").drop("part"))  # replayed after it was merged
    same_as_batch(again, samples.drop("part"), items)
    fewer = (1, 2, 5)
    assert table(again.winners(fewer), G.ITEM + ["n"]) == table(G.majority_winner(samples, fewer).where(F.col("n").isin(*fewer) | (F.col("n") <= 5)), G.ITEM + ["n"])


def test_a_failure_between_the_tables_of_a_run_loses_and_repeats_nothing(spark, samples, monkeypatch):
    items = spark.range(25).withColumnRenamed("id", "pid")
    root = scratch_dir(spark, "test-running-failure")
    rows = samples.drop("part")
    with monkeypatch.context() as m:
        m.setattr(G, "vote_groups", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("executor lost")))
        with pytest.raises(RuntimeError):
            RunningScaling(spark, root).add("run", rows)
    RunningScaling(spark, root).add("run", rows)
    same_as_batch(RunningScaling(spark, root), rows, items)


def test_nothing_has_arrived(spark):
    with pytest.raises(ValueError):
        RunningScaling(spark, scratch_dir(spark, "test-none")).winners()


def test_ledger_publishes_a_run_once_and_whole(spark, monkeypatch):
    root = scratch_dir(spark, "test-ledger")
    a, b = Ledger(spark, root), Ledger(spark, root)
    assert a.read() is None and a.read(spark.range(1).schema).count() == 0
    assert a.commit("r1", spark.range(3)) and not b.commit("r1", spark.range(100))
    # two attempts at one run that both write their rows: one is published
    with monkeypatch.context() as m:
        m.setattr(Ledger, "has", lambda *_: False)
        assert not b.commit("r1", spark.range(50))
    with monkeypatch.context() as m:
        m.setattr(Ledger, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            a.commit("r2", spark.range(7))
    assert a.read().count() == 3 and list(a.runs()) == ["r1"]
    assert a.commit("r2", spark.range(7), {"why": "again"}) and b.runs()["r2"]["why"] == "again"
    assert b.compact("m1", lambda df: df.distinct()) and a.read().count() == 7
    assert list(a.runs()) == ["m1"] and not a.commit("r1", spark.range(9)) and a.commit("r3", spark.range(2))
    assert a.compact("m2", lambda df: df) and not a.commit("r2", spark.range(9)) and a.read().count() == 9
    with pytest.raises(ValueError):
        a.commit("x/y", spark.range(1))
