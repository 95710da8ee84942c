"""End-to-end runs and the row gate."""

import pytest

from glossa.operators import language as L
from glossa.operators import splits as B
from glossa.plans import runs
from glossa.session import scratch_dir
from glossa.sources import fixtures as X

from .conftest import SF_SMALL


def test_require_rows(spark):
    df = spark.range(3)
    assert B.require_rows(df, "x") is df
    with pytest.raises(B.EmptyResultError):
        B.require_rows(df.where("id < 0"), "empty")


def test_position_split_exact(spark):
    df = spark.createDataFrame([(k,) for k in [5, 1, 9, 3, 7, 100, 42, 8]], "pid long")
    got = {r.pid: (r.position, r.part) for r in B.split_by_position(df, "pid", 3).collect()}
    order = sorted(got)
    assert [got[k][0] for k in order] == list(range(8))
    assert [got[k][1] for k in order] == ["train"] * 3 + ["test"] * 5


def test_scaling_run(spark):
    items, comp = X.items(spark, SF_SMALL), X.completions(spark, SF_SMALL)
    prof = L.fit_profile(X.labelled_text(spark, SF_SMALL), "text", "lang", ("de", "en"))
    out = scratch_dir(spark, "test-run")
    # 200 items at this scale: the first 150 by pid are the training part.
    wide, series = runs.scaling_run(items, comp, prof, "de", "en", out, train_rows=150)
    row = wide.collect()
    assert len(row) == 2 and "da_majority_of_10_accuracy" in wide.columns
    back = spark.read.json(f"{out}/json")
    assert back.count() == 2
    assert series.where("figure = 'best_of_accuracy'").count() > 0


def test_unpaired_set(spark):
    rows = runs.unpaired_training_set(X.items(spark, SF_SMALL), 42, 150)
    assert rows.where("lang = 'da'").count() > 0 and rows.where("lang = 'en'").count() == 150
