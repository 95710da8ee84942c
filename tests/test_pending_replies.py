"""Replies of pending items are found without a shuffle of the replies."""

import pytest

from glossa.plans import runs
from glossa.session import scratch_dir, written

GRAMS = [(lang, gram, -1.0 - (gram == wrong)) for gram in ("ich", "the") for lang, wrong in (("de", "the"), ("en", "ich"))]
ATTEMPTS = [(1, 0, "ich\nDanish Answer: ich", None), (2, 0, "the\nDanish Answer: the", None), (2, 1, "ich\nDanish Answer: ich ich", None),
            (3, 0, None, "timeout"), (4, 0, "ich ich\nDanish Answer: ich", None), (4, 0, "ich ich\nDanish Answer: ich", None), (None, 0, "ich\nDanish Answer: ich", None)]
KIND = "id long, attempt int, content string, error string"


def test_replies_stay_where_they_are(spark):
    todo = written(spark.createDataFrame([(2,), (2,), (4,), (None,)], "id long"), "todo")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = runs.replies_of(spark.createDataFrame(ATTEMPTS, KIND), todo)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert sorted((r.id, r.attempt) for r in out.collect()) == [(2, 0), (2, 1), (4, 0), (4, 0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("most", [0, 2, 100])
def test_log_is_the_same_with_many_pending_items(spark, monkeypatch, most):
    monkeypatch.setattr(runs, "BROADCAST_IDS", most)
    profile = spark.createDataFrame(GRAMS, "lang string, gram string, logp double")
    source = spark.createDataFrame([(i, f"q{i}", f"a{i}") for i in range(1, 6)], "pid long, question string, answer string")
    attempts = spark.createDataFrame(ATTEMPTS, KIND)
    log = runs.TranslationLog(spark, scratch_dir(spark, "log"))
    assert log.run("first", source, attempts.where("id < 3"), profile, "de", ("de", "en"))
    assert log.run("second", source, attempts, profile, "de", ("de", "en"))
    assert not log.run("second", source, attempts, profile, "de", ("de", "en"))
    assert sorted((r.id, r.da_question, r.da_answer) for r in log.translated().collect()) == [(1, "ich", "ich"), (2, "ich", "ich ich"), (3, "", ""), (4, "ich ich", "ich")]
    assert [r.id for r in log.pending(source).collect()] == [5]


def test_votes_are_dealt_by_number_of_samples(spark, monkeypatch):
    """Parts sized by bytes held so many votes that a task sorted them on disk."""
    from glossa.operators import scaling as G

    monkeypatch.setattr(G, "SAMPLES_PER_TASK", 10)
    rows = [(p, "m", "en", i, 1.0, True, float(i % 3), i % 3 == 1, "en", 0.5) for p in range(100) for i in range(12)] + [(None, "m", None, 0, None, False, 2.0, None, None, None)]
    scored = spark.createDataFrame(rows, "pid long, model string, mode string, sample_idx long, gold double, boxed boolean, pred double, correct boolean, lang_label string, lang_score double")
    out = G.voters(scored, 10)
    # 1,201 samples, and Spark does not merge the parts
    assert out.rdd.getNumPartitions() == max(121, 3 * spark.sparkContext.defaultParallelism)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(G.majority_winner(out)) == key(G.majority_winner(G.prefix_samples(scored, 10)))
