"""Training-set, translation and review runs, rendered message arrays, running metrics."""

import pytest
from pyspark.sql import functions as F

from glossa.operators import language as L
from glossa.operators import prompts as D
from glossa.plans import runs
from glossa.session import scratch_dir
from glossa.sources import fixtures as X
from glossa.streaming import incremental as ST

from .conftest import SF_SMALL

ITEMS = "pid long, question string, answer string, da_question string, da_answer string"


def test_rendered_messages(spark):
    df = spark.createDataFrame([(1, [("user", "hi"), ("assistant", None)]), (2, []), (3, None)],
                               "id long, messages array<struct<role:string,content:string>>")
    out = {r.id: (r.a, r.b) for r in df.select(
        "id", D.render_messages("messages").alias("a"),
        D.render_messages("messages", add_generation_prompt=True).alias("b")).collect()}
    chat = "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert out == {1: (chat, chat + "<|im_start|>assistant\n"), 2: ("", "<|im_start|>assistant\n"), 3: (None, None)}


def test_training_sets(spark):
    items = spark.createDataFrame([(2, "q2", "a\n#### 2", "d2", "b\n#### 2"), (1, "q1", "a\n#### 1", None, None),
                                   (3, "q3", "c\n#### 3", "d3", "e\n#### 3")], ITEMS)
    paired = runs.paired_training_set(items, train_rows=2).collect()
    assert sorted((r.pid, r.lang) for r in paired) == [(1, "da"), (1, "en"), (2, "da"), (2, "en")]
    one = next(r for r in paired if (r.pid, r.lang) == (2, "en"))
    assert one.text.startswith(f"<|im_start|>system\n{D.SYSTEM_EN}<|im_end|>\n<|im_start|>user\n") and "q2" in one.text
    assert one.text.endswith(f"<|im_start|>assistant\n{one.a}<|im_end|>\n")
    assert runs.target_training_set(items, train_rows=2).count() == 2
    unpaired = runs.unpaired_training_set(items, train_rows=2).collect()
    assert sorted((r.pid, r.lang) for r in unpaired) == [(1, "en"), (2, "da"), (2, "en")]
    rl = runs.rl_training_set(items, "da", subset=None).collect()
    assert sorted((r.pid, r.solution) for r in rl if r.pid > 1) == [(2, "\\boxed{2}"), (3, "\\boxed{3}")]
    assert runs.rl_training_set(items, subset=1).first().pid == 1
    assert "<|im_start|>system" not in runs.english_training_set(items).first().text
    assert {r.pid for r in runs.evaluation_subset(items, 5, train_rows=1).collect()} == {2, 3}


def test_translation_run_resumes(spark):
    items, tries = X.items(spark, SF_SMALL), X.translation_attempts(spark, SF_SMALL)
    prof = L.fit_profile(X.labelled_text(spark, SF_SMALL), "text", "lang", ("de", "en"))
    whole = runs.translation_run(items, tries, None, prof, "de", ("de", "en"))
    done = L.written(whole.where("id % 3 = 0"), "test-done")
    again = runs.translation_run(items, tries, done, prof, "de", ("de", "en"))
    assert again.count() == items.count()
    assert again.exceptAll(whole).count() == 0


def test_review_run(spark):
    items = X.items(spark, SF_SMALL)
    out = scratch_dir(spark, "test-review")
    report = runs.review_run(items, X.review_attempts(spark, SF_SMALL), out)
    # items without a reply are issues
    assert report.where("pid % 29 = 0").count() == items.where("pid % 29 = 0").count() > 0
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(out).count() == report.count()


def test_evaluation_run(spark):
    items, comp = X.items(spark, SF_SMALL), X.completions(spark, SF_SMALL)
    prof = L.fit_profile(X.labelled_text(spark, SF_SMALL), "text", "lang", ("de", "en"))
    wide = runs.evaluation_run(items, comp, prof, "de", "en", scratch_dir(spark, "test-eval"), train_rows=150)
    assert wide.count() == 2


def test_running_metrics_over_restarts(spark):
    comp, items = X.completions(spark, SF_SMALL), X.items(spark, SF_SMALL)
    prof = L.fit_profile(X.labelled_text(spark, SF_SMALL), "text", "lang", ("de", "en"))
    base = scratch_dir(spark, "test-running")
    seen = []
    for name in ("m0", "m1"):
        comp.where(F.col("model") == name).write.parquet(f"{base}/in/{name}")
        ST.stream_score(spark, f"{base}/in/*", f"{base}/scored", f"{base}/c1", items, prof, "de", "en", counters_dir=f"{base}/language")
        ST.stream_metrics(spark, f"{base}/in/*", f"{base}/metrics", f"{base}/c2", items)
        seen.append(ST.read_metrics(spark, f"{base}/metrics").agg(F.sum("rows")).first()[0])
    assert seen == [comp.where("model = 'm0'").count(), comp.count()]
    lang = ST.running_language(spark, f"{base}/language")
    whole = ST.language_counters(ST.read_scored(spark, f"{base}/scored"))
    cols = ["model", "mode", "target", "other", "mixed", "unclear"]
    assert lang.select(*cols).exceptAll(whole.select(*cols)).count() == 0
    r = ST.rates(ST.read_metrics(spark, f"{base}/metrics"), lang)
    assert r.where("accuracy between 0 and 1 and boxed_rate between 0 and 1").count() == r.count() == whole.count()


def test_letters_reach_the_scores(spark):
    docs = spark.createDataFrame([("schöne grüße über flüsse", "de"), ("the quick brown fox", "en")], "text string, lang string")
    letters = "A-Za-zÄÖÜäöüß"
    prof = L.fit_profile(docs, letters=letters)
    assert prof.where(F.col("gram").contains("ü")).count() > 0
    df = spark.createDataFrame([(1, "üße üße")], "id long, text string")
    with_them = L.language_confidence(df, "id", "text", prof, letters=letters).first()
    without = L.language_confidence(df, "id", "text", prof).first()
    assert with_them.conf_de > without.conf_de
    assert L.detect_language(df, "id", "text", prof, ("de", "en"), "de", letters=letters).first().is_target


def test_translation_log_loses_and_repeats_nothing(spark, monkeypatch):
    items, tries = X.items(spark, SF_SMALL), X.translation_attempts(spark, SF_SMALL)
    prof = L.fit_profile(X.labelled_text(spark, SF_SMALL), "text", "lang", ("de", "en"))
    how = (prof, "de", ("de", "en"))
    whole = {tuple(r) for r in runs.translation_run(items, tries, None, *how).collect()}
    root = scratch_dir(spark, "test-translation-log")
    log = runs.TranslationLog(spark, root)
    assert log.translated().count() == 0 and log.pending(items).count() == items.count()
    assert log.run("a", items, tries.where("id % 2 = 0"), *how)
    first = log.translated().count()
    assert 0 < first < items.count() and log.pending(items).count() == items.count() - first
    # the rows are written, but the run is lost before it is published
    with monkeypatch.context() as m:
        m.setattr(runs.Ledger, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            log.run("b", items, tries, *how)
    log = runs.TranslationLog(spark, root)
    assert log.translated().count() == first
    assert not log.run("a", items, tries, *how)  # a name that was published before
    assert log.run("b", items, tries, *how) and log.run("c", items, tries, *how)
    got = [tuple(r) for r in log.translated().collect()]
    assert len(got) == len(whole) and set(got) == whole
    assert log.pending(items).count() == 0
