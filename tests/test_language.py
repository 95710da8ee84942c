"""Language model: bounded profile, normalised confidences, held-out accuracy."""

from pyspark.sql import functions as F

from glossa.functions.answers import clean_eval
from glossa.operators import language as L
from glossa.sources import fixtures as X

from .conftest import SF_SMALL


def test_profile_is_bounded_by_the_alphabet(spark):
    prof = L.fit_profile(X.labelled_text(spark, SF_SMALL), "text", "lang", ("de", "en"))
    n = prof.count()
    assert prof.where(~F.col("gram").rlike("^[a-zæøå ]{3}$")).count() == 0
    assert n <= 30 ** 3 * 2
    assert prof.groupBy("gram").count().where("count <> 2").count() == 0


def test_confidences_sum_to_one_and_held_out_accuracy(spark):
    docs = X.labelled_text(spark, "/root/testdata/sf0.01").where(F.col("lang").isin("de", "en"))
    train, held = docs.where(F.col("doc_id") % 5 != 0), docs.where(F.col("doc_id") % 5 == 0)
    prof = L.fit_profile(train, "text", "lang", ("de", "en"))
    conf = L.language_confidence(held.select("doc_id", clean_eval("text").alias("t")),
                                 "doc_id", "t", prof, ("de", "en"))
    rows = conf.join(held.select("doc_id", "lang"), "doc_id").collect()
    assert all(abs(r.conf_de + r.conf_en - 1.0) < 1e-9 for r in rows)
    right = sum((r.conf_de > r.conf_en) == (r.lang == "de") for r in rows)
    assert len(rows) > 100 and right / len(rows) >= 0.95


def test_dense_tables_equal_joined_grams(spark, monkeypatch):
    """Scores by index arithmetic and by exploded grams, and a text of no gram, of one, and of signs."""
    docs = X.labelled_text(spark, SF_SMALL)
    langs = ("de", "en", "fr")
    prof = L.fit_profile(docs, "text", "lang", langs)
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, "ab"), (-4, "abc"), (-5, "12 !"), (-6, "é𝄞 ŁØÅ zzz"), (-7, "the " * 3000)], "doc_id long, text string")
    texts = docs.select("doc_id", "text").unionByName(more)

    def scores():
        conf = L.language_confidence(texts, "doc_id", "text", prof, langs)
        pair = L.language_confidence(texts, "doc_id", "text", prof, ("de", "en")).withColumnsRenamed({"conf_de": "a", "conf_en": "b"})
        found = L.detect_language(texts, "doc_id", "text", prof, langs, "de")
        sig = L.language_signal(texts, "text", prof, "de", "en").drop("text", "conf_target", "conf_other")
        rew = L.language_reward(texts, "text", prof, "de", "en").drop("text")
        rows = conf.join(pair, "doc_id").join(found, "doc_id").join(sig, "doc_id").join(rew, "doc_id")
        return {r.doc_id: [round(x, 7) if isinstance(x, float) else x for x in r] for r in rows.collect()}

    dense = scores()
    assert dense[-1][1:4] == [round(1 / 3, 7)] * 3 and dense[-2][4:6] == [0.5, 0.5] and len(dense) == texts.count()
    monkeypatch.setattr(L, "DENSE_SIZE", 10)
    assert L.dense_model(prof, langs) is None
    assert scores() == dense


def test_alphabet_of_a_class():
    assert "".join(L.alphabet("A-Za-zÆØÅæøå")) == " abcdefghijklmnopqrstuvwxyzåæø"
    assert L.alphabet("abc") == [" ", "a", "b", "c"] and L.alphabet("\\p{L}") is None and L.alphabet("a-") is None


def test_scoring_explodes_and_shuffles_no_text(spark):
    prof = L.fit_profile(X.labelled_text(spark, SF_SMALL), "text", "lang", ("de", "en"))
    df = spark.createDataFrame([(1, "ein Text")], "id long, text string")
    for out in (L.language_signal(df, "text", prof, "de", "en"), L.language_reward(df, "text", prof, "de", "en"), L.language_confidence(df, "id", "text", prof)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Exchange" not in plan


def test_profile_follows_its_corpus(spark, monkeypatch):
    from glossa.operators.profiles import ProfileStore
    from glossa.session import scratch_dir

    docs = X.labelled_text(spark, SF_SMALL).where(F.col("lang").isin("de", "en", "fr"))
    corpus, root = scratch_dir(spark, "test-corpus"), scratch_dir(spark, "test-profiles")
    read = []

    def reader(files):
        read.append(sorted(files))
        return spark.read.parquet(*files).select("text", "lang")

    def same(langs=("de", "en")):
        got = ProfileStore(spark, root, reader).refresh(corpus, langs)
        want = L.fit_profile(spark.read.parquet(corpus), "text", "lang", langs)
        key = lambda df: sorted((r.gram, r.lang, round(r.logp, 9)) for r in df.collect())
        assert key(got) == key(want)

    part = lambda i: docs.where(F.col("doc_id") % 3 == i).coalesce(1).write.mode("append").parquet(corpus)
    part(0)
    same()
    same()
    same(("de", "fr"))  # other languages: no further pass
    assert len(read) == 1
    part(1)
    same()
    assert len(read) == 2 and len(read[1]) == 1 and not set(read[0]) & set(read[1])
    # a file goes: its table is no longer usable, and the other file of it is none
    gone = read[1][0]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(gone)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(path, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root + "-kept.parquet"))
    same()
    assert len(read) == 2
    part(2)
    same()
    assert len(read) == 3 and len(read[2]) == 1
