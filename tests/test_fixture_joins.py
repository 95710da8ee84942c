"""Rows joined to whole documents: same rows as the statements, and documents sent once unless their rows fill several parts."""

import datetime

import duckdb
from pyspark.sql import functions as F

from checks.fixtures_sql import COMPLETIONS
from glossa.sources import fixtures as X


def write_documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")


def test_documents_are_sent_once(spark, tmp_path):
    """Every document was copied for each dozen of parts: many times the input on disk."""
    write_documents(spark, tmp_path, [(i, f"{i} " + "x" * (500 + i)) for i in range(100)])
    out = X._with_document(spark.range(9600), F.col("id"), 48, spark, str(tmp_path))
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.rdd.getNumPartitions() == 48
    assert out.where(F.col("text").startswith(F.concat((F.col("id") % 100).cast("string"), F.lit(" ")))).count() == out.count() == 9600


def test_only_heavy_documents_are_sent_more_than_once(spark, tmp_path):
    # a repeated id, a null one and a null text keep their rows
    write_documents(spark, tmp_path, [(i, "x" * 1000) for i in range(96)] + [(3, "again"), (None, "none"), (96, None), (97, "y" * 50_000)])
    keyed = spark.range(9600).select(F.when(F.col("id") < 4800, 5).otherwise(F.col("id") % 200).alias("_doc"))
    docs = X.table(spark, str(tmp_path), "documents")
    heavy = dict(X._heavy_documents(keyed, docs, 48))
    assert set(heavy) == {5, 97} and heavy[5] > 10 and sum(heavy.values()) < 2 * 48
    rows = spark.range(9600).withColumn("key", F.when(F.col("id") < 4800, 5).when(F.col("id") % 7 != 0, F.col("id") % 200))
    out = X._with_document(rows, F.col("key"), 48, spark, str(tmp_path))
    want = rows.join(docs, F.pmod("key", F.lit(100)) == docs["doc_id"])
    columns = ["id", "key", "doc_id", F.md5("text").alias("text")]
    assert sorted(map(str, out.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
    assert out.where("key = 5").select(F.spark_partition_id().alias("p")).distinct().count() > 5


def test_no_rows_and_no_documents(spark, tmp_path):
    write_documents(spark, tmp_path, [(0, "a")])
    assert X._with_document(spark.range(0), F.col("id"), 48, spark, str(tmp_path)).count() == 0
    write_documents(spark, tmp_path / "other", [(7, "a")])
    assert X._with_document(spark.range(9), F.col("id"), 48, spark, f"{tmp_path}/other").count() == 0


LINE = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp")


def test_completions_of_odd_lines(spark, tmp_path):
    """Ties, repeated lines and nulls give the rows of the statement, whose order has further columns."""
    day = datetime.datetime(2020, 1, 1)
    lines = [(o, p, s, n, q, price, 0.1, 0.0, flag, "O", day)
             for o in (0, 11, 13, 26) for p in (1, 2) for s in (3, 4) for n in (1, 2, 3, 4, 5, 6, None) for q in (7.0, 8.5, None)
             for price, flag in ((5.0, "A"), (4.0, "N"), (None, None), (4.0, "N"), (1.0, "R"))]
    spark.createDataFrame(lines, LINE).repartition(5).write.parquet(f"{tmp_path}/lineitem.parquet")
    write_documents(spark, tmp_path, [(i, f"text {i}") for i in range(9)])
    out = X.completions(spark, str(tmp_path))
    con = duckdb.connect(config={"default_null_order": "nulls_first"})  # as Spark
    for t in ("lineitem", "documents"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.execute(COMPLETIONS).fetchall()
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want)) and len(want) == 4 * 420
    # what no text or number is made of is not shuffled
    assert "l_extendedprice" not in out._jdf.queryExecution().executedPlan().toString()


def test_rewards_join_numbers_not_texts(spark):
    """Whole completions were shuffled to their solutions."""
    from glossa.operators import scoring as S

    rows = [(1, "m", "en", 0, "a \\boxed{4}"), (1, "m", "en", 0, "a \\boxed{4}"), (1, "m", "da", 1, "\\boxed{5}"), (2, "m", "en", 0, None), (2, "m", "da_en", 0, "\\boxed{1}"),
            (9, "m", "en", 0, "\\boxed{1}"), (None, "m", "en", 0, "\\boxed{1}"), (2, "m", None, 0, "\\boxed{1}"), (2, "m", "da", 3, "ich ich ich ich ich \\boxed{1,0}")]
    comp = spark.createDataFrame(rows, "pid long, model string, mode string, sample_idx long, text string")
    sol = S.rl_solutions(spark.createDataFrame([(1, "#### 4", "#### 6"), (2, "#### 1", "#### 1"), (2, None, "x")], "pid long, answer string, da_answer string"))
    profile = spark.createDataFrame([("de", "ich", -1.0), ("en", "ich", -2.0)], "lang string, gram string, logp double")
    columns = [*S.KEY, "accuracy_reward", "language_reward", "total_reward"]
    joined = S.total_reward(comp.join(sol, ["pid", "mode"]), S.default_rewards(profile, "de", "en"))
    out = S.total_reward(comp, S.default_rewards(profile, "de", "en", solutions=sol))
    assert "text" not in out.columns
    assert sorted(map(str, out.select(*columns).collect())) == sorted(map(str, joined.select(*columns).collect())) and out.count() == 7
    one = S.accuracy_reward(comp, solutions=sol)
    assert sorted(map(str, one.select(*S.KEY, "accuracy_reward").collect())) == sorted(map(str, joined.select(*S.KEY, "accuracy_reward").collect()))
