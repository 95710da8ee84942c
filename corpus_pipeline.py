"""A corpus pipeline: clean, de-duplicate, decontaminate, redact and mix documents.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import decontaminate, mix, ngram_join, pii, toxicity
from glossa.llm.common import drop_steps, steps_so_far, unused
from glossa.session import scratch_dir

#: Documents at this score or above are rejected.
TOXIC = 0.3
_KEPT: dict[str, list[str]] = {}


def _start(spark: SparkSession, first: bool = False) -> None:
    """Give back what the steps of the stage before wrote.

    A stage's result reads those steps until it is written, so that it must be written before the next stage is
    called, as ``run`` does; a caller that has not done so would lose it.
    """
    key = spark.sparkContext.applicationId
    done = _KEPT.pop(key, [])
    if not first:
        drop_steps(spark, done)
    _KEPT[key] = []


def _end(spark: SparkSession, before: list[str], out: DataFrame) -> DataFrame:
    _KEPT[spark.sparkContext.applicationId] = [p for p in steps_so_far() if p not in before]
    return out


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: learned from the labelled documents outside the held-out fold; rejected documents go."""
    _start(spark, first=True)
    before = steps_so_far()
    model = toxicity.fit(toxicity.labelled_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    column = unused(docs, "_toxicity")
    scored = toxicity.score(docs, model, column)
    return _end(spark, before, scored.filter(F.col(column) < TOXIC).select(*docs.columns))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each group stays."""
    _start(spark)
    before = steps_so_far()
    return _end(spark, before, ngram_join.keep_one(docs))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    _start(spark)
    before = steps_so_far()
    return _end(spark, before, decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; n_chars follows."""
    _start(spark)
    before = steps_so_far()
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return _end(spark, before, out.select(*docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    _start(spark)
    before = steps_so_far()
    return _end(spark, before, mix.mix(docs))


STAGES = [("toxicity", clean), ("near_duplicates", deduplicate), ("decontamination", decontaminated), ("pii", redacted), ("mixture", mixed)]

#: The model of the first stage and hash order of the last are not SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = scratch_dir(spark, f"pipeline-{name}-{uuid.uuid4().hex[:6]}")
        out.write.parquet(path)
        if last:
            drop_steps(spark, [last])
        docs, last = spark.read.schema(out.schema).parquet(path), path
    return docs
