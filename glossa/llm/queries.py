"""The registered queries of the thirteen operators and of the pipeline, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, decontaminate, mix, ngram_join, pii, prefix_trie, secrets, spelling, statements, subspace, substring, suffix, toxicity,
               url_filter)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(toxicity.labelled_rows(docs, _table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(toxicity.fold() == 2, F.lit(False)).alias("held_out"), "score",
                                              F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # two arrivals, the ledger of the first one between them
    return secrets.report(_table(spark, sf_dir, "documents"), arrivals=2)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.report(_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.report(_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspace.report(_table(spark, sf_dir, "embeddings"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.report(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.report(_table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_toxicity, op3_secrets, op4_url_filter, op5_neighbours, op6_mixture,
                            op7_ngram_join, op8_substring_dedup, op9_suffix_dedup, op10_pii, op11_near_vectors, op12_spelling, op13_prefix_trie,
                            pipeline)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {
    # every distinct shingle of an item of five words or more, looked up in the shingles of all documents
    "op1_decontamination": rf"""
with i as (select item_id, {_WORDS} w from benchmark),
s as (select distinct item_id, array_to_string(w[k:k+4], ' ') g from (select item_id, w, unnest(generate_series(1, len(w) - 4)) k from i where len(w) >= 5)),
n as (select item_id, count(*) n from s group by 1),
d as (select doc_id, {_WORDS} w from documents),
h as (select distinct doc_id, array_to_string(w[k:k+4], ' ') g from (select doc_id, w, unnest(generate_series(1, len(w) - 4)) k from d where len(w) >= 5))
select h.doc_id, s.item_id, n.n as n_shingles, count(*) as n_found, count(*) / n.n as containment
from h join s using (g) join n using (item_id) group by 1, 2, 3 having 10 * count(*) >= 8 * n.n""",
    "op11_near_vectors": statements.NEAR_VECTORS,
    "op12_spelling": statements.SPELLING,
    "op13_prefix_trie": statements.PREFIX_TRIE,
    # the water level is reached in as many steps as there are sources; documents in the order of a hash that DuckDB
    # does not have, so only the rows' sums by source could be compared: no statement for op6
}
