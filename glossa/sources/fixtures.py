"""Input tables derived from the driver's parquet tables.

The reference reads a bilingual CSV, model completions and service replies that
are not shipped.  These builders derive the same shapes from the driver tables
so that every job's work grows with them:

* ``items``                 <- part           (one item per part)
* ``completions``           <- lineitem x documents (one completion per line)
* ``translation_attempts``  <- part, 3 attempts each, texts from documents
* ``review_attempts``       <- part, 3 attempts each
* ``labelled_text``         <- documents (doc_id, text, lang)

All documents are joined, by a key modulo their number, with a plain join.
Completion and attempt texts hold the whole document text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a table over the cores when its scan yields fewer partitions than
    cores (one small file locally); by hash of ``keys`` when given, so a later
    grouping on them reuses this partitioning.  On a cluster the scan already
    has more splits than cores, and this is a no-op."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys) if keys else df.repartition(cores)


#: Rows with a text that one task takes.
ROWS_PER_TASK = 100_000
#: Bytes that a row weighs besides its text.
ROW_BYTES = 100


def _s(c: Column) -> Column:
    return c.cast("string")


def tasks(spark: SparkSession, rows: int) -> int:
    """Partitions for a step that makes or reads a text for each of so many narrow rows.  Spark sizes partitions by their bytes
    before the texts are attached, so that the texts of a large table would meet in a few tasks."""
    return max(3 * spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))


def _heavy_documents(keyed: DataFrame, docs: DataFrame, parts: int) -> list[tuple[int, int]]:
    """(document, shares) of the documents whose rows would make more text than one of ``parts`` partitions has on average: fewer
    than ``parts`` of them, and fewer than twice as many shares, whatever the tables."""
    sizes = docs.groupBy("doc_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(float(ROW_BYTES))).alias("_bytes"))
    loads = keyed.groupBy("_doc").agg(F.count(F.lit(1)).alias("_rows")).join(sizes, F.col("_doc") == F.col("doc_id")) \
        .select("_doc", (F.col("_rows") * F.col("_bytes")).alias("_load"))
    total, most = loads.agg(F.sum("_load"), F.max("_load")).first()
    if not most or most * parts <= total:
        return []
    fair = total / parts
    return [tuple(r) for r in loads.where(F.col("_load") > fair).select("_doc", F.ceil(F.col("_load") / fair).cast("int")).collect()]


def _with_document(df: DataFrame, key: Column, parts: int, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows joined to the document numbered ``key`` modulo the number of documents, in ``parts`` partitions.

    A broadcast of the narrow rows would leave their texts to the few tasks that read the documents.  The rows of a document that
    makes more text than a partition's part are dealt over several, so that it does not make the longest task; only such
    documents are sent more than once, as copies of all of them would be many times the input."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = docs.select(F.count(F.lit(1))).scalar()
    keyed = df.withColumn("_doc", F.pmod(key, n))
    heavy = _heavy_documents(keyed, docs, parts)
    if not heavy:
        return keyed.repartition(parts, "_doc").join(docs.hint("merge"), F.col("_doc") == docs["doc_id"]).drop("_doc")
    shares = F.broadcast(spark.createDataFrame(heavy, "_heavy long, _shares int"))
    of = F.coalesce(F.col("_shares"), F.lit(1))
    keyed = keyed.join(shares, F.col("_doc") == F.col("_heavy"), "left") \
        .select(*df.columns, "_doc", F.pmod(F.xxhash64(*df.columns), of).cast("int").alias("_share"))
    docs = docs.join(shares, docs["doc_id"] == F.col("_heavy"), "left") \
        .select("doc_id", "text", F.explode(F.sequence(F.lit(0), of - 1)).alias("_part"))
    return keyed.repartition(parts, "_doc", "_share") \
        .join(docs.hint("merge"), (F.col("_doc") == docs["doc_id"]) & (F.col("_share") == docs["_part"])).drop("_doc", "_share", "_part")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, question, answer, da_question, da_answer (all answer forms present)."""
    p = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), _s(F.col("p_size"))
    k5 = _s(key % 5)
    nl = F.lit("\n")
    answer = (
        F.when(key % 4 == 0, F.concat(F.lit("Half of "), size, F.lit(" go."), nl, F.lit("#### "), k5))
        .when(key % 4 == 1, F.concat(F.lit("First 9 then "), k5))
        .when(key % 4 == 2, F.concat(F.lit("Sum it."), nl, F.lit("#### "), k5, F.lit(",0")))
        .otherwise(F.concat(F.lit("Sum."), nl, F.lit("#### about "), k5, F.lit(" kr")))
    )
    da_question = (
        F.when(key % 13 == 0, F.lit(None).cast("string"))
        .when(key % 11 == 0, F.lit("  "))
        .otherwise(F.concat(F.lit("Kasse "), _s(key), F.lit(" rummer "), size,
                            F.lit(". Hvor mange er tilbage?")))
    )
    da_answer = (
        F.when(key % 17 == 0, F.lit(None).cast("string"))
        .when(key % 19 == 0, F.lit("ingen tal"))
        .otherwise(F.concat(F.lit("Vi tager halvdelen."), nl, F.lit("#### "), k5))
    )
    return p.select(
        key.alias("pid"),
        F.concat(F.lit("Box "), _s(key), F.lit(" holds "), size,
                 F.lit(" items. How many are left?")).alias("question"),
        answer.alias("answer"),
        da_question.alias("da_question"),
        da_answer.alias("da_answer"),
    )


# Columns that together order the lines of one completion group.  The statements go on with price, discount, tax, dates and flags; lines that
# are equal in these four, and in the group, have the same text, so that their rows are the same in any order.
_LINE_ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"]


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, model, mode, sample_idx, text: groups of 1..24 samples per prompt."""
    from pyspark.sql.window import Window

    li = table(spark, sf_dir, "lineitem")
    parts = tasks(spark, li.count())
    # model and mode are numbers until the texts are made, as two shuffles carry them
    li = li.select(
        F.col("l_partkey").alias("pid"),
        (F.col("l_suppkey") % 2).alias("_model"),
        F.when(F.col("l_returnflag") == "R", F.when(F.col("l_orderkey") % 13 == 0, 2).otherwise(1)).otherwise(0).alias("_mode"),
        *_LINE_ORDER,
    )
    # Numbering happens on narrow line columns, before any text is attached.
    # A (pid, model, mode) group is one prompt's samples, so it is small.
    w = Window.partitionBy("pid", "_model", "_mode").orderBy(*_LINE_ORDER)
    ln, order = F.col("l_linenumber"), F.col("l_orderkey")
    li = li.withColumn("_at", F.row_number().over(w)).select(
        "pid", "_model", "_mode", (F.col("_at") - 1).cast("long").alias("sample_idx"), order.alias("_order"),
        F.when((ln == 1) & (order % 11 == 0), 0).when(ln.between(2, 5), ln).otherwise(1).alias("_form"),
        (F.col("l_quantity").cast("int") % 5).alias("_k"))
    joined = _with_document(li, F.col("_order"), parts, spark, sf_dir)
    k, form = _s(F.col("_k")), F.col("_form")
    d, nl, box = F.col("text"), F.lit("\n"), F.lit("\\boxed{")
    text = (
        F.when(form == 0, F.concat(F.lit("\\boxed{"), k, F.lit(".12345678}")))
        .when(form == 3, F.concat(d, nl, F.lit("Answer "), k))
        .when(form == 2, F.concat(d, nl, box, k, F.lit(",0}"), nl))
        .when(form == 4, F.concat(F.lit("\\boxed{ "), k, F.lit(" kr}")))
        .when(form == 5, F.concat(d, F.lit(" \\boxed{x} \\boxed{"), k, F.lit("}")))
        .otherwise(F.concat(d, nl, box, k, F.lit("}")))
    )
    return joined.select("pid", F.concat(F.lit("m"), _s(F.col("_model"))).alias("model"),
                         F.when(F.col("_mode") == 2, "da_en").when(F.col("_mode") == 1, "da").otherwise("en").alias("mode"),
                         "sample_idx", text.alias("text"))


def translation_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, attempt, content, error: three replies per item in several shapes."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    # two texts a row
    parts = tasks(spark, 6 * p.count())
    p = p.withColumn("attempt", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    j = _with_document(p, F.col("id") * 3 + F.col("attempt"), parts, spark, sf_dir)
    r = F.col("id") + F.col("attempt")
    d, nl = F.col("text"), F.lit("\n")
    qlab, alab = F.lit("Danish Question:"), F.lit("Danish Answer:")
    content = (
        F.when(r % 7 == 0, F.lit(None).cast("string"))
        .when(F.col("id") % 23 == 0, F.concat(qlab, F.lit(" 12 + 4?"), nl, alab, F.lit(" 16")))
        .when(r % 5 == 0, F.concat(d, nl, alab, nl, d))
        .when(r % 5 == 1, F.concat(d, nl, d))
        .when(r % 5 == 2, F.concat(qlab, nl, d, nl, alab, nl))
        .otherwise(F.concat(qlab, nl, d, nl, nl, alab, nl, d))
    )
    error = F.when(r % 7 == 0, F.lit("timeout"))
    return j.select("id", F.col("attempt").cast("int").alias("attempt"),
                    content.alias("content"), error.alias("error"))


def review_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, attempt, content, error: review replies (fenced, prose, cut-off, ...)."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    p = p.repartition(tasks(spark, 3 * p.count()))
    # items without any reply
    p = p.where(F.col("id") % 29 != 0)
    p = p.withColumn("attempt", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    i, r = F.col("id"), F.col("id") + F.col("attempt")
    content = (
        F.when(r % 3 == 0, F.lit(None).cast("string"))
        .when(i % 8 == 1, F.lit("not json"))
        .when(i % 8 == 2, F.lit('```json\n{"en_ok": true, "issues": [], "severity": "none", '
                                '"verdict": "ok"}\n```'))
        .when(i % 8 == 3, F.lit('Here: {"en_ok": false, "issues": [{"target": "EN", "type": '
                                '"sum", "brief": "b"}], "severity": "minor", "verdict": '
                                '"ISSUE"} end'))
        .when(i % 8 == 4, F.lit('{"en_ok": true, "verdict": null}'))
        .when(i % 8 == 5, F.lit('{"da_ok": true}'))
        .when(i % 8 == 6, F.lit('{"en_ok": true, "verdict": "OK"'))
        .when(i % 40 == 7, F.lit('{"en_ok": false, "verdict": "ISSUE", "en_ok": true, "verdict": "OK"}'))
        .when(i % 40 == 15, F.lit('{"en_ok": true, "math_ok_en": NaN, "name_mismatch": -Infinity, "verdict": "NaN or \\"OK\\""}'))
        .when(i % 40 == 23, F.lit('{"en_ok": true} {"verdict": "OK"}'))
        .when(i % 40 == 31, F.lit('{"en_ok": "yes, \\\\ \\"q\\"", "issues": [{"brief": "a \\\\", "n": [NaN, null]}], "issues": null, "comment": 3, "severity": "{}"}'))
        .otherwise(F.lit('{"en_ok": true, "da_ok": true, "verdict": "OK"}'))
    )
    error = F.when(r % 3 == 0, F.concat(F.lit("ERROR: timeout "), _s(F.col("attempt"))))
    return p.select("id", F.col("attempt").cast("int").alias("attempt"),
                    content.alias("content"), error.alias("error"))


def labelled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, lang: labelled prose for fitting the language model."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
