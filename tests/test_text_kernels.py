"""Cleaning, gram sums, word counts and line rules over Arrow batches equal their patterns and plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossa.functions import answers as A
from glossa.functions import kernels as K
from glossa.functions import text as T
from glossa.operators import language as L
from glossa.operators import review as H
from glossa.sources import fixtures as X

from .conftest import SF_SMALL

TEXTS = [None, "", " ", "a", "  Ab  c1d ", "ÆBLE på Ø", "éa𝄞b", "x" * 30, "Hej\r\nmed dig\n\\boxed{3}", "\\boxed{3}", "a\\boxed{x\ny}b \\alpha{} z",
         "a\n\n\\boxed{1} \n", "a\r\\boxed{1}\r\\boxed{2}", "a\n\\boxed{1}\n\n", "\n\\boxed{1}", "a\r\n  \\boxed{1}}\n", "l1\nl2\nl3\n\\boxed{4}", "æ",
         " æ ", "K Å İ", "tab\tand\x0bvt", "$a$ b ``` c ``` \\(x\\) \\[y\\] \\frac{1}{2}", "one \\ two", "a\r", "\r\n", "a\rb\r\nc\n\nd", "øåØÅ" * 9]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").repartition(3)


def values(df):
    return [r[1] for r in sorted(df.collect(), key=lambda r: r[0])]


def test_clean_letters_equals_patterns(texts):
    by_pattern = F.lower(F.trim(A.letters_only(F.col("t"))))
    assert values(texts.select("i", A.clean_letters(F.col("t")))) == values(texts.select("i", by_pattern))


def test_line_rules_equal_python(texts):
    final = re.compile(r"(?:^|\r\n|\n|\r)[^\S\n]*\\boxed\{[^\n]*\}[^\S\n]*\n?\Z", re.ASCII)
    assert values(texts.select("i", A.drop_final_boxed("t"))) == [final.sub("", t or "", count=1) for t in TEXTS]
    assert values(texts.select("i", T.word_count("t"))) == [len((t or "").split()) for t in TEXTS]
    assert values(texts.select("i", T.strip("t"))) == [None if t is None else t.strip() for t in TEXTS]
    lines = [None if t is None else re.split(r"\r\n|\r|\n", re.sub(r"(?:\r\n|\r|\n)\Z", "", t, count=1)) if t else [] for t in TEXTS]
    assert values(texts.select("i", T.split_lines("t"))) == lines


def test_gram_sums_equal_plain_counts(spark, texts):
    letters = K.Letters.of(A.DEFAULT_LETTERS)
    base, at = len(letters.symbols) + 1, {c: i for i, c in enumerate(letters.symbols, 1)}
    table = [float((7 * i) % 11) for i in range(base ** 3)]
    out = texts.select("i", K.gram_sums(F.col("t"), letters, 3, {"s": table}, True).alias("x"))
    clean = values(texts.select("i", A.clean_letters(F.col("t"))))

    def total(c):
        return sum(table[(at[a] * base + at[b]) * base + at[d]] for a, b, d in zip(c, c[1:], c[2:]))

    assert [x and (x.length, x.s) for x in values(out)] == [None if c is None else (len(c), total(c)) for c in clean]


def test_lower_case_from_outside_the_class(spark, texts):
    letters = K.Letters.of(A.DEFAULT_LETTERS)
    low = values(texts.select("i", K.lowered(F.col("t"), letters)))
    assert low[TEXTS.index("K Å İ")] == "k å i̇" and low[3] == "a"


def test_texts_are_spread_by_rows_not_by_bytes(spark):
    """Narrow rows were packed by their bytes into a few tasks before their texts were attached."""
    least = 3 * spark.sparkContext.defaultParallelism
    for made in (X.completions(spark, SF_SMALL), X.translation_attempts(spark, SF_SMALL), X.review_attempts(spark, SF_SMALL)):
        assert made.rdd.getNumPartitions() >= least
    assert X.tasks(spark, 10 ** 9) == 10 ** 9 // X.ROWS_PER_TASK


def test_attempts_are_accepted_in_their_row(spark):
    """Parts were shuffled and joined back, with the replies cut three times."""
    prof = L.fit_profile(X.labelled_text(spark, SF_SMALL), "text", "lang", ("de", "en"))
    replies = H.parse_sections(X.translation_attempts(spark, SF_SMALL))
    before = H.accept_translations(replies, prof, "de", ("de", "en"))._jdf.queryExecution().optimizedPlan().toString()
    assert before.count("Join") == replies._jdf.queryExecution().optimizedPlan().toString().count("Join")


FINAL = re.compile(r"(?:^|\r\n|\n|\r)[^\S\n]*\\boxed\{[^\n]*\}[^\S\n]*\n?\Z", re.ASCII)
BITS = ["\\boxed{", "\\boxed", "}", "{", "\n", "\r", "\r\n", " ", "\t", "a", "b1", "\\", "\\boxed{1}", "æØ", "é", "\\alpha", "\n\\boxed{2}", "\x0b", "}\n"]


def odd_texts(n):
    pick = random.Random(7)
    return ["".join(pick.choice(BITS) for _ in range(pick.randint(0, 9))) for _ in range(n)]


@pytest.mark.parametrize("final_line", [False, True])
def test_blanked_texts_equal_patterns(final_line):
    texts = odd_texts(20_000)
    kernel = K.Letters.of(A.DEFAULT_LETTERS).kernel()
    got = []
    for _, _, data, offsets in K.pieces(pa.array(texts)):
        low, at = kernel.symbols(K.blanked(data, offsets, final_line), offsets, True, text=True)
        got += [low.tobytes()[a:b].decode() for a, b in zip(at[:-1], at[1:])]
    bare = [re.sub(r"\\[a-zA-Z]+", " ", re.sub(r"(?s)\\boxed\s*\{.*?\}", " ", FINAL.sub("", t, count=1) if final_line else t)) for t in texts]
    assert got == [re.sub(f"[^{A.DEFAULT_LETTERS}]+", " ", t).strip().lower() for t in bare]


def test_long_texts_are_measured_like_short_ones():
    kernel = K.Letters.of(A.DEFAULT_LETTERS).kernel()
    texts = ["Ét ord, og  ét til. " * 40 + str(i) for i in range(9)] + ["", " "]
    data, offsets = next((d, o) for _, _, d, o in K.pieces(pa.array(texts)))
    long = kernel.symbols(data, offsets, True)[1]
    short = [len(kernel.symbols(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), True)[0]) for t in texts]
    assert np.diff(long).tolist() == short


def test_last_line_rule_on_odd_texts(spark):
    texts = odd_texts(5_000)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = df.select("i", A.drop_final_boxed("t").alias("o"))
    assert values(out) == [FINAL.sub("", t, count=1) for t in texts]
    # no pattern runs over the lines of a text
    assert "(?:^" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_language_of_a_text_needs_no_patterns(spark):
    profile = spark.createDataFrame([("de", "ich", -1.0), ("en", "the", -1.0)], "lang string, gram string, logp double")
    df = spark.createDataFrame([(1, "the \\alpha ich\n\\boxed{3}")], "i int, text string")
    plan = L.language_signal(df, "text", profile, "de", "en")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_first_accepted_cuts_a_reply_once(spark):
    profile = spark.createDataFrame([(lang, gram, p) for gram in ("ich", "the") for lang, p in (("de", -1.0 - (gram == "the")), ("en", -1.0 - (gram == "ich")))],
                                    "lang string, gram string, logp double")
    items = spark.createDataFrame([(1, "q", "a"), (2, "q", "a"), (3, "q", "a")], "pid long, question string, answer string")
    attempts = spark.createDataFrame([(1, 0, "the\nDanish Answer: the", None), (1, 1, "ich\nDanish Answer: ich ich", None), (1, 2, "ich ich\nDanish Answer: ich", None),
                                      (2, 0, "the\nDanish Answer: ich", None), (2, 1, None, "timeout")], "id long, attempt int, content string, error string")
    out = H.first_accepted(items, attempts, profile, "de", ("de", "en"))
    assert sorted(map(tuple, out.collect())) == [(1, "q", "a", "ich", "ich ich"), (2, "q", "a", "", ""), (3, "q", "a", "", "")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and H.A_LABEL in line]


def test_rows_of_one_document_are_dealt_over_tasks(spark, tmp_path):
    spark.createDataFrame([(0, "long"), (1, "short")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.range(3000).withColumn("twice", F.lit(1)).unionByName(spark.range(10).withColumn("twice", F.lit(1)))
    out = X._with_document(rows, F.lit(0), 48, spark, str(tmp_path))
    assert out.groupBy("id").count().where("id < 10").agg(F.min("count"), F.max("count")).first()[:] == (2, 2)
    assert out.count() == 3010
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1
