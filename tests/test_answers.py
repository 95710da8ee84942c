"""Hand cases for answer parsing and cleaning (expectations written by hand)."""

from pyspark.sql import functions as F

from glossa.functions import answers as A

BS = "\\"


def one(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


def test_gold_number(spark):
    got = one(spark, A.gold_number, [
        "a 3 b\n#### 42", "1,234", "x\n####\n12 then 5", "#### abc 7 and 9", "no numbers",
        None, "#### -3.5", "7 then #### 8 then 9", "5 #### abc\nthen 9"])
    assert got == [42.0, 1.234, 12.0, 7.0, None, None, -3.5, 8.0, 9.0]


def test_gold_text(spark):
    got = one(spark, A.gold_text, ["#### 1,5", "  ingen tal  ", None, "a 2 b 3"])
    assert got == ["1.5", "ingen tal", "", "3"]


def test_boxed_number_first_box_only(spark):
    got = one(spark, A.boxed_number, [
        f"{BS}boxed{{x}} {BS}boxed{{4}}", f"{BS}boxed{{{BS}frac{{1}}{{2}}}}", f"{BS}boxed{{ 12 kr}}",
        f"{BS}boxed {{3,5}}", "no box", f"{BS}boxed{{}} {BS}boxed{{4}}", None])
    assert got == [None, 1.0, 12.0, 3.5, None, 4.0, None]


def test_boxed_flag(spark):
    assert one(spark, A.boxed_flag, [f"{BS}boxed {{", "boxed{1}", None]) == [True, False, False]


def test_boxed_answer(spark):
    got = one(spark, A.boxed_answer, ["Step one.\n#### 5", "#### 5", None, "Just 3 and 4"])
    assert got == [f"Step one.\n{BS}boxed{{5}}", f"{BS}boxed{{5}}", f"{BS}boxed{{}}",
                   f"Just 3 and 4\n{BS}boxed{{4}}"]


def test_boxed_answer_en(spark):
    df = spark.createDataFrame([(0, "Reason\n#### 7 "), (1, "no marker"), (2, "a #### b #### c")],
                               "i int, t string")
    resp, rej = A.boxed_answer_en(F.col("t"))
    got = [tuple(r) for r in df.orderBy("i").select(resp, rej).collect()]
    assert got == [(f"Reason\n{BS}boxed{{7}}", False), (f"no marker\n{BS}boxed{{}}", False), (None, True)]


def test_clean_eval(spark):
    got = one(spark, A.clean_eval, [f"Hej {BS}boxed{{4}} med 12 æbler! {BS}frac ÅÆ", None])
    assert got == ["hej med æbler åæ", ""]


def test_clean_reward(spark):
    got = one(spark, A.clean_reward, ["Tekst $x$ og ```kode``` og \\(a\\) \\textbf{fed} slut 5"])
    assert got == ["Tekst   og   og     slut 5"]


def test_drop_final_boxed(spark):
    got = one(spark, A.drop_final_boxed, [
        f"a\nb\n{BS}boxed{{4}}", f"a\n  {BS}boxed{{4}}  \n", f"a\n{BS}boxed{{4}}\n\n", f"{BS}boxed{{4}}",
        f"a {BS}boxed{{4}}", f"a\r\n{BS}boxed{{4}}"])
    assert got == ["a\nb", "a", f"a\n{BS}boxed{{4}}\n\n", "", f"a {BS}boxed{{4}}", "a"]


def test_vote_key(spark):
    assert one(spark, lambda c: A.vote_key(c.cast("double")), ["1.0000004", "2.5"]) == [1.0, 2.5]
