"""Hand cases for translation replies and review replies."""

import pytest
from pyspark.sql import functions as F

from glossa.operators import language as L
from glossa.operators import review as H
from glossa.sources import fixtures as X

from .conftest import SF_SMALL

LANGS = ("de", "en", "es", "fr")


def test_parse_sections(spark):
    cases = [
        (0, "Danish Question:\nQ text\n\nDanish Answer:\nA text"),
        (1, "Q part\nDanish Answer:\nA part"),
        (2, "l1\nl2\nl3\nl4\nl5"),
        (3, "Danish Answer: a first\nDanish Question: q late"),
        (4, "x Danish Answer: one Danish Answer: two"),
        (5, None),
    ]
    df = spark.createDataFrame(cases, "id long, content string")
    got = {r.id: (r.da_q, r.da_a) for r in H.parse_sections(df).collect()}
    assert got[0] == ("Q text", "A text")
    assert got[1] == ("Q part", "A part")
    assert got[2] == ("l1\nl2", "l3\nl4\nl5")
    assert got[3] == ("", "")          # answer label only before the question label
    assert got[4] == ("x", "one")      # a second answer label cuts the answer
    assert got[5] == ("", "")


@pytest.fixture(scope="module")
def texts(spark):
    d = X.labelled_text(spark, SF_SMALL)
    de = d.where("lang = 'de'").orderBy("doc_id").first().text
    en = d.where("lang = 'en'").orderBy("doc_id").first().text
    prof = L.fit_profile(d, "text", "lang", LANGS).cache()
    return de, en, prof


def test_first_accepted(spark, texts):
    de, en, prof = texts
    lab = "Danish Question:\n{}\n\nDanish Answer:\n{}"
    attempts = spark.createDataFrame([
        (1, 0, lab.format(en, en), None), (1, 1, lab.format(de, de), None),   # wrong language, then fine
        (2, 0, None, "timeout"), (2, 1, lab.format(en, de), None), (2, 2, "", None),  # none accepted
    ], "id long, attempt int, content string, error string")
    items = spark.createDataFrame([(1, "q1", "a1"), (2, "q2", "a2"), (3, "q3", "a3")],
                                  "pid long, question string, answer string")
    got = {r.id: r for r in H.first_accepted(items, attempts, prof, "de", LANGS).collect()}
    assert got[1].da_question == de.strip() and got[1].da_answer == de.strip()
    assert (got[2].da_question, got[2].da_answer) == ("", "")
    assert (got[3].da_question, got[3].da_answer) == ("", "")
    assert len(got) == 3


def test_detect_blank_is_never_target(spark, texts):
    _, _, prof = texts
    df = spark.createDataFrame([(0, "   "), (1, "")], "k long, t string")
    got = {r.k: r.is_target for r in L.detect_language(df, "k", "t", prof, LANGS, "de").collect()}
    assert got == {0: False, 1: False}


def test_text_without_a_language_is_not_accepted(spark, texts):
    de, _, prof = texts
    cases = [(0, "42"), (1, "#### 42"), (2, "3 + 4 = 7"), (3, "qq"), (4, de)]
    df = spark.createDataFrame(cases, "k long, t string")
    got = {r.k: (r.detected, r.is_target) for r in L.detect_language(df, "k", "t", prof, LANGS, "de").collect()}
    assert got == {0: (None, False), 1: (None, False), 2: (None, False), 3: (None, False), 4: ("de", True)}


def test_reviews(spark):
    fenced = '```json\n{"en_ok": false, "issues": [{"target": "EN", "type": "t", "brief": "b"}], "verdict": "ISSUE"}\n```'
    attempts = spark.createDataFrame([
        (1, 0, fenced, None),
        (2, 0, 'Sure: {"verdict": "ok"} done', None),
        (3, 0, '{"verdict": null}', None),
        (4, 0, '{"da_ok": true}', None),
        (5, 0, "not json", None), (5, 1, None, "ERROR: boom"), (5, 2, "x" * 200, None),
        (6, 0, "nope", None), (6, 1, '{"verdict": "OK"}', None), (6, 3, '{"verdict": "ISSUE"}', None),
    ], "id long, attempt int, content string, error string")
    asked = spark.createDataFrame([(i,) for i in range(1, 8)], "pid long")
    r = {x.id: x for x in H.first_parseable(attempts, asked).collect()}
    assert r[7].verdict == "ISSUE" and r[7].comment == "Model error: "   # no reply at all
    assert r[1].en_ok == "false" and r[1].verdict == "ISSUE"
    assert r[1].issues == '[{"target":"EN","type":"t","brief":"b"}]'
    assert r[2].verdict == "ok" and r[2].issues == "[]" and r[2].name_mismatch == "false"
    assert r[3].verdict is None and r[3].severity == ""
    assert r[4].verdict == "ISSUE" and r[4].da_ok == "true" and r[4].en_ok is None
    assert r[5].verdict == "ISSUE" and r[5].comment == "Model error: " + "x" * 150
    assert r[5].issues == "[]" and r[5].en_ok is None
    assert r[6].verdict == "OK"   # attempt 3 is beyond the three tries
    issues = {x.id: x.is_issue for x in
              H.first_parseable(attempts, asked).select("id", H.is_issue(F.col("verdict")).alias("is_issue")).collect()}
    assert issues == {1: True, 2: False, 3: True, 4: True, 5: True, 6: False, 7: True}


def test_parse_sections_cuts_without_lists_of_parts(spark):
    cases = [
        (0, " one "), (1, "a\r\nb\rc"), (2, "Danish Question: q Danish Answer: a Danish Question: q2 Danish Answer: a2"),
        (3, "Danish Question: q Danish Question: r Danish Answer: a"), (4, "æ\nø\n\nå"), (5, " \n "), (6, "Danish Answer: é Danish Answer: x Danish Answer: y"),
    ]
    df = H.parse_sections(spark.createDataFrame(cases, "id long, content string"))
    got = {r.id: (r.da_q, r.da_a) for r in df.collect()}
    assert got == {0: ("", "one"), 1: ("a", "b\nc"), 2: ("q", "a"), 3: ("", ""), 4: ("æ\nø", "å"), 5: ("", ""), 6: ("", "é")}
    # whole replies are searched by their bytes: no patterns, no lists of their parts
    assert "split" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
