"""Prompt rendering: chat text independent of chunking, unknown modes rejected,
null questions rendered as ''."""

import pytest
from pyspark.sql import functions as F

from glossa.operators import prompts as D
from glossa.sources import fixtures as X

from .conftest import SF_SMALL


def test_chat_chunks_do_not_change_text(spark):
    conv = X.table(spark, SF_SMALL, "conversations")
    a = {r.conv_id: r.chat for r in D.render_chats(conv, chunk=2).collect()}
    b = {r.conv_id: r.chat for r in D.render_chats(conv, chunk=256).collect()}
    assert a == b and len(a) == conv.select("conv_id").distinct().count()
    one = conv.where("conv_id = 0").orderBy("turn").collect()
    want = "".join(f"<|im_start|>{r.role}\n{r.text}<|im_end|>\n" for r in one)
    assert a[0] == want


def test_unknown_mode(spark):
    items = X.items(spark, SF_SMALL)
    with pytest.raises(ValueError):
        D.to_messages(items, "eval", "xx")
    with pytest.raises(ValueError):
        D.to_rl_set(items, "en")


def test_null_question_renders_empty(spark):
    df = spark.createDataFrame([(1, None, None, None, None)],
                               "pid long, question string, answer string, da_question string, da_answer string")
    r = D.render_prompts(df, "eval", "da").first()
    assert r.system == D.SYSTEM_DA
    assert r.user.endswith("Spørgsmål: \nSvar:\n")
    assert D.render_prompts(df, "rl", "da").first().system is None
