"""Spelling groups against a plain restatement."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter

from glossa.llm import spelling

DOCS = "doc_id long, text string"


def words_of(docs):
    n = Counter()
    for doc_id, text in docs:
        for m in re.finditer("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[0])
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return n


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(docs):
    n = {w: c for w, c in words_of(docs).items() if len(w) >= 7 and c >= 2}
    near = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 10 * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def same(spark, docs, schema=DOCS, df=None):
    got = [tuple(r) for r in spelling.report(df if df is not None else spark.createDataFrame(docs, schema)).collect()]
    want = plain(docs)
    assert len(got) == len(want) and set(got) == want
    return want


def test_chains_ties_and_code_points(spark):
    text = ("aaaaaaaa " * 3 + "aaaaaaab " * 40 + "aaaaaabb " * 500 + "zzzzzzz Zzzzzzy zzzzzzx " * 4 + "ÀÀÀÀÀÀÀ àÀÀÀÀÀÀ " * 2 + "réveiller reveiller réveillers " * 3
            + "ééééééé " * 2 + "éééééééé " * 30 + "straße×÷x 12abcdefgh34abcdefgh_ABCDEFGH ")
    rows = same(spark, [(1, text), (2, text), (1, text), (None, text), (None, None), (3, None), (4, ""), (5, "é𝄞" * 50), (6, "a" * 70_000), (7, "a" * 70_000)])
    assert any(r[1] and r[1] != r[2] for r in rows) and any(r[4] > 1 for r in rows)


def test_all_words_one_edit_apart_are_found(spark):
    """Every edit at every place, in words of repeated bigrams too."""
    base = ["ababababab", "abcdefghij", "aaaaaaaaaa", "mississippi"]
    words = set(base)
    for w in base:
        for i in range(len(w) + 1):
            words |= {w[:i] + w[i + 1:], w[:i] + "x" + w[i:], w[:i] + "a" + w[i:], w[:i] + "b" + w[i + 1:]}
    docs = [(i, " ".join(sorted(words))) for i in range(4)]
    rows = same(spark, docs)
    assert sum(r[4] for r in rows) > 400


def test_long_lists_are_cut_into_blocks(spark):
    words = [f"qqqqqq{x}{y}" for x in "abcdef" for y in "abcdef"]
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = {tuple(sorted(r)) for r in spelling.near_pairs(df, list_words=3).collect()}
    assert got == {tuple(sorted(p)) for p in itertools.combinations(words, 2) if one_edit(*p)}


def test_extra_columns_and_no_rows(spark):
    docs = [(i, "correctly corectly correctly " * 12) for i in range(3)]
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], "doc_id long, text string, n int, word int, d string")
    same(spark, docs, df=df)
    assert spelling.report(spark.createDataFrame([], DOCS)).collect() == []
