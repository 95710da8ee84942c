"""N-gram Jaccard join against all pairs."""

from __future__ import annotations

import random

import pytest

from glossa.llm import ngram_join

from . import brute

SCHEMA = "doc_id long, text string"


def near_docs(seed, groups=12, vocabulary=400):
    rng = random.Random(seed)
    words = [f"W{i}" if i % 3 else f"w{i}" for i in range(vocabulary)]
    phrase = "this work is licensed under some public license version four point zero".split()
    docs, i = [], 0
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(3, 140))]
        for _ in range(rng.choice([1, 2, 5, 12, 60 if g == 0 else 3])):
            w = list(base)
            for _ in range(rng.randint(0, 5) if len(w) > 30 else 0):
                w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.4:
                w += phrase
            docs.append((i * 7 % 1009, " ".join(w)))
            i += 1
    docs += [(2000, None), (2001, ""), (2002, "  \n"), (2003, "one two"), (2004, "ONE\ttwo"), (2005, docs[0][1]), (2006, docs[0][1].upper())]
    return docs


@pytest.mark.parametrize("seed,long", [(1, 16), (2, 2)])
def test_components_equal_all_pairs(spark, seed, long, monkeypatch):
    monkeypatch.setattr(ngram_join, "SALT", 5)
    monkeypatch.setattr(ngram_join, "BLOCK", 700)
    monkeypatch.setattr(ngram_join, "LONG", long)
    docs = near_docs(seed)
    sets = {d: brute.shingles(t) for d, t in docs}
    want = brute.components(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.report(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == {d: (len(sets[d]), want[d]) for d in sets}


def test_odd_rows(spark):
    assert ngram_join.report(spark.createDataFrame([], SCHEMA)).count() == 0
    text = "a b c d e f g h"
    docs = spark.createDataFrame([(None, text, 1), (3, text, 2), (3, text, 2), (9, None, 3), (9, "", 4)], "doc_id long, text string, node int")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.report(docs).collect())
    assert got == [(0, 4, 3), (3, 4, 3), (3, 4, 3), (9, 0, 9), (9, 0, 9)]
    kept = sorted((r.doc_id, r.text or "", r.node) for r in ngram_join.keep_one(docs).collect())
    assert kept == [(3, text, 2), (9, "", 3), (9, "", 4)]


def test_one_pass_of_prefixes_and_the_compared_sets_are_sent(spark, monkeypatch):
    write, shared, links = ngram_join.written, [], []

    def spy(df, name):
        if name == "join-links":
            links.append(df._jdf.queryExecution().executedPlan().toString())
        out = write(df, name)
        if name == "join-shared":
            shared.append({r.token % ngram_join.PASSES for r in out.collect()})
        return out

    monkeypatch.setattr(ngram_join, "written", spy)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ngram_join.report(spark.createDataFrame(near_docs(3), SCHEMA)).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert shared == [{i} for i in range(ngram_join.PASSES)]
    # whole sets are not shuffled to find those of compared nodes, on either side
    semi = [line for plan in links for line in plan.splitlines() if "LeftSemi" in line]
    assert links and len(semi) == 2 * len(links) and all("BroadcastHashJoin" in line for line in semi)
