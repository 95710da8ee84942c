"""Substring and suffix de-duplication against brute force."""

from __future__ import annotations

import dataclasses
import random

import numpy as np
import pytest

from glossa.llm import repeats, substring, suffix

from . import brute

SCHEMA = "doc_id long, text string"


def word_docs(seed, n=40, vocabulary=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passages = [[rng.choice(words) for _ in range(rng.randint(15, 60))] for _ in range(6)]
    docs = []
    for i in range(n):
        w = []
        while len(w) < rng.randint(0, 150):
            if rng.random() < 0.5:
                p = rng.choice(passages)
                a = rng.randint(0, 10)
                w += p[a:a + rng.randint(10, 60)]
            else:
                w += [rng.choice(words) for _ in range(rng.randint(1, 30))]
        docs.append((i * 3, " ".join(w)))
    docs += [(1, None), (2, ""), (4, "a " * 70), (5, "b " + "a " * 45), (7, docs[3][1]), (8, docs[3][1] + " end"), (10, "x\ty\n" * 30)]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_equals_brute_force(spark, seed):
    docs = word_docs(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.report(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == brute.substring(docs)


def byte_docs(seed):
    rng = random.Random(seed)
    alphabet = "abcdé \n"
    passages = ["".join(rng.choice(alphabet) for _ in range(rng.randint(300, 900))) for _ in range(5)]
    docs = []
    for i in range(25):
        t = ""
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, 200)
            t += p[a:a + rng.randint(250, 800)] if rng.random() < 0.7 else "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 500)))
        docs.append((i, t))
    docs += [(100, None), (101, ""), (102, "a" * 1500), (103, "ab" * 350), (104, "z" * 399), (105, "y" * 400), (106, "q" * 401)]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_equals_brute_force(spark, seed):
    docs = byte_docs(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.report(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == brute.suffix(docs)


def test_long_texts_go_in_pieces(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 300)
    pieces = list(repeats._pieces(np.zeros(2500, np.uint8), np.array([0, 2500]), 400))
    starts = [int(base[0]) + i for part, _, _, base in pieces for i in range(min(300, len(part) - 399))]
    assert starts == list(range(2101))  # every window of 400 starts in one piece
    assert all(len(part) <= 699 for part, _, _, _ in pieces)


@pytest.mark.parametrize("seed", [1, 2])
def test_results_do_not_depend_on_pieces(spark, monkeypatch, seed):
    docs = byte_docs(seed)
    rng = random.Random(seed)
    docs += [(200 + i, "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 90))) + "".join(t or "" for _, t in docs[i:i + 3])) for i in range(20)]
    whole = suffix.setting()
    for piece in (57, 300):
        monkeypatch.setattr(suffix, "setting", lambda *_, piece=piece: dataclasses.replace(whole, piece=piece))
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.report(spark.createDataFrame(docs, SCHEMA)).collect()}
        assert got == brute.suffix(docs)


def test_empty_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    empty = spark.createDataFrame([], SCHEMA)
    assert substring.report(empty).count() == 0 and suffix.report(empty).count() == 0
    rows = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None)], SCHEMA)
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring.report(rows).collect())
    # the null id comes first and keeps its words; the repeated row is one document, removed twice
    assert got == [(0, 0, 0), (0, 50, 0), (1, 50, 50), (1, 50, 50)]
