"""The prefix trie against a plain one, with long conversations in blocks and hot parents."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from glossa.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
    members, kids = defaultdict(list), defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved, out = {}, {}, []
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids[path]) if kids[path] else 1
        saved[path] = (len(members[path]) - 1) * (len(path[-1][1]) if path else 0) + sum(saved[k] for k in kids[path])
    for path, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(path))))
        out.append((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(kids[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def same(spark, rows):
    got = sorted([tuple(r) for r in prefix_trie.report(spark.createDataFrame(rows, SCHEMA)).collect()], key=str)
    assert got == plain(rows)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 2)
    monkeypatch.setattr(prefix_trie, "HOT_PARENT", 1)


def mixed(seed, n=140):
    r = random.Random(seed)
    ids = [None, 0, 1, 2, 100, 101, 102, 103, 104, 150, 200, 201, 202, -5, -100, -101]
    return [(r.choice(ids), r.choice([None, 0, 1, 2, 3]), r.choice([None, "u", "a"]), r.choice([None, "", "x", "y𝄞"])) for _ in range(n)]


def test_nulls_ties_and_repeated_rows(spark):
    same(spark, mixed(1))


def test_blocks_and_hot_parents(spark, small_blocks):
    same(spark, mixed(2))
    # many equal conversations, one of many turns, and texts of some length
    same(spark, [(1000 + i, 0, "u", "same" * 500) for i in range(40)] + [(2000, i, "u", str(i % 3)) for i in range(30)] + [(3001, i, "u", str(i % 3)) for i in range(28)])


def test_no_rows_and_turnless_conversations(spark):
    assert prefix_trie.report(spark.createDataFrame([], SCHEMA)).collect() == []
    turnless = [c for c in range(1, 60) if zlib.crc32(str(c).encode()) % 6]
    same(spark, [(c, None, None, None) for c in turnless])


def test_ends_pass_through_pieces_in_order(spark, monkeypatch):
    ends = spark.createDataFrame([(1, c) for c in range(-50, 500)] + [(2, 7)], "depth long, conv long").repartition(5)
    got = {r["node"]: r["ends_sha256"] for r in prefix_trie.digests(ends, ["depth"]).collect()}
    assert got == {"1": hashlib.sha256(",".join(map(str, range(-50, 500))).encode()).hexdigest(), "2": hashlib.sha256(b"7").hexdigest()}


def test_extra_columns(spark):
    rows = mixed(3, 60)
    names = SCHEMA + ", conv long, place long, h1 string, node string, depth int"
    df = spark.createDataFrame([(*r, 1, 2, "x", "y", 3) for r in rows], names)
    assert sorted([tuple(r) for r in prefix_trie.report(df).collect()], key=str) == plain(rows)
