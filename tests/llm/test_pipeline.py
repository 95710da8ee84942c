"""Every stage of the pipeline, and the whole of it, against plain restatements; clashing columns, caps that are gone."""

from __future__ import annotations

import math
import random

import pytest

import corpus_pipeline as P
from glossa.llm import decontaminate, mix, ngram_join, pii, secrets, toxicity, url_filter

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["row_key", "_d", "_id", "_key", "text_key", "_text_key", "blob", "spans", "_open", "_text", "_merged", "_cut", "node", "row", "_toxicity", "score", "group"]


def corpus(seed=5):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(600)]
    bad = [f"vile{i}" for i in range(12)]
    item = [f"bench{i}" for i in range(20)]
    rows, labels = [], []
    for i in range(220):
        toxic = i % 4 == 0
        w = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        if toxic:
            w = [rng.choice(bad) if rng.random() < 0.5 else x for x in w]
        rows.append((i, " ".join(w), "en", f"s{i % 3}" if i % 7 else None))
        labels.append((i, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 4]
    rows += [(1000 + k, r[1] + " extra", "en", "s1") for k, r in enumerate(clean[:6])]  # near copies
    rows += [(1100, clean[7][1], "en", "s2"), (clean[8][0], clean[8][1], "en", "s0")]  # a copy, and a repeated row
    rows += [(1200, clean[9][1].upper() + " " + " ".join(item).upper() + " tail of it", "en", "s0")]  # contaminated
    rows += [(1300, "write to a.b@c.org or +1 (555) 010-2000 now", "en", "s1"), (1400, None, None, None), (1401, "", "en", "s1"), (None, "nobody's words", "en", "s2")]
    full = [(d, t, g, s, None if t is None else len(t)) for d, t, g, s in rows]
    return full, labels, [(1, " ".join(item)), (2, None), (3, "")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, labels, items = corpus()
    top = str(tmp_path_factory.mktemp("pipe"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top, rows, labels, items


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def kept_one(rows):
    """One row of each class of near duplicates: the least id, null last; rows without words stay."""
    sets = {i: brute.shingles(r[1]) for i, r in enumerate(rows)}
    comp = brute.components(sets)
    best = {}
    for i, r in enumerate(rows):
        if sets[i]:
            best.setdefault(comp[i], []).append((r[0] is None, r[0] or 0, i))
    keep = {min(v)[2] for v in best.values()}
    return sorted((r for i, r in enumerate(rows) if not sets[i] or i in keep), key=repr)


def test_stages_equal_plain_restatements(spark, tables):
    top, rows, labels, items = tables
    docs = spark.createDataFrame(rows, SCHEMA)
    stages = dict(P.STAGES)
    # toxicity: the decision is that of the operator's scores, which separate these labels
    clean = plain(stages["toxicity"](spark, docs, top))
    model = toxicity.fit(toxicity.labelled_rows(docs, spark.read.parquet(f"{top}/labels.parquet")))
    rejected = {r.doc_id for r in toxicity.score(docs, model).filter(f"score >= {P.TOXIC}").collect()}
    assert clean == sorted((r for r in rows if r[0] not in rejected or r[0] is None), key=repr)
    toxic = {d for d, _, t in labels if t}
    assert len(rejected & toxic) >= 0.9 * len(toxic) and len(rejected - toxic) <= 0.05 * len(rows)
    # near duplicates
    once = plain(stages["near_duplicates"](spark, docs, top))
    assert once == kept_one(rows) and len(once) <= len(rows) - 8
    # decontamination
    left = plain(stages["decontamination"](spark, docs, top))
    assert left == sorted((r for r in rows if r[0] != 1200), key=repr)
    # personal data
    hidden = plain(stages["pii"](spark, docs, top))
    cut = "write to [EMAIL] or [PHONE] now"
    assert hidden == sorted(((r[0], cut, r[2], r[3], len(cut)) if r[0] == 1300 else r for r in rows), key=repr)
    # mixture
    mixed = stages["mixture"](spark, docs, top).collect()
    assert len(mixed) == len(rows)
    for source in {r[3] for r in rows}:
        mine = [m for m in mixed if m.source == source]
        assert sum(m.taken for m in mine) == round(mine[0].target) and sum(m["size"] for m in mine) == mine[0].source_size
        assert all(m.taken <= 3 * m["size"] for m in mine)


def test_run_applies_every_stage_to_what_the_one_before_kept(spark, tables):
    top, rows, labels, items = tables
    docs = spark.read.parquet(f"{top}/documents.parquet")
    model = toxicity.fit(toxicity.labelled_rows(docs, spark.read.parquet(f"{top}/labels.parquet")))
    rejected = [tuple(r) for r in toxicity.score(docs, model).filter(f"score >= {P.TOXIC}").select(*docs.columns).collect()]
    want = kept_one([r for r in rows if r not in rejected])
    want = [r for r in want if "bench0 bench1 bench2" not in (r[1] or "").lower()]
    sizes = {}
    for r in want:
        text = "write to [EMAIL] or [PHONE] now" if r[0] == 1300 else r[1]
        sizes.setdefault(r[3], []).append((r[0], len((text or "").split())))
    got = P.run(spark, top).collect()
    assert sorted(((m.doc_id, m["size"]) for m in got), key=repr) == sorted((x for v in sizes.values() for x in v), key=repr)
    assert {m.source: m.source_size for m in got} == {s: sum(n for _, n in v) for s, v in sizes.items()}


def test_stages_on_empty_tables(spark, tables):
    top, *_ = tables
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in P.STAGES:
        assert stage(spark, docs, top).count() == 0, name


def test_clashing_columns_are_kept(spark, tables):
    top, rows, _, _ = tables
    some = [r for r in rows if r[0] is None or r[0] >= 1000 or r[0] < 12]
    wide = spark.createDataFrame([(*r, *[f"{c}{i}" for c in CLASH]) for i, r in enumerate(some)], SCHEMA + "".join(f", `{c}` string" for c in CLASH))
    cut = "write to [EMAIL] or [PHONE] now"
    want = {"near_duplicates": kept_one(some), "decontamination": [r for r in some if r[0] != 1200],
            "pii": [(r[0], cut, r[2], r[3], len(cut)) if r[0] == 1300 else r for r in some]}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, wide, top)
        assert out.columns == wide.columns
        got = plain(out)
        if name in want:
            assert sorted((r[:5] for r in got), key=repr) == sorted(want[name], key=repr), name
        for r in got:
            i = int(r[5][len(CLASH[0]):])
            assert r[0] == some[i][0] and r[5:] == tuple(f"{c}{i}" for c in CLASH)
    assert mix.mix(wide).count() == len(some)


def test_rows_of_one_id_are_spread_and_counted(spark, monkeypatch):
    monkeypatch.setattr(mix, "COPIES", 7)
    rows = [(None, "a b c", "x")] * 40 + [(None, " ".join("w" * (i % 9)), "x") for i in range(300)] + [(1, "d e", "y")] * 30 + [(2, None, "y")] * 20 + [(3, "f " * 50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix.mix(docs, range_rows=5).collect()
    assert sorted((r.doc_id or 0, r.source or "", r["size"]) for r in out) == sorted((d or 0, s or "", len((t or "").split())) for d, t, s in rows)
    for source in ("x", "y", None):
        mine = [r for r in out if r.source == source]
        assert sum(r.taken for r in mine) == round(mine[0].target)
        passes = {r.taken // r["size"] for r in mine if r["size"] and r.taken % r["size"] == 0} | {r.taken / r["size"] for r in mine if r["size"]}
        assert max(passes) - min(passes) <= 1
    assert sorted(map(repr, out)) == sorted(map(repr, mix.mix(docs.repartition(3), range_rows=5).collect()))


def test_long_labelled_texts_are_learned_from(spark):
    long = "awful nasty vermin " * 4000  # beyond 50,000 characters
    rows = [(i, (long if i % 2 else "pleasant sunny meadow ") + f"n{i}", i % 2) for i in range(60)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame([(1, "awful nasty vermin " * 200), (2, "pleasant sunny meadow")], "doc_id long, text string"), model).collect()}
    assert got[1] > 0.5 > got[2]


def test_contexts_reach_over_other_matches_and_hold_whole_words(spark):
    text = "first second 1.1.1.1 2.2.2.2 3.3.3.3 end " + "x" * 200 + " 4.4.4.4 " + "y" * 200
    found = pii.find(spark.createDataFrame([(bytearray(b"k"), text)], "blob binary, text string"), pii.KINDS, context=True)
    got = {r.value: (r.left, r.right) for r in found.collect() if r.kind == "ip"}
    for value, (left, right) in got.items():
        at = text.index(value)
        assert left == text[max(0, at - 80):at] and right == text[at + len(value):at + len(value) + 80]
    pats = {r.value: r.patterns for r in pii._patterns(found.filter("kind = 'ip'")).collect()}
    assert "2 2.2.2.2 1.1.1.1" not in pats["3.3.3.3"] and "2 1.1.1.1 2.2.2.2" in pats["3.3.3.3"]
    assert pats["4.4.4.4"] == []  # the words beside it do not fit into a context


def test_arrivals_do_not_change_findings_and_scan_a_blob_once(spark, monkeypatch):
    rows = [(i, f"token=abcdefgh{i % 4}") for i in range(20)] + [(50, None), (None, "AKIA" + "B" * 20), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scanned = []
    real = secrets.scan

    def counting(history, ledger=None, packs=secrets.PACKS):
        paths, fresh = real(history, ledger, packs)
        scanned.append(fresh.count())
        return paths, fresh

    monkeypatch.setattr(secrets, "scan", counting)
    whole = plain(secrets.report(docs))
    assert plain(secrets.report(docs, arrivals=2)) == whole
    blobs = len({t or "" for _, t in rows})
    assert len(scanned) == 3 and scanned[0] == sum(scanned[1:]) == 2 * blobs  # two rule versions


def test_only_edges_and_the_protocol_make_aliases(spark):
    rows = [(1, "http://example.com/de/", None), (2, "http://example.com/de", None), (3, "http://www.example.com/de", None), (4, "HTTP://Example.com:80/de#x", "<link rel=canonical href=http://example.com/de/>"),
            (5, "http://a.info", "<meta http-equiv=refresh content='0;url=http://x.net/'>"), (6, "http://a.info/", None), (7, "http://a.info/?b=1", None), (8, "https://a.info/", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge(frame).collect()}
    # 2 and 4 are one address, which declares a blocked canonical url
    assert got == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "block", 6: "block", 7: "allow", 8: "allow"}
    without = {r.page_id: r.verdict for r in url_filter.judge(frame.filter("page_id <= 3")).collect()}
    assert without == {1: "block", 2: "allow", 3: "allow"}
