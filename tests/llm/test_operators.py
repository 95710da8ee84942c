"""Spans, mixture, url rules, decontamination, neighbours and toxicity against plain restatements."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from glossa.llm import ann, decontaminate, mix, ngram_join, pii, secrets, toxicity, url_filter

from . import brute

DOCS = "doc_id long, text string"
SF = "/root/testdata/sf0.001"

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits(t):
    return re.sub("[^0-9]", "", t)


def secret_spans(t):
    found = [("assign", m) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    found += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [("hex", m) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return found


def pii_spans(t):
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return found


def sha(found, kinds):
    order = sorted(found, key=lambda f: (f[1].start(), kinds.index(f[0])))
    return hashlib.sha256(",".join(f"{k}:{m.start()}:{m.end()}" for k, m in order).encode()).hexdigest()


HARD = [
    "password = 'abcdefgh1' SECRET:short token=\"longenough+/_.=-\" api_key: x api_key:abcdefghij", "AKIA" + "B" * 12 + " AKIA1 AKIA" + "9" * 40,
    "0123456789abcdef" * 2 + " " + "ab" * 40 + "G" + "f" * 31, "é𝄞 password=éabc token=abcdefgh𝄞 hex " + "a" * 33, "\u0001 token=abcdefghi \u0002", "", None,
    "a@b.c_d@e.f x.y+z@q-r.s.t. @no a@b mail me.at@host 𝄞u@v.ww", "1.2.3.4.5.6.7.8 256.1.1.1 010.020.030.255 9999999999.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 1 2 3 4",
    "+1 (988) 555-2485 +12 +1234567 +1-2-3-4-5-6-7-8-9 + 123456789", "7 " * 6000, "a" * 20000 + "@", "1" * 30000, "x" * 30000 + " 4111111111111111",
]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    return rows + [(10_000 + i, t) for i, t in enumerate(HARD)]


def test_secrets(spark, texts):
    kinds = ["assign", "access", "hex"]
    got = {r.doc_id: r for r in secrets.report(spark.createDataFrame(texts, DOCS)).collect()}
    for i, t in texts:
        found = secret_spans(t or "")
        assert [got[i][f"n_{k}"] for k in kinds] == [sum(f[0] == k for f in found) for k in kinds], (i, t and t[:80])
        assert got[i].base_sha256 == sha(found, kinds), i


def test_ledger_scans_only_unseen_pairs(spark):
    first = spark.createDataFrame([("a", "token=abcdefgh"), ("b", "nothing"), ("c", None)], "path string, text string")
    _, ledger = secrets.scan(first)
    assert ledger.count() == 6  # three blobs, two rule versions
    second = spark.createDataFrame([("d", "token=abcdefgh"), ("e", "password=12345678")], "path string, text string")
    paths, fresh = secrets.scan(second, ledger)
    assert fresh.count() == 2  # one unseen blob
    got = {r.path: len(r.spans) for r in secrets.findings(paths, ledger.unionByName(fresh)).collect()}
    assert got == {"d": 1, "e": 1}
    newer = [secrets.BASE, secrets.Pack("more-2", secrets.MORE.kinds, secrets.MORE.gate, 100)]
    assert {r.version for r in secrets.scan(first, ledger, newer)[1].collect()} == {"more-2"}


def test_pii(spark, texts):
    kinds = ["email", "ip", "card", "phone"]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(texts, DOCS)).collect()}
    for i, t in texts:
        found = pii_spans(t or "")
        assert [got[i][f"n_{k}"] for k in kinds] == [sum(f[0] == k for f in found) for k in kinds], (i, t and t[:80])
        assert got[i].base_sha256 == sha(found, kinds), i


def test_pii_contexts_and_redaction(spark):
    rows = [(i, f"word{i} contact number +1 (555) 010-{1000 + i} end") for i in range(12)] + [(50, "see contact number +1 (555) 99 end"), (51, "no data"), (52, None)]
    frame = spark.createDataFrame(rows, DOCS)
    out = {r.doc_id: r.text for r in pii.redact(frame).collect()}
    assert len(out) == 15 and out[0] == "word0 contact number [PHONE] end" and out[51] == "no data" and out[52] is None


def test_pii_contexts_find_unseen_forms(spark):
    rows = [(i, f"word{i} contact number +1 (555) 010-{1000 + i} end") for i in range(30)]
    rows += [(100 + i, f"reach them at mail{i}@host.org today") for i in range(30)] + [(200 + i, f"costs about {i} coins") for i in range(30)]
    rows += [(300, "contact number 0171-2345678 now"), (301, "a contact number 123 45 6789"), (302, "contact number none, costs about 77 coins"), (303, "reach them at x(a)y7 today")]
    frame = spark.createDataFrame(rows, DOCS)
    out = {r.doc_id: r.text for r in pii.redact(frame).collect()}
    assert out[300] == "contact number [PHONE] now" and out[301] == "a contact number [PHONE]" and out[302] == rows[-2][1]
    assert out[303] == "reach them at [EMAIL] today" and all(out[i] == t for i, t in rows if 200 <= i < 300)
    spans = {r.doc_id: r.spans for r in pii.report(frame).collect()}
    assert spans[300] == "ctx_phone:15:27" and spans[301] == "ctx_phone:17:28" and spans[303] == "ctx_email:14:20"


def test_mixture(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 30))), s) for i, s in enumerate(rng.choice(["a", "b", "B", "é", None], 400, p=[.6, .1, .1, .1, .1]))]
    rows = [(i, t, None if s is None else str(s)) for i, t, s in rows] + [(900, None, "a"), (901, "", "zero")]
    got = mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), range_rows=40).collect()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    target, free, rest = {}, set(size), float(sum(size.values()))
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * size[s]
            rest -= target[s]
        free -= over
    taken = {}
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == size[r.source] and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in size)


def test_url_rules_and_classes(spark):
    rows = [(1, "http://x.net/a", None), (2, "https://sub.EXAMPLE.net/en/1?q#f", None), (3, "http://example.com/de/", ""), (4, "http://a.org/fr/x", None),
            (5, None, None), (6, "no scheme", None), (7, "http://notnet/a", None),
            (8, "http://alias.info/p", '<link rel="canonical" href="http://x.net/a">'), (9, "https://www.alias.info/p/?utm_source=f", None),
            (10, "http://both.info/", '<meta http-equiv="refresh" content="0; url=http://a.org/fr/x"><link rel=canonical href=http://x.net/a>')]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), spellings=True).collect()}
    assert got[1] == ("x.net", "/a", "net/", "block") and got[2] == ("sub.example.net", "/en/1", "example.net/en/", "allow")
    assert got[3][2:] == ("example.com/de/", "block") and got[4][2:] == ("org/fr/", "allow")
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow") and got[7][2] is None
    # x.net/a, a.org/fr/x and both.info are one class, and the explicit allow goes first for members without a rule
    assert got[8][3] == got[9][3] == got[10][3] == "allow"
    alone = rows[:1] + rows[7:9]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(alone, "page_id long, url string, html string"), spellings=True).collect()}
    assert got == {1: "block", 8: "block", 9: "block"}


def test_decontamination(spark):
    words = [f"W{i}" for i in range(40)]
    items = [(1, " ".join(words)), (2, "one two three"), (3, None), (4, "  "), (5, " ".join(words[:6]))]
    docs = [(1, "x " * 500 + " ".join(words).lower() + " y" * 500), (2, " ".join(words[:33])), (3, " ".join(words[:37])), (4, "say ONE\ttwo three now"), (5, None), (6, ""), (6, "one two")]
    got = {(r.doc_id, r.item_id): r.n_found for r in decontaminate.report(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in docs:
        for i, q in items:
            s = brute.shingles(q)
            k = min(5, len(brute.WORD.findall(q or "")))
            w = brute.WORD.findall(brute.lower(t))
            n = len(s & {tuple(w[j:j + k]) for j in range(len(w) - k + 1)}) if s else 0
            if s and 10 * n >= 8 * len(s):
                want[d, i] = n
    assert got == want and (1, 1) in got and (4, 2) in got


def test_url_targets_outside_the_table_vote(spark):
    rows = [(1, "http://alias.info/p", '<link rel="canonical" href="http://x.net/a">'), (2, "https://www.alias.info/p/", None),
            (3, "http://twin.info/", '<meta http-equiv=refresh content="0.5;url=//x.net/b">'), (4, "http://far.info/", "<link rel=canonical data-x='" + "y" * 5000 + "' href=http://x.net/c>"),
            (5, "http://both.info/", '<meta property="og:url" content="http://x.net/d"><link href="http://a.org/fr/x" rel="canonical">'),
            (6, "http://free.info/", '<link rel="stylesheet" href="http://x.net/refresh.css"><meta name="description" content="canonical x.net/e">'),
            (7, None, '<link rel=canonical href="http://x.net/f">'), (8, "http://open.info/", '<link rel="canonical" href="http://x.net/g"'),
            (9, "http://example.org/q/login?x", None), (10, "http://none.info/", '<link rel=canonical href="mailto:a@x.net">')]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), spellings=True).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "allow"}


def test_url_link_targets(spark):
    page = "http://h.info/a/b/c.html?x=1#f"
    cases = [("0;url=login.html", "http://h.info/a/b/login.html"), ("0.5;url=../d", "http://h.info/a/d"), ("3; URL='/z/./y/../w?q#r' ", "http://h.info/z/w?q#r"),
             ("0;url=?p=2", "http://h.info/a/b/c.html?p=2"), ("1, //o.info/x", "http://o.info/x"), ("0 ; url = https://o.info/it's", "https://o.info/it's"),
             ("0;url=../../../../e/", "http://h.info/e/"), ("0;url=..", "http://h.info/a/"), ("5", None), ("0;url=#top", None)]
    rows = [(i, page, f'<p><META content="{c}"\nHTTP-EQUIV="Refresh">') for i, (c, _) in enumerate(cases)]
    rows += [(50, "http://h.info", "<link rel='x canonical' href=y>"), (51, None, "<link rel=canonical href=y>"), (52, page, '<meta content="a > b" property=og:url><link href="/a>b" rel=canonical>'),
             (53, page, "<link =\"" * 30_000), (54, page, "<meta a" * 30_000)]
    frame = spark.createDataFrame(rows, "i long, url string, html string")
    got = {r.i: r.t for r in frame.select("i", url_filter.link_targets(frame.url, frame.html).alias("t")).collect()}
    assert got == {**{i: [w] if w else [] for i, (_, w) in enumerate(cases)}, 50: ["http://h.info/y"], 51: [None],
                   52: ["http://h.info/a/b/a > b", "http://h.info/a>b"], 53: [], 54: []}


@pytest.mark.parametrize("block", [3, 20])
def test_decontamination_in_blocks(spark, block):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"v{w}" for w in rng.integers(0, 1000, int(n))) for n in rng.integers(3, 40, 30)]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(100, texts[0])], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"a b {t} c {texts[-i]} d") for i, t in enumerate(texts)], DOCS)
    found = lambda n: {tuple(r) for r in decontaminate.contained(docs, items, block=n).collect()}
    whole = found(decontaminate.BLOCK)
    assert {(r[0], r[2]) for r in whole} >= {(i, i) for i in range(30)} and found(block) == whole


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16)) * rng.uniform(0.5, 2, (600, 1))
    rows = [(i, [float(np.float32(v)) for v in r], 0) for i, r in enumerate(x)]
    rows += [(i, rows[40][1], 0) for i in range(700, 740)] + [(800, None, 0), (820, [0.0] * 16, 0), (840, [float("nan")] * 16, 0), (860, [None] * 16, 0), (880, [1.0], 0)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    v = {i: np.array(e) for i, e, _ in rows if i < 800}
    hits = total = 0
    for q in [i for i in v if i % 20 == 0]:
        true = sorted(((-(v[q] * v[i]).sum(), i) for i in v if i != q))[:20]
        hits += len({i for _, i in true} & {i for i, _ in got[q]})
        total += 20
        assert len(got[q]) == 20 and all(abs(s - (v[q] * v[i]).sum()) < 1e-9 for i, s in got[q])
    assert set(got) == {i for i in v if i % 20 == 0} and hits / total >= 0.9


def test_neighbours_of_an_index_of_any_size(spark, monkeypatch):
    # an index of more points than this once had buckets of two axes, with too few probes for them
    monkeypatch.setattr(ann, "ONE_AXIS", 100, raising=False)
    x = np.random.default_rng(3).normal(size=(2000, 64))
    got = {}
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 2000, 20):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20].tolist()) & got.get(q, set()))
    assert hits / 2000 >= 0.9


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(toxicity.labelled_rows(docs, labels))
    rows = toxicity.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").filter(toxicity.fold() == 2).select("score", "toxic").collect()
    toxic = np.array([r.score for r in rows if r.toxic == 1])
    clean = np.array([r.score for r in rows if r.toxic == 0])
    # measured 0.956 with the about 3,000 labels of this size
    assert (toxic[:, None] > clean[None, :]).mean() > 0.93
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100_000)], DOCS)
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (secrets.report(docs), pii.report(docs), mix.mix(docs), decontaminate.report(docs, items), ngram_join.keep_one(docs),
                ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"))):
        assert out.count() == 0
