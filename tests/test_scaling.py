"""Best-of-N, majority vote and language mix against a plain-Python restatement
of the rules on random short sample lists (0 to 12 samples, null predictions)."""

import random

import pytest
from pyspark.sql import functions as F

from glossa.operators import scaling as G

NS = tuple(range(1, 11))
LABELS = ["target", "other", "mixed", "unclear"]


def make_rows(seed=7, items=40):
    rnd = random.Random(seed)
    out = []
    for pid in range(items):
        for model in ("m0", "m1"):
            for mode in ("da", "en"):
                if rnd.random() < 0.1:
                    continue  # item without completions for this model/mode
                gold = float(rnd.randint(1, 3))
                for idx in range(rnd.randint(0, 12)):
                    pred = rnd.choice([None, 1.0, 2.0, 3.0, 2.0000001, 1.0])
                    boxed = pred is not None or rnd.random() < 0.3
                    correct = pred is not None and abs(pred - gold) < 1e-3
                    lab = rnd.choice(LABELS) if mode == "da" else None
                    score = round(rnd.uniform(-1, 1), 3) if mode == "da" else None
                    out.append((pid, model, mode, idx, boxed, pred, correct, lab, score))
    return out


def beats(a, b):
    """Whether the answer given at indexes ``a`` wins over the one at ``b``."""
    if len(a) != len(b):
        return len(a) > len(b)
    if sum(a) != sum(b):
        return sum(a) < sum(b)
    return min(a) < min(b)


def restate(rows, items):
    groups = {}
    for r in rows:
        groups.setdefault((r[1], r[2]), {}).setdefault(r[0], []).append(r)
    best, maj, mix = {}, {}, {}
    for (model, mode), per_item in groups.items():
        for n in NS:
            b = {"acc": 0, "box": 0, "strict": 0, "cnt": 0, "ct": 0, "co": 0}
            m = {"acc": 0, "box": 0, "parsed": 0, "strict": 0, "cnt": 0, "sel": [0, 0, 0, 0], "ssum": 0.0}
            s = {"lab": [0, 0, 0, 0], "ssum": 0.0}
            for pid, samples in per_item.items():
                prefix = sorted([x for x in samples if x[3] < 10], key=lambda x: x[3])[:n]
                b["acc"] += any(x[6] for x in prefix)
                b["box"] += any(x[4] for x in prefix)
                b["strict"] += any(x[6] and x[4] and x[7] == "target" for x in prefix)
                b["cnt"] += any(x[6] and x[7] != "target" for x in prefix)
                b["ct"] += any(x[6] and x[7] == "target" for x in prefix)
                b["co"] += any(x[6] and x[7] == "other" for x in prefix)
                if mode == "da":
                    for x in prefix:
                        s["lab"][LABELS.index(x[7])] += 1
                        s["ssum"] += x[8]
                supporters = {}
                for x in prefix:
                    if x[5] is not None:
                        supporters.setdefault(f"{x[5]:.6f}", []).append(x[3])
                winner = [k for k in supporters if not any(beats(supporters[o], supporters[k])
                                                           for o in supporters if o != k)]
                if winner:
                    assert len(winner) == 1
                    w = next(x for x in prefix if x[3] == min(supporters[winner[0]]))
                    m["parsed"] += 1
                    m["acc"] += w[6]
                    m["box"] += w[4]
                    if mode == "da":
                        m["strict"] += w[6] and w[4] and w[7] == "target"
                        m["cnt"] += w[6] and w[7] != "target"
                        m["sel"][LABELS.index(w[7])] += 1
                        m["ssum"] += w[8]
            best[(model, mode, n)] = {k: v / items for k, v in b.items()}
            mm = {k: m[k] / items for k in ("acc", "box", "parsed", "strict", "cnt")}
            mm["sel"] = [v / items for v in m["sel"]]
            mm["contrast"] = m["ssum"] / m["parsed"] if m["parsed"] else 0.0
            maj[(model, mode, n)] = mm
            if mode == "da":
                mix[(model, mode, n)] = [v / (items * n) for v in s["lab"]] + [s["ssum"] / (items * n)]
    return best, maj, mix


@pytest.fixture(scope="module")
def data(spark):
    items_n = 40
    rows = make_rows(items=items_n)
    schema = ("pid long, model string, mode string, sample_idx long, boxed boolean, pred double, "
              "correct boolean, lang_label string, lang_score double")
    scored = spark.createDataFrame(rows, schema)
    items = spark.range(items_n).withColumnRenamed("id", "pid")
    return rows, items_n, G.prefix_samples(scored, 10, 4), items


def close(a, b):
    return a is None and b is None or (a is not None and b is not None and abs(a - b) < 1e-9)


def test_best_of_n(data):
    rows, n_items, samples, items = data
    best, _, _ = restate(rows, n_items)
    got = {(r.model, r.mode, r.n): r for r in G.best_of_n(samples, items, NS).collect()}
    assert set(got) == set(best)
    for k, e in best.items():
        r = got[k]
        assert close(r.oracle_accuracy, e["acc"]) and close(r.oracle_boxed_rate, e["box"])
        if k[1] == "da":
            assert close(r.oracle_strict_accuracy, e["strict"])
            assert close(r.oracle_correct_but_not_target_rate, e["cnt"])
            assert close(r.oracle_any_correct_target_rate, e["ct"])
            assert close(r.oracle_any_correct_other_rate, e["co"])
            assert close(r.oracle_any_correct_rate, r.oracle_accuracy)
        else:
            assert r.oracle_strict_accuracy is None


def test_majority(data):
    rows, n_items, samples, items = data
    _, maj, _ = restate(rows, n_items)
    winners = G.majority_winner(samples, NS)
    got = {(r.model, r.mode, r.n): r for r in G.majority_metrics(winners, samples, items, NS).collect()}
    assert set(got) == set(maj)
    for k, e in maj.items():
        r = got[k]
        assert close(r.accuracy, e["acc"]) and close(r.boxed_rate, e["box"])
        assert close(r.parsed_rate, e["parsed"])
        if k[1] == "da":
            assert close(r.strict_accuracy, e["strict"])
            assert close(r.correct_but_not_target_rate, e["cnt"])
            for lab, v in zip(LABELS, e["sel"]):
                assert close(r[f"selected_{lab}_rate"], v)
            assert close(r.selected_avg_target_minus_other, e["contrast"])


def test_sample_language_mix(data):
    rows, n_items, samples, items = data
    _, _, mix = restate(rows, n_items)
    got = {(r.model, r.mode, r.n): r for r in G.sample_language_mix(samples, items, NS).collect()}
    assert set(got) == set(mix)
    for k, e in mix.items():
        r = got[k]
        for name, v in zip(G.SAMPLE_MIX, e):
            assert close(r[name], v)


def test_identities(data):
    _, _, samples, items = data
    best = {(r.model, r.mode, r.n): r for r in G.best_of_n(samples, items, NS).collect()}
    winners = G.majority_winner(samples, NS)
    maj = {(r.model, r.mode, r.n): r for r in G.majority_metrics(winners, samples, items, NS).collect()}
    for (model, mode, n), b in best.items():
        m = maj[(model, mode, n)]
        assert m.boxed_rate <= m.parsed_rate + 1e-12
        assert m.accuracy <= b.oracle_accuracy + 1e-12
        if n == 1:
            assert close(m.accuracy, b.oracle_accuracy)
        if n > 1:
            assert b.oracle_accuracy >= best[(model, mode, n - 1)].oracle_accuracy - 1e-12


def test_majority_plan_shape(data):
    _, _, samples, items = data
    plan = G.majority_metrics(G.majority_winner(samples, NS), samples, items, NS) \
        ._jdf.queryExecution().executedPlan().toString()
    for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan


def test_winner_keeps_its_own_prediction(spark):
    rows = [(1, "m", "da", 0, True, 1.23456789, False, "other", 0.1), (1, "m", "da", 1, True, 1.2345681, False, "other", 0.2)]
    schema = ("pid long, model string, mode string, sample_idx long, boxed boolean, pred double, "
              "correct boolean, lang_label string, lang_score double")
    got = G.majority_winner(spark.createDataFrame(rows, schema), (1, 2)).orderBy("n").collect()
    assert [(r.n, r.pred, r.votes) for r in got] == [(1, 1.23456789, 1), (2, 1.23456789, 2)]
