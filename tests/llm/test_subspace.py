"""The subspace join against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from glossa.llm import subspace

SCHEMA = "vec_id long, embedding array<float>"


def takes_part(i, v):
    return i is not None and bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def all_pairs(rows, least=0.95):
    rows = list({(i, None if v is None else tuple(v)): (i, v) for i, v in rows}.values())
    good = [(i, np.array(v, float)) for i, v in rows if takes_part(i, v)]
    unit = [v / abs(v).max() for _, v in good]
    unit = [v / np.sqrt((v * v).sum()) for v in unit]
    links, label = [0] * len(good), list(range(len(good)))
    for a in range(len(good)):
        for b in range(a):
            if len(unit[a]) == len(unit[b]) and (unit[a] * unit[b]).sum() >= least:
                links[a] += 1
                links[b] += 1
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    first = {c: min(good[i][0] for i in range(len(good)) if label[i] == c) for c in set(label)}
    out = [(good[i][0], links[i], first[label[i]], first[label[i]] == good[i][0]) for i in range(len(good))]
    return sorted(out + [(i, 0, i, True) for i, v in rows if not takes_part(i, v)], key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 64))

    def near(v, far):
        e = rng.normal(size=len(v))
        return (v / np.linalg.norm(v) + far * e / np.linalg.norm(e)) * rng.uniform(0.5, 3)

    vectors = [*base, *[near(base[i % 20], rng.uniform(0, 0.6)) for i in range(200)], base[5] * 2, base[5], base[5].copy()]
    out = [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(rng.permutation(len(vectors)), vectors)]
    nan, inf = float("nan"), float("inf")
    return out + [out[0], out[1], (9000, None), (9001, [0.0] * 64), (9002, [nan] + [1.0] * 63), (9003, [None] + [1.0] * 63), (None, out[3][1]), (9004, []),
                  (9005, [1.0, 0.0]), (9006, [2.0, 0.125]), (9007, [1.0]), (9008, [3.0]), (9009, [-3.0]), (9010, [2.0 ** 100] * 3), (9011, [2.0 ** 101] * 3), (9012, [-0.0, 1.0]),
                  (9013, [0.0, 1.0]), (9014, [inf, 1.0]), (out[5][0], out[6][1])]


@pytest.mark.parametrize("how", [{}, {"grid": 2}, {"grid": 3, "cell": 40}, {"blocks": 4, "cell": 16}])
def test_all_links_and_no_others(spark, rows, how):
    got = subspace.report(spark.createDataFrame(rows, SCHEMA), **how)
    assert sorted([tuple(r) for r in got.collect()], key=str) == all_pairs(rows)


def test_extra_columns_other_types_and_no_rows(spark, rows):
    some = [r for r in rows if r[0] is not None and r[1] is None or len(r[1] or []) in (1, 2)]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in some], "vec_id int, embedding array<double>, k1 int, cell int, point string")
    assert sorted([tuple(r) for r in subspace.report(df).collect()], key=str) == all_pairs(some)
    assert subspace.report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_large_group_is_dealt_to_many_tasks(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=32)
    group = [(i, [float(np.float32(x)) for x in v + 0.05 * rng.normal(size=32)]) for i in range(150)]
    lone = [(1000 + i, [float(np.float32(x)) for x in rng.normal(size=32)]) for i in range(50)]
    copies = [(2000 + i, group[0][1]) for i in range(60)]
    rows = group + lone + copies
    got = subspace.report(spark.createDataFrame(rows, SCHEMA), cell=32)
    assert sorted([tuple(r) for r in got.collect()], key=str) == all_pairs(rows)
