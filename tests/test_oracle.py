"""Every registered query against its DuckDB statement on the smallest tables,
plus plan checks: no Python evaluation anywhere, no nested-loop or cartesian
join in the scoring and scaling jobs."""

import pytest

import __spark_entry__ as entry
from checks.compare import digest, duck

from .conftest import SF_SMALL

# The training-data operators have their own tests.
OWN = set(entry._llm("QUERIES"))
QUERIES = {k: v for k, v in entry.queries().items() if k not in OWN}
ORACLE = {k: v for k, v in entry.oracle_sql().items() if k not in OWN}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]


PLAN_CHECKED = ["f2_score_completions", "g6_best_of_n", "g8_majority_winner", "g9_majority_metrics",
                "e2_language_confidence", "h3_first_accepted"]


@pytest.mark.parametrize("name", PLAN_CHECKED)
def test_plan_shape(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("BatchEvalPython", "ArrowEvalPython", "BroadcastNestedLoopJoin", "CartesianProduct"):
        assert bad not in plan, (name, bad)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "accuracy" in df.columns
