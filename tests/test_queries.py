"""Every registered query against its SQL, on the smallest tables."""

from dataclasses import replace
from pathlib import Path

import pytest
from oracle_check import compare, connect

from attestry.conf import DEFAULT
from attestry.queries import ORACLES, QUERIES
from attestry.sources.repos import read_listing

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(ROOT).exists(), reason="no test tables")

# whole screenings take longest; their logic is also covered in test_plans
SLOW = {"invariance_audit", "screen_corpus", "assess_authenticity", "stream_screen_corpus"}


@pytest.fixture(scope="module")
def con():
    return connect(ROOT)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert len(QUERIES) > 100


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, con, name):
    problem, rows = compare(QUERIES[name](spark, ROOT), con, ORACLES[name])
    assert not problem
    if name not in ("search_results",):
        assert rows > 0


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_need(spark):
    plan = plan_of(QUERIES["transfer_factors"](spark, ROOT))
    assert "l_discount" in plan and "l_shipdate" not in plan and "l_comment" not in plan
    assert "PushedFilters: [IsNotNull(c_mktsegment)" in plan_of(QUERIES["search_results"](spark, ROOT))


def test_no_cross_joins_and_ranks_are_cut_early(spark):
    for name in ("jd_clone", "canonical_skill", "role_overlap", "judge_metric", "erase"):
        plan = plan_of(QUERIES[name](spark, ROOT))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    assert "WindowGroupLimit" in plan_of(QUERIES["error_buckets"](spark, ROOT))


def test_listing_is_whole_unless_a_limit_is_given(spark):
    rows = [("c", f"r{k:03}", False, "2020-01-01", f"2021-{1 + k // 28:02}-{1 + k % 28:02}", [], "main", "", "") for k in range(90)]
    schema = (
        "candidate_id string, name string, fork boolean, created_at string, pushed_at string, "
        "topics array<string>, default_branch string, description string, language string"
    )
    raw = spark.createDataFrame(rows, schema)
    assert read_listing(raw).count() == 90
    cut = read_listing(raw, replace(DEFAULT, max_repos=7))
    assert sorted(r.name for r in cut.collect()) == [f"r{k:03}" for k in range(83, 90)]
    assert "WindowGroupLimit" in plan_of(cut)
