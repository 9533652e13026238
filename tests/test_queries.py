"""Registered queries against their oracle SQL on the smallest driver tables.

``check.py`` compares all of them; these cover every module in a short run.
"""

import os

import pytest

import __spark_entry__ as entry
import check
from registry.oracles import ORACLES
from registry.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
NAMES = (
    "first_time_cohort", "asof_latest_strict", "asof_next_within", "window_pick_flags", "window_pick_half_hour", "window_pick_months", "history_counts", "value_as_of",
    "distinct_on_first", "sql_text_functions", "horizon_fee_lookup", "horizon_fee_lookup_keyed", "mart_roundtrip", "report_star", "contact_features", "loan_outcomes_business_days", "trailing_rate_nation", "trailing_rate_refreshed",
    "cumulative_fee_curve", "second_platform_first_loan", "monthly_cashout", "monthly_net_cash", "repeat_counts",
    "installment_performance", "withdrawal_stats", "build_model_table_line_of_credit",
)


@pytest.fixture(scope="module")
def oracle():
    return check.connect(FOLDER)


def test_every_query_has_an_oracle():
    """Queries of the removable subpackage have tests of their own beside it."""
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, oracle, name):
    problem = check.compare(spark, oracle, name, entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    assert problem is None, problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["asof_latest_strict", "window_pick_flags", "trailing_rate_nation", "monthly_cashout"])
def test_no_pairwise_join(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
