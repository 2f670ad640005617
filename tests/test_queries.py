"""Every named query against its SQL, golden counts, and the shape of the main plan."""

import re

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry_points
from stridelake.plans.oracle import ORACLE
from stridelake.plans.pipeline import Replay
from stridelake.plans.queries import QUERIES
from stridelake.sources.events import activity, read_events

SMALL = "/root/testdata/sf0.001"
GOLDEN = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert QUERIES.items() <= entry_points.queries().items() and ORACLE.items() <= entry_points.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    assert compare(spark, duck, name, QUERIES[name], ORACLE[name], SMALL) is None


@pytest.mark.parametrize("hidden", ["stridelake.llm", "xxhash", "regex", "ahocorasick", "public_tokenizers"])
def test_core_queries_need_no_text_operators(hidden):
    import subprocess
    import sys
    from pathlib import Path

    code = (
        f"import sys; sys.modules[{hidden!r}] = None; import __spark_entry__ as e; from stridelake.plans.queries import QUERIES;"
        "print(set(QUERIES) <= set(e.queries()) and set(QUERIES) <= set(e.oracle_sql()))"
    )
    root = Path(__file__).resolve().parent.parent
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=root, capture_output=True, text=True)
    assert done.stdout.strip() == "True", done.stderr


def test_entry(spark):
    assert entry_points.entry(spark).count() == 104


def test_golden_counts(spark):
    queries = entry_points.queries()

    def counts(name, column):
        return {r[0]: r[1] for r in queries[name](spark, GOLDEN).groupBy(column).count().collect()}

    assert counts("daily_steps", "label") == {
        "daily_low_stepper": 564, "daily_medium_stepper": 1845, "daily_high_stepper": 1597,
    }
    assert counts("weekly_label", "week_label") == {"": 2468, "low": 996, "medium_or_high": 542}
    assert counts("weekly_label_changelog", "week_label") == {"": 6173, "low": 2560, "medium_or_high": 1267}
    assert counts("weekly_label_latest", "week_label") == {"": 73, "low": 51, "medium_or_high": 26}
    assert queries["notification_candidates"](spark, GOLDEN).count() == 1241
    assert queries["notifications"](spark, GOLDEN).count() == 1241
    assert queries["notifications_six_hours"](spark, GOLDEN).count() == 874
    assert queries["late_rows"](spark, GOLDEN).count() == 43


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_notifications_shuffle_the_rows_once(spark):
    plan = plan_of(Replay(activity(read_events(spark, SMALL))).notifications())
    exchanges = re.findall(r"Exchange hashpartitioning\((\w+)", plan)
    assert exchanges == ["key"]
    # The closings of the days are joined by broadcast, the scan reads four columns.
    assert plan.count("BroadcastHashJoin") == 1
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in plan


def test_daily_sums_are_partly_done_before_the_shuffle(spark):
    plan = plan_of(entry_points.queries()["daily_steps"](spark, SMALL))
    on_raw_rows = plan[plan.rindex("Exchange") :]
    assert "HashAggregate" in on_raw_rows and "partial_sum" in on_raw_rows and "Sort" not in on_raw_rows
    # Weekly labels need no user ids: one shuffle for the days, one for the keys.
    weekly = plan_of(entry_points.queries()["weekly_label"](spark, SMALL))
    assert re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", weekly)[0].startswith("key")
    assert weekly.count("Exchange hashpartitioning") == 2 and "SortAggregate" not in weekly
