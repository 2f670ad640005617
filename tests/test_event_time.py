from datetime import datetime, timedelta, timezone

import pytest
from conftest import at
from pyspark.sql import functions as F

from stridelake.operators.daily import daily_steps, observed
from stridelake.operators.event_time import with_event_time, with_lateness
from stridelake.operators.skew import SkewPolicy, hot_keys, number_in_order
from pyspark.sql import Observation

DAY_END = datetime(2024, 1, 2, tzinfo=timezone.utc)


def on_time(rows):
    return [r.on_time for r in with_lateness(rows).orderBy("partition_id", "arrival_seq").collect()]


def test_grace_ends_exactly_one_hour_after_the_day(activity):
    milli = timedelta(milliseconds=1)
    kept = activity(("a", at(), 1), ("b", DAY_END + timedelta(hours=1) - milli, 1), ("a", DAY_END - milli, 1))
    dropped = activity(("a", at(), 1), ("b", DAY_END + timedelta(hours=1), 1), ("a", DAY_END - milli, 1))
    assert on_time(kept) == [True, True, True]
    assert on_time(dropped) == [True, True, False]


def test_each_source_partition_has_its_own_clock(activity):
    ahead = activity(("a", at(5), 1))
    behind = activity(("b", at(0), 1), partition=1).withColumn("arrival_seq", F.lit(9).cast("bigint"))
    assert on_time(ahead.unionByName(behind)) == [True, True]


def test_clock_never_goes_back_and_skips_days(activity):
    rows = activity(("a", at(0), 1), ("a", at(9), 1), ("a", at(3), 1), ("a", at(8.5), 1), ("a", at(9), 1))
    # The record nine days on is past one in the morning, so it closes the day before it.
    assert on_time(rows) == [True, True, False, False, True]


@pytest.mark.parametrize("block_rows", [1, 2, 1000])
def test_stream_time_fills_missing_bodies(spark, block_rows):
    times = [None, at(1), None, at(0), None, at(2), None]
    rows = spark.createDataFrame([(0, i, t) for i, t in enumerate(times)], "partition_id int, arrival_seq long, timestamp timestamp")
    out = with_event_time(rows, SkewPolicy(block_rows=block_rows)).orderBy("arrival_seq").collect()
    day = lambda t: None if t is None else t.day
    assert [day(r.event_time) for r in out] == [None, 2, 2, 1, 2, 3, 3]
    assert [day(r.stream_time) for r in out] == [None, 2, 2, 2, 2, 3, 3]


def test_numbering_is_dense_across_buckets(spark):
    rows = spark.createDataFrame(
        [(i % 2, at(hours=(i * 7) % 11), i) for i in range(40)], "partition_id int, arrived timestamp, event_id int"
    )
    out = number_in_order(rows, "partition_id", "arrived", "event_id").collect()
    for partition in (0, 1):
        mine = sorted((r.arrived, r.event_id, r.arrival_seq) for r in out if r.partition_id == partition)
        assert [seq for _, _, seq in mine] == list(range(1, 21))


def test_hot_keys(activity):
    rows = activity(*[("a", at(), 1)] * 5, ("b", at(), 1))
    assert [r.key for r in hot_keys(rows, SkewPolicy(hot_rows=4)).collect()] == ["a"]
    assert hot_keys(rows, SkewPolicy(hot_rows=5)) is None
    assert hot_keys(rows, SkewPolicy(hot_rows=100)) is None


def test_daily_sums_follow_the_key_and_the_last_user(activity):
    rows = activity(
        ("k", at(), 500, "u1"), ("k", at(hours=1), 400, "u2"), ("k", at(1), 5000, "u1"), ("j", at(), 1000, "u1")
    )
    watch = Observation()
    daily = observed(daily_steps(rows), watch)
    got = {(r.key, r.userId, r.steps, r.day.day, r.label) for r in daily.collect()}
    assert got == {
        ("k", "u2", 900, 1, "daily_low_stepper"),
        ("k", "u1", 5000, 2, "daily_high_stepper"),
        ("j", "u1", 1000, 1, "daily_medium_stepper"),
    }
    assert watch.get == {
        "rows": 3, "steps": 6900, "daily_low_stepper": 1, "daily_medium_stepper": 1, "daily_high_stepper": 1,
    }


def test_totals_do_not_wrap(activity):
    rows = activity(*[("k", at(), 2_000_000_000)] * 3)
    assert daily_steps(rows).first().steps == 6_000_000_000
