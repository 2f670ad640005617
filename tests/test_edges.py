"""What must not depend on files, batches or sessions, and what must not vanish."""

import pytest
from conftest import at
from oracle_check import compare, connect
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from stridelake.functions.rules import day_number, utc_day
from stridelake.operators.daily import daily_steps
from stridelake.operators.event_time import with_event_time
from stridelake.plans import queries
from stridelake.plans.oracle import ORACLE
from stridelake.plans.pipeline import Replay, Settings
from stridelake.schemas import ACTIVITY, ACTIVITY_FIELDS
from stridelake.sources.activity_json import check_normalized, decode_normalized, quarantined
from stridelake.sources.streams import FEED, files
from stridelake.sources.events import late_activity, read_events
from stridelake.streaming import clock, pipeline, sinks

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def in_los_angeles(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    yield
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_days_are_utc_days_in_any_session(spark, activity, in_los_angeles):
    rows = activity(("u", at(0.6), 700), ("u", at(0.9), 700), ("u", at(-1000.5), 1))
    got = rows.select(day_number(F.col("timestamp")), F.unix_micros(utc_day(F.col("timestamp")))).collect()
    assert [tuple(r) for r in got] == [(19724, 19724 * 86_400_000_000)] * 2 + [(18722, 18722 * 86_400_000_000)]
    assert {(str(r.day), r.steps) for r in daily_steps(rows).collect()} == {("2024-01-02", 1400), ("2021-04-05", 1)}


@pytest.mark.parametrize("name", ["stream_daily_steps", "stream_changes"])
def test_streams_do_not_depend_on_files(spark, tmp_path, name):
    events = spark.read.parquet(f"{SMALL}/events.parquet").orderBy(F.rand(4))
    events.repartition(150).write.parquet(str(tmp_path / "events.parquet"))
    assert compare(spark, connect(SMALL), name, _elsewhere(name, str(tmp_path)), ORACLE[name], SMALL) is None


def _elsewhere(name, folder):
    return lambda spark, _: queries.QUERIES[name](spark, folder)


def test_records_behind_are_set_aside(spark, tmp_path, activity):
    folders = {name: str(tmp_path / name) for name in ("in", "out", "checkpoint")}
    rows = activity(*[("u", at(d), 2000) for d in range(9)])
    for part in ("arrival_seq < 5", "arrival_seq >= 7", "arrival_seq IN (5, 6)"):
        rows.where(part).coalesce(1).write.mode("append").parquet(folders["in"])
    stream = files(spark, folders["in"], ACTIVITY, files_per_batch=1)
    pipeline.start_changes(stream, folders["out"], folders["checkpoint"], once=True).awaitTermination()
    read = lambda table: {r.arrival_seq for r in sinks.read_log(spark, folders["out"], table).collect()}
    assert read(sinks.BEHIND) == {5, 6} and read(sinks.CHANGES) == {0, 1, 2, 3, 4, 7, 8}


def test_the_clock_goes_on_from_batch_to_batch(spark, tmp_path):
    rows = late_activity(read_events(spark, SMALL)).select(*ACTIVITY_FIELDS)
    base, source = str(tmp_path / "out"), str(tmp_path / "in")
    for low in range(0, 300, 100):
        rows.where(f"arrival_seq > {low} AND arrival_seq <= {low + 100}").coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):
        stream = files(spark, source, ACTIVITY, files_per_batch=1)
        clock.start_clock(stream, base, str(tmp_path / "checkpoint"), once=True).awaitTermination()
    got = sinks.read_log(spark, base, clock.CLOCKED)
    want = with_event_time(rows).select(*ACTIVITY_FIELDS, "stream_time")
    assert got.select("batch_id").distinct().count() == 3
    assert got.drop("batch_id").exceptAll(want).isEmpty() and got.count() == want.count()


def test_records_without_key_or_count(activity):
    week = [("u", at(d), None if d == 3 else 2000) for d in range(8)]
    replay = Replay(activity(*week, (None, at(1), 50), (None, at(2), 50)))
    assert replay.without_key().count() == 2
    rows = {r.arrival_seq: (r.steps, r.day_label) for r in replay.timeline().collect()}
    assert len(rows) == 8 and rows[3] == (0, "daily_low_stepper")
    assert {r.key for r in daily_steps(replay.activity).collect()} == {"u"}


def test_normalized_faults_are_reported(spark):
    values = ['{"userId":"u","timestamp":"2024-01-01T10:00:00Z"}', "garbage", '{"userId":"u","steps":"x"}', None]
    feed = spark.createDataFrame([("u", 0, i, v) for i, v in enumerate(values)], FEED)
    got = {r.arrival_seq: (r.userId, r.steps) for r in decode_normalized(feed).collect()}
    assert got == {0: ("u", 0), 3: (None, None)}
    faults = {r.arrival_seq for r in quarantined(check_normalized(feed)).collect()}
    assert faults == {1, 2, 3}


def test_only_a_missing_path_counts_as_missing(spark, tmp_path):
    assert sinks.read_if_there(spark, str(tmp_path / "none")) is None
    (tmp_path / "empty").mkdir()
    with pytest.raises(AnalysisException):
        sinks.read_if_there(spark, str(tmp_path / "empty"))


def test_delivery_with_the_constant_id(spark, tmp_path, activity):
    weeks = activity(*[("u", at(d), 2000) for d in range(12)])
    sent = Replay(weeks, Settings(debounce_seconds=10)).notifications()
    deliver = sinks.deliver_to(str(tmp_path / "outbox"))
    for batch in (0, 1):
        deliver(sent, batch)
    assert sent.count() == 5 and spark.read.parquet(str(tmp_path / "outbox")).count() == 5


def test_debounce_across_small_arrow_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        for query in ("debounce", "late_notifications", "notifications_in_blocks"):
            assert compare(spark, connect(SMALL), query, queries.QUERIES[query], ORACLE[query], SMALL) is None
    finally:
        spark.conf.set(name, before)
