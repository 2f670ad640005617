"""Streams against batch replay, restarts, and batches that are run twice."""

import pytest
from conftest import at
from test_timeline import random_rows

from stridelake.operators.event_time import with_event_time
from stridelake.operators.latest import latest_labels
from stridelake.plans.pipeline import Replay, Settings
from stridelake.schemas import ACTIVITY, ACTIVITY_FIELDS
from stridelake.sources import events as feeds
from stridelake.sources.activity_json import decode_normalized, encode_normalized
from stridelake.sources.streams import FEED, files
from stridelake.streaming import pipeline, sinks
from stridelake.streaming.metrics import ObservedMetrics, rows_dropped
from stridelake.streaming.clock import with_clock
from stridelake.streaming.stateful import Changes, changes

SETTINGS = Settings(debounce_seconds=3600, unique_ids=True)
CLOCKED = ACTIVITY + ", stream_time timestamp"


def add_file(rows, path):
    rows.coalesce(1).write.mode("append").parquet(path)


def same(one, other):
    return one.exceptAll(other).count() == 0 and other.exceptAll(one).count() == 0


@pytest.fixture
def clocked(activity):
    return with_event_time(activity(*random_rows(3, keys=4, count=300))).select(*ACTIVITY_FIELDS, "stream_time").cache()


def run_changes(spark, folders):
    stream = files(spark, folders["in"], CLOCKED, files_per_batch=1)
    pipeline.start_changes(stream, folders["out"], folders["checkpoint"], SETTINGS, once=True).awaitTermination()


def test_changes_equal_replay_across_a_restart(spark, tmp_path, clocked):
    folders = {name: str(tmp_path / name) for name in ("in", "out", "checkpoint")}
    for low, high in ((0, 90), (90, 140)):
        add_file(clocked.where(f"arrival_seq >= {low} AND arrival_seq < {high}"), folders["in"])
    run_changes(spark, folders)
    add_file(clocked.where("arrival_seq >= 140"), folders["in"])
    run_changes(spark, folders)

    replay = Replay(clocked, SETTINGS)
    timeline = replay.timeline().drop("block").cache()
    log = sinks.read_log(spark, folders["out"], sinks.CHANGES)
    assert log.select("batch_id").distinct().count() == 3
    assert same(log.select(*timeline.columns), timeline)

    sent = replay.notifications()
    assert sent.count() > 0
    for table in (sinks.NOTIFICATIONS, sinks.NOTIFICATION_TABLE):
        assert same(sinks.read_log(spark, folders["out"], table).select(*sent.columns), sent)

    labels = latest_labels(timeline)
    assert same(sinks.current(spark, folders["out"], sinks.LABELS).select(*labels.columns), labels)
    assert sinks.compact(spark, folders["out"], sinks.LABELS) == 2
    sinks.write_batch(spark.createDataFrame([("k0", 9999, "low")], labels.schema), folders["out"], sinks.LABELS, 3)
    current = sinks.current(spark, folders["out"], sinks.LABELS)
    assert same(current.where("key <> 'k0'").select(*labels.columns), labels.where("key <> 'k0'"))
    assert current.where("key = 'k0'").first().week_label == "low"


def test_a_repeated_batch_changes_nothing(spark, tmp_path, activity):
    base, outbox = str(tmp_path / "out"), str(tmp_path / "outbox")
    changes = (
        Replay(activity(*[("u", at(d), 2000) for d in range(8)]), SETTINGS)
        .timeline()
        .selectExpr("*", "label_seen <=> 'medium_or_high' AS notified")
    )
    write, deliver = sinks.write_changes(base, unique_ids=True), sinks.deliver_to(outbox)
    for _ in range(2):
        write(changes, 4)
        deliver(sinks.read_log(spark, base, sinks.NOTIFICATIONS).drop("batch_id"), 4)
    assert sinks.read_log(spark, base, sinks.CHANGES).count() == 8
    assert sinks.read_log(spark, base, sinks.NOTIFICATIONS).count() == 1
    assert spark.read.parquet(outbox).count() == 1
    # The same notification in a later batch is not sent again either, a new one is.
    deliver(sinks.read_log(spark, base, sinks.NOTIFICATIONS).drop("batch_id"), 5)
    write(changes.selectExpr("* EXCEPT (arrival_seq)", "arrival_seq + 100 AS arrival_seq"), 5)
    deliver(sinks.read_log(spark, base, sinks.NOTIFICATIONS).where("batch_id = 5").drop("batch_id"), 6)
    assert spark.read.parquet(outbox).count() == 2


def test_delivery_stream(spark, tmp_path, activity):
    from stridelake.operators.notify import notification_fields

    rows = notification_fields(activity(("u", at(), 1), ("v", at(1), 1)), unique_ids=True)
    source, outbox = str(tmp_path / "in"), str(tmp_path / "outbox")
    add_file(rows, source)
    add_file(rows, source)
    stream = files(spark, source, "key string, arrival_seq bigint, userId string, notificationId string, "
                   "payload string, timestamp timestamp", files_per_batch=1)
    pipeline.start_delivery(stream, outbox, str(tmp_path / "checkpoint"), once=True).awaitTermination()
    assert spark.read.parquet(outbox).count() == 2


def test_delivery_of_repeated_and_late_batches_reads_no_outbox(spark, tmp_path, activity):
    """A batch that comes twice, one that comes late with times before it, and one of both."""
    from stridelake.operators.notify import notification_fields
    from stridelake.schemas import NOTIFICATION_ROW

    rows = notification_fields(activity(*[(f"u{i % 3}", at(i / 4), 1) for i in range(40)]))
    source, outbox = str(tmp_path / "in"), str(tmp_path / "outbox")
    checkpoint = str(tmp_path / "checkpoint")

    def deliver(part):
        add_file(part, source)
        stream = files(spark, source, NOTIFICATION_ROW, files_per_batch=1)
        query = pipeline.start_delivery(stream, outbox, checkpoint, once=True)
        query.awaitTermination()
        return rows_dropped(query)

    for part in ("arrival_seq >= 20", "arrival_seq >= 25", "arrival_seq < 10", "arrival_seq < 30"):
        assert deliver(rows.where(part)) == 0
    sent = spark.read.parquet(outbox)
    assert sent.count() == 40 and sent.select("key", "arrival_seq").distinct().count() == 40
    assert sent.where("day = date'2024-01-01'").count() > 0
    # Far behind the newest one nothing is known any more: such rows are counted, not sent twice.
    deliver(notification_fields(activity(("u9", at(100), 1))).selectExpr("* EXCEPT (arrival_seq)", "99L AS arrival_seq"))
    assert deliver(rows.where("arrival_seq = 0")) == 1
    assert spark.read.parquet(outbox).count() == 41


def test_normalization_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ios, android, out = (str(tmp_path / name) for name in ("ios", "android", "out"))
    add_file(feeds.ios_feed(events), ios)
    add_file(feeds.android_feed(events), android)
    merged = pipeline.normalized(files(spark, ios), files(spark, android))
    pipeline.start_normalization(merged, out, str(tmp_path / "checkpoint"), once=True).awaitTermination()
    got = decode_normalized(spark.read.schema(FEED).parquet(out))
    assert same(got, feeds.activity(events).select(*got.columns))
    assert same(encode_normalized(got), spark.read.schema(FEED).parquet(out))


def test_idle_keys_are_forgotten(spark, tmp_path, activity):
    folders = {name: str(tmp_path / name) for name in ("in", "out", "checkpoint")}
    weeks = [("u", at(d), 2000) for d in range(7)]
    others = [("v", at(40), 1), ("v", at(41), 1)]
    back = [("u", at(60), 2000), ("u", at(61), 2000)]
    weeks += others + back
    for low, high in ((0, 7), (7, 8), (8, 9), (9, 10), (10, 11)):
        add_file(activity(*weeks).where(f"arrival_seq >= {low} AND arrival_seq < {high}"), folders["in"])
    stream = files(spark, folders["in"], ACTIVITY, files_per_batch=1)
    pipeline.start_changes(
        stream, folders["out"], folders["checkpoint"], SETTINGS, idle_days=10, once=True
    ).awaitTermination()
    log = {r.arrival_seq: r.label_seen for r in sinks.read_log(spark, folders["out"], sinks.CHANGES).collect()}
    assert len(log) == 11 and log[6] == "" and log[9] is None and log[10] == ""


def test_daily_stream_reports_what_it_observed(spark, tmp_path, activity):
    listener = ObservedMetrics()
    spark.streams.addListener(listener)
    try:
        source, base = str(tmp_path / "in"), str(tmp_path / "out")
        add_file(activity(("u", at(), 600), ("u", at(hours=1), 600), ("v", at(), 10)), source)
        query = pipeline.start_daily(files(spark, source, ACTIVITY), base, str(tmp_path / "checkpoint"), once=True)
        query.awaitTermination()
        rows = {(r.key, r.steps, r.label) for r in sinks.read_log(spark, base, "daily_totals").collect()}
        assert rows == {("u", 1200, "daily_medium_stepper"), ("v", 10, "daily_low_stepper")}
        import time

        for _ in range(50):
            if str(query.id) in listener.input_rows and listener.observed:
                break
            time.sleep(0.1)
        assert listener.input_rows[str(query.id)] == 3
        assert listener.failures == []
    finally:
        spark.streams.removeListener(listener)


def test_a_key_with_half_of_the_rows_is_never_in_memory_as_a_whole(spark, tmp_path, activity, monkeypatch):
    """Its rows come in offset order, batch by batch, from files that are cut at random."""
    rows = [("hot", at(minutes=i // 3), 3) for i in range(4000)] + [(f"k{i % 900}", at(i / 900), 50) for i in range(4000)]
    table = activity(*sorted(rows, key=lambda row: row[1])).cache()
    folders = {name: str(tmp_path / name) for name in ("in", "out", "checkpoint")}
    table.repartition(5).write.parquet(folders["in"])
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "100")
    try:
        stream = files(spark, folders["in"], ACTIVITY, files_per_batch=None)
        pipeline.start_changes(stream, folders["out"], folders["checkpoint"], SETTINGS, once=True).awaitTermination()
    finally:
        spark.conf.unset(name)
    log = sinks.read_log(spark, folders["out"], sinks.CHANGES)
    assert log.select("batch_id").distinct().count() == 1
    assert sinks.read_log(spark, folders["out"], sinks.BEHIND).count() == 0
    replay = Replay(table, SETTINGS).timeline().drop("block")
    assert same(log.select(*replay.columns), replay)


def test_rows_of_a_key_are_taken_in_batches():
    import pandas as pd

    class Value:
        stored = None

        def get(self):
            return self.stored

        def update(self, value):
            self.stored = value

    taken = []

    def batches():
        for i in range(50):
            taken.append(i)
            yield pd.DataFrame(
                {"arrival_seq": [i], "userId": ["u"], "time_us": [i * 3_600_000_000], "stream_us": [-(2**62)], "steps": [10]}
            )

    processor = Changes(3600, 10, False, None)
    processor.value = Value()
    for i, frame in enumerate(processor.handleInputRows(("u",), batches(), None)):
        assert len(frame) == 1 and len(taken) == i + 1
    assert processor.value.stored[:2] == ([0, 1, 2], [240, 240, 20])


def test_clock_and_changes_in_one_query(spark, tmp_path, activity, clocked):
    """The clock of the source partition goes on from batch to batch; records without a key move it too."""
    rows = clocked.drop("stream_time").selectExpr("* EXCEPT (key)", "IF(arrival_seq % 11 = 0, NULL, key) AS key")
    folders = {name: str(tmp_path / name) for name in ("in", "out", "checkpoint")}
    for low, high in ((0, 60), (60, 61), (61, 200), (200, 300)):
        add_file(rows.where(f"arrival_seq >= {low} AND arrival_seq < {high}"), folders["in"])
        stream = with_clock(files(spark, folders["in"], ACTIVITY, files_per_batch=1))
        pipeline.start_changes(stream, folders["out"], folders["checkpoint"], SETTINGS, once=True).awaitTermination()
    replay = Replay(rows, SETTINGS).timeline().drop("block")
    log = sinks.read_log(spark, folders["out"], sinks.CHANGES)
    assert log.select("batch_id").distinct().count() == 4
    assert same(log.select(*replay.columns), replay)
    assert replay.where("NOT on_time").count() > 0


def test_keyed_streams_run_where_workers_cannot_import_the_package(tmp_path):
    """A fresh process in another folder, without the package on the workers' path."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    script = tmp_path / "run.py"
    script.write_text(
        "import sys\n"
        f"sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})\n"
        "import __spark_entry__ as entry\n"
        "from stridelake.session import build_session\n"
        "settings = {'spark.sql.shuffle.partitions': '2', 'spark.ui.enabled': 'false'}\n"
        "spark = build_session(master='local[2]', **settings)\n"
        "for name in ('stream_changes', 'stream_late_changes', 'stream_notifications_given'):\n"
        "    print(name, entry.queries()[name](spark, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert "stream_changes 1000" in done.stdout and "stream_late_changes 1000" in done.stdout


def test_state_comes_with_the_rows_of_its_key(spark, tmp_path, activity, capfd):
    """Many keys of few rows: their state travels in the batches of rows, not in a call to the store for each key."""
    from stridelake.streaming import given

    add_file(activity(("a", at(), 10)), str(tmp_path / "in"))
    stream = files(spark, str(tmp_path / "in"), ACTIVITY)
    labels = stream.selectExpr("key", "arrival_seq AS change_seq", "timestamp", "userId AS label")
    sent = stream.selectExpr("key", "arrival_seq AS change_seq", "timestamp", "timestamp AS sent_at")
    for rows in (changes(stream), given.join_given_tables(stream, labels, sent)):
        rows.explain(True)
        plan = capfd.readouterr().out
        assert "FlatMapGroupsInPandasWithState" in plan and "TransformWithState" not in plan
