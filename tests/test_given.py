"""Given tables in batch and stream: the same two logs give the same rows, whole or in parts."""

import random

import pytest
from conftest import at

from stridelake.operators.latest import current_rows
from stridelake.operators.notify import notification_fields
from stridelake.plans import given
from stridelake.schemas import ACTIVITY
from stridelake.sources.streams import files
from stridelake.streaming import given as running
from stridelake.streaming import sinks
from stridelake.streaming.tables import KeyedTable, start_table

LABELS = "key string, change_seq bigint, timestamp timestamp, label string"
SENT = "key string, change_seq bigint, timestamp timestamp, sent_at timestamp"
TABLE = "key string, change_seq bigint, label string"


def add_file(rows, path):
    rows.coalesce(1).write.mode("append").parquet(path)


def same(one, other):
    return one.exceptAll(other).count() == 0 and other.exceptAll(one).count() == 0


def logs(spark, activity, seed=2, count=400):
    rng = random.Random(seed)
    key = lambda: f"k{rng.randrange(5)}"
    times = sorted(at(minutes=rng.randrange(3000)) for _ in range(count))
    rows = activity(*[(key(), time, 100) for time in times])
    labels = [(key(), i, at(minutes=rng.randrange(3000)), rng.choice(["medium_or_high", "medium_or_high", "low", "", None]))
              for i in range(120)]
    sent = []
    for i in range(120):
        time = at(minutes=rng.randrange(3000))
        sent.append((key(), i, time, rng.choice([time, time, None])))
    return rows, spark.createDataFrame(labels, LABELS), spark.createDataFrame(sent, SENT)


def batch(activity, labels, sent, seconds):
    return notification_fields(given.far_enough(given.candidates_with_last(activity, labels, sent), seconds))


@pytest.mark.parametrize("cuts", [[3000], [500, 1700, 3000]], ids=["whole", "in three parts"])
def test_stream_equals_batch(spark, activity, tmp_path, cuts):
    tables = logs(spark, activity)
    names, schemas = ("activity", "labels", "sent"), (ACTIVITY, LABELS, SENT)
    start = -1
    for cut in cuts:
        for name, table in zip(names, tables):
            part = table.where(f"unix_seconds(timestamp) - {int(at().timestamp())} > {start * 60}")
            part = part.where(f"unix_seconds(timestamp) - {int(at().timestamp())} <= {cut * 60}")
            add_file(part, str(tmp_path / name))
        streams = [files(spark, str(tmp_path / name), schema, files_per_batch=None) for name, schema in zip(names, schemas)]
        running.start_given(
            *streams, str(tmp_path / "out"), str(tmp_path / "checkpoint"), 3600, once=True
        ).awaitTermination()
        start = cut
    want = batch(*tables, 3600)
    assert want.count() > 5
    got = sinks.read_log(spark, str(tmp_path / "out"), sinks.NOTIFICATIONS)
    assert same(got.select(*want.columns), want)
    joined = sinks.read_log(spark, str(tmp_path / "out"), "joined")
    assert joined.select("batch_id").distinct().count() == len(cuts)
    labelled = given.join_given_labels(tables[0], tables[1])
    assert same(joined.where("label IS NOT NULL").select(*labelled.columns), labelled)


def random_changes(seed, count=300):
    rng = random.Random(seed)
    changes = [(f"k{rng.randrange(40)}", i, rng.choice(["low", "", None, None])) for i in range(count)]
    return changes + [(None, count, "low")]


def test_table_in_any_order_of_batches(spark, tmp_path):
    """Deletes, keys that come back, batches that are repeated, and older changes that come late."""
    changes = random_changes(1)
    want = {}
    for key, seq, label in changes:
        want[key] = (seq, label)
    want = {(k, *v) for k, v in want.items() if v[1] is not None and k is not None}
    log = spark.createDataFrame(changes, TABLE)
    assert {tuple(r) for r in current_rows(log).collect()} == want
    random.Random(2).shuffle(changes)
    table = KeyedTable(spark, str(tmp_path / "table"), TABLE, buckets=7)
    assert table.current().count() == 0
    for version in range(6):
        part = spark.createDataFrame(changes[version::6], TABLE)
        for _ in range(1 + version % 2):
            table.merge(part, version)
    assert {tuple(r) for r in table.current().collect()} == want


def test_table_writes_the_touched_buckets_only(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "table"), TABLE, buckets=16)
    table.merge(spark.createDataFrame([(f"k{i}", i, "low") for i in range(200)], TABLE), 0)
    table.merge(spark.createDataFrame([("k7", 1000, None)], TABLE), 1)
    assert len(list((tmp_path / "table/data/version=0").glob("bucket=*"))) == 16
    assert len(list((tmp_path / "table/data/version=1").glob("bucket=*"))) == 1
    assert table.current().count() == 199
    # A batch that stopped before its last step leaves the table as it was.
    table.merge(spark.createDataFrame([], TABLE), 2)
    assert table.current().count() == 199


def test_table_from_a_stream(spark, tmp_path):
    changes = random_changes(3)
    source = str(tmp_path / "in")
    table = KeyedTable(spark, str(tmp_path / "table"), TABLE)
    for start in range(0, len(changes), 110):
        add_file(spark.createDataFrame(changes[start : start + 110], TABLE), source)
        stream = files(spark, source, TABLE, files_per_batch=1)
        start_table(stream, table, str(tmp_path / "checkpoint"), once=True).awaitTermination()
    assert same(table.current(), current_rows(spark.createDataFrame(changes, TABLE)))
