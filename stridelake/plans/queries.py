"""Named queries over the `events` table: one for each operator, and the job as a whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridelake.functions.rules import daily_label, utc_day
from stridelake.operators import daily, event_time, history, latest, normalize, notify
from stridelake.plans import given
from stridelake.operators.debounce import debounce
from stridelake.operators.skew import SkewPolicy
from stridelake.plans.pipeline import Replay, Settings
from stridelake.schemas import ACTIVITY, ACTIVITY_FIELDS, NOTIFICATION_ROW
from stridelake.session import new_path, staged, use_utc
from stridelake.sources import activity_json as codec
from stridelake.sources import events as feed
from stridelake.sources import streams
from stridelake.streaming import clock, debounced, sinks
from stridelake.streaming import given as running_given
from stridelake.streaming import pipeline as running
from stridelake.streaming.metrics import rows_dropped
from stridelake.streaming.tables import KeyedTable, start_table

# Candidates of this data are more than ten seconds apart; six hours makes the debounce work.
SIX_HOURS = 6 * 3600
SLOW = Settings(debounce_seconds=SIX_HOURS)
# The way of hot keys, for every key: blocks that a small table has several of.
BLOCKS = SkewPolicy(hot_rows=0, block_rows=500)
SLOW_BLOCKS = Settings(debounce_seconds=SIX_HOURS, skew=BLOCKS)
HOUR = 3600
CANDIDATE = "key string, arrival_seq bigint, timestamp timestamp"
LABEL_TABLE = "key string, change_seq bigint, label string"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"

Query = Callable[[SparkSession, str], DataFrame]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.read_events(use_utc(spark), sf_dir)


def _activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.activity(_events(spark, sf_dir))


def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The late feed, numbered once for all the passes over it."""
    return staged(feed.late_activity(_events(spark, sf_dir)), "late-feed")


def _very_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(feed.very_late_activity(_events(spark, sf_dir)), "very-late-feed")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finished table in one micro-batch, so that it doesn't matter how it is cut into files."""
    return streams.files(use_utc(spark), f"{sf_dir}/events.parque[t]", EVENTS, files_per_batch=None)


def _plain_times(df: DataFrame) -> DataFrame:
    """Times without a zone, as the tables have them."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else f.name
            for f in df.schema.fields
        ]
    )


# Sources and sinks


def decode_ios(spark, sf_dir):
    decoded = codec.decode_ios(feed.ios_feed(_events(spark, sf_dir)))
    record = F.col("record")
    return _plain_times(
        codec.accepted(decoded).select(
            "key",
            "partition_id",
            "arrival_seq",
            record["UserId"].alias("user_id"),
            record["UserGender"].alias("gender"),
            record["UserHeight"].alias("height"),
            record["UserWeight"].alias("weight"),
            record["PhysicalActivity"]["Sleep_hours"].alias("sleep_hours"),
            record["PhysicalActivity"]["walking_steps"].alias("walking_steps"),
            record["Geo_lat"].alias("lat"),
            record["Geo_lon"].alias("lon"),
            record["pincode"].alias("pincode"),
            record["event_timestamp"].alias("event_timestamp"),
        )
    )


def decode_android(spark, sf_dir):
    decoded = codec.decode_android(feed.android_feed(_events(spark, sf_dir)))
    record = F.col("record")
    return _plain_times(
        codec.accepted(decoded).select(
            "key",
            "partition_id",
            "arrival_seq",
            record["Person"]["Id"].alias("user_id"),
            record["Person"]["Gender"].alias("gender"),
            record["Person"]["Height"].alias("height"),
            record["Person"]["Weight"].alias("weight"),
            record["Activity"]["Sleep_hours"].alias("sleep_hours"),
            record["Activity"]["walking_steps"].alias("walking_steps"),
            record["Location"].isNotNull().alias("located"),
            record["Location"]["lat"].alias("lat"),
            record["Location"]["pincode"].alias("pincode"),
            record["ts"].alias("ts"),
        )
    )


def quarantine(spark, sf_dir):
    """Documents of another kind mixed into the iOS feed come out with their text and the fault."""
    events = _events(spark, sf_dir)
    mixed = feed.ios_feed(events).unionByName(feed.foreign_feed(events))
    return codec.quarantined(codec.decode_ios(mixed))


def encode_normalized(spark, sf_dir):
    return codec.encode_normalized(_activity(spark, sf_dir))


def event_time_query(spark, sf_dir):
    rows = event_time.with_event_time(feed.activity_with_gaps(_events(spark, sf_dir)))
    return _plain_times(rows.select("key", "partition_id", "arrival_seq", "event_time", "stream_time"))


def last_notification(spark, sf_dir):
    return _plain_times(latest.last_notifications(Replay(_activity(spark, sf_dir), SLOW).notifications()))


def weekly_label_latest(spark, sf_dir):
    return latest.latest_labels(Replay(_activity(spark, sf_dir)).timeline())


# Projections


def normalize_ios(spark, sf_dir):
    decoded = codec.decode_ios(feed.ios_feed(_events(spark, sf_dir)))
    return _plain_times(normalize.normalize_ios(codec.accepted(decoded)))


def normalize_android(spark, sf_dir):
    decoded = codec.decode_android(feed.android_feed(_events(spark, sf_dir)))
    return _plain_times(normalize.normalize_android(codec.accepted(decoded)))


def normalize_union(spark, sf_dir):
    events = _events(spark, sf_dir)
    return _plain_times(running.normalized(feed.ios_feed(events), feed.android_feed(events)))


def step_label(spark, sf_dir):
    rows = _activity(spark, sf_dir).select(
        "key",
        "arrival_seq",
        "steps",
        daily_label(F.col("steps")).alias("label"),
        utc_day(F.col("timestamp")).alias("day_start"),
    )
    return _plain_times(rows)


# Daily sums


def daily_steps(spark, sf_dir):
    return daily.daily_steps(_activity(spark, sf_dir))


def daily_metrics(spark, sf_dir):
    """What is observed while the daily rows pass: their number, all steps, and the count of each label."""
    seen = Observation("daily_metrics")
    rows = daily.observed(daily.daily_steps(_activity(spark, sf_dir)), seen)
    rows.write.format("noop").mode("overwrite").save()
    names = ["rows", "steps", *daily.LABELS]
    schema = ", ".join(f"{name} bigint" for name in names)
    return spark.createDataFrame([tuple(seen.get[name] for name in names)], schema)


def _day_changes(timeline: DataFrame) -> DataFrame:
    return timeline.where("on_time").select("key", "arrival_seq", "userId", "day", "steps", "day_label")


def daily_steps_changelog(spark, sf_dir):
    return _day_changes(Replay(_activity(spark, sf_dir)).timeline())


def late_steps_changelog(spark, sf_dir):
    return _day_changes(Replay(_late(spark, sf_dir)).timeline())


def daily_steps_grace(spark, sf_dir):
    return daily.daily_steps(event_time.with_lateness(_late(spark, sf_dir)).where("on_time"))


def late_rows(spark, sf_dir):
    rows = event_time.with_lateness(_late(spark, sf_dir)).where("not on_time")
    return _plain_times(rows.select("event_id", "key", "partition_id", "arrival_seq", "timestamp"))


# Seven-day history


def history7(spark, sf_dir):
    return history.last_days(daily.day_totals(_activity(spark, sf_dir)))


def gap_check(spark, sf_dir):
    return history.gaps(daily.day_totals(_activity(spark, sf_dir)))


def weekly_label(spark, sf_dir):
    return history.week_labels(daily.day_totals(_activity(spark, sf_dir)))


def weekly_all_match(spark, sf_dir):
    """The test on the kept labels as one collection, seven at most for each key."""
    kept = history.last_days(daily.day_totals(_activity(spark, sf_dir)))
    return history.all_match(kept)


def hourly_labels(spark, sf_dir):
    """The same rule over the last seven active hours, which may lie up to a day apart."""
    hours = daily.window_totals(_activity(spark, sf_dir), "1 hour")
    return _plain_times(history.window_labels(hours, target_seconds=24 * HOUR))


def _week_changes(timeline: DataFrame) -> DataFrame:
    return timeline.where("on_time").select("key", "arrival_seq", "day", "week_label")


def weekly_label_changelog(spark, sf_dir):
    return _week_changes(Replay(_activity(spark, sf_dir)).timeline())


def late_label_changelog(spark, sf_dir):
    return _week_changes(Replay(_late(spark, sf_dir)).timeline())


# Notifications


def label_join(spark, sf_dir):
    return _plain_times(Replay(_activity(spark, sf_dir)).labelled().drop("block"))


def label_join_fresh(spark, sf_dir):
    settings = Settings(fresh_label=True)
    return _plain_times(Replay(_activity(spark, sf_dir), settings).labelled().drop("block"))


def notification_candidates(spark, sf_dir):
    return _plain_times(Replay(_activity(spark, sf_dir)).candidates())


def debounce_query(spark, sf_dir):
    """Debounce on its own: every activity is a candidate."""
    replay = Replay(_activity(spark, sf_dir), SLOW)
    rows = replay.timeline().select("key", "block", "arrival_seq", "timestamp")
    kept = debounce(rows, SIX_HOURS, blocked=replay.hot is not None)
    return _plain_times(kept.drop("block"))


def notifications(spark, sf_dir):
    return _plain_times(Replay(_activity(spark, sf_dir)).notifications())


def notifications_six_hours(spark, sf_dir):
    return _plain_times(Replay(_activity(spark, sf_dir), SLOW).notifications())


def late_notifications(spark, sf_dir):
    return _plain_times(Replay(_late(spark, sf_dir), SLOW).notifications())


def notifications_in_blocks(spark, sf_dir):
    return _plain_times(Replay(_activity(spark, sf_dir), SLOW_BLOCKS).notifications())


def late_notifications_in_blocks(spark, sf_dir):
    return _plain_times(Replay(_late(spark, sf_dir), SLOW_BLOCKS).notifications())


def late_label_changelog_in_blocks(spark, sf_dir):
    return _week_changes(Replay(_late(spark, sf_dir), SLOW_BLOCKS).timeline())


def notifications_of_keyed(spark, sf_dir):
    """Records without a key, or without a count, among the others: every ninth and every fifth."""
    rows = _activity(spark, sf_dir)
    rows = rows.withColumn("key", F.when(F.col("arrival_seq") % 9 != 0, F.col("key")))
    rows = rows.withColumn("steps", F.when(F.col("arrival_seq") % 5 != 0, F.col("steps")))
    return _plain_times(Replay(rows, SLOW).notifications())


def outbox(spark, sf_dir):
    settings = Settings(debounce_seconds=SIX_HOURS, unique_ids=True)
    sent = Replay(_activity(spark, sf_dir), settings).notifications()
    return _plain_times(notify.undelivered(sent))


# More than two days open


def steps_changelog_30h(spark, sf_dir):
    return _day_changes(Replay(_very_late(spark, sf_dir), Settings(grace_seconds=30 * HOUR)).timeline())


def label_changelog_30h(spark, sf_dir):
    return _week_changes(Replay(_very_late(spark, sf_dir), Settings(grace_seconds=30 * HOUR)).timeline())


def label_changelog_72h(spark, sf_dir):
    return _week_changes(Replay(_very_late(spark, sf_dir), Settings(grace_seconds=72 * HOUR)).timeline())


def label_changelog_72h_in_blocks(spark, sf_dir):
    settings = Settings(grace_seconds=72 * HOUR, skew=BLOCKS)
    return _week_changes(Replay(_very_late(spark, sf_dir), settings).timeline())


def label_changelog_9d(spark, sf_dir):
    """A late day can be older than all seven that are kept: the oldest of them leaves before it enters."""
    return _week_changes(Replay(_very_late(spark, sf_dir), Settings(grace_seconds=9 * 24 * HOUR)).timeline())


def notifications_72h(spark, sf_dir):
    settings = Settings(grace_seconds=72 * HOUR, debounce_seconds=SIX_HOURS)
    return _plain_times(Replay(_very_late(spark, sf_dir), settings).notifications())


# Tables that are given as logs of changes, with deletes


def label_table(spark, sf_dir):
    return latest.current_rows(feed.label_log(_events(spark, sf_dir)).select("key", "change_seq", "label"))


def notification_table(spark, sf_dir):
    log = feed.sent_log(_events(spark, sf_dir)).select("key", "change_seq", "sent_at")
    return _plain_times(latest.current_rows(log))


def label_join_given(spark, sf_dir):
    return _plain_times(given.join_given_labels(_activity(spark, sf_dir), feed.label_log(_events(spark, sf_dir))))


def label_join_given_in_blocks(spark, sf_dir):
    labels = feed.label_log(_events(spark, sf_dir))
    return _plain_times(given.join_given_labels(_activity(spark, sf_dir), labels, policy=BLOCKS))


def late_label_join_given(spark, sf_dir):
    """A late record sees the label as it is when the record arrives, by the clock of its source partition."""
    records = event_time.with_event_time(_late(spark, sf_dir))
    labels = feed.label_log(_events(spark, sf_dir)).withColumnRenamed("timestamp", "stream_time")
    return _plain_times(given.join_given_labels(records, labels, time="stream_time"))


def _given(spark, sf_dir) -> DataFrame:
    events = _events(spark, sf_dir)
    return given.candidates_with_last(_activity(spark, sf_dir), feed.label_log(events), feed.sent_log(events))


def last_notification_join_given(spark, sf_dir):
    return _plain_times(_given(spark, sf_dir))


def notifications_given(spark, sf_dir):
    return _plain_times(notify.notification_fields(given.far_enough(_given(spark, sf_dir), SIX_HOURS)))


# The same as streams, run until the table is used up


def stream_normalized(spark, sf_dir):
    events = _event_stream(spark, sf_dir)
    path = new_path(spark, "stream-normalized")
    activity = running.normalized(feed.ios_feed(events), feed.android_feed(events))
    query = running.start_normalization(activity, path, new_path(spark, "stream-checkpoint"), once=True)
    query.awaitTermination()
    return _plain_times(codec.decode_normalized(spark.read.schema(streams.FEED).parquet(path)))


def stream_daily_steps(spark, sf_dir):
    base = new_path(spark, "stream-daily")
    activity = feed.activity(_event_stream(spark, sf_dir))
    query = running.start_daily(activity, base, new_path(spark, "stream-checkpoint"), once=True)
    query.awaitTermination()
    if rows_dropped(query):
        raise RuntimeError(f"{rows_dropped(query)} rows came behind the watermark")
    log = sinks.read_log(spark, base, "daily_totals")
    last = log.groupBy("key", "day").agg(F.max_by(F.struct("userId", "steps", "label"), "batch_id").alias("last"))
    return last.select("key", "day", "last.*")


def stream_changes(spark, sf_dir):
    base = new_path(spark, "stream-changes")
    activity = feed.activity(_event_stream(spark, sf_dir))
    query = running.start_changes(activity, base, new_path(spark, "stream-checkpoint"), SLOW, once=True)
    query.awaitTermination()
    return _plain_times(sinks.read_log(spark, base, sinks.CHANGES).drop("batch_id"))


def stream_late_changes(spark, sf_dir):
    """The late feed by the clock of its source partitions, both in one running query."""
    base, source = new_path(spark, "stream-late"), new_path(spark, "late-files")
    feed.late_activity(_events(spark, sf_dir)).select(*ACTIVITY_FIELDS).write.parquet(source)
    late = clock.with_clock(streams.files(spark, source, ACTIVITY, files_per_batch=None))
    running.start_changes(late, base, f"{base}/_changes", SLOW, once=True).awaitTermination()
    return _plain_times(sinks.read_log(spark, base, sinks.CHANGES).drop("batch_id"))


def stream_very_late_changes(spark, sf_dir):
    base, source = new_path(spark, "stream-late"), new_path(spark, "late-files")
    feed.very_late_activity(_events(spark, sf_dir)).select(*ACTIVITY_FIELDS).write.parquet(source)
    late = clock.with_clock(streams.files(spark, source, ACTIVITY, files_per_batch=None))
    settings = Settings(grace_seconds=9 * 24 * HOUR, debounce_seconds=SIX_HOURS)
    running.start_changes(late, base, f"{base}/_changes", settings, once=True).awaitTermination()
    return _week_changes(sinks.read_log(spark, base, sinks.CHANGES).drop("batch_id"))


def stream_debounce_in_blocks(spark, sf_dir):
    """Every activity is a candidate; three batches, in each of them every key in blocks."""
    base, source = new_path(spark, "stream-debounce"), new_path(spark, "candidate-files")
    rows = _activity(spark, sf_dir).select("key", "arrival_seq", "timestamp")
    first, last = rows.agg(F.min("arrival_seq"), F.max("arrival_seq")).first()
    cuts = [first + (last + 1 - first) * i // 3 for i in range(4)]
    for low, high in zip(cuts, cuts[1:]):
        # The files of a batch are as many as the table is read in; the query goes on where it has stopped.
        rows.where(F.col("arrival_seq").between(low, high - 1)).write.mode("append").parquet(source)
        candidates = streams.files(spark, source, CANDIDATE, files_per_batch=None)
        query = debounced.start_debounce(candidates, base, f"{base}/_checkpoint", SIX_HOURS, BLOCKS, once=True)
        query.awaitTermination()
    return _plain_times(sinks.read_log(spark, base, debounced.KEPT).drop("batch_id"))


def stream_label_table(spark, sf_dir):
    """The label log in batches, merged one after the other into the current table."""
    base, source = new_path(spark, "stream-table"), new_path(spark, "label-files")
    feed.label_log(_events(spark, sf_dir)).select("key", "change_seq", "label").repartition(4).write.parquet(source)
    table = KeyedTable(spark, base, LABEL_TABLE)
    changes = streams.files(spark, source, LABEL_TABLE, files_per_batch=1)
    start_table(changes, table, f"{base}/_checkpoint", once=True).awaitTermination()
    return table.current()


def stream_notifications_given(spark, sf_dir):
    """Activity and the logs of both tables as three inputs of one query."""
    base = new_path(spark, "stream-given")
    labels, sent = (log(_event_stream(spark, sf_dir)) for log in (feed.label_log, feed.sent_log))
    activity = feed.activity(_event_stream(spark, sf_dir))
    query = running_given.start_given(activity, labels, sent, base, f"{base}/_checkpoint", SIX_HOURS, once=True)
    query.awaitTermination()
    return _plain_times(sinks.read_log(spark, base, sinks.NOTIFICATIONS).drop("batch_id"))


def _run_job(spark, sf_dir, settings: Settings) -> str:
    """The job over both feeds, with documents of another kind among the iOS ones; the folder of its tables."""
    base = new_path(spark, "stream-job")
    events = _event_stream(spark, sf_dir)
    ios = feed.ios_feed(events).unionByName(feed.foreign_feed(events))
    running.run_job(ios, feed.android_feed(events), base, settings)
    return base


def stream_quarantine(spark, sf_dir):
    base = new_path(spark, "stream-job")
    events = _event_stream(spark, sf_dir)
    ios = feed.ios_feed(events).unionByName(feed.foreign_feed(events))
    running.start_ingest(ios, feed.android_feed(events), base, f"{base}/_ingest", once=True).awaitTermination()
    return sinks.read_log(spark, base, sinks.QUARANTINE).drop("batch_id")


def stream_labels(spark, sf_dir):
    return sinks.current(spark, _run_job(spark, sf_dir, SLOW), sinks.LABELS)


def stream_notifications(spark, sf_dir):
    log = sinks.read_log(spark, _run_job(spark, sf_dir, SLOW), sinks.NOTIFICATIONS)
    return _plain_times(log.drop("batch_id"))


def stream_end_to_end(spark, sf_dir):
    """From raw documents to the outbox."""
    base = _run_job(spark, sf_dir, Settings(debounce_seconds=SIX_HOURS, unique_ids=True))
    return _plain_times(spark.read.schema(f"{NOTIFICATION_ROW}, day date").parquet(f"{base}/outbox"))


QUERIES: dict[str, Query] = {
    "decode_ios": decode_ios,
    "decode_android": decode_android,
    "quarantine": quarantine,
    "encode_normalized": encode_normalized,
    "event_time": event_time_query,
    "last_notification": last_notification,
    "weekly_label_latest": weekly_label_latest,
    "normalize_ios": normalize_ios,
    "normalize_android": normalize_android,
    "normalize_union": normalize_union,
    "step_label": step_label,
    "daily_steps": daily_steps,
    "daily_metrics": daily_metrics,
    "daily_steps_changelog": daily_steps_changelog,
    "late_steps_changelog": late_steps_changelog,
    "daily_steps_grace": daily_steps_grace,
    "late_rows": late_rows,
    "history7": history7,
    "gap_check": gap_check,
    "weekly_label": weekly_label,
    "weekly_all_match": weekly_all_match,
    "hourly_labels": hourly_labels,
    "weekly_label_changelog": weekly_label_changelog,
    "late_label_changelog": late_label_changelog,
    "label_join": label_join,
    "label_join_fresh": label_join_fresh,
    "notification_candidates": notification_candidates,
    "debounce": debounce_query,
    "notifications": notifications,
    "notifications_six_hours": notifications_six_hours,
    "late_notifications": late_notifications,
    "notifications_in_blocks": notifications_in_blocks,
    "late_notifications_in_blocks": late_notifications_in_blocks,
    "late_label_changelog_in_blocks": late_label_changelog_in_blocks,
    "notifications_of_keyed": notifications_of_keyed,
    "outbox": outbox,
    "steps_changelog_30h": steps_changelog_30h,
    "label_changelog_30h": label_changelog_30h,
    "label_changelog_72h": label_changelog_72h,
    "label_changelog_72h_in_blocks": label_changelog_72h_in_blocks,
    "label_changelog_9d": label_changelog_9d,
    "notifications_72h": notifications_72h,
    "label_table": label_table,
    "notification_table": notification_table,
    "label_join_given": label_join_given,
    "label_join_given_in_blocks": label_join_given_in_blocks,
    "late_label_join_given": late_label_join_given,
    "last_notification_join_given": last_notification_join_given,
    "notifications_given": notifications_given,
    "stream_normalized": stream_normalized,
    "stream_daily_steps": stream_daily_steps,
    "stream_changes": stream_changes,
    "stream_late_changes": stream_late_changes,
    "stream_quarantine": stream_quarantine,
    "stream_very_late_changes": stream_very_late_changes,
    "stream_debounce_in_blocks": stream_debounce_in_blocks,
    "stream_label_table": stream_label_table,
    "stream_notifications_given": stream_notifications_given,
    "stream_labels": stream_labels,
    "stream_notifications": stream_notifications,
    "stream_end_to_end": stream_end_to_end,
}
