"""Activity joined with given tables in a stream: the change logs of the tables are inputs of their own.

The inputs become one stream of tagged rows. Inside a micro-batch the rows of a key are walked in order of time,
changes before records at one instant; the tables' values for the key are one value of state. What a later micro-batch
brings is applied after what an earlier one has brought, as a consumer of several logs does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stridelake.functions.rules import DEBOUNCE_SECONDS, WEEK_MEDIUM_OR_HIGH
from stridelake.operators.daily import counted
from stridelake.operators.notify import notification_fields
from stridelake.streaming.fold import passes_debounce
from stridelake.streaming.sinks import NOTIFICATIONS, write_batch
from stridelake.streaming.stateful import NO_TIME, columns_of, dealt, stream_settings

LABEL_CHANGE, SENT_CHANGE, RECORD = 0, 1, 2
TABLES = "label string, sent_us bigint"
JOINED = "key string, arrival_seq bigint, userId string, time_us bigint, label string, sent_us bigint, notified boolean"


def _walk(debounce_seconds: int):
    """Keeps what the two tables hold for a key and shows it to the key's records."""

    def walk(key: tuple, rows: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        label, sent = group.get if group.exists else (None, None)
        for batch in rows:
            out = []
            for tag, seq, user, time_us, new_label, sent_us in zip(
                *(batch[name].tolist() for name in ("tag", "seq", "userId", "time_us", "label", "sent_us"))
            ):
                if tag == LABEL_CHANGE:
                    label = new_label
                elif tag == SENT_CHANGE:
                    sent = None if sent_us == NO_TIME else sent_us
                else:
                    notified = label == WEEK_MEDIUM_OR_HIGH and passes_debounce(time_us, sent, debounce_seconds)
                    out.append((key[0], seq, user, time_us, label, sent, notified))
            frame = pd.DataFrame(out, columns=columns_of(JOINED))
            yield frame.astype({"sent_us": "Int64"})
        group.update((label, sent))

    return walk


def _tagged(rows: DataFrame, tag: int, seq: str, **own) -> DataFrame:
    kinds = {"userId": "string", "label": "string", "sent_us": "bigint"}
    empty = {"userId": None, "label": None, "sent_us": NO_TIME}
    return rows.where("key IS NOT NULL AND timestamp IS NOT NULL").select(
        "key",
        F.unix_micros("timestamp").alias("time_us"),
        F.lit(tag).alias("tag"),
        F.col(seq).cast("bigint").alias("seq"),
        *[own.get(name, F.lit(empty[name])).cast(kind).alias(name) for name, kind in kinds.items()],
    )


def join_given_tables(
    activity: DataFrame, labels: DataFrame, sent: DataFrame, debounce_seconds: int = DEBOUNCE_SECONDS
) -> DataFrame:
    """One row for each activity: the label and the last notification of its key at that moment, and `notified`.

    `labels` has key, change_seq, timestamp, label; `sent` has key, change_seq, timestamp, sent_at. A null label or
    `sent_at` deletes the key's row. Starts under `stateful.stream_settings`.
    """
    rows = (
        _tagged(counted(activity), RECORD, "arrival_seq", userId=F.col("userId"))
        .unionByName(_tagged(labels, LABEL_CHANGE, "change_seq", label=F.col("label")))
        .unionByName(
            _tagged(sent, SENT_CHANGE, "change_seq", sent_us=F.coalesce(F.unix_micros("sent_at"), F.lit(NO_TIME)))
        )
    )
    grouped = dealt(rows, "key", "time_us", "tag", "seq").groupBy("key")
    joined = grouped.applyInPandasWithState(
        _walk(debounce_seconds), JOINED, TABLES, "append", GroupStateTimeout.NoTimeout
    )
    return joined.select(
        "key",
        "arrival_seq",
        "userId",
        F.timestamp_micros("time_us").alias("timestamp"),
        "label",
        F.timestamp_micros("sent_us").alias("sent_at"),
        "notified",
    )


def start_given(
    activity: DataFrame,
    labels: DataFrame,
    sent: DataFrame,
    base: str,
    checkpoint: str,
    debounce_seconds: int = DEBOUNCE_SECONDS,
    once: bool = False,
) -> StreamingQuery:
    """Write the joined activities (table `joined`) and the notifications, a folder for each micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            write_batch(batch, base, "joined", batch_id)
            write_batch(notification_fields(batch.where("notified")), base, NOTIFICATIONS, batch_id)
        finally:
            batch.unpersist()

    rows = join_given_tables(activity, labels, sent, debounce_seconds)
    writer = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    with stream_settings(activity.sparkSession):
        return (writer.trigger(availableNow=True) if once else writer).start()
