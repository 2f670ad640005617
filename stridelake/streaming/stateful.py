"""The keyed stateful operator: daily totals, weekly label, label join and debounce in one pass.

The label table and the notification table are fed by the job's own output, which a streaming plan cannot
express as joins; per key both are one value of state.

Rows are dealt by key and sorted by (key, offset) before the operator, so a key's rows come as an iterator of
batches in offset order. Only one batch of them is in memory, however many a micro-batch brings for one key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stridelake.functions.rules import DAY_MICROS, DEBOUNCE_SECONDS, GRACE_SECONDS
from stridelake.operators.daily import counted
from stridelake.streaming.fold import KeyState, apply_activity, step_label

#: The state of a key in the order of `KeyState`: days that are kept and others that are still open, each with its total.
#: One value, which travels with the key's rows: a call to the state store for each key would be a trip to the JVM and back.
KEY_VALUE = (
    "days array<int>, totals array<bigint>, label string, newest_us bigint, kept_us bigint, last_seq bigint, "
    "open_days array<int>, open_totals array<bigint>"
)
CHANGES = (
    "key string, arrival_seq bigint, userId string, time_us bigint, day_no int, on_time boolean, "
    "steps bigint, day_label string, week_label string, label_seen string, notified boolean, behind boolean"
)
#: Stands for no time where a column of numbers has to stay one.
NO_TIME = -(2**62)

STREAM_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # The sort below is inside the partitions of each micro-batch, which the check takes for a sort of the stream.
    "spark.sql.streaming.unsupportedOperationCheck": "false",
}


@contextmanager
def stream_settings(spark: SparkSession) -> Iterator[None]:
    """What keyed queries need while they start; a query keeps the settings it has started with."""
    before = {name: spark.conf.get(name, None) for name in STREAM_SETTINGS}
    for name, value in STREAM_SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def dealt(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of each key in one partition, in order: what the operator's own exchange and sort find done."""
    return rows.repartition(key).sortWithinPartitions(key, *order)


def columns_of(layout: str) -> list[str]:
    return [field.split()[0] for field in layout.split(", ")]


class Changes:
    """Applies activities to the state of their key, see `fold`. `value` gives and takes the key's one value of state."""

    def __init__(self, grace_seconds: int, debounce_seconds: int, fresh_label: bool, idle_days: int | None, value=None):
        self.rules = (grace_seconds, debounce_seconds, fresh_label)
        self.idle_ms = None if idle_days is None else idle_days * 86_400_000
        self.value = value

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues=None) -> Iterator[pd.DataFrame]:
        stored = self.value.get()
        state = KeyState()
        if stored is not None:
            days, totals, *rest, open_days, open_totals = stored
            state = KeyState(list(days), list(totals), *rest, dict(zip(open_days, open_totals)))
        for batch in rows:
            yield self._advance(key[0], state, batch)
        self._store(state)

    def _advance(self, key: str, state: KeyState, rows: pd.DataFrame) -> pd.DataFrame:
        grace, debounce, fresh = self.rules
        out = []
        for seq, time_us, clock, steps in zip(
            *(rows[name].tolist() for name in ("arrival_seq", "time_us", "stream_us", "steps"))
        ):
            if state.last_seq is not None and seq <= state.last_seq:
                out.append((False, None, None, None, None, False, True))
                continue
            state.last_seq = seq
            on_time, total, label, seen, notified = apply_activity(
                state, time_us, steps, None if clock == NO_TIME else clock, grace, debounce, fresh
            )
            out.append((on_time, total, step_label(total) if on_time else None, label, seen, notified, False))
        # Keys are many and their batches small: columns are made as arrays, without a look at each value.
        on_time, total, day_label, week_label, seen, notified, behind = zip(*out)
        late = np.array([value is None for value in total])
        steps = np.array([0 if value is None else value for value in total], dtype="int64")
        time_us = rows["time_us"].to_numpy("int64")
        return pd.DataFrame(
            {
                "key": key,
                "arrival_seq": rows["arrival_seq"].to_numpy("int64"),
                "userId": rows["userId"].to_numpy(),
                "time_us": time_us,
                "day_no": time_us // DAY_MICROS,
                "on_time": np.array(on_time, dtype=bool),
                "steps": pd.arrays.IntegerArray(steps, late),
                "day_label": np.array(day_label, dtype=object),
                "week_label": np.array(week_label, dtype=object),
                "label_seen": np.array(seen, dtype=object),
                "notified": np.array(notified, dtype=bool),
                "behind": np.array(behind, dtype=bool),
            }
        )

    def _store(self, state: KeyState) -> None:
        opened = sorted(state.open.items())
        self.value.update(
            (
                state.days,
                state.totals,
                state.label,
                state.newest_us,
                state.kept_us,
                state.last_seq,
                [day for day, _ in opened],
                [total for _, total in opened],
            )
        )
        if self.idle_ms is not None:
            self.value.forget_at(state.newest_us // 1000 + self.idle_ms)


class Held:
    """The value of state that comes with a group."""

    def __init__(self, group: GroupState):
        self.group = group

    def get(self) -> tuple | None:
        return self.group.get if self.group.exists else None

    def update(self, value: tuple) -> None:
        self.group.update(value)

    def forget_at(self, time_ms: int) -> None:
        self.group.setTimeoutTimestamp(time_ms)


def _walk(*rules):
    def walk(key: tuple, rows: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            group.remove()
        else:
            yield from Changes(*rules, value=Held(group)).handleInputRows(key, rows)

    return walk


def changes(
    activity: DataFrame,
    grace_seconds: int = GRACE_SECONDS,
    debounce_seconds: int = DEBOUNCE_SECONDS,
    fresh_label: bool = False,
    idle_days: int | None = None,
) -> DataFrame:
    """One row for each activity of a stream: the columns of the batch timeline, and `notified`. Starts under
    `stream_settings`.

    A record whose offset is not above the last one applied to its key came behind it: it changes nothing and is
    marked `behind`. A `stream_time` column, when there is one, is the clock for the grace period. `idle_days` drops the
    state of keys that have been silent for so long; by default state is kept for ever.
    """
    stream_us = F.unix_micros("stream_time") if "stream_time" in activity.columns else F.lit(None).cast("bigint")
    rows = counted(activity)
    if idle_days is not None:
        # The watermark trails by the idle time itself, so it never drops a record that still counts.
        rows = rows.withWatermark("timestamp", f"{idle_days} days")
    rows = rows.select(
        "key",
        "arrival_seq",
        "userId",
        *(["timestamp"] if idle_days is not None else []),
        F.unix_micros("timestamp").alias("time_us"),
        F.coalesce(stream_us, F.lit(NO_TIME)).alias("stream_us"),
        "steps",
    )
    walk = _walk(grace_seconds, debounce_seconds, fresh_label, idle_days)
    timeout = GroupStateTimeout.NoTimeout if idle_days is None else GroupStateTimeout.EventTimeTimeout
    grouped = dealt(rows, "key", "arrival_seq").groupBy("key")
    stateful = grouped.applyInPandasWithState(walk, CHANGES, KEY_VALUE, "append", timeout)
    return stateful.select(
        "key",
        "arrival_seq",
        "userId",
        F.timestamp_micros("time_us").alias("timestamp"),
        F.date_from_unix_date("day_no").alias("day"),
        "on_time",
        "steps",
        "day_label",
        "week_label",
        "label_seen",
        "notified",
        "behind",
    )
