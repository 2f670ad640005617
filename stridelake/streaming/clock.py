"""The clock of each source partition in a running stream: the highest event time seen so far, batch after batch.

It is one number of state for each source partition, in the same query as the keyed operator that goes by it: nothing is
written between the two, and what a batch costs doesn't depend on how many there have been.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from stridelake.schemas import ACTIVITY_FIELDS
from stridelake.streaming.sinks import write_batch
from stridelake.streaming.stateful import NO_TIME, columns_of, dealt, stream_settings

CLOCKED = "clocked"
CLOCKED_ROW = (
    "key string, partition_id int, arrival_seq bigint, userId string, steps int, time_us bigint, stream_us bigint, "
    "others string"
)
#: Fields that the keyed operator doesn't read.
OTHERS = "steps int, firstName string, lastName string, latitude double, longitude double, pincode string"
NAMES = columns_of(CLOCKED_ROW)


class PartitionClock(StatefulProcessor):
    """Adds to each record the running maximum of the times of its source partition, its own included."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("clock", "top_us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.top.get()
        top = NO_TIME if stored is None else stored[0]
        for batch in rows:
            clock = np.maximum.accumulate(np.append(top, batch["time_us"].to_numpy("int64")))[1:]
            top = int(clock[-1])
            yield batch.assign(stream_us=clock)[NAMES]
        self.top.update((top,))

    def close(self) -> None:
        pass


def with_clock(activity: DataFrame, others: bool = False) -> DataFrame:
    """Activity with `stream_time`, the clock for the grace period, of the columns that the keyed operator reads, or with
    the other ones too.

    The records of a source partition are sorted by offset inside a micro-batch and walked by one task in batches, as a
    consumer of the partition would. Records without a key move the clock too; those without a time don't.
    Starts under `stateful.stream_settings`.
    """
    names = [field.split()[0] for field in OTHERS.split(", ")]
    rows = activity.select(
        "key",
        "partition_id",
        "arrival_seq",
        "userId",
        F.coalesce("steps", F.lit(0)).cast("int").alias("steps"),
        F.coalesce(F.unix_micros("timestamp"), F.lit(NO_TIME)).alias("time_us"),
        # On the way through Python they stay one text, which keeps nulls apart from numbers.
        (F.to_json(F.struct(*names)) if others else F.lit(None).cast("string")).alias("others"),
    )
    grouped = dealt(rows, "partition_id", "arrival_seq").groupBy("partition_id")
    clocked = grouped.transformWithStateInPandas(PartitionClock(), CLOCKED_ROW, "Append", "None")
    if others:
        clocked = clocked.withColumn("own", F.from_json("others", OTHERS)).drop("steps", "others").select("*", "own.*")

    def time(name: str):
        return F.when(F.col(name) != NO_TIME, F.timestamp_micros(name))

    return clocked.select(
        "key",
        "partition_id",
        "arrival_seq",
        "userId",
        *(names if others else ["steps"]),
        time("time_us").alias("timestamp"),
        time("stream_us").alias("stream_time"),
    )


def start_clock(activity: DataFrame, base: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write activity with its partition's clock as a table of its own, for other readers than the job."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch.select(*ACTIVITY_FIELDS, "stream_time"), base, CLOCKED, batch_id)

    writer = with_clock(activity, others=True).writeStream.outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint).foreachBatch(write)
    with stream_settings(activity.sparkSession):
        return (writer.trigger(availableNow=True) if once else writer).start()
