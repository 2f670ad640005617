"""Debounce of a stream of candidates whose hot keys are worked on in blocks.

A micro-batch is debounced as a table: the candidates of a hot key become step functions, block by block, all blocks at
once (`operators.debounce_blocks`). What a batch has to know of the ones before is one time for each key, the last
one kept, in a table of current rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stridelake.functions.rules import DEBOUNCE_SECONDS
from stridelake.operators.debounce import debounce
from stridelake.operators.latest import latest
from stridelake.operators.skew import SkewPolicy, hot_keys, in_blocks
from stridelake.streaming.sinks import write_batch
from stridelake.streaming.tables import KeyedTable

KEPT = "kept"
KEPT_TIMES = "key string, arrival_seq bigint, kept_us bigint"


def with_blocks(candidates: DataFrame, policy: SkewPolicy) -> tuple[DataFrame, bool]:
    """The candidates with `block`, null but for hot keys, and whether there are any."""
    hot = hot_keys(candidates, policy)
    if hot is None:
        return candidates.withColumn("block", F.lit(None).cast("bigint")), False
    regular = candidates.join(hot, "key", "left_anti").withColumn("block", F.lit(None).cast("bigint"))
    return regular.unionByName(in_blocks(candidates.join(hot, "key", "left_semi"), policy)), True


def start_debounce(
    candidates: DataFrame,
    base: str,
    checkpoint: str,
    seconds: int = DEBOUNCE_SECONDS,
    policy: SkewPolicy = SkewPolicy(),
    once: bool = False,
) -> StreamingQuery:
    """Write the kept candidates (table `kept`), a folder for each micro-batch.

    Candidates have key, arrival_seq, timestamp and may have more; those without a key or a time are left out. Batches
    have to come in arrival order. A batch that is repeated reads the times as they were before it.
    """
    times = KeyedTable(candidates.sparkSession, f"{base}/kept_times", KEPT_TIMES, order="arrival_seq")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.where("key IS NOT NULL AND timestamp IS NOT NULL").persist()
        try:
            rows, blocked = with_blocks(batch, policy)
            kept = debounce(rows, seconds, blocked, times.current(before=batch_id)).drop("block").persist()
            write_batch(kept, base, KEPT, batch_id)
            newest = kept.select("key", "arrival_seq", F.unix_micros("timestamp").alias("kept_us"))
            times.merge(latest(newest), batch_id)
            kept.unpersist()
        finally:
            batch.unpersist()

    writer = candidates.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()
