"""Debounce: keep a candidate only when it is far enough from the last one kept for its key.

What a row does depends on the last kept row, not on the previous row, so no window function gives it.
Candidates are shuffled and sorted by Spark; a small Arrow task walks each sorted partition with one
timestamp of state. Rows further than the limit from everything before them are kept in any case, a
window function finds them, and only the rest is walked one by one.

A hot key is walked block by block, all blocks at once. For that the state each block starts with is
needed, see `debounce_blocks`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stridelake.functions.rules import DEBOUNCE_SECONDS, MICROS
from stridelake.operators.debounce_blocks import NOTHING_KEPT, entry_states
from stridelake.session import staged


def debounce(
    candidates: DataFrame, seconds: int = DEBOUNCE_SECONDS, blocked: bool = False, start: DataFrame | None = None
) -> DataFrame:
    """Rows of `candidates` that are kept. Needs `key`, `arrival_seq`, `timestamp`, `block`.

    `block` is null for keys that one task walks as a whole; pass `blocked` when some rows have one. `start` (key,
    kept_us) has the time last kept for keys whose candidates before are not among the rows.
    """
    if not blocked:
        return _walked(_from(candidates, start), ["key"], seconds)
    # The candidates of hot keys are read twice, for the states and for the walk, so they are written once.
    hot = staged(candidates.where("block IS NOT NULL"), "hot-candidates")
    states = entry_states(hot.withColumn("_us", F.unix_micros("timestamp")), seconds, start)
    regular = debounce(candidates.where("block IS NULL"), seconds, start=start)
    return regular.unionByName(_walked(hot.join(states, ["key", "block"], "left"), ["key", "block"], seconds))


def _from(rows: DataFrame, start: DataFrame | None) -> DataFrame:
    if start is None:
        return rows.withColumn("_state", F.lit(None).cast("bigint"))
    return rows.join(start.select("key", F.col("kept_us").alias("_state")), "key", "left")


def _walked(rows: DataFrame, groups: list[str], seconds: int) -> DataFrame:
    """Kept rows of each group, which starts with `_state` as the last time kept."""
    fields = [name for name in rows.columns if name != "_state"]
    by_arrival = W.partitionBy(*groups).orderBy("arrival_seq")
    rows = rows.withColumn("_us", F.unix_micros("timestamp")).withColumn(
        "_newest", F.max("_us").over(by_arrival.rowsBetween(W.unboundedPreceding, -1))
    )
    # In a block, rows before it count as well: there only the walk can tell.
    apart = F.coalesce(F.col("_us") - F.greatest("_newest", "_state") > seconds * MICROS, F.lit(True))
    # The time goes to Python and back as one number.
    passed = [name for name in fields if name != "timestamp"]
    rows = rows.select(
        *passed,
        "_us",
        (apart & F.col("block").isNull()).alias("_apart"),
        F.coalesce("_state", F.lit(NOTHING_KEPT)).alias("_state"),
    )
    kept = rows.sortWithinPartitions(*groups, "arrival_seq").mapInPandas(
        _keep([*passed, "_us"], seconds), rows.select(*passed, "_us").schema
    )
    return kept.withColumn("timestamp", F.timestamp_micros("_us")).select(*fields)


def _keep(fields: list[str], seconds: int):
    late_limit, early_limit = seconds * MICROS, -(seconds + 1) * MICROS

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, last = None, NOTHING_KEPT
        for batch in batches:
            if batch.empty:
                continue
            key, block = batch["key"].to_numpy(), batch["block"].astype("Int64").fillna(-1).to_numpy("int64")
            us, state = batch["_us"].to_numpy(), batch["_state"].to_numpy()
            kept = batch["_apart"].to_numpy(dtype=bool).copy()
            starts = np.ones(len(batch), dtype=bool)
            starts[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
            starts[0] = (key[0], block[0]) != group
            index = np.arange(len(batch))
            start = np.maximum.accumulate(np.where(starts, index, -1))
            sure = np.maximum.accumulate(np.where(kept, index, -1))
            latest = -1
            for i in np.flatnonzero(~kept):
                before = max(sure[i], latest)
                if before >= start[i] and before >= 0:
                    reference = us[before]
                else:
                    reference = state[start[i]] if start[i] >= 0 else last
                apart = us[i] - reference
                if apart > late_limit or apart <= early_limit:
                    kept[i] = True
                    latest = i
            tail = start[-1]
            kept_in_tail = np.flatnonzero(kept[max(tail, 0) :])
            if kept_in_tail.size:
                last = us[max(tail, 0) + kept_in_tail[-1]]
            elif tail >= 0:
                last = state[tail]
            group = (key[-1], block[-1])
            yield batch.loc[kept, fields]

    return keep
