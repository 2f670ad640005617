"""The debounce state each block of a hot key starts with, found without walking the blocks in turn.

A block maps the last kept timestamp before it to the last kept one after it. That map is a step function,
and steps are few: a block forgets its start once its timestamps spread over twice the limit. Maps of
neighbouring blocks are composed in groups, groups of groups likewise, until one map per key is left;
then the states are handed back down. No task holds more than one block or one group of maps, and one batch of rows.
Blocks and groups that are smaller than a batch are worked on together, column by column.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.functions.rules import MICROS
from stridelake.session import staged_to_join

NOTHING_KEPT = -(2**62)
END = 2**62
GROUP = 32

# For a last kept timestamp in [low, high): it becomes `kept`, or stays as it is when `same`.
STEPS = "key string, block bigint, low bigint, high bigint, kept bigint, same boolean"
STATES = "key string, block bigint, _state bigint"


def entry_states(rows: DataFrame, seconds: int, start: DataFrame | None = None) -> DataFrame:
    """(key, block, _state) for all blocks of `rows`, which has key, block, arrival_seq and `_us`. `start` (key, kept_us)
    has what was kept before the first block of a key."""

    def block_steps(frame: pd.DataFrame) -> pd.DataFrame:
        begins = _begins(frame, ["key", "block"])
        of, *steps = _steps(frame["_us"].to_numpy("int64"), begins, seconds)
        at = begins[of]
        return _frame(frame["key"].to_numpy()[at], frame["block"].to_numpy()[at], *steps)

    narrow = rows.select("key", "block", "arrival_seq", "_us")
    steps = staged_to_join(_by_group(narrow, ["key", "block"], ["arrival_seq"], block_steps, STEPS), "debounce-steps")
    top = steps.agg(F.max("block")).first()[0]
    levels = 0 if not top else math.ceil(math.log(top + 1, GROUP))
    return _states(steps, levels, start)


def _states(steps: DataFrame, levels: int, start: DataFrame | None) -> DataFrame:
    if levels <= 1:
        nothing = F.lit(NOTHING_KEPT).cast("bigint")
        if start is None:
            first = steps.withColumn("_state", nothing)
        else:
            first = steps.join(start.select("key", F.col("kept_us").alias("_state")), "key", "left")
            first = first.withColumn("_state", F.coalesce("_state", nothing))
        return _by_group(first, ["key"], ["block", "low"], _walk, STATES)
    parents = steps.withColumn("parent", F.floor(F.col("block") / GROUP).cast("bigint"))
    order = ["block", "low"]
    composed = staged_to_join(_by_group(parents, ["key", "parent"], order, _compose_groups, STEPS), "debounce-steps")
    above = _states(composed, levels - 1, start).withColumnRenamed("block", "parent")
    return _by_group(parents.join(above, ["key", "parent"]), ["key", "parent"], order, _walk, STATES)


def _by_group(
    rows: DataFrame, keys: list[str], order: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], layout: str
) -> DataFrame:
    """`work` on sorted rows of whole groups, all that end in a batch at once, so that many small groups cost no more
    than a few large ones. A task holds one batch and the group that goes on behind it."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            last = int(_begins(batch, keys)[-1])
            goes_on = bool(held) and all(held[0][key].iloc[0] == batch[key].iloc[0] for key in keys)
            if last == 0 and goes_on:
                held.append(batch)
                continue
            done = [*held, *([batch.iloc[:last]] if last else [])]
            if done:
                yield work(pd.concat(done, ignore_index=True))
            held = [batch.iloc[last:]]
        if held:
            yield work(pd.concat(held, ignore_index=True))

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(walk, layout)


def _begins(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Places where the groups of sorted rows begin."""
    changed = np.ones(len(frame), dtype=bool)
    changed[1:] = False
    for key in keys:
        values = frame[key].to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(changed)


def _walk(frame: pd.DataFrame) -> pd.DataFrame:
    """State at the start of each block, given the state at the start of its group: the first blocks of all groups at
    once, then the second ones, and so on."""
    groups = _begins(frame, [name for name in ("key", "parent") if name in frame])
    blocks = _begins(frame, [name for name in ("key", "parent", "block") if name in frame])
    group = np.searchsorted(groups, blocks, side="right") - 1
    place = np.arange(len(blocks)) - np.searchsorted(blocks, groups)[group]
    block_of_row = np.repeat(np.arange(len(blocks)), np.diff(np.append(blocks, len(frame))))
    low, high, kept = (frame[name].to_numpy("int64") for name in ("low", "high", "kept"))
    changes = ~frame["same"].to_numpy(dtype=bool)
    state = frame["_state"].to_numpy("int64")[groups].copy()
    states = np.zeros(len(blocks), dtype="int64")
    by_place = np.argsort(place, kind="stable")
    rows_by_place = np.argsort(place[block_of_row], kind="stable")
    for now, rows in zip(_parts(by_place, place), _parts(rows_by_place, place[block_of_row])):
        states[now] = state[group[now]]
        own = group[block_of_row[rows]]
        hit = (low[rows] <= state[own]) & (state[own] < high[rows]) & changes[rows]
        state[own[hit]] = kept[rows[hit]]
    first = frame.iloc[blocks]
    return pd.DataFrame({"key": first["key"].to_numpy(), "block": first["block"].to_numpy(), "_state": states})


def _parts(order: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """`order`, which sorts `place`, cut where the place changes."""
    return np.split(order, np.flatnonzero(np.diff(place[order])) + 1)


def _compose_groups(frame: pd.DataFrame) -> pd.DataFrame:
    """The map of each group of blocks. A group of one block has its map already."""
    groups = _begins(frame, ["key", "parent"])
    blocks = _begins(frame, ["key", "parent", "block"])
    ends = np.append(groups[1:], len(frame))
    first, behind = np.searchsorted(blocks, groups), np.searchsorted(blocks, ends)
    alone = np.repeat(behind - first == 1, ends - groups)
    names = ("low", "high", "kept", "same")
    key, parent = frame["key"].to_numpy(), frame["parent"].to_numpy("int64")
    columns = [frame[name].to_numpy() for name in names]
    done = [_frame(key[alone], parent[alone], *[column[alone] for column in columns])]
    cuts = np.append(blocks, len(frame))
    for at, start, end in zip(groups, first, behind):
        if end - start == 1:
            continue
        composed = None
        for low, high in zip(cuts[start:end], cuts[start + 1 : end + 1]):
            steps = tuple(column[low:high] for column in columns)
            composed = steps if composed is None else compose(composed, steps)
        done.append(_frame(key[at], parent[at], *composed))
    return pd.concat(done, ignore_index=True)


def _frame(key, block, low, high, kept, same) -> pd.DataFrame:
    return pd.DataFrame({"key": key, "block": block, "low": low, "high": high, "kept": kept, "same": same})


def steps_of(us: np.ndarray, seconds: int) -> tuple[np.ndarray, ...]:
    """Step function of one block; `us` in arrival order."""
    return _steps(us, np.zeros(1, dtype="int64"), seconds)[1:]


def _steps(us: np.ndarray, begins: np.ndarray, seconds: int) -> tuple[np.ndarray, ...]:
    """Step functions of the blocks that begin at `begins`; the first column tells which of them a step belongs to.

    A candidate t is dropped for the states in [t - limit, t + limit + 1 s). The states that all first i
    candidates drop shrink with i; where they shrink, the cut-off states keep candidate i.
    """
    behind, ahead = seconds * MICROS, (seconds + 1) * MICROS
    sizes = np.diff(np.append(begins, len(us)))
    of, ends = np.repeat(np.arange(len(begins)), sizes), np.repeat(begins + sizes, sizes)
    blocks = pd.Series(us).groupby(of)
    low = blocks.cummax().to_numpy() - behind
    high = blocks.cummin().to_numpy() + ahead
    empty = (low >= high).astype("int64")
    earlier = np.cumsum(empty) - empty
    used = earlier == earlier[begins][of]
    low_before, high_before = np.append(NOTHING_KEPT, low[:-1]), np.append(END, high[:-1])
    low_before[begins], high_before[begins] = NOTHING_KEPT, END
    after = _kept_at_end(us, ends, behind, ahead)
    from_below = np.minimum(low, high_before)
    from_above = np.maximum(high, low_before)
    never = np.zeros(len(us), dtype=bool)
    pieces = [
        (of, low_before, from_below, after, never),
        # When the states are used up from below, nothing is left to cut from above.
        (of, np.maximum(from_above, from_below), high_before, after, never),
    ]
    pieces = [tuple(column[used] for column in piece) for piece in pieces]
    last = (begins + sizes - 1)[np.add.reduceat(empty, begins) == 0]
    pieces.append((of[last], low[last], high[last], np.zeros(len(last), dtype="int64"), np.ones(len(last), dtype=bool)))
    of, *joined = (np.concatenate(column) for column in zip(*pieces))
    return _tidy(*joined, of=of)


def _kept_at_end(us: np.ndarray, ends: np.ndarray, behind: int, ahead: int) -> np.ndarray:
    """For each candidate: the last one kept in its block, if that candidate is kept. `ends` has where its block ends.

    Ranges of 2**k candidates know their extremes, so the next one kept after each candidate is found by
    skipping the longest ranges without one; following these links by doubling leads to the last.
    """
    n = len(us)
    own = np.arange(n)
    longest = int((ends - own).max())
    tops, bottoms = [us], [us]
    while 2 ** len(tops) <= longest:
        half = 2 ** (len(tops) - 1)
        tops.append(np.maximum(tops[-1][:-half], tops[-1][half:]))
        bottoms.append(np.minimum(bottoms[-1][:-half], bottoms[-1][half:]))
    following = own + 1
    for top, bottom, length in zip(reversed(tops), reversed(bottoms), 2 ** np.arange(len(tops) - 1, -1, -1)):
        inside = following + length <= ends
        at = np.where(inside, following, 0)
        dropped = inside & (top[at] <= us + behind) & (bottom[at] > us - ahead)
        following = np.where(dropped, following + length, following)
    final = np.where(following < ends, following, own)
    while True:
        further = final[final]
        if np.array_equal(further, final):
            return us[final]
        final = further


def compose(first: tuple[np.ndarray, ...], then: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The step function that applies `first`, then `then`."""
    low, high, kept, same = first
    then_low, then_high, then_kept, then_same = then
    at = np.searchsorted(then_low, kept, side="right") - 1
    moved = (low[~same], high[~same], np.where(then_same[at], kept, then_kept[at])[~same], same[~same])
    pieces = [moved]
    for start, end in zip(low[same], high[same]):
        cut_low, cut_high = np.maximum(then_low, start), np.minimum(then_high, end)
        pieces.append((cut_low, cut_high, then_kept, then_same))
    return _tidy(*[np.concatenate(column) for column in zip(*pieces)])


def _tidy(low, high, kept, same, of=None) -> tuple[np.ndarray, ...]:
    """Sorted, without empty pieces, neighbours with the same outcome merged. With `of`, the pieces of several blocks,
    each by itself, and `of` comes first."""
    one = of is None
    of = np.zeros(len(low), dtype="int64") if one else of
    real = low < high
    of, low, high, kept, same = of[real], low[real], high[real], kept[real], same[real].astype(bool)
    order = np.lexsort((low, of))
    of, low, high, kept, same = of[order], low[order], high[order], kept[order], same[order]
    begins = np.ones(len(low), dtype=bool)
    begins[1:] = (of[1:] != of[:-1]) | (same[1:] != same[:-1]) | (~same[1:] & (kept[1:] != kept[:-1]))
    at = np.flatnonzero(begins)
    tidy = low[at], high[np.append(at[1:] - 1, len(low) - 1)], kept[at], same[at]
    return tidy if one else (of[at], *tidy)
