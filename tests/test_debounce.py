import random

import numpy as np
import pytest
from conftest import at

from stridelake.operators import debounce_blocks
from stridelake.operators.debounce import debounce
from stridelake.operators.debounce_blocks import NOTHING_KEPT, compose, steps_of
from stridelake.streaming.fold import passes_debounce

SECOND = 1_000_000


def walk(times_us, seconds, last=None):
    kept = []
    for i, us in enumerate(times_us):
        if passes_debounce(us, last, seconds):
            kept.append(i)
            last = us
    return kept, last


def apply(steps, state):
    low, high, kept, same = steps
    at_piece = int(np.searchsorted(low, state, side="right")) - 1
    assert low[at_piece] <= state < high[at_piece]
    return state if same[at_piece] else int(kept[at_piece])


def times(rng, count, spread, disorder):
    now, out = 0, []
    for _ in range(count):
        now += rng.randrange(spread)
        out.append(now - rng.choice([0, 0, rng.randrange(disorder + 1)]))
    return np.array(out, dtype="int64")


@pytest.mark.parametrize("seed", range(30))
def test_step_functions_give_the_state_after_a_block(seed):
    rng = random.Random(seed)
    spread = rng.choice([SECOND // 3, 3 * SECOND, 30 * SECOND])
    first = times(rng, rng.randrange(1, 60), spread, rng.choice([0, 40 * SECOND]))
    then = times(rng, rng.randrange(1, 60), spread, rng.choice([0, 40 * SECOND])) + first[-1]
    one, two = steps_of(first, 10), steps_of(then, 10)
    both = compose(one, two)
    edges = np.concatenate([first, first - 10 * SECOND, first + 11 * SECOND, then - 10 * SECOND])
    states = [NOTHING_KEPT, *edges.tolist(), *(edges - 1).tolist(), *(edges + 1).tolist()]
    for state in states:
        last = None if state == NOTHING_KEPT else state
        after_first = walk(first, 10, last)[1]
        assert apply(one, state) == (NOTHING_KEPT if after_first is None else after_first)
        after_both = walk(then, 10, after_first)[1]
        assert apply(both, state) == (NOTHING_KEPT if after_both is None else after_both)


def rows_of(spark, data, block_rows=None):
    schema = "key string, block bigint, arrival_seq bigint, timestamp timestamp"
    rows = [(key, None if block_rows is None else seq // block_rows, seq, time) for seq, (key, time) in enumerate(data)]
    return spark.createDataFrame(rows, schema)


def test_kept_moments(spark):
    moments = (0, 3000, 10000, 10001, 15000, 20002, 31000)
    rows = rows_of(spark, [("k", at(milliseconds=ms)) for ms in moments])
    assert [r.arrival_seq for r in debounce(rows).orderBy("arrival_seq").collect()] == [0, 3, 5, 6]


@pytest.mark.parametrize(
    "second, kept",
    [({"seconds": 10}, 1), ({"seconds": 10, "microseconds": 1}, 2), ({"seconds": -10.9}, 1), ({"seconds": -11}, 2)],
)
def test_boundaries(spark, second, kept):
    assert debounce(rows_of(spark, [("k", at()), ("k", at(**second))])).count() == kept


@pytest.mark.parametrize(
    "block_rows, group, disorder", [(None, 32, 0), (None, 32, 60), (25, 2, 0), (25, 2, 60), (100, 32, 60), (20, 8, 60)]
)
def test_debounce_agrees_with_a_walk(spark, monkeypatch, block_rows, group, disorder):
    monkeypatch.setattr(debounce_blocks, "GROUP", group)
    rng = random.Random(disorder)
    data, now = [], 0.0
    for _ in range(600):
        now += rng.choice([0.2, 0.2, 1.0, 4.0])
        back = rng.choice([0, 0, rng.uniform(0, disorder)])
        data.append((rng.choice("aaab"), at(seconds=now - back)))
    got = {(r.key, r.arrival_seq) for r in debounce(rows_of(spark, data, block_rows), blocked=block_rows is not None).collect()}
    want = set()
    for key in "ab":
        mine = [(seq, round(time.timestamp() * SECOND)) for seq, (k, time) in enumerate(data) if k == key]
        want |= {(key, mine[i][0]) for i in walk([us for _, us in mine], 10)[0]}
    assert got == want


@pytest.mark.parametrize(
    "block_rows, cuts",
    [(7, [300]), (1, [40, 41, 300]), (10**6, [40, 41, 180, 300])],
    ids=["one batch", "blocks of 1", "whole keys"],
)
def test_stream_in_blocks_equals_one_walk(spark, tmp_path, block_rows, cuts):
    """The time kept last is handed from batch to batch, whatever blocks a batch is cut into."""
    from stridelake.operators.skew import SkewPolicy
    from stridelake.sources.streams import files
    from stridelake.streaming import debounced, sinks

    rng = random.Random(block_rows)
    data = [(f"k{rng.randrange(3)}", at(seconds=int(us) / 1e6)) for us in times(rng, 300, 9 * SECOND, 25 * SECOND)]
    data += [(None, at())]
    rows = rows_of(spark, data).drop("block")
    start = 0
    for cut in cuts:
        rows.where(f"arrival_seq >= {start} AND arrival_seq < {cut}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = files(spark, f"{tmp_path}/in", "key string, arrival_seq bigint, timestamp timestamp", files_per_batch=1)
        debounced.start_debounce(
            stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", 10, SkewPolicy(0, block_rows), once=True
        ).awaitTermination()
        start = cut
    log = sinks.read_log(spark, str(tmp_path / "out"), debounced.KEPT)
    want = set()
    for key in ("k0", "k1", "k2"):
        own = [(seq, round(time.timestamp() * SECOND)) for seq, (name, time) in enumerate(data) if name == key]
        want |= {own[i][0] for i in walk([us for _, us in own], 10)[0]}
    assert {r.arrival_seq for r in log.collect()} == want and len(want) < 250
    assert log.count() == len(want)


def test_small_blocks_are_worked_on_together():
    """What a batch ends is one call, however many blocks it is, and gives what each block gives alone."""
    import numpy as np
    import pandas as pd

    sizes = np.arange(400) % 7 + 1
    block = np.repeat(np.arange(400), sizes)
    rng = np.random.default_rng(4)
    us = np.cumsum(rng.integers(0, 6 * SECOND, len(block))) - rng.integers(0, 30 * SECOND, len(block))
    rows = pd.DataFrame({"key": "k", "block": block, "_us": us})
    calls = []

    def work(frame):
        calls.append(frame)
        begins = debounce_blocks._begins(frame, ["key", "block"])
        of, *steps = debounce_blocks._steps(frame["_us"].to_numpy(), begins, 10)
        return debounce_blocks._frame("k", frame["block"].to_numpy()[begins[of]], *steps)

    class Rows:
        def repartition(self, *keys):
            return self

        def sortWithinPartitions(self, *keys):
            return self

        def mapInPandas(self, walk, layout):
            return pd.concat(walk(iter([rows.iloc[:700], rows.iloc[700:702], rows.iloc[702:]])))

    got = debounce_blocks._by_group(Rows(), ["key", "block"], ["block"], work, "")
    assert len(calls) <= 4 and sum(len(frame) for frame in calls) == len(rows)
    for one in range(400):
        want = steps_of(us[block == one], 10)
        for name, column in zip(("low", "high", "kept", "same"), want):
            assert got.loc[got["block"] == one, name].tolist() == column.tolist()
