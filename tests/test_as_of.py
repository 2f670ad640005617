"""As-of joins of two given logs against a plain search."""

import random
from datetime import timedelta

import pytest
from conftest import at

from stridelake.operators.as_of import as_of
from stridelake.operators.skew import SkewPolicy, in_blocks

CHANGES = "key string, change_seq bigint, timestamp timestamp, label string, since int"


def logs(spark, seed=1, keys=4, count=300):
    rng = random.Random(seed)
    # Few instants, so that records and changes meet at the same one.
    moment = lambda: at(minutes=10 * rng.randrange(200))
    records = [(rng.choice([*(f"k{i}" for i in range(keys)), None]), seq, moment()) for seq in range(count)]
    records += [("k0", count, None), ("alone", count + 1, at())]
    records += [("hot", count + 2 + i, at(minutes=i)) for i in range(count)]
    labels = ["low", "medium_or_high", "", None]
    changes = [(f"k{rng.randrange(keys)}", seq, moment(), rng.choice(labels)) for seq in range(count // 3)]
    changes += [("hot", 1000 + i, at(minutes=17 * i), f"l{i}") for i in range(10)]
    changes += [(None, 2000, at(), "low"), ("k0", 2001, None, "low"), ("never", 2002, at(), "low")]
    changes = [(*c, None if c[3] is None else c[1]) for c in changes]
    left = spark.createDataFrame(records, "key string, arrival_seq bigint, timestamp timestamp")
    return records, changes, left, spark.createDataFrame(changes, CHANGES)


def search(records, changes, inclusive):
    out = []
    for key, seq, time in records:
        seen = [
            (c[2], c[1], c[3], c[4])
            for c in changes
            if key is not None and time is not None and c[0] == key and c[2] is not None
            and (c[2] < time or inclusive and c[2] == time)
        ]
        out.append((key, seq, *(max(seen, key=lambda c: c[:2])[2:] if seen else (None, None))))
    return sorted(out, key=str)


@pytest.mark.parametrize(
    "policy", [SkewPolicy(), SkewPolicy(0, 1), SkewPolicy(0, 13), SkewPolicy(150, 20)],
    ids=["regular", "blocks of 1", "blocks of 13", "one key hot"],
)
@pytest.mark.parametrize("inclusive", [True, False])
def test_as_of_equals_a_search(spark, policy, inclusive):
    records, changes, left, right = logs(spark)
    got = as_of(left, right, inclusive=inclusive, policy=policy)
    assert sorted(((r.key, r.arrival_seq, r.label, r.since) for r in got.collect()), key=str) == search(
        records, changes, inclusive
    )


def test_a_label_that_comes_and_goes(spark):
    left = spark.createDataFrame([("u", i, at(hours=i)) for i in range(6)], "key string, arrival_seq bigint, timestamp timestamp")
    half = timedelta(minutes=30)
    changes = [("u", 1, at(hours=1) - half, "low"), ("u", 2, at(hours=3) - half, None), ("u", 3, at(hours=5) - half, "")]
    right = spark.createDataFrame(changes, "key string, change_seq bigint, timestamp timestamp, label string")
    got = {r.arrival_seq: r.label for r in as_of(left, right).collect()}
    assert got == {0: None, 1: "low", 2: "low", 3: None, 4: None, 5: ""}


def test_empty_logs_and_clashing_names(spark):
    _, _, left, right = logs(spark)
    assert as_of(left.limit(0), right).count() == 0
    rows = as_of(left, right.limit(0)).collect()
    assert len(rows) == left.count() and all(r.label is None for r in rows)
    with pytest.raises(ValueError):
        as_of(left.withColumn("label", left["key"]), right)


def test_one_shuffle_of_both_logs(spark):
    _, _, left, right = logs(spark)
    plan = as_of(left, right)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(key") == 1 and "Join" not in plan


def test_blocks_go_by_the_keys_own_rows(spark):
    """A hot key with every hundredth offset of a long partition gets rows / block_rows blocks, not one a range."""
    rows = spark.createDataFrame([("thin", 100 * i) for i in range(1000)], "key string, arrival_seq bigint")
    counts = [r["count"] for r in in_blocks(rows, SkewPolicy(0, 50)).groupBy("block").count().collect()]
    assert len(counts) == 20 and max(counts) < 100
