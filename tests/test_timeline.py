"""The change stream and the notifications: known cases, and random input against the per-key rules."""

import random
from datetime import timedelta

import pytest
from conftest import at

from stridelake.plans.pipeline import Replay, Settings
from stridelake.operators.skew import SkewPolicy
from stridelake.streaming.fold import DAY_US, KeyState, apply_activity

REGULAR = SkewPolicy()
BLOCKED = SkewPolicy(hot_rows=0, block_rows=3)

SIMPLE = [2000, 2000, 6000, 2000, 9000, 2500, 2000, 2000]
MORE = [("user1", at(7), 5000), ("user1", at(7), 2000), ("user1", at(7, seconds=2), 6000)]
LOW_TODAY = [2000, 2000, 6000, 2000, 9000, 2500, 100]
BECOMES_MEDIUM = [("user1", at(6, hours=1), 2000), ("user1", at(6, hours=1), 2000)]


def days(steps):
    return [("user1", at(i), s) for i, s in enumerate(steps)]


@pytest.mark.parametrize("policy", [REGULAR, BLOCKED], ids=["regular", "blocked"])
@pytest.mark.parametrize(
    "rows, count",
    [
        (days(SIMPLE), 1),
        (days(SIMPLE) + MORE, 1),
        (days(LOW_TODAY), 0),
        (days(LOW_TODAY) + BECOMES_MEDIUM, 1),
    ],
    ids=["simple", "suppressed", "low today", "becomes medium"],
)
def test_notifications(activity, rows, count, policy):
    sent = Replay(activity(*rows), Settings(skew=policy)).notifications().collect()
    assert len(sent) == count
    for row in sent:
        assert (row.key, row.payload) == ("user1", "Time for a juice nearby!user1")
        assert row.notificationId == "UNIQUE-NOTIFICATION-ID"


def test_the_label_seen_is_the_one_before(activity):
    rows = activity(*days(SIMPLE))
    stale = [r.label_seen for r in Replay(rows).timeline().orderBy("arrival_seq").collect()]
    fresh = [r.label_seen for r in Replay(rows, Settings(fresh_label=True)).timeline().orderBy("arrival_seq").collect()]
    assert stale == [None, "", "", "", "", "", "", "medium_or_high"]
    assert fresh == ["", "", "", "", "", "", "medium_or_high", "medium_or_high"]


def test_a_gap_resets_the_label(activity):
    rows = [("u", at(d), 1000) for d in [0, 1, 2, 3, 4, 5, 9]]
    assert Replay(activity(*rows)).timeline().orderBy("arrival_seq").collect()[-1].week_label == ""


def test_a_negative_grace_is_refused(activity):
    with pytest.raises(ValueError):
        Replay(activity(("u", at(), 1)), Settings(grace_seconds=-1))


def random_rows(seed, keys=6, count=500, delays=(0, 0, 0, 0, 1, 3, 26)):
    """Dense records over twelve days: some hours late, some dropped, days with late records only."""
    rng = random.Random(seed)
    now, rows = at(0), []
    for _ in range(count):
        now += timedelta(minutes=rng.choice([1, 5, 30, 90]))
        time = now - timedelta(hours=rng.choice(delays))
        rows.append((f"k{rng.randrange(keys)}", time, rng.choice([0, 300, 700, 2000])))
    return rows


def expected(rows, seconds, grace=3600):
    states, clock, out = {}, None, []
    for seq, (key, time, steps) in enumerate(rows):
        us = round(time.timestamp() * 1_000_000)
        clock = us if clock is None else max(clock, us)
        state = states.setdefault(key, KeyState())
        on_time, total, label, seen, notified = apply_activity(
            state, us, steps, clock, grace, debounce_seconds=seconds
        )
        out.append((key, seq, us // DAY_US, on_time, total, label, seen, notified))
    return out


@pytest.mark.parametrize(
    "seed, policy",
    [
        (1, REGULAR),
        (2, REGULAR),
        (1, SkewPolicy(0, 1)),
        (2, SkewPolicy(0, 17)),
        (3, SkewPolicy(80, 50)),
    ],
    ids=["regular", "regular again", "blocks of 1", "blocks of 17", "some keys hot"],
)
def test_replay_agrees_with_the_per_key_rules(activity, seed, policy):
    agrees(activity, random_rows(seed), policy, 3600)


LATE_DELAYS = (0, 0, 0, 1, 3, 26, 40, 60, 90, 150, 200, 230)


@pytest.mark.parametrize(
    "days_open, policy",
    [
        (2, REGULAR),
        (3, SkewPolicy(0, 17)),
        (6, SkewPolicy(140, 50)),
        (7, REGULAR),
        (7, SkewPolicy(0, 17)),
        (9, SkewPolicy(0, 1)),
        (9, SkewPolicy(140, 50)),
    ],
    ids=["2", "3 in blocks", "6 some hot", "7", "7 in blocks", "9 in blocks of 1", "9 some hot"],
)
def test_replay_agrees_when_more_days_are_open(activity, days_open, policy):
    """From seven days on a late day can be older than all that are kept; steps are few, so that labels change."""
    rows = random_rows(days_open, keys=3, count=600, delays=LATE_DELAYS)
    agrees(activity, rows, policy, days_open * 86_400 - 7200)


def agrees(activity, rows, policy, grace):
    settings = Settings(grace_seconds=grace, debounce_seconds=3600, skew=policy)
    replay = Replay(activity(*rows), settings)
    sent = {r.arrival_seq for r in replay.notifications().collect()}
    got = [
        (r.key, r.arrival_seq, (r.day - at().date()).days + at().date().toordinal() - 719163, r.on_time, r.steps,
         r.week_label, r.label_seen, r.arrival_seq in sent)
        for r in replay.timeline().orderBy("arrival_seq").collect()
    ]
    want = expected(rows, 3600, grace)
    assert got == want
    assert not all(row[3] for row in want) and any(row[7] for row in want)
