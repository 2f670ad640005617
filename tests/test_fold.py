"""The per-key rules of the streaming operator, without Spark."""

import pytest

from stridelake.streaming.fold import (
    DAY_US,
    KeyState,
    add_steps,
    apply_activity,
    is_continuous,
    passes_debounce,
    step_label,
    week_label,
)


@pytest.mark.parametrize(
    "before, added, total, label",
    [
        (500, 400, 900, "daily_low_stepper"),
        (800, 300, 1100, "daily_medium_stepper"),
        (2000, 2500, 4500, "daily_medium_stepper"),
        (4000, 1200, 5200, "daily_high_stepper"),
        (5000, 3000, 8000, "daily_high_stepper"),
    ],
)
def test_totals_and_labels(before, added, total, label):
    state = KeyState(days=[3], totals=[before])
    assert add_steps(state, 3, added) == total
    assert step_label(total) == label


def test_fewer_than_seven_days_have_no_label():
    state, labels = KeyState(), []
    for day in (0, 1, 1):
        add_steps(state, day, 1000)
        labels.append(week_label(state))
    assert labels == ["", "", ""] and len(state.days) == 2


def test_seven_of_ten_medium_days():
    state, labels = KeyState(), []
    for day in range(1, 11):
        add_steps(state, day, 1000)
        labels.append(week_label(state))
    assert len(labels) == 10 and state.days == list(range(4, 11)) and labels[-1] == "medium_or_high"


def test_a_gap_takes_the_label_away():
    state = KeyState()
    for day in [1, 2, 3, 4, 5, 6, 10]:
        add_steps(state, day, 1000)
    assert len(state.days) == 7 and week_label(state) == ""


def test_the_oldest_day_leaves_before_a_new_one_enters():
    state = KeyState(days=list(range(10, 17)), totals=[1000] * 7)
    add_steps(state, 2, 1000)
    assert state.days == [2, 11, 12, 13, 14, 15, 16]


def test_a_day_that_was_pushed_out_goes_on_from_its_total():
    state = KeyState(days=list(range(10, 17)), totals=[1000] * 7)
    add_steps(state, 2, 300)
    assert state.open == {10: 1000}
    assert add_steps(state, 10, 5) == 1005
    assert state.days == list(range(10, 17)) and state.open == {2: 300}
    # Once it is closed it is forgotten.
    apply_activity(state, 17 * DAY_US, 10, stream_us=17 * DAY_US)
    assert state.open == {}


@pytest.mark.parametrize("days, result", [([0, 1, 2, 3, 4, 5], True), ([4], True), ([], True), ([0, 1, 2, 5], False)])
def test_continuity(days, result):
    assert is_continuous(days) is result


def test_windows_closer_than_the_target_are_continuous():
    assert is_continuous([1, 2, 3], target=86_400_000)


@pytest.mark.parametrize("kept, result", [(None, True), (-3_000_000, False), (-3_600_000_000, True)])
def test_debounce(kept, result):
    assert passes_debounce(0, kept) is result


def test_suppressed_candidates_do_not_move_the_reference():
    kept, last = [], None
    for ms in (0, 3000, 10000, 10001, 15000, 20002, 31000):
        if passes_debounce(ms * 1000, last):
            last = ms * 1000
            kept.append(ms)
    assert kept == [0, 10001, 20002, 31000]


def test_grace_ends_one_hour_after_the_day():
    end = DAY_US + 3600 * 1_000_000
    assert not apply_activity(KeyState(), 5, 10, stream_us=end)[0]
    assert apply_activity(KeyState(), 5, 10, stream_us=end - 1)[0]
