"""What one activity does to the state of its key. Used by the streaming operator only.

Batch replay states the same rules as window functions, and the tests hold the two against each other.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from stridelake.functions.rules import (
    DAILY_HIGH,
    DAILY_LOW,
    DAILY_MEDIUM,
    DEBOUNCE_SECONDS,
    GRACE_SECONDS,
    HIGH_FROM,
    HISTORY_DAYS,
    MEDIUM_FROM,
    MICROS,
    WEEK_LOW,
    WEEK_MEDIUM_OR_HIGH,
    WEEK_NONE,
)

DAY_US = 86_400 * MICROS


@dataclass
class KeyState:
    """Totals of the days kept, in day order; label; newest event time; time of the last notification;
    offset of the last record applied; totals of days that are still open but not kept any more."""

    days: list[int] = field(default_factory=list)
    totals: list[int] = field(default_factory=list)
    label: str | None = None
    newest_us: int | None = None
    kept_us: int | None = None
    last_seq: int | None = None
    open: dict[int, int] = field(default_factory=dict)


def step_label(steps: int) -> str:
    return DAILY_LOW if steps < MEDIUM_FROM else DAILY_MEDIUM if steps < HIGH_FROM else DAILY_HIGH


def add_steps(state: KeyState, day: int, steps: int) -> int:
    """Add to the day's total and return it; a new day pushes out the oldest one kept, whichever it is.

    A day that was pushed out while it is open goes on from its total when it comes back.
    """
    totals = dict(zip(state.days, state.totals))
    if day not in totals:
        if len(totals) >= HISTORY_DAYS:
            oldest = min(totals)
            state.open[oldest] = totals.pop(oldest)
        totals[day] = state.open.pop(day, 0)
    totals[day] += steps
    state.days = sorted(totals)
    state.totals = [totals[d] for d in state.days]
    return totals[day]


def is_continuous(days: list[int], target: int = 1) -> bool:
    """No step between neighbours (in ascending order) is longer than the target."""
    return all(later - earlier <= target for earlier, later in zip(days, days[1:]))


def week_label(state: KeyState, target: int = 1) -> str:
    if len(state.days) < HISTORY_DAYS or not is_continuous(state.days, target):
        return WEEK_NONE
    return WEEK_LOW if min(state.totals) < MEDIUM_FROM else WEEK_MEDIUM_OR_HIGH


def passes_debounce(candidate_us: int, kept_us: int | None, seconds: int = DEBOUNCE_SECONDS) -> bool:
    return kept_us is None or abs((kept_us - candidate_us) // MICROS) > seconds


def apply_activity(
    state: KeyState,
    time_us: int,
    steps: int,
    stream_us: int | None = None,
    grace_seconds: int = GRACE_SECONDS,
    debounce_seconds: int = DEBOUNCE_SECONDS,
    fresh_label: bool = False,
) -> tuple[bool, int | None, str | None, str | None, bool]:
    """Update `state`; return (on_time, running day total, weekly label, label seen, notified).

    `stream_us` is the stream time of the source partition where the source knows it; otherwise the
    key's own newest time is used, which forgives more and does not depend on how batches are cut.
    """
    state.newest_us = time_us if state.newest_us is None else max(state.newest_us, time_us)
    clock = state.newest_us if stream_us is None else stream_us
    day, closed = time_us // DAY_US, clock - grace_seconds * MICROS
    on_time = (day + 1) * DAY_US > closed
    seen, total, label = state.label, None, None
    if on_time:
        total = add_steps(state, day, steps)
        label = state.label = week_label(state)
    if state.open:
        state.open = {d: total for d, total in state.open.items() if (d + 1) * DAY_US > closed}
    if fresh_label:
        seen = state.label
    notified = seen == WEEK_MEDIUM_OR_HIGH and passes_debounce(time_us, state.kept_us, debounce_seconds)
    if notified:
        state.kept_us = time_us
    return on_time, total, label, seen, notified
