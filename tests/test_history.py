from datetime import date, timedelta

import pytest

from stridelake.operators import history
from stridelake.operators.latest import latest
from stridelake.functions.rules import DAILY_LOW, DAILY_MEDIUM


@pytest.fixture
def daily(spark):
    def build(days, low=()):
        start = date(2024, 2, 20)
        rows = [("u", start + timedelta(days=d), DAILY_LOW if d in low else DAILY_MEDIUM) for d in days]
        return spark.createDataFrame(rows, "key string, day date, label string")

    return build


def final(df):
    return df.orderBy("day").collect()[-1]


@pytest.mark.parametrize(
    "days, low, label",
    [
        (range(6), (), ""),
        (range(7), (), "medium_or_high"),
        (range(7), (3,), "low"),
        (range(10), (1,), "medium_or_high"),
        ([0, 1, 2, 3, 4, 5, 9], (), ""),
        ([0, 2, 3, 4, 5, 6, 7, 8], (), "medium_or_high"),
    ],
)
def test_week_label(daily, days, low, label):
    assert final(history.week_labels(daily(days, low))).week_label == label


@pytest.mark.parametrize(
    "days, kept, widest, continuous",
    [(range(6), 6, 1, True), ([4], 1, None, True), ([0, 1, 2, 5], 4, 3, False), ([0, 5, 6, 7, 8, 9, 10, 11], 7, 1, True)],
)
def test_gaps(daily, days, kept, widest, continuous):
    row = final(history.gaps(daily(days)))
    assert (row.days_kept, row.widest_step, row.continuous) == (kept, widest, continuous)


def test_last_days_and_all_match(daily):
    kept = history.last_days(daily(range(10), low=(1, 2)))
    assert [r.position for r in kept.orderBy("day").collect()] == [7, 6, 5, 4, 3, 2, 1]
    row = history.all_match(kept).first()
    assert (row.days_kept, row.all_medium_or_high) == (7, True)
    assert history.all_match(history.last_days(daily(range(4), low=(3,)))).first().all_medium_or_high is False


def test_latest_keeps_null_values_of_the_last_row(spark):
    log = spark.createDataFrame(
        [("a", 1, "x"), ("a", 3, None), ("b", 2, "y")], "key string, arrival_seq long, label string"
    )
    assert {tuple(r) for r in latest(log).collect()} == {("a", 3, None), ("b", 2, "y")}


@pytest.mark.parametrize(
    "steps_ms, low, target_seconds, label",
    [
        # Windows of a millisecond, one behind the other, are closer than a day.
        ([1] * 9, (), 86_400, "medium_or_high"),
        ([1] * 9, (), 0.001, "medium_or_high"),
        ([1, 1, 1, 1, 1, 2], (), 0.001, ""),
        ([1] * 5, (), 86_400, ""),
        ([1] * 6, (2,), 86_400, "low"),
        ([5000, *[1] * 6], (), 0.001, "medium_or_high"),
    ],
)
def test_labels_of_windows_of_any_length(spark, steps_ms, low, target_seconds, label):
    from conftest import at

    places = [0]
    for step in steps_ms:
        places.append(places[-1] + step)
    rows = [("u", at(milliseconds=ms), DAILY_LOW if i in low else DAILY_MEDIUM) for i, ms in enumerate(places)]
    windows = spark.createDataFrame(rows, "key string, start timestamp, label string")
    got = history.window_labels(windows, target_seconds).orderBy("start").collect()
    assert got[-1].window_label == label
    assert got[0].continuous and got[0].widest_seconds is None and got[-1].windows_kept == min(7, len(places))


def test_windows_of_a_day_give_the_weekly_label(spark, activity):
    from conftest import at

    from stridelake.operators import daily

    rows = activity(*[("u", at(d), s) for d, s in [(0, 2000), (1, 10), (2, 2000), (3, 1000), (4, 1500), (5, 1200), (6, 5000),
                                                   (7, 2000), (8, 1999), (11, 2000)]])
    days = history.week_labels(daily.day_totals(rows))
    windows = history.window_labels(daily.window_totals(rows, "1 day"), 86_400)
    assert windows.selectExpr("key", "CAST(start AS DATE) AS day", "window_label").exceptAll(days).count() == 0
