from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from stridelake.functions import rules


@pytest.mark.parametrize(
    "steps, label",
    [
        (-5, "daily_low_stepper"),
        (999, "daily_low_stepper"),
        (1000, "daily_medium_stepper"),
        (4999, "daily_medium_stepper"),
        (5000, "daily_high_stepper"),
    ],
)
def test_daily_label_thresholds(spark, steps, label):
    assert spark.range(1).select(rules.daily_label(F.lit(steps))).first()[0] == label


def test_utc_day(spark):
    row = (
        spark.sql("SELECT TIMESTAMP'2024-03-10T23:59:59.999999Z' AS t")
        .select(rules.utc_day(F.col("t")).cast("string"), rules.day_number(F.col("t")))
        .first()
    )
    assert row[0] == "2024-03-10 00:00:00"
    assert row[1] == (datetime(2024, 3, 10, tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)).days


@pytest.mark.parametrize(
    "later_us, earlier_us, exceeds",
    [
        (10_000_000, 0, False),
        (10_000_001, 0, True),
        (3_000_000, 0, False),
        (3_600_000_000, 0, True),
        (0, 10_900_000, False),
        (0, 11_000_000, True),
    ],
)
def test_gap_is_uneven_around_the_limit(spark, later_us, earlier_us, exceeds):
    gap = rules.gap_exceeds(F.lit(later_us), F.lit(earlier_us), 10)
    assert spark.range(1).select(gap).first()[0] is exceeds


def test_label_test_is_null_safe(spark):
    rows = spark.createDataFrame([("medium_or_high",), ("low",), ("",), (None,)], "label string")
    assert [r[0] for r in rows.select(rules.is_week_active(F.col("label"))).collect()] == [True, False, False, False]


def test_all_medium_or_high(spark):
    medium, high, low = rules.DAILY_MEDIUM, rules.DAILY_HIGH, rules.DAILY_LOW
    rows = spark.createDataFrame([([medium, high],), ([medium, low],)], "labels array<string>")
    assert [r[0] for r in rows.select(rules.all_medium_or_high(F.col("labels"))).collect()] == [True, False]


def test_instants_have_the_shortest_exact_fraction(spark):
    times = ["2024-01-01T10:00:00Z", "2024-01-01T10:00:00.120Z", "2024-01-01T10:00:00.000007Z"]
    rows = spark.createDataFrame([(t,) for t in times], "t string")
    texts = [r[0] for r in rows.select(rules.instant_text(F.col("t").cast("timestamp"))).collect()]
    assert texts == times


def test_payload_and_ids(spark):
    row = (
        spark.sql("SELECT 'u1' AS k, TIMESTAMP'2024-01-01T00:00:00Z' AS t, 5L AS s")
        .select(
            rules.payload(F.col("k")),
            rules.unique_notification_id(F.col("k"), F.col("t"), F.col("s")),
            rules.unique_notification_id(F.col("k"), F.col("t"), F.col("s") + 1),
        )
        .first()
    )
    assert row[0] == "Time for a juice nearby!u1"
    assert row[1] != row[2] and len(row[1]) == 64
