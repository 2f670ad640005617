"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results must carry exactly these.
DAILY_LOW = "daily_low_stepper"
DAILY_MEDIUM = "daily_medium_stepper"
DAILY_HIGH = "daily_high_stepper"
MEDIUM_FROM = 1000
HIGH_FROM = 5000
WEEK_NONE = ""
WEEK_LOW = "low"
WEEK_MEDIUM_OR_HIGH = "medium_or_high"
HISTORY_DAYS = 7
GRACE_SECONDS = 3600
DEBOUNCE_SECONDS = 10
NOTIFICATION_ID = "UNIQUE-NOTIFICATION-ID"
PAYLOAD_PREFIX = "Time for a juice nearby!"

MICROS = 1_000_000
DAY_MICROS = 86_400 * MICROS


def daily_label(steps: Column) -> Column:
    """Null without a count: no total is no label."""
    return (
        F.when(steps < MEDIUM_FROM, DAILY_LOW)
        .when(steps < HIGH_FROM, DAILY_MEDIUM)
        .when(steps >= HIGH_FROM, DAILY_HIGH)
    )


def _day_start_micros(timestamp: Column) -> Column:
    micros = F.unix_micros(timestamp)
    return micros - F.pmod(micros, F.lit(DAY_MICROS))


def utc_day(timestamp: Column) -> Column:
    """First instant of the UTC day, whatever the session's time zone is."""
    return F.timestamp_micros(_day_start_micros(timestamp))


def day_number(timestamp: Column) -> Column:
    """Days since 1970-01-01 in UTC, the form that range frames and offsets can use."""
    return (_day_start_micros(timestamp) / F.lit(DAY_MICROS)).cast("int")


def day_of(timestamp: Column) -> Column:
    """The UTC day as a date."""
    return F.date_from_unix_date(day_number(timestamp))


def is_week_active(label: Column) -> Column:
    """Null-safe: a missing label is not a match."""
    return label.eqNullSafe(WEEK_MEDIUM_OR_HIGH)


def all_medium_or_high(labels: Column) -> Column:
    """True when no daily label in the array is the low one."""
    return F.forall(labels, lambda label: label.isin(DAILY_MEDIUM, DAILY_HIGH))


def payload(user_id: Column) -> Column:
    return F.concat(F.lit(PAYLOAD_PREFIX), user_id)


def unique_notification_id(key: Column, timestamp: Column, arrival_seq: Column) -> Column:
    """Repeatable id: a redelivered notification hashes to the id it had before."""
    return F.sha2(F.concat_ws("#", key, F.unix_micros(timestamp), arrival_seq), 256)


def gap_exceeds(later_us: Column, earlier_us: Column, seconds: int) -> Column:
    """Debounce test: whole seconds from `later` back to `earlier`, rounded down, beyond +/- `seconds`.

    Rounding down makes it uneven: above `seconds` when `later` is later, from `seconds + 1` when earlier.
    """
    whole = F.floor((earlier_us - later_us) / F.lit(MICROS))
    return F.abs(whole) > seconds


def instant_text(timestamp: Column) -> Column:
    """ISO-8601 instant with no, three or six fraction digits, the shortest that is exact."""
    micros = F.unix_micros(timestamp)
    return (
        F.when(micros % MICROS == 0, F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(micros % 1000 == 0, F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .otherwise(F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    )
