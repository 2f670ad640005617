"""The whole job as batch replay over an arrival-ordered activity table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from stridelake.functions.rules import DEBOUNCE_SECONDS, GRACE_SECONDS
from stridelake.operators import notify
from stridelake.operators.debounce import debounce
from stridelake.operators.event_time import DAY_SECONDS, with_lateness
from stridelake.operators.open_days import timeline_with_open_days
from stridelake.operators.skew import SkewPolicy, hot_keys
from stridelake.operators.timeline import timeline


@dataclass(frozen=True)
class Settings:
    grace_seconds: int = GRACE_SECONDS
    debounce_seconds: int = DEBOUNCE_SECONDS
    fresh_label: bool = False
    unique_ids: bool = False
    skew: SkewPolicy = SkewPolicy()


class Replay:
    """The steps of one replay.

    Building it counts the rows of each key, and the first step that needs them writes the day closings; both are
    written once and used by all steps. What a step returns is lazy but for the tables that hot keys need.
    Records without a key move the clock of their partition and take no other part, see `without_key`.
    """

    def __init__(self, activity: DataFrame, settings: Settings = Settings()):
        if settings.grace_seconds < 0:
            raise ValueError("the grace period can't be negative")
        self.settings = settings
        self.activity = activity
        self.hot = hot_keys(activity, settings.skew)
        self._dated: DataFrame | None = None

    def without_key(self) -> DataFrame:
        """The records that no sum, label or notification can belong to."""
        return self.activity.where("key IS NULL")

    def dated(self) -> DataFrame:
        """Activity with `day_no` and `on_time`."""
        if self._dated is None:
            dated = with_lateness(self.activity, self.settings.grace_seconds)
            self._dated = dated.where("key IS NOT NULL")
        return self._dated

    def timeline(self) -> DataFrame:
        """One row for each activity, see `operators.timeline`. Up to a day of grace leaves two days open, more grace
        more of them."""
        settings = self.settings
        open_days = -(-settings.grace_seconds // DAY_SECONDS)
        if open_days <= 1:
            return timeline(self.dated(), settings.skew, self.hot, settings.fresh_label)
        return timeline_with_open_days(self.dated(), open_days, settings.skew, self.hot, settings.fresh_label)

    def labelled(self) -> DataFrame:
        return notify.join_label(self.timeline())

    def candidates(self) -> DataFrame:
        return notify.notification_fields(notify.candidates(self.labelled()), self.settings.unique_ids)

    def notifications(self) -> DataFrame:
        """Debounced notifications: what goes both to the lookup table and downstream.

        The debounce looks at times only, so it runs on narrow rows and the texts are added after it.
        """
        kept = debounce(
            notify.candidates(self.labelled()), self.settings.debounce_seconds, blocked=self.hot is not None
        )
        return notify.notification_fields(kept, self.settings.unique_ids)
