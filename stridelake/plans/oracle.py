"""The named queries once more as plain SQL over the tables, to check the results against.

Written from the definitions, not from the Spark plans: the weekly label, for one, is taken from the totals
of all days as they stood at each record, by joining every record with all earlier ones of its key.
"""

from __future__ import annotations

ACTIVITY = """activity AS (
  SELECT CAST(user_id AS VARCHAR) AS key, CAST(user_id % 4 AS INTEGER) AS partition_id, event_id AS arrival_seq,
         CAST(user_id AS VARCHAR) AS "userId", 'user-' || CAST(user_id AS VARCHAR) AS "firstName",
         'Doe' AS "lastName", CAST(round(value * 40) AS INTEGER) AS steps,
         CASE WHEN event_type IN ('click', 'view') THEN CAST(1.3521 AS DOUBLE) END AS latitude,
         CASE WHEN event_type IN ('click', 'view') THEN CAST(103.8198 AS DOUBLE) END AS longitude,
         CASE WHEN event_type IN ('click', 'view') THEN '333001' END AS pincode,
         ts AS "timestamp"
  FROM events)"""

# Records without a key move the clock and nothing else; a missing count is zero.
KEYED = ACTIVITY.replace(
    "CAST(user_id AS VARCHAR) AS key", "CASE WHEN event_id % 9 <> 0 THEN CAST(user_id AS VARCHAR) END AS key"
).replace(
    "CAST(round(value * 40) AS INTEGER) AS steps",
    "CASE WHEN event_id % 5 <> 0 THEN CAST(round(value * 40) AS INTEGER) ELSE 0 END AS steps",
)

LATE = """arrivals AS (
  SELECT *, ts + CASE WHEN event_id % 17 = 0 THEN INTERVAL 3 HOUR ELSE INTERVAL 0 HOUR END AS arrived FROM events),
activity AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS key, CAST(user_id % 4 AS INTEGER) AS partition_id,
         row_number() OVER (PARTITION BY user_id % 4 ORDER BY arrived, event_id) AS arrival_seq,
         CAST(user_id AS VARCHAR) AS "userId", CAST(round(value * 40) AS INTEGER) AS steps, ts AS "timestamp"
  FROM arrivals)"""

_DELAY = "greatest(" + ", ".join(
    f"CASE WHEN event_id % {n} = 0 THEN {hours} ELSE 0 END" for n, hours in ((17, 3), (13, 40), (29, 100), (31, 190))
) + ")"
VERY_LATE = LATE.replace(
    "CASE WHEN event_id % 17 = 0 THEN INTERVAL 3 HOUR ELSE INTERVAL 0 HOUR END", f"to_hours(CAST({_DELAY} AS INTEGER))"
)

TIMED = """clocked AS (
  SELECT *, CAST("timestamp" AS DATE) AS day,
         max("timestamp") OVER (PARTITION BY partition_id ORDER BY arrival_seq ROWS UNBOUNDED PRECEDING) AS clock
  FROM activity),
timed AS (
  SELECT *, CAST(day AS TIMESTAMP) + INTERVAL 1 DAY > clock - INTERVAL 1 HOUR AS on_time FROM clocked)"""

CHAIN = """standing AS (
  SELECT r.key, r.arrival_seq, q.day, sum(q.steps) AS total
  FROM timed r JOIN timed q ON q.key = r.key AND q.arrival_seq <= r.arrival_seq
  WHERE r.on_time AND q.on_time GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY key, arrival_seq ORDER BY day DESC) AS position FROM standing),
labels AS (
  SELECT key, arrival_seq,
         CASE WHEN count(*) < 7 OR max(day) - min(day) > 6 THEN ''
              WHEN bool_and(total >= 1000) THEN 'medium_or_high' ELSE 'low' END AS week_label
  FROM ranked WHERE position <= 7 GROUP BY key, arrival_seq),
running AS (
  SELECT t.*, CAST(CASE WHEN t.on_time THEN a.total END AS BIGINT) AS total, l.week_label
  FROM timed t LEFT JOIN standing a ON a.key = t.key AND a.arrival_seq = t.arrival_seq AND a.day = t.day
  LEFT JOIN labels l ON l.key = t.key AND l.arrival_seq = t.arrival_seq),
timeline AS (
  SELECT *, CASE WHEN total < 1000 THEN 'daily_low_stepper' WHEN total < 5000 THEN 'daily_medium_stepper'
                 WHEN total >= 5000 THEN 'daily_high_stepper' END AS day_label,
         last_value(week_label IGNORE NULLS) OVER (PARTITION BY key ORDER BY arrival_seq
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS label_seen,
         last_value(week_label IGNORE NULLS) OVER (PARTITION BY key ORDER BY arrival_seq
           ROWS UNBOUNDED PRECEDING) AS label_now
  FROM running)"""

# The days kept are walked record by record: a new one takes the place of the oldest, whichever it is.
WALK = """numbered AS (
  SELECT key, arrival_seq, day, row_number() OVER (PARTITION BY key ORDER BY arrival_seq) AS n FROM timed WHERE on_time),
walk AS (
  SELECT key, arrival_seq, n, [day] AS kept FROM numbered WHERE n = 1
  UNION ALL
  SELECT r.key, r.arrival_seq, r.n, CASE WHEN list_contains(w.kept, r.day) THEN w.kept
    ELSE list_sort(list_append(CASE WHEN len(w.kept) >= 7 THEN w.kept[2:] ELSE w.kept END, r.day)) END
  FROM walk w JOIN numbered r ON r.key = w.key AND r.n = w.n + 1),
standing AS (
  SELECT r.key, r.arrival_seq, q.day, sum(q.steps) AS total
  FROM timed r JOIN timed q ON q.key = r.key AND q.arrival_seq <= r.arrival_seq
  WHERE r.on_time AND q.on_time GROUP BY ALL),
walked AS (
  SELECT w.key, w.arrival_seq, CASE WHEN len(any_value(w.kept)) < 7 OR max(s.day) - min(s.day) > 6 THEN ''
    WHEN bool_and(s.total >= 1000) THEN 'medium_or_high' ELSE 'low' END AS week_label
  FROM walk w JOIN standing s ON s.key = w.key AND s.arrival_seq = w.arrival_seq AND list_contains(w.kept, s.day)
  GROUP BY w.key, w.arrival_seq)"""

DAILY = """daily AS (
  SELECT key, arg_max("userId", arrival_seq) AS "userId", CAST(sum(steps) AS BIGINT) AS steps,
         CAST("timestamp" AS DATE) AS day
  FROM activity GROUP BY key, CAST("timestamp" AS DATE)),
labelled AS (
  SELECT *, CASE WHEN steps < 1000 THEN 'daily_low_stepper' WHEN steps < 5000 THEN 'daily_medium_stepper'
                 ELSE 'daily_high_stepper' END AS label FROM daily)"""

# Tables given as logs of changes.
LABEL_LOG = """labels_given AS (
  SELECT CAST(user_id + 1 AS VARCHAR) AS key, event_id AS change_seq, ts + INTERVAL 90 SECOND AS at,
         CASE event_type WHEN 'signup' THEN 'medium_or_high' WHEN 'purchase' THEN 'low' WHEN 'click' THEN '' END AS label
  FROM events WHERE event_type IN ('signup', 'purchase', 'click', 'error'))"""
SENT_LOG = """sent_given AS (
  SELECT CAST(user_id + 2 AS VARCHAR) AS key, event_id AS change_seq, ts + INTERVAL 45 SECOND AS at,
         CASE event_type WHEN 'signup' THEN ts + INTERVAL 45 SECOND END AS sent_at
  FROM events WHERE event_type IN ('signup', 'error'))"""


def _as_of(name: str, records: str, log: str, value: str, time: str = '"timestamp"') -> str:
    """Each record with the value of the last change at or before its time."""
    return f"""{name} AS (
  SELECT * EXCLUDE (back) FROM (
    SELECT r.*, l.{value}, row_number() OVER (
      PARTITION BY r.key, r.arrival_seq ORDER BY l.at DESC NULLS LAST, l.change_seq DESC) AS back
    FROM {records} r LEFT JOIN {log} l ON l.key = r.key AND l.at <= r.{time}) WHERE back = 1)"""


GIVEN = (
    ACTIVITY,
    LABEL_LOG,
    SENT_LOG,
    _as_of("labelled_given", "activity", "labels_given", "label"),
    "wanted AS (SELECT * FROM labelled_given WHERE label = 'medium_or_high')",
    _as_of("with_last", "wanted", "sent_given", "sent_at"),
)

SEEN = "candidate AS MATERIALIZED (SELECT * FROM timeline WHERE label_seen = 'medium_or_high')"
NOTIFICATION = """key, arrival_seq, "userId", 'UNIQUE-NOTIFICATION-ID' AS "notificationId",
  'Time for a juice nearby!' || "userId" AS payload, "timestamp\""""


def _kept(seconds: int) -> str:
    return f"""kept AS (
  SELECT c.* FROM candidate c
  JOIN (SELECT key, min(arrival_seq) AS arrival_seq FROM candidate GROUP BY key) f
    ON f.key = c.key AND f.arrival_seq = c.arrival_seq
  UNION ALL
  SELECT n.* FROM kept k, LATERAL (
    SELECT c.* FROM candidate c WHERE c.key = k.key AND c.arrival_seq > k.arrival_seq
      AND abs(floor((epoch_us(k."timestamp") - epoch_us(c."timestamp")) / 1000000.0)) > {seconds}
    ORDER BY c.arrival_seq LIMIT 1) n)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _recursive(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


TIMELINE = (ACTIVITY, TIMED, CHAIN)
LATE_TIMELINE = (LATE, TIMED, CHAIN)


def _very_late(hours: int, chain: str = CHAIN) -> tuple[str, ...]:
    return (VERY_LATE, TIMED.replace("INTERVAL 1 HOUR", f"INTERVAL {hours} HOUR"), chain)


NORMALIZED = """SELECT key, partition_id, arrival_seq, "userId", "firstName", "lastName", steps, latitude, longitude,
  pincode, "timestamp" FROM activity"""

CHANGES = """SELECT t.key, t.arrival_seq, t."userId", t."timestamp", t.day, t.on_time, t.total AS steps, t.day_label,
  t.week_label, t.label_seen, k.key IS NOT NULL AS notified
FROM timeline t LEFT JOIN kept k ON k.key = t.key AND k.arrival_seq = t.arrival_seq"""

ORACLE: dict[str, str] = {
    "decode_ios": _with(ACTIVITY)
    + """SELECT key, partition_id, arrival_seq, "userId" AS user_id, 'male' AS gender, CAST(175 AS DOUBLE) AS height,
  CAST(70 AS DOUBLE) AS weight, 3 AS sleep_hours, steps AS walking_steps, latitude AS lat, longitude AS lon, pincode,
  "timestamp" AS event_timestamp FROM activity WHERE CAST(key AS BIGINT) % 2 = 0""",
    "decode_android": _with(ACTIVITY)
    + """SELECT key, partition_id, arrival_seq, "userId" AS user_id, 'male' AS gender, CAST(175 AS DOUBLE) AS height,
  CAST(70 AS DOUBLE) AS weight, 3 AS sleep_hours, steps AS walking_steps, latitude IS NOT NULL AS located,
  latitude AS lat, pincode, "timestamp" AS ts FROM activity WHERE CAST(key AS BIGINT) % 2 = 1""",
    "quarantine": """SELECT CAST(user_id AS VARCHAR) AS key, CAST(user_id % 4 AS INTEGER) AS partition_id,
  event_id AS arrival_seq, props AS value, 'missing PhysicalActivity' AS fault FROM events""",
    "encode_normalized": _with(ACTIVITY)
    + """SELECT key, partition_id, arrival_seq,
  '{"userId":"' || "userId" || '","firstName":"' || "firstName" || '","lastName":"' || "lastName" || '","steps":' || steps
  || ',"latitude":' || coalesce(CAST(latitude AS VARCHAR), 'null')
  || ',"longitude":' || coalesce(CAST(longitude AS VARCHAR), 'null')
  || ',"pincode":' || coalesce('"' || pincode || '"', 'null') || ',"timestamp":"'
  || CASE WHEN epoch_us("timestamp") % 1000000 = 0 THEN strftime("timestamp", '%Y-%m-%dT%H:%M:%SZ')
          WHEN epoch_us("timestamp") % 1000 = 0 THEN strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%gZ')
          ELSE strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%fZ') END || '"}' AS value FROM activity""",
    "event_time": """WITH body AS (
  SELECT CAST(user_id AS VARCHAR) AS key, CAST(user_id % 4 AS INTEGER) AS partition_id, event_id AS arrival_seq,
         CASE WHEN event_type <> 'error' THEN ts END AS own FROM events),
clocked AS (
  SELECT *, max(own) OVER (PARTITION BY partition_id ORDER BY arrival_seq ROWS UNBOUNDED PRECEDING) AS stream_time
  FROM body)
SELECT key, partition_id, arrival_seq, coalesce(own, stream_time) AS event_time, stream_time FROM clocked""",
    "last_notification": _recursive(*TIMELINE, SEEN, _kept(21600))
    + f"""SELECT {NOTIFICATION} FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY arrival_seq DESC) AS back FROM kept) WHERE back = 1""",
    "weekly_label_latest": _with(*TIMELINE)
    + """SELECT key, max(arrival_seq) AS arrival_seq, arg_max(week_label, arrival_seq) AS week_label
  FROM timeline WHERE on_time GROUP BY key""",
    "normalize_ios": _with(ACTIVITY) + NORMALIZED + " WHERE CAST(key AS BIGINT) % 2 = 0",
    "normalize_android": _with(ACTIVITY) + NORMALIZED + " WHERE CAST(key AS BIGINT) % 2 = 1",
    "normalize_union": _with(ACTIVITY) + NORMALIZED,
    "step_label": _with(ACTIVITY)
    + """SELECT key, arrival_seq, steps, CASE WHEN steps < 1000 THEN 'daily_low_stepper'
  WHEN steps < 5000 THEN 'daily_medium_stepper' ELSE 'daily_high_stepper' END AS label,
  CAST(date_trunc('day', "timestamp") AS TIMESTAMP) AS day_start FROM activity""",
    "daily_steps": _with(ACTIVITY, DAILY) + 'SELECT key, "userId", steps, day, label FROM labelled',
    "daily_metrics": _with(ACTIVITY, DAILY)
    + """SELECT count(*) AS rows, CAST(sum(steps) AS BIGINT) AS steps,
  count(*) FILTER (label = 'daily_low_stepper') AS daily_low_stepper,
  count(*) FILTER (label = 'daily_medium_stepper') AS daily_medium_stepper,
  count(*) FILTER (label = 'daily_high_stepper') AS daily_high_stepper FROM labelled""",
    "daily_steps_changelog": _with(*TIMELINE)
    + 'SELECT key, arrival_seq, "userId", day, total AS steps, day_label FROM timeline WHERE on_time',
    "late_steps_changelog": _with(*LATE_TIMELINE)
    + 'SELECT key, arrival_seq, "userId", day, total AS steps, day_label FROM timeline WHERE on_time',
    "daily_steps_grace": _with(LATE, TIMED)
    + """SELECT key, arg_max("userId", arrival_seq) AS "userId", CAST(sum(steps) AS BIGINT) AS steps, day,
  CASE WHEN sum(steps) < 1000 THEN 'daily_low_stepper' WHEN sum(steps) < 5000 THEN 'daily_medium_stepper'
       ELSE 'daily_high_stepper' END AS label FROM timed WHERE on_time GROUP BY key, day""",
    "late_rows": _with(LATE, TIMED)
    + 'SELECT event_id, key, partition_id, arrival_seq, "timestamp" FROM timed WHERE NOT on_time',
    "history7": _with(ACTIVITY, DAILY)
    + """SELECT key, day, label, position FROM (
  SELECT key, day, label, CAST(row_number() OVER (PARTITION BY key ORDER BY day DESC) AS INTEGER) AS position
  FROM labelled) WHERE position <= 7""",
    "gap_check": _with(ACTIVITY, DAILY)
    + """, kept AS (
  SELECT a.key, a.day, b.day AS kept_day, row_number() OVER (PARTITION BY a.key, a.day ORDER BY b.day DESC) AS back
  FROM daily a JOIN daily b ON b.key = a.key AND b.day <= a.day),
stepped AS (
  SELECT *, kept_day - lag(kept_day) OVER (PARTITION BY key, day ORDER BY kept_day) AS step FROM kept WHERE back <= 7)
SELECT key, day, CAST(count(*) AS INTEGER) AS days_kept, CAST(max(step) AS INTEGER) AS widest_step,
  coalesce(max(step) <= 1, true) AS continuous FROM stepped GROUP BY key, day""",
    "weekly_label": _with(ACTIVITY, DAILY)
    + """, kept AS (
  SELECT a.key, a.day, b.day AS kept_day, b.steps,
         row_number() OVER (PARTITION BY a.key, a.day ORDER BY b.day DESC) AS back
  FROM daily a JOIN daily b ON b.key = a.key AND b.day <= a.day)
SELECT key, day, CASE WHEN count(*) < 7 OR max(kept_day) - min(kept_day) > 6 THEN ''
  WHEN bool_and(steps >= 1000) THEN 'medium_or_high' ELSE 'low' END AS week_label
FROM kept WHERE back <= 7 GROUP BY key, day""",
    "weekly_all_match": _with(ACTIVITY, DAILY)
    + """SELECT key, CAST(count(*) AS INTEGER) AS days_kept, bool_and(label <> 'daily_low_stepper') AS all_medium_or_high
FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY day DESC) AS back FROM labelled)
WHERE back <= 7 GROUP BY key""",
    "hourly_labels": _with(ACTIVITY)
    + """, hours AS (
  SELECT key, CAST(date_trunc('hour', "timestamp") AS TIMESTAMP) AS start, sum(steps) AS steps FROM activity GROUP BY ALL),
kept AS (
  SELECT a.key, a.start, b.start AS kept_start, b.steps, row_number() OVER (PARTITION BY a.key, a.start ORDER BY b.start DESC) AS back
  FROM hours a JOIN hours b ON b.key = a.key AND b.start <= a.start),
stepped AS (
  SELECT *, epoch_us(kept_start) - epoch_us(lag(kept_start) OVER (PARTITION BY key, start ORDER BY kept_start)) AS step
  FROM kept WHERE back <= 7)
SELECT key, start, CAST(count(*) AS INTEGER) AS windows_kept, CAST(max(step) / 1000000 AS DOUBLE) AS widest_seconds,
  coalesce(max(step) <= 86400000000, true) AS continuous,
  CASE WHEN count(*) < 7 OR max(step) > 86400000000 THEN '' WHEN bool_and(steps >= 1000) THEN 'medium_or_high'
       ELSE 'low' END AS window_label
FROM stepped GROUP BY key, start""",
    "weekly_label_changelog": _with(*TIMELINE)
    + "SELECT key, arrival_seq, day, week_label FROM timeline WHERE on_time",
    "late_label_changelog": _with(*LATE_TIMELINE)
    + "SELECT key, arrival_seq, day, week_label FROM timeline WHERE on_time",
    "label_join": _with(*TIMELINE)
    + """SELECT key, arrival_seq, "userId", "timestamp", label_seen AS label FROM timeline
  WHERE label_seen IS NOT NULL""",
    "label_join_fresh": _with(*TIMELINE)
    + 'SELECT key, arrival_seq, "userId", "timestamp", label_now AS label FROM timeline WHERE label_now IS NOT NULL',
    "notification_candidates": _with(*TIMELINE, SEEN) + f"SELECT {NOTIFICATION} FROM candidate",
    "debounce": _recursive(
        ACTIVITY, "candidate AS MATERIALIZED (SELECT key, arrival_seq, \"timestamp\" FROM activity)", _kept(21600)
    )
    + 'SELECT key, arrival_seq, "timestamp" FROM kept',
    "notifications": _recursive(*TIMELINE, SEEN, _kept(10)) + f"SELECT {NOTIFICATION} FROM kept",
    "notifications_six_hours": _recursive(*TIMELINE, SEEN, _kept(21600)) + f"SELECT {NOTIFICATION} FROM kept",
    "late_notifications": _recursive(*LATE_TIMELINE, SEEN, _kept(21600)) + f"SELECT {NOTIFICATION} FROM kept",
    "notifications_of_keyed": _recursive(KEYED, *TIMELINE[1:], SEEN, _kept(21600)) + f"SELECT {NOTIFICATION} FROM kept",
    "outbox": _recursive(*TIMELINE, SEEN, _kept(21600))
    + """SELECT key, arrival_seq, "userId",
  sha256(key || '#' || CAST(epoch_us("timestamp") AS VARCHAR) || '#' || CAST(arrival_seq AS VARCHAR)) AS "notificationId",
  'Time for a juice nearby!' || "userId" AS payload, "timestamp", CAST("timestamp" AS DATE) AS day FROM kept""",
    "stream_normalized": _with(ACTIVITY) + NORMALIZED,
    "stream_daily_steps": _with(ACTIVITY, DAILY) + 'SELECT key, "userId", steps, day, label FROM labelled',
    "stream_changes": _recursive(*TIMELINE, SEEN, _kept(21600)) + CHANGES,
    "stream_late_changes": _recursive(*LATE_TIMELINE, SEEN, _kept(21600)) + CHANGES,
}

ORACLE |= {
    "steps_changelog_30h": _with(*_very_late(30))
    + 'SELECT key, arrival_seq, "userId", day, total AS steps, day_label FROM timeline WHERE on_time',
    "label_changelog_30h": _with(*_very_late(30)) + "SELECT key, arrival_seq, day, week_label FROM timeline WHERE on_time",
    "label_changelog_72h": _with(*_very_late(72)) + "SELECT key, arrival_seq, day, week_label FROM timeline WHERE on_time",
    "label_changelog_9d": _recursive(*_very_late(216, WALK))
    + """SELECT key, arrival_seq, t.day, week_label FROM timed t JOIN walked USING (key, arrival_seq)""",
    "notifications_72h": _recursive(*_very_late(72), SEEN, _kept(21600)) + f"SELECT {NOTIFICATION} FROM kept",
    "label_table": _with(LABEL_LOG)
    + """SELECT key, change_seq, label FROM labels_given
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY change_seq DESC) = 1 AND label IS NOT NULL""",
    "notification_table": _with(SENT_LOG)
    + """SELECT key, change_seq, sent_at FROM sent_given
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY change_seq DESC) = 1 AND sent_at IS NOT NULL""",
    "label_join_given": _with(*GIVEN)
    + 'SELECT key, arrival_seq, "userId", "timestamp", label FROM labelled_given WHERE label IS NOT NULL',
    "late_label_join_given": _with(
        LATE, TIMED, LABEL_LOG, _as_of("labelled_given", "timed", "labels_given", "label", "clock")
    )
    + 'SELECT key, arrival_seq, "userId", "timestamp", label FROM labelled_given WHERE label IS NOT NULL',
    "last_notification_join_given": _with(*GIVEN)
    + 'SELECT key, arrival_seq, "userId", "timestamp", sent_at FROM with_last',
    "notifications_given": _with(*GIVEN)
    + f"""SELECT {NOTIFICATION} FROM with_last WHERE sent_at IS NULL
  OR abs(floor((epoch_us(sent_at) - epoch_us("timestamp")) / 1000000.0)) > 21600""",
}

# The same rows by another way: the blocks of hot keys, and the running job.
for _name, _same_as in {
    "notifications_in_blocks": "notifications_six_hours",
    "late_notifications_in_blocks": "late_notifications",
    "late_label_changelog_in_blocks": "late_label_changelog",
    "stream_quarantine": "quarantine",
    "stream_labels": "weekly_label_latest",
    "stream_notifications": "notifications_six_hours",
    "stream_end_to_end": "outbox",
    "label_changelog_72h_in_blocks": "label_changelog_72h",
    "label_join_given_in_blocks": "label_join_given",
    "stream_very_late_changes": "label_changelog_9d",
    "stream_debounce_in_blocks": "debounce",
    "stream_label_table": "label_table",
    "stream_notifications_given": "notifications_given",
}.items():
    ORACLE[_name] = ORACLE[_same_as]
