"""The `events` table read as step activity: its rows stand for records of the two platforms.

Even users send the iOS layout, odd ones the Android layout; four source partitions by user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.operators.skew import number_in_order
from stridelake.schemas import ACTIVITY_FIELDS

# Fixed values of the mapping.
PARTITIONS = 4
STEPS_PER_VALUE = 40
LATITUDE = 1.3521
LONGITUDE = 103.8198
PINCODE = "333001"
LAST_NAME = "Doe"
LOCATED_TYPES = ("click", "view")
LATE_EVERY = 17
LATE_HOURS = 3
BODILESS_TYPE = "error"
# Given tables: labels of users one further, notifications of users two further, at times of their own.
LABEL_OF_TYPE = {"signup": "medium_or_high", "purchase": "low", "click": "", "error": None}
LABEL_USERS_ON, LABEL_SECONDS = 1, 90
SENT_TYPE, UNSENT_TYPE = "signup", "error"
SENT_USERS_ON, SENT_SECONDS = 2, 45
# Delays in hours of every n-th record: some beyond a day, some beyond a week.
LONG_DELAYS = {17: 3, 13: 40, 29: 100, 31: 190}


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def activity(events: DataFrame) -> DataFrame:
    """Normalized activity, arriving in event id order."""
    located = F.col("event_type").isin(*LOCATED_TYPES)
    user = F.col("user_id").cast("string")
    return events.select(
        user.alias("key"),
        (F.col("user_id") % PARTITIONS).cast("int").alias("partition_id"),
        F.col("event_id").alias("arrival_seq"),
        user.alias("userId"),
        F.concat(F.lit("user-"), user).alias("firstName"),
        F.lit(LAST_NAME).alias("lastName"),
        F.round(F.col("value") * STEPS_PER_VALUE).cast("int").alias("steps"),
        F.when(located, F.lit(LATITUDE)).alias("latitude"),
        F.when(located, F.lit(LONGITUDE)).alias("longitude"),
        F.when(located, F.lit(PINCODE)).alias("pincode"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def late_activity(events: DataFrame) -> DataFrame:
    """The same records, every seventeenth delivered three hours after its time."""
    delayed = F.when(F.col("arrival_seq") % LATE_EVERY == 0, LATE_HOURS).otherwise(0)
    arrived = F.col("timestamp") + F.make_dt_interval(hours=delayed)
    rows = activity(events).withColumn("arrived", arrived).withColumnRenamed("arrival_seq", "event_id")
    return number_in_order(rows, "partition_id", "arrived", "event_id").select("event_id", *ACTIVITY_FIELDS)


def very_late_activity(events: DataFrame) -> DataFrame:
    """The same records with delays of hours to days; where several delays fit, the longest holds."""
    hours = F.greatest(*[F.when(F.col("arrival_seq") % n == 0, h).otherwise(0) for n, h in LONG_DELAYS.items()])
    arrived = F.col("timestamp") + F.make_dt_interval(hours=hours)
    rows = activity(events).withColumn("arrived", arrived).withColumnRenamed("arrival_seq", "event_id")
    return number_in_order(rows, "partition_id", "arrived", "event_id").select("event_id", *ACTIVITY_FIELDS)


def label_log(events: DataFrame) -> DataFrame:
    """A label table given as a log of changes (key, change_seq, timestamp, label); a null label deletes the row."""
    kind = F.col("event_type")
    label = F.coalesce(*[F.when(kind == name, F.lit(text)) for name, text in LABEL_OF_TYPE.items() if text is not None])
    return _changes(events.where(kind.isin(*LABEL_OF_TYPE)), LABEL_USERS_ON, LABEL_SECONDS, label.alias("label"))


def sent_log(events: DataFrame) -> DataFrame:
    """A notification table given as a log (key, change_seq, timestamp, sent_at); a null `sent_at` deletes the row."""
    kind = F.col("event_type")
    at = F.col("ts").cast("timestamp") + F.make_dt_interval(secs=F.lit(SENT_SECONDS))
    sent = F.when(kind == SENT_TYPE, at).alias("sent_at")
    return _changes(events.where(kind.isin(SENT_TYPE, UNSENT_TYPE)), SENT_USERS_ON, SENT_SECONDS, sent)


def _changes(events: DataFrame, users_on: int, seconds: int, value) -> DataFrame:
    return events.select(
        (F.col("user_id") + users_on).cast("string").alias("key"),
        F.col("event_id").alias("change_seq"),
        (F.col("ts").cast("timestamp") + F.make_dt_interval(secs=F.lit(seconds))).alias("timestamp"),
        value,
    )


def activity_with_gaps(events: DataFrame) -> DataFrame:
    """Records whose body may be missing: those of one event type have no timestamp and no steps."""
    has_body = F.col("event_type") != BODILESS_TYPE
    envelope = ["key", "partition_id", "arrival_seq"]
    rows = activity(events.withColumn("ts", F.when(has_body, F.col("ts"))))
    return rows.select(
        *envelope,
        *[
            F.when(F.col("timestamp").isNotNull(), F.col(name)).alias(name)
            for name in ACTIVITY_FIELDS
            if name not in envelope
        ],
    )


def ios_feed(events: DataFrame) -> DataFrame:
    """iOS JSON documents: (key, partition_id, arrival_seq, value)."""
    rows = activity(events.where(F.col("user_id") % 2 == 0))
    document = F.struct(
        F.col("firstName").alias("UserFirstName"),
        F.col("lastName").alias("UserLastName"),
        F.col("userId").alias("UserId"),
        F.lit("male").alias("UserGender"),
        F.lit(175).alias("UserHeight"),
        F.lit(70).alias("UserWeight"),
        _activity_struct().alias("PhysicalActivity"),
        F.col("latitude").alias("Geo_lat"),
        F.col("longitude").alias("Geo_lon"),
        F.col("pincode").cast("int").alias("pincode"),
        _wire_time().alias("event_timestamp"),
    )
    return rows.select(
        "key", "partition_id", "arrival_seq", F.to_json(document, {"ignoreNullFields": "false"}).alias("value")
    )


def android_feed(events: DataFrame) -> DataFrame:
    """Android JSON documents; `Location` is left out where there is none."""
    rows = activity(events.where(F.col("user_id") % 2 == 1))
    document = F.struct(
        F.struct(
            F.col("firstName").alias("FirstName"),
            F.col("lastName").alias("LastName"),
            F.col("userId").alias("Id"),
            F.lit("male").alias("Gender"),
            F.lit(175).alias("Height"),
            F.lit(70).alias("Weight"),
        ).alias("Person"),
        _activity_struct().alias("Activity"),
        F.when(
            F.col("latitude").isNotNull(),
            F.struct(
                F.col("latitude").alias("lat"),
                F.col("longitude").alias("lon"),
                F.col("pincode").cast("int").alias("pincode"),
            ),
        ).alias("Location"),
        _wire_time().alias("ts"),
    )
    return rows.select("key", "partition_id", "arrival_seq", F.to_json(document).alias("value"))


def foreign_feed(events: DataFrame) -> DataFrame:
    """Valid JSON of another kind under the same envelope: the `props` of each event."""
    return events.select(
        F.col("user_id").cast("string").alias("key"),
        (F.col("user_id") % PARTITIONS).cast("int").alias("partition_id"),
        F.col("event_id").alias("arrival_seq"),
        F.col("props").alias("value"),
    )


def _activity_struct():
    return F.struct(
        F.lit(100).alias("Dance_minutes"),
        F.lit(100).alias("Yoga_minutes"),
        F.lit(3).alias("Sleep_hours"),
        F.col("steps").alias("walking_steps"),
    )


def _wire_time():
    return F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
