"""One flat layout for the two platforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.schemas import ENVELOPE_FIELDS


def normalize_ios(decoded: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """`decoded` has the envelope and a `record` in the iOS layout; columns to `keep` come along."""
    return decoded.select(
        *ENVELOPE_FIELDS,
        *keep,
        F.col("record.UserId").alias("userId"),
        F.col("record.UserFirstName").alias("firstName"),
        F.col("record.UserLastName").alias("lastName"),
        F.col("record.PhysicalActivity.walking_steps").alias("steps"),
        F.col("record.Geo_lat").alias("latitude"),
        F.col("record.Geo_lon").alias("longitude"),
        F.col("record.pincode").alias("pincode"),
        F.col("record.event_timestamp").alias("timestamp"),
    )


def normalize_android(decoded: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Same for the Android layout; a record without `Location` has null coordinates."""
    return decoded.select(
        *ENVELOPE_FIELDS,
        *keep,
        F.col("record.Person.Id").alias("userId"),
        F.col("record.Person.FirstName").alias("firstName"),
        F.col("record.Person.LastName").alias("lastName"),
        F.col("record.Activity.walking_steps").alias("steps"),
        F.col("record.Location.lat").alias("latitude"),
        F.col("record.Location.lon").alias("longitude"),
        F.col("record.Location.pincode").alias("pincode"),
        F.col("record.ts").alias("timestamp"),
    )


def merge(ios: DataFrame, android: DataFrame) -> DataFrame:
    """All records of both, duplicates kept, no order implied."""
    return ios.unionByName(android)
