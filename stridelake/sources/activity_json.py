"""Platform JSON to typed records, and normalized records to JSON.

Every JSON scalar is read as text and then typed here, because producers mix forms that the built-in
typed parser would turn into nulls: counts as 12, 12.7 or "12", pincodes as numbers, times as ISO text or
epoch seconds with or without a fraction. What does not fit its type makes the record faulty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridelake.functions.rules import instant_text
from stridelake.schemas import ANDROID_RECORD, ENVELOPE_FIELDS, IOS_RECORD, NORMALIZED, NORMALIZED_FIELDS

# Parts a record cannot do without, and its event time.
REQUIRED = {
    IOS_RECORD: (["PhysicalActivity"], "event_timestamp"),
    ANDROID_RECORD: (["Person", "Activity"], "ts"),
    NORMALIZED: ([], "timestamp"),
}
# Measures that read as zero when absent; all other fields stay null.
ZERO_WHEN_ABSENT = {
    "UserHeight",
    "UserWeight",
    "Height",
    "Weight",
    "Dance_minutes",
    "Yoga_minutes",
    "Sleep_hours",
    "walking_steps",
    "steps",
}
ISO_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})$"

UNPARSED = "_unparsed"
NO_BODY = "no body"
NOT_JSON = "not a JSON object"
MISSING = "missing "
BAD_FIELD = "bad field "
UNKNOWN_FIELD = "unknown field "


def decode_ios(feed: DataFrame, strict: bool = False, reject_unknown: bool = False) -> DataFrame:
    return decode(feed, IOS_RECORD, strict, reject_unknown)


def decode_android(feed: DataFrame, strict: bool = False, reject_unknown: bool = False) -> DataFrame:
    return decode(feed, ANDROID_RECORD, strict, reject_unknown)


def decode(feed: DataFrame, layout: str, strict: bool = False, reject_unknown: bool = False) -> DataFrame:
    """Add `record` in the given layout and `fault`, null for a good record; else `record` is not to be used.

    `feed` has the envelope columns and `value`. Split the result with `accepted` and `quarantined`.
    `strict` fails the query at the first fault instead; `reject_unknown` makes extra fields a fault.
    """
    record_type = T.StructType.fromDDL(layout)
    # An explode of one element keeps the optimizer from copying the parser, and then the casts, into every
    # use of a field.
    layout_as_text = _as_text(record_type).add(UNPARSED, "string")
    document = F.from_json("value", layout_as_text, {"columnNameOfCorruptRecord": UNPARSED})
    parsed = feed.select(*ENVELOPE_FIELDS, "value", F.explode(F.array(document)).alias("_text"))
    text, record = F.col("_text"), F.col("record")
    typed = parsed.select(
        *ENVELOPE_FIELDS, "value", "_text", F.explode(F.array(_typed(text, record_type))).alias("record")
    )
    required, time_field = REQUIRED[layout]
    # An object opens with a brace; the parser takes some other things for empty objects.
    is_object = F.ltrim("value").startswith("{") & text.isNotNull() & text[UNPARSED].isNull()
    faults = [
        F.when(F.col("value").isNull(), NO_BODY),
        F.when(~F.coalesce(is_object, F.lit(False)), NOT_JSON),
        *[F.when(text[part].isNull(), MISSING + part) for part in required],
        F.when(text[time_field].isNull(), MISSING + time_field),
        *[
            F.when(value.isNull() & (F.trim(written) != ""), BAD_FIELD + field.name)
            for field, written, value in _leaves(text, record, record_type)
            if not isinstance(field.dataType, T.StringType)
        ],
    ]
    if reject_unknown:
        faults += _unknown_fields(record_type)
    fault = F.coalesce(*faults)
    if strict:
        fault = F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("undecodable activity: "), fault)))
    return typed.select(*ENVELOPE_FIELDS, "value", "record", fault.cast("string").alias("fault"))


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("fault").isNull()).select(*ENVELOPE_FIELDS, "record")


def quarantined(decoded: DataFrame) -> DataFrame:
    """Faulty records with their text as it came."""
    return decoded.where(F.col("fault").isNotNull()).select(*ENVELOPE_FIELDS, "value", "fault")


def encode_normalized(activity: DataFrame) -> DataFrame:
    """Normalized records as JSON documents: nulls written out, time as an ISO instant."""
    fields = [
        instant_text(F.col(name)).alias(name) if name == "timestamp" else F.col(name) for name in NORMALIZED_FIELDS
    ]
    return activity.select(
        *ENVELOPE_FIELDS, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value")
    )


def decode_normalized(feed: DataFrame) -> DataFrame:
    """The way back from `encode_normalized`; a record without a value keeps its place with null fields.

    Missing steps are zero. Faulty values are left out; `quarantined(check_normalized(feed))` has them.
    """
    usable = check_normalized(feed).where(F.coalesce(F.col("fault") == NO_BODY, F.lit(True)))
    good = F.col("fault").isNull()
    return usable.select(
        *ENVELOPE_FIELDS, *[F.when(good, F.col("record")[name]).alias(name) for name in NORMALIZED_FIELDS]
    )


def check_normalized(feed: DataFrame, strict: bool = False) -> DataFrame:
    """`decode` for normalized documents."""
    return decode(feed, NORMALIZED, strict)


def _as_text(struct: T.StructType) -> T.StructType:
    return T.StructType(
        [
            T.StructField(f.name, _as_text(f.dataType) if isinstance(f.dataType, T.StructType) else T.StringType())
            for f in struct.fields
        ]
    )


def _leaves(text: Column, record: Column, struct: T.StructType):
    """Scalar fields with the text they came as and the value it gave."""
    for field in struct.fields:
        if isinstance(field.dataType, T.StructType):
            yield from _leaves(text[field.name], record[field.name], field.dataType)
        else:
            yield field, text[field.name], record[field.name]


def _unknown_fields(struct: T.StructType, path: str = "$") -> list[Column]:
    names = F.json_object_keys(F.get_json_object("value", path) if path != "$" else F.col("value"))
    extra = F.array_except(names, F.array(*[F.lit(f.name) for f in struct.fields]))
    found = [F.when(F.size(extra) > 0, F.concat(F.lit(UNKNOWN_FIELD), extra[0]))]
    for field in struct.fields:
        if isinstance(field.dataType, T.StructType):
            found += _unknown_fields(field.dataType, f"{path}.{field.name}")
    return found


def _typed(text: Column, struct: T.StructType) -> Column:
    fields = []
    for field in struct.fields:
        written = text[field.name]
        if isinstance(field.dataType, T.StructType):
            value = F.when(written.isNotNull(), _typed(written, field.dataType))
        else:
            value = _scalar(written, field.dataType)
            if field.name in ZERO_WHEN_ABSENT:
                absent = written.isNull() | (F.trim(written) == "")
                value = F.when(absent, F.lit(0).cast(field.dataType)).otherwise(value)
        fields.append(value.alias(field.name))
    return F.struct(*fields)


def _scalar(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.TimestampType):
        return _instant(text)
    number = text.try_cast("double")
    return number.try_cast("int") if isinstance(kind, T.IntegerType) else number


def _instant(text: Column) -> Column:
    """ISO instant with a zone, or epoch seconds with an optional fraction."""
    seconds = text.try_cast("decimal(20,6)")
    return F.when(text.rlike(ISO_INSTANT), text.try_cast("timestamp")).otherwise(
        F.timestamp_micros((seconds * 1_000_000).try_cast("bigint"))
    )
