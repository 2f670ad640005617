"""Record layouts. The wire layouts hold every JSON scalar as text; `sources.activity_json` types them."""

from __future__ import annotations

# Position of a record in its source: record key, source partition, offset inside the partition.
# (partition_id, arrival_seq) is unique, and all records of a key share one partition.
ENVELOPE = "key string, partition_id int, arrival_seq bigint"

IOS_RECORD = (
    "UserFirstName string, UserLastName string, UserAddress string, UserId string, UserGender string, "
    "UserHeight double, UserWeight double, "
    "PhysicalActivity struct<Dance_minutes:int,Yoga_minutes:int,Sleep_hours:int,walking_steps:int>, "
    "Geo_lat double, Geo_lon double, pincode string, event_timestamp timestamp"
)

ANDROID_RECORD = (
    "Person struct<FirstName:string,LastName:string,Address:string,Id:string,Gender:string,"
    "Height:double,Weight:double>, "
    "Activity struct<Dance_minutes:int,Yoga_minutes:int,Sleep_hours:int,walking_steps:int>, "
    "Location struct<lat:double,lon:double,pincode:string>, ts timestamp"
)

NORMALIZED = (
    "userId string, firstName string, lastName string, steps int, "
    "latitude double, longitude double, pincode string, timestamp timestamp"
)

ACTIVITY = f"{ENVELOPE}, {NORMALIZED}"

NOTIFICATION = "userId string, notificationId string, payload string, timestamp timestamp"

NOTIFICATION_ROW = f"key string, arrival_seq bigint, {NOTIFICATION}"

NORMALIZED_FIELDS = [field.split()[0] for field in NORMALIZED.split(", ")]
ENVELOPE_FIELDS = [field.split()[0] for field in ENVELOPE.split(", ")]
ACTIVITY_FIELDS = ENVELOPE_FIELDS + NORMALIZED_FIELDS
