import json

import pytest

from stridelake.operators.normalize import merge, normalize_android, normalize_ios
from stridelake.sources import activity_json as codec
from stridelake.sources.streams import FEED

IOS = {
    "UserFirstName": "MEDIUM-user-1",
    "UserLastName": "Doe",
    "UserId": "MEDIUM-user-1",
    "UserGender": "male",
    "UserHeight": 175,
    "UserWeight": 70,
    "PhysicalActivity": {"Dance_minutes": 100, "Yoga_minutes": 100, "Sleep_hours": 3, "walking_steps": 72},
    "Geo_lat": 1.3521,
    "Geo_lon": 103.8198,
    "pincode": 333001,
    "event_timestamp": "2024-01-01T10:00:00.000Z",
}
ANDROID = {
    "Person": {"FirstName": "MEDIUM-user-2", "LastName": "Doe", "Id": "MEDIUM-user-2", "Gender": "male",
               "Height": 175, "Weight": 70},
    "Activity": {"Dance_minutes": 100, "Yoga_minutes": 100, "Sleep_hours": 3, "walking_steps": 72},
    "Location": {"lat": 1.3521, "lon": 103.8198, "pincode": 333001},
    "ts": "2024-01-01T10:00:00.000Z",
}


def steps(value):
    return {**IOS, "PhysicalActivity": {**IOS["PhysicalActivity"], "walking_steps": value}}


def without(document, name):
    return {k: v for k, v in document.items() if k != name}


@pytest.fixture
def feed(spark):
    def build(*documents):
        rows = [
            ("k", 0, seq, document if document is None or isinstance(document, str) else json.dumps(document))
            for seq, document in enumerate(documents)
        ]
        return spark.createDataFrame(rows, FEED)

    return build


def by_seq(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("arrival_seq").collect()]


def test_both_platforms_give_one_layout(feed):
    bare = without(ANDROID, "Location")
    merged = merge(
        normalize_ios(codec.accepted(codec.decode_ios(feed(IOS)))),
        normalize_android(codec.accepted(codec.decode_android(feed(ANDROID, bare)))),
    )
    rows = {(r.userId, r.latitude, r.longitude, r.pincode, r.steps, str(r.timestamp)) for r in merged.collect()}
    when = "2024-01-01 10:00:00"
    assert rows == {
        ("MEDIUM-user-1", 1.3521, 103.8198, "333001", 72, when),
        ("MEDIUM-user-2", 1.3521, 103.8198, "333001", 72, when),
        ("MEDIUM-user-2", None, None, None, 72, when),
    }


def test_counts_come_in_several_forms(feed):
    activity = without(IOS["PhysicalActivity"], "walking_steps")
    documents = [steps(12.7), steps("12"), steps(7), steps(None), steps(""), {**IOS, "PhysicalActivity": activity}]
    rows = normalize_ios(codec.accepted(codec.decode_ios(feed(*documents))))
    assert by_seq(rows, "steps") == [(12,), (12,), (7,), (0,), (0,), (0,)]


def test_times_come_in_several_forms(feed):
    times = ["2024-01-01T10:00:00Z", "2024-01-01T12:00:00.000001+02:00", 1704103200, 1704103200.5]
    rows = normalize_ios(codec.accepted(codec.decode_ios(feed(*[{**IOS, "event_timestamp": t} for t in times]))))
    assert [str(t) for (t,) in by_seq(rows, "timestamp")] == [
        "2024-01-01 10:00:00",
        "2024-01-01 10:00:00.000001",
        "2024-01-01 10:00:00",
        "2024-01-01 10:00:00.500000",
    ]


FAULTY = [
    (None, "no body"),
    ("not json", "not a JSON object"),
    ("[1]", "not a JSON object"),
    (json.dumps(IOS)[:-1], "not a JSON object"),
    (without(IOS, "PhysicalActivity"), "missing PhysicalActivity"),
    (without(IOS, "event_timestamp"), "missing event_timestamp"),
    (steps("many"), "bad field walking_steps"),
    (steps(3_000_000_000), "bad field walking_steps"),
    ({**IOS, "event_timestamp": "yesterday"}, "bad field event_timestamp"),
    ({**IOS, "event_timestamp": "2024-01-01T10:00:00"}, "bad field event_timestamp"),
    ({**IOS, "UserHeight": "tall"}, "bad field UserHeight"),
]


def test_faults_go_to_quarantine_with_their_text(feed):
    documents = [d for d, _ in FAULTY]
    decoded = codec.decode_ios(feed(IOS, *documents))
    bad = codec.quarantined(decoded)
    assert [f for (f,) in by_seq(bad, "fault")] == [fault for _, fault in FAULTY]
    texts = [d if d is None or isinstance(d, str) else json.dumps(d) for d in documents]
    assert [v for (v,) in by_seq(bad, "value")] == texts
    assert codec.accepted(decoded).count() == 1


def test_android_faults(feed):
    decoded = codec.decode_android(feed(without(ANDROID, "Person"), without(ANDROID, "Activity"), ANDROID))
    assert by_seq(decoded, "fault") == [("missing Person",), ("missing Activity",), (None,)]


def test_strict_fails_the_query(feed):
    assert codec.accepted(codec.decode_ios(feed(IOS), strict=True)).count() == 1
    with pytest.raises(Exception, match="missing PhysicalActivity"):
        codec.accepted(codec.decode_ios(feed(without(IOS, "PhysicalActivity")), strict=True)).collect()


def test_unknown_fields_are_ignored_unless_rejected(feed):
    nested = {**IOS, "PhysicalActivity": {**IOS["PhysicalActivity"], "laps": 1}}
    rows = feed({**IOS, "extra": 1}, nested, IOS)
    assert by_seq(codec.decode_ios(rows), "fault") == [(None,)] * 3
    rejected = codec.decode_ios(rows, reject_unknown=True)
    assert by_seq(rejected, "fault") == [("unknown field extra",), ("unknown field laps",), (None,)]


def test_encode_and_back(feed, activity):
    from conftest import at

    rows = activity(("u", at(microseconds=7), 5))
    encoded = codec.encode_normalized(rows)
    assert encoded.first()["value"] == (
        '{"userId":"u","firstName":"first","lastName":"last","steps":5,"latitude":null,"longitude":null,'
        '"pincode":null,"timestamp":"2024-01-01T10:00:00.000007Z"}'
    )
    assert codec.decode_normalized(encoded).collect() == rows.collect()


def test_a_record_without_body_keeps_its_place(feed):
    rows = codec.decode_normalized(feed(None))
    assert by_seq(rows, "key", "steps", "timestamp") == [("k", None, None)]
