from __future__ import annotations

import random
import re

from stridelake.llm import surrogates as S

KEY = b"k"


def test_detection():
    text = (
        "Mail Jo.55@mail9.example.com or +1 (974) 555-3436, host 129.38.82.176, card 4952935900253052 and "
        "4111 1111 1111 1111, IBAN DE89 3704 0044 0532 0130 00, SSN 078-05-1120. Anna Schmidt met Mr. Jones; Schmidt left."
    )
    found = [(k, text[a:b]) for k, _, a, b in S.mentions(text)]
    assert found == [
        ("email", "Jo.55@mail9.example.com"), ("phone", "+1 (974) 555-3436"), ("ip", "129.38.82.176"),
        ("card", "4952935900253052"), ("card", "4111 1111 1111 1111"), ("iban", "DE89 3704 0044 0532 0130 00"),
        ("ssn", "078-05-1120"), ("first_f", "Anna"), ("last", "Schmidt"), ("last", "Jones"), ("last", "Schmidt"),
    ]
    for clean in ("on 2024-01-01 10:00 it was 3.14159265", "token=04dbebab91ab85687d33eeaaf9ac699e", "The and attion. Anna", "v1.2.3"):
        assert S.mentions(clean) == []


def test_formats_are_kept():
    assert S.luhn("4111111111111111") == 0 and S.luhn(S.surrogate(KEY, "card", "4111111111111111", 0)) == 0
    assert S.iban_remainder(S.surrogate(KEY, "iban", "DE89370400440532013000", 0)) == 1
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", S.fitted("phone", "+1 (974) 555-3436", S.surrogate(KEY, "phone", "+19745553436", 0)))
    mail = S.surrogate(KEY, "email", "erä.34@mail7.example.com", 0)
    assert re.fullmatch(r"[a-z]{3}\.\d{2}@[a-z]{4}\d\.[a-z]{7}\.example", mail)
    assert S.surrogate(KEY, "first_f", "анна", 0) in S.FIRST["cyrillic", "f"].split()
    assert S.fitted("last", "SCHMIDT", "weber") == "WEBER" and S.fitted("last", "Schmidt", "weber") == "Weber"
    assert S.surrogate(b"other", "card", "4111111111111111", 0) != S.surrogate(KEY, "card", "4111111111111111", 0)


def test_distinct_and_coreferent_in_the_corpus(spark):
    rng = random.Random(1)
    last = ["Name" + "".join(rng.choice("abcdef") for _ in range(6)) for _ in range(60)]
    rows = [(i, f"Anna {last[i % 60]} wrote to Peter {last[(i * 7) % 60]}. Call +1 (974) 555-{i % 50:04d}.", "x") for i in range(200)]
    rows += [(300, "плохо: Иван Петров и Анна Петров.", "x"), (301, None, "x"), (302, "", "x"), (302, "", "x")]
    rows += [(None, "in.55@mail9.example.com", "x"), (303, "a " * 60_000 + "IN.55@MAIL9.EXAMPLE.COM", "x"), (303, "other text", "x")]
    df = spark.createDataFrame(rows, "doc_id int, text string, known string").repartition(3)
    got = S.pseudonymise(df, KEY).collect()
    assert len(got) == len(rows)
    new = {r.doc_id: r.text for r in got}
    pattern = re.compile(r"(\S+) (\S+) wrote to (\S+) (\S+)\. Call (\+1 \(\d{3}\) \d{3}-\d{4})\.")
    surname, phone = {}, {}
    for i in range(200):
        a, b, c, d, number = pattern.fullmatch(new[i]).groups()
        assert a.lower() in S.FIRST["latin", "f"].split() and c.lower() in S.FIRST["latin", "m"].split() and a != "Anna"
        for old, name in ((last[i % 60], b), (last[(i * 7) % 60], d)):
            assert surname.setdefault(old, name) == name
        assert phone.setdefault(i % 50, number) == number
    assert len(set(surname.values())) == 60 and len(set(phone.values())) == 50
    assert not set(surname.values()) & set(last)
    assert new[None].upper() == new[303].split()[-1] if new[303].startswith("a ") else True
    assert new[301] == new[302] == ""
    assert re.fullmatch(r"плохо: [А-Я][а-я]+ ([А-Я][а-я]+) и [А-Я][а-я]+ \1\.", new[300])
    assert {r.spans for r in got if r.doc_id == 300} == {"first_m:7:11,last:12:18,first_f:21:25,last:26:32"}
    assert S.pseudonymise(df.limit(0), KEY).count() == 0


def test_national_phones_cards_and_long_addresses():
    text = (
        "Call 01 23 45 67 89 or 030 1234567, card 3782 822463 10005, host 2001:db8::1 and FE80:0:0:0:1:2:3:4. "
        "At 10:00:00 std::abs(a::b1) is 1 23 45 67 89."
    )
    found = [(k, text[a:b]) for k, _, a, b in S.mentions(text)]
    assert found == [
        ("phone", "01 23 45 67 89"), ("phone", "030 1234567"), ("card", "3782 822463 10005"),
        ("ipv6", "2001:db8::1"), ("ipv6", "FE80:0:0:0:1:2:3:4"),
    ]
    new = S.surrogate(KEY, "ipv6", "fe80:0000:0000:0000:0001:0002:0003:0004", 0)
    assert S.fitted("ipv6", "FE80:0:0:0:1:2:3:4", new).startswith("2001:DB8:")
    assert re.fullmatch(r"\d\d( \d\d){4}", S.fitted("phone", "01 23 45 67 89", S.surrogate(KEY, "phone", "0123456789", 0)))


def test_a_crowded_form_grows(spark, monkeypatch):
    """More addresses than their form has values, and numbers that are all taken."""
    monkeypatch.setattr(S, "ROUNDS", 40)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [("email", f"{a}@{b}.de") for a in letters for b in letters] + [("email", f"{a}@{n}.de") for a in letters for n in range(9)]
    table = S.surrogate_table(spark.createDataFrame(rows, "kind string, value string").repartition(3), KEY).collect()
    assert len({r.surrogate for r in table}) == len(rows) and not {r.surrogate for r in table} & {v for _, v in rows}
    monkeypatch.setattr(S, "CROWDED", 2)
    rows = [("phone", f"{n:02d}") for n in range(100)]
    table = S.surrogate_table(spark.createDataFrame(rows, "kind string, value string"), KEY).collect()
    assert len({r.surrogate for r in table}) == 100 and all(len(r.surrogate) > 2 for r in table)
    assert S.fitted("phone", "0-1", "2345") == "2-345"
