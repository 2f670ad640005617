"""Conversation repair against a plain programme over whole records, at several sizes of piece."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stridelake.llm import audits
from stridelake.llm import conversations as C

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
        seen.add((role, text))
        out.append(fault)
    return out


def cheapest(turns):
    """The least (cost, record, roles) from the end backwards, with the records spelled out."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @cache
    def best(i, state, inserts):
        options = []
        if i == len(turns):
            if state in ("", "a"):
                options.append((0, "", ()))
        else:
            initial, fault = turns[i]
            cost, record, roles = best(i + 1, state, 0)
            options.append((cost + 3, "D" + record, (("D", i),) + roles))
            if fault not in (1, 2):
                more = 1 if fault == 3 else 0
                if (state, initial) in step:
                    cost, record, roles = best(i + 1, step[state, initial], 0)
                    options.append((cost + more, "K" + record, (("K", i),) + roles))
                for new in "ua":
                    if (state, new) in step:
                        cost, record, roles = best(i + 1, new, 0)
                        options.append((cost + 2 + more, "R" + record, ((new, i),) + roles))
        if inserts < 4:
            for new in "ua":
                if (state, new) in step:
                    cost, record, roles = best(i, new, inserts + 1)
                    options.append((cost + 2, "I" + record, ((new, None),) + roles))
        return min(options, default=(10**9, "", ()))

    return best(0, "", 0)


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        part = [r for r in damage(rows) if r[0] == conv]
        part.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        kinds = faults(part)
        numbers = [r[1] for r in part if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [r[2][:1] for r in part]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, steps = cheapest(tuple(zip(initials, kinds)))
        lines = []
        for kind, i in steps:
            if kind == "D":
                continue
            role = {"u": "user", "a": "assistant"}.get(kind) or part[i][2]
            lines.append(f"{role}:{'' if i is None else part[i][3]}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *(kinds.count(k) for k in (1, 2, 3)), illegal, cost, audit, digest)
    return out


def random_rows(seed, convs=40):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(convs), None]:
        for turn in range(rng.choice([1, 2, 3, 5, 8, 40])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool"])
            text = rng.choice(["a.", "b!", "c", "", " \n", None, f"{turn} é?", "a." * 60, "a." * 60 + "x"])
            rows.append((conv, rng.choice([turn, turn, turn, turn * 3, None, turn - 1]), role, text))
    return rows


def result(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("bits", [0, 1, 3, 12])
def test_equals_brute_force_at_any_size_of_piece(spark, monkeypatch, bits):
    monkeypatch.setattr(C, "PIECE_BITS", bits)
    rows = random_rows(bits)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", conv string, at int")
    assert result(C.repaired_digests(df.repartition(3))) == brute(rows)


def test_one_long_conversation_is_cut(spark, monkeypatch):
    monkeypatch.setattr(C, "PIECE_BITS", 4)
    rng = random.Random(5)
    rows = [(7, i, rng.choice(["user", "assistant", "system"]), f"{rng.randrange(300)}.") for i in range(600)]
    rows += [(8, 0, "user", "x" * 200_000), (8, 1, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert C.coded(C.in_order(C.turns_of(df))).select("piece").distinct().count() > 30
    assert result(C.repaired_digests(df)) == brute(rows)


def test_all_turns_dropped_and_empty_table(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 0, "user", "Hi.")], SCHEMA)
    assert result(C.repaired_digests(df)) == {conv: (0, 0, 0, 0, 0, 0, "", C.EMPTY_SHA256)}
    assert C.repaired_digests(df.limit(0)).count() == 0


def test_repair_without_damage_keeps_the_texts(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes"), (1, 2, "user", "Hi."), (1, 4, "user", "More?")]
    mended = C.repair(spark.createDataFrame(rows, SCHEMA))
    report = mended.report.first()
    assert (report.gaps, report.duplicate, report.truncated, report.illegal) == (1, 1, 1, 1)
    got = [(r.role, r.text, r.edit) for r in mended.turns.orderBy("at", "sub").collect()]
    # Deleting the last turn and adding an answer cost 3 and 2.
    assert report.cost == 6 and report.audit == "KKDKI"
    assert got == [("user", "Hi.", "K"), ("assistant", "Yes", "K"), ("user", "More?", "K"), ("assistant", "", "I")]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.integers(0, 3)), max_size=14), st.sampled_from([2, 5, audits.MODULUS]))
def test_records_with_colliding_hashes(turns, modulus):
    records = audits.Records(modulus)
    cost, record = audits.cheapest(records, audits.advance(records, {audits.START: (0, 0)}, turns))
    assert (cost, records.text(record)) == cheapest(tuple(turns))[:2]


@settings(max_examples=60, deadline=None)
@given(st.text("DIKR", max_size=20), st.text("DIKR", max_size=20), st.sampled_from([2, 7, audits.MODULUS]))
def test_order_of_records(one, other, modulus):
    records, nodes = audits.Records(modulus), []
    for text in (one, other):
        node = 0
        for letter in text:
            node = records.add(node, letter)
        nodes.append(node)
    assert records.less(*nodes) == (one < other)
