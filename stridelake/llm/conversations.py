"""Repair of damaged conversations: the cheapest edits, their record, and the turns that are left.

The turns are sorted once over the whole table (ranges of conversation and turn), so a conversation of any length is
cut into pieces of bounded size that lie side by side. Each piece gives the best way from every state it may be
entered with to every state it may be left with (`audits`); a short walk over the pieces of a conversation picks
one way through them, and the plan of each piece goes back to its turns by their place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridelake.llm import audits
from stridelake.llm.common import bounded_batches
from stridelake.llm.line_dedup import SPACES
from stridelake.session import staged

#: Turns in one piece: 2 ** PIECE_BITS.
PIECE_BITS = 12
SORT_CHARS = 64

FIGURES = (
    "blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_initial string, last_initial string, "
    "first_turn bigint, last_turn bigint, turns bigint"
)
FIGURE_NAMES = [part.split()[0] for part in FIGURES.split(", ")]
SEGMENT = f"conv string, piece bigint, first_at bigint, entry int, exit int, cost bigint, audit string, plan array<string>, {FIGURES}"
CHOSEN = (
    "conv string, first_at bigint, plan array<string>, tail string, gaps bigint, blank bigint, duplicate bigint, "
    "truncated bigint, illegal bigint, cost bigint, audit string"
)
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def conversation_key(conv_id: Column) -> Column:
    """A text that tells every id, the missing one too, from the others."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def turns_of(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; a missing role or text is one space."""
    space = F.lit(" ")
    return rows.select(
        rows["conv_id"].alias("conv_id"),
        rows["turn"].cast("bigint").alias("turn"),
        F.coalesce(rows["role"].cast("string"), space).alias("role"),
        F.coalesce(rows["text"].cast("string"), space).alias("text"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Turns with faults planted by crc32(`conv_id:turn`) % 20 (a missing part is one space).

    0 drops the turn, 1 empties its text, 2 takes out its end marks, 3 repeats it, 4 makes it the user's.
    """
    space = F.lit(" ")
    turns = turns_of(rows)
    name = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)
    )
    kind = F.crc32(name.cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", ""))
    return (
        turns.withColumn("kind", kind)
        .where("kind <> 0")
        .withColumn("text", text.otherwise(F.col("text")))
        .withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))))
        .select("conv_id", "turn", "role", "text")
    )


@dataclass(frozen=True)
class Repair:
    """`report`: one row for each conversation with turns (conv_id, the counts, cost, audit).

    `turns`: one row for each turn that is left or inserted (conv_id, at, sub, turn, role, text, edit), in the order of
    (at, sub) inside its conversation.
    """

    report: DataFrame
    turns: DataFrame


def in_order(turns: DataFrame) -> DataFrame:
    """The turns as a written table with `at`: a number that rises through the whole table in order of conversation
    and turn (a missing one first), then role and text.

    The ranges look at the first characters of the texts, which is all that the driver sees of them, and may end
    inside a conversation, so one that holds a third of all turns is dealt to as many tasks as its share.
    """
    keyed = turns.withColumns(
        {
            "conv": conversation_key(F.col("conv_id")),
            "head": F.substring("text", 1, SORT_CHARS),
            "mark": F.xxhash64("text"),
            "mark2": F.xxhash64(F.lit(1), F.col("text")),
        }
    )
    order = ["conv", "turn", "role"]
    placed = keyed.repartitionByRange(*order, "head").sortWithinPartitions(*order, "text").drop("head")
    return staged(placed.withColumn("at", F.monotonically_increasing_id()), "turns")


def coded(placed: DataFrame) -> DataFrame:
    """conv, piece, at, turn, initial, fault: what the edits depend on, without the texts."""
    same = ["conv", "role", "mark", "mark2"]
    repeated = placed.groupBy(*same).agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = staged(repeated.drop("n"), "repeated-turns")
    bare = F.btrim("text", F.lit(SPACES))
    ends = F.coalesce(F.substring(bare, -1, 1).isin(".", "!", "?"), F.lit(False))
    narrow = placed.select(
        *same, "at", "turn", (bare == "").alias("is_blank"), ends.alias("ends"), F.substring("role", 1, 1).alias("initial")
    )
    fault = (
        F.when(F.col("is_blank"), audits.BLANK)
        .when(F.coalesce(F.col("at") > F.col("first"), F.lit(False)), audits.DUPLICATE)
        .when(~F.col("ends"), audits.TRUNCATED)
        .otherwise(audits.NONE)
    )
    piece = F.shiftright("at", PIECE_BITS)
    return narrow.join(repeated, same, "left").select(
        "conv", piece.alias("piece"), "at", "turn", "initial", fault.alias("fault")
    )


def repair(turns: DataFrame) -> Repair:
    """Find and mend the faults of conversations given as turns (conv_id, turn, role, text).

    Each turn's first fault counts: blank (nothing but ASCII white space), duplicate (role and text seen earlier in
    the conversation), truncated (no end mark). Edits: Keep 0, Rerole 2, Delete 3 (blank and duplicate turns have no
    other), Insert 2, a truncated turn that stays 1. The initials of the roles left make `(s?(ua)+)?`, at the least
    cost, and of equal costs by the record that is least in ASCII order. `gaps` are turn numbers that are missing between
    the first and the last; `illegal` are neighbours whose initials are none of su, ua, au.

    Missing roles and texts are one space, turns without a number come first, turns without a conversation make one of
    their own. A role without a first letter can't be kept. Repeated rows are turns like others. An empty table
    gives empty ones; other columns are not read.
    """
    placed = in_order(turns_of(turns))
    segments = staged(coded(placed).groupBy("piece").applyInArrow(_segments, SEGMENT), "conversation-pieces")
    walked = segments.repartition("conv").sortWithinPartitions("conv", "piece", "entry", "exit")
    bounded_batches(turns.sparkSession)
    chosen = staged(walked.mapInArrow(_choose, CHOSEN), "conversation-plans")
    ids = placed.groupBy("conv").agg(F.first("conv_id").alias("conv_id"))
    report = chosen.where("audit IS NOT NULL").join(ids, "conv").select("conv_id", *COUNTS, "audit")
    return Repair(report, _edited(placed, chosen))


def _segments(table: pa.Table) -> pa.Table:
    """The ways through one piece, conversation by conversation. Only the first one can have begun before the piece."""
    rows = sorted(zip(*(table[name].to_pylist() for name in ("at", "conv", "turn", "initial", "fault"))))
    piece = table["piece"][0].as_py()
    out = []
    for number, (conv, group) in enumerate(groupby(rows, key=lambda row: row[1])):
        part = list(group)
        turns = [(row[3], row[4]) for row in part]
        faults = [row[4] for row in part]
        numbers = [row[2] for row in part if row[2] is not None]
        initials = [row[3] for row in part]
        figures = (
            faults.count(audits.BLANK),
            faults.count(audits.DUPLICATE),
            faults.count(audits.TRUNCATED),
            sum(_illegal(a, b) for a, b in zip(initials, initials[1:])),
            initials[0],
            initials[-1],
            numbers[0] if numbers else None,
            numbers[-1] if numbers else None,
            len(set(numbers)),
        )
        entries = audits.STATES if number == 0 else (audits.START,)
        for entry, leaves, cost, audit, plan in audits.segment(turns, entries):
            out.append((conv, piece, part[0][0], entry, leaves, cost, audit, plan, *figures))
    return _table(out, SEGMENT)


def _illegal(one: str, other: str) -> bool:
    return one + other not in ("su", "ua", "au")


ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}


def _table(rows: list[tuple], layout: str) -> pa.Table:
    fields = [pa.field(*(name, ARROW[kind])) for name, kind in (part.split() for part in layout.split(", "))]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, fields)], schema=pa.schema(fields))


class _Walk:
    """One conversation, piece by piece: the best way to each state so far, and the running figures."""

    def __init__(self, conv: str):
        self.conv = conv
        self.records = audits.Records()
        self.ways = {audits.START: (0, 0)}
        self.segments: dict[int, tuple[int, list[str]]] = {}
        self.counts = [0, 0, 0, 0]
        self.first_turn = self.last_turn = self.last_initial = None
        self.turns = 0

    def add(self, rows: list[dict]) -> None:
        figures = rows[0]
        for i, name in enumerate(("blank", "duplicate", "truncated", "illegal")):
            self.counts[i] += figures[name]
        if self.last_initial is not None:
            self.counts[3] += _illegal(self.last_initial, figures["first_initial"])
        self.last_initial = figures["last_initial"]
        if figures["first_turn"] is not None:
            self.turns += figures["turns"] - (figures["first_turn"] == self.last_turn)
            self.first_turn = figures["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = figures["last_turn"]
        ways: dict[int, audits.Way] = {}
        for row in rows:
            before = self.ways.get(row["entry"])
            if before is None:
                continue
            cost, best = before[0] + row["cost"], ways.get(row["exit"])
            if best is not None and best[0] < cost:
                continue
            record = self.records.add(before[1], row["audit"])
            if best is None or cost < best[0] or self.records.less(record, best[1]):
                self.segments[record] = (row["first_at"], row["plan"])
                ways[row["exit"]] = (cost, record)
        self.ways = ways

    def result(self) -> Iterator[tuple]:
        cost, record = audits.cheapest(self.records, self.ways)
        path = self.records.path(record)
        inserts = [node for node in path if node not in self.segments]
        state = next(s for s, way in self.ways.items() if way[1] == (path[-len(inserts) - 1] if inserts else record))
        tail = ""
        for _ in inserts:
            tail += audits.NEEDED[state]
            state = audits.STEP[state, audits.NEEDED[state]]
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        nodes = [node for node in path if node in self.segments]
        for node in nodes:
            first_at, plan = self.segments[node]
            last = node == nodes[-1]
            rest = (gaps, *self.counts, cost, self.records.text(record)) if last else (None,) * 7
            yield (self.conv, first_at, plan, tail if last else "", *rest)


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best way through each conversation; the rows come sorted by conversation and piece."""
    walk, pending, out = None, [], []
    for batch in batches:
        for row in batch.to_pylist():
            if pending and (row["conv"], row["piece"]) != (pending[0]["conv"], pending[0]["piece"]):
                walk.add(pending)
                pending = []
            if walk is None or row["conv"] != walk.conv:
                if walk is not None:
                    out += walk.result()
                walk = _Walk(row["conv"])
            pending.append(row)
        if len(out) >= 1000:
            yield from _table(out, CHOSEN).to_batches()
            out = []
    if walk is not None:
        walk.add(pending)
        out += walk.result()
    yield from _table(out, CHOSEN).to_batches()


#: Order inside a turn: what is inserted before it, the turn, what is inserted behind the last one.
OWN, BEHIND = 100, 200


def _edited(placed: DataFrame, chosen: DataFrame) -> DataFrame:
    by_place = chosen.select(
        F.posexplode("plan").alias("pos", "step"), "first_at", F.size("plan").alias("n"), "tail"
    ).select(
        (F.col("first_at") + F.col("pos")).alias("at"),
        "step",
        F.when(F.col("pos") == F.col("n") - 1, F.col("tail")).otherwise("").alias("tail"),
    )
    letter = F.substring("step", -1, 1)
    role = F.when(letter == "U", "user").when(letter == "A", "assistant").otherwise(F.col("role"))
    edit = F.when(letter.isin("U", "A"), audits.REROLE).otherwise(letter)
    own = F.struct(
        F.lit(OWN).alias("sub"), F.col("turn").alias("turn"), role.alias("role"), F.col("text").alias("text"), edit.alias("edit")
    )
    before = F.regexp_extract("step", "^[ua]*", 0)
    parts = F.concat(
        _inserted(before, 0),
        F.when(letter == audits.DELETE, F.array().cast(f"array<{PART}>")).otherwise(F.array(own)),
        _inserted(F.col("tail"), BEHIND),
    )
    return (
        placed.join(by_place, "at")
        .select("conv_id", "conv", "at", F.explode(parts).alias("part"))
        .select("conv_id", "conv", "at", "part.*")
    )


PART = "struct<sub:int,turn:bigint,role:string,text:string,edit:string>"


def _inserted(initials: Column, first: int) -> Column:
    letters = F.filter(F.split(initials, ""), lambda letter: letter != "")
    return F.transform(
        letters,
        lambda letter, i: F.struct(
            (i + first).cast("int").alias("sub"),
            F.lit(None).cast("bigint").alias("turn"),
            F.when(letter == "u", "user").otherwise("assistant").alias("role"),
            F.lit("").alias("text"),
            F.lit(audits.INSERT).alias("edit"),
        ),
    )


def _hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's `role:text` lines, which come in order; only the running hash is kept."""
    conv, digest, out = None, None, []
    for batch in batches:
        for name, role, text in zip(*(batch[c].to_pylist() for c in ("conv", "role", "text"))):
            if name != conv or digest is None:
                if digest is not None:
                    out.append((conv, digest.hexdigest()))
                conv, digest = name, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if len(out) >= 1000:
            yield from _table(out, "conv string, repaired_sha256 string").to_batches()
            out = []
    if digest is not None:
        out.append((conv, digest.hexdigest()))
    yield from _table(out, "conv string, repaired_sha256 string").to_batches()


def text_digests(turns: DataFrame) -> DataFrame:
    """conv, repaired_sha256 of the turns of a `Repair`: `role:text`, joined by newlines.

    A hash of one whole text can't be put together from parts, so each conversation streams through one task.
    """
    bounded_batches(turns.sparkSession)
    sorted_turns = turns.select("conv", "at", "sub", "role", "text").repartition("conv")
    return sorted_turns.sortWithinPartitions("conv", "at", "sub").mapInArrow(
        _hash_texts, "conv string, repaired_sha256 string"
    )


def repaired_digests(conversations: DataFrame) -> DataFrame:
    """Damage the rows, repair them, and report on every conversation of the table, those without a turn left too."""
    mended = repair(damaged(conversations))
    ids = conversations.select("conv_id").distinct().withColumn("conv", conversation_key(F.col("conv_id")))
    report = mended.report.withColumn("conv", conversation_key(F.col("conv_id"))).drop("conv_id")
    return (
        ids.join(report, "conv", "left")
        .join(text_digests(mended.turns), "conv", "left")
        .select(
            "conv_id",
            *[F.coalesce(name, F.lit(0).cast("bigint")).alias(name) for name in COUNTS],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"),
        )
    )
