"""Alignment of the tokens of two tokenizers, and how often their tokens meet in the whole corpus.

First pass: every text is encoded by both, their tokens are laid over each other, and each task counts the pairs of
ids that overlap. The distinct pairs get a minimal perfect hash; the tasks' counts become dense vectors indexed by it,
which are summed in a tree of groups of `FAN`. Second pass: the texts are aligned again, and the counts of their
pairs looked up by hash, each checked against its key.

Pairs lie in `SLOTS` slots by a hash. The vocabularies bound what a slot can hold (50257 x 32000 pairs in 256
slots are 6.3 million), so no group, vector or broadcast table grows with the corpus beyond that. Neighbouring slots
are hashed as one shard while they hold few pairs; a worker has one shard's table at a time. A text is cut into units
at single spaces between other than white space, where no token of either vocabulary goes across; a unit's tokens
depend on the unit alone, so each worker remembers those of recent units.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import bounded_batches, text_of
from stridelake.llm.perfect_hash import PerfectHash, build, scattered
from stridelake.session import staged

SLOTS = 256
FAN = 8
#: Distinct pairs of a shard, about: as many neighbouring slots as they fill are hashed together.
SHARD_PAIRS = 1 << 21
#: Distinct pairs that a task of the first pass holds before it hands them on.
HELD_PAIRS = 1 << 21
#: Bytes of vectors that a task sums before it hands them on.
HELD_BYTES = 64 << 20
#: Units a worker remembers in each of two generations, and the longest of them.
REMEMBERED, LONGEST = 1 << 18, 64
#: Characters of texts that are worked on together, and of new units that are encoded together.
BATCH_CHARS, ENCODED_CHARS = 4 << 20, 1 << 15

BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")
TWO_SPACES = re.compile(r"\s\s")
SPACE_MARK = "▁"
#: Slot of a pair: another level of the hash than the tables use.
SLOT_LEVEL = 1 << 20

COUNTED = "node bigint, slot int, pairs binary, counts binary"
HASHED = "shard int, sizes array<bigint>, words binary, pairs binary"
DENSE = "node bigint, shard int, counts binary"
RESULT = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"
)
DIGEST = RESULT.replace("groups string", "groups_sha256 string")

#: A unit with white space at its ends, in units between zero bytes.
ODD_UNIT = re.compile(r"\s\0|\0\s")

#: Tokens of a unit laid over each other: numbers of tokens of both, groups and links, the pairs of the links as 64-bit
#: numbers, and, where it is asked for, the groups as text with a `;` behind each.
Unit = tuple[int, int, int, int, bytes, str]


def has_odd_space(text: str) -> bool:
    """Whether there is white space beside white space or an end of the text."""
    return text[:1].isspace() or text[-1:].isspace() or TWO_SPACES.search(text) is not None


def byte_level_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable ones as themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """Byte-level BPE from the file of the `tokenizers` library, without special tokens."""

    def __init__(self, data: bytes, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        layout = json.loads(data)
        special = {token["content"] for token in layout["added_tokens"]}
        letters = byte_level_alphabet()
        self.bytes_of: dict[int, bytes] = {
            id_: bytes(letters[c] for c in token) for token, id_ in layout["model"]["vocab"].items() if token not in special
        }
        self.size = max(self.bytes_of) + 1
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in layout["model"]["merges"]]
        merged = [layout["model"]["vocab"]["".join(pair)] for pair in merges]
        if merged == sorted(merged):
            # Ids in the order of the merges are ranks, and the ranks' library is several times faster.
            ranks = {token: id_ for id_, token in self.bytes_of.items()}
            coder = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            # Its tokens are cut out of the text's bytes.
            self.encode, self.exact = coder.encode_ordinary, True
        else:
            coder = Tokenizer.from_str(data.decode())
            coder.encode_special_tokens = True
            self.encode, self.exact = lambda text: coder.encode(text, add_special_tokens=False).ids, False


class Pieces:
    """A sentencepiece model; it puts a space before the text itself."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(self.size)]
        self.bytes_of = {
            i: bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(SPACE_MARK, " ").encode()
            for i, piece in enumerate(pieces)
        }
        #: No piece goes on over a space that follows another character.
        self.by_words = not any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", piece) for piece in pieces)

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


class Recent:
    """What has been worked out for units, in two generations of `REMEMBERED`."""

    def __init__(self, work: Callable[[list[str]], list]):
        self.work, self.young, self.old = work, {}, {}

    def of(self, units: list[str]) -> list:
        """The value of each of the distinct units; those that are not remembered are worked out together."""
        unknown = object()
        values = list(map(self.young.get, units, repeat(unknown)))
        late = [i for i, value in enumerate(values) if value is unknown]
        asked = [units[i] for i in late]
        fresh = list(map(self.old.get, asked, repeat(unknown)))
        missing = [i for i, value in enumerate(fresh) if value is unknown]
        for i, value in zip(missing, self.work([asked[i] for i in missing])):
            fresh[i] = value
        if len(self.young) + len(fresh) > REMEMBERED:
            self.old, self.young = self.young, {}
        for i, unit, value in zip(late, asked, fresh):
            values[i] = value
            if len(unit) <= LONGEST:
                self.young[unit] = value
        return values


class Aligner:
    def __init__(self, first: bytes, pattern: str, second: bytes):
        self.a, self.b = ByteLevel(first, pattern), Pieces(second)
        self.lengths_a, self.lengths_b = (
            np.array([len(coder.bytes_of.get(i, b"")) for i in range(coder.size)], np.int64) for coder in (self.a, self.b)
        )
        # Each id as text with the two signs that can follow it.
        self.written = np.array(
            [f"{i}{sign}" for size, signs in ((self.a.size, ",|"), (self.b.size, ",;")) for sign in signs for i in range(size)],
            object,
        )
        self.recent = Recent(self.aligned)

    def is_plain(self, text: str) -> bool:
        """Whether the units of a text are what stands between its spaces."""
        return self.b.by_words and not has_odd_space(text)

    def units(self, text: str) -> list[str]:
        """Space + text, cut before spaces where neither tokenizer's tokens go across; the units' first spaces are left
        out. The first tokenizer's pattern has to begin a piece at each space between others than white space."""
        if self.is_plain(text):
            return text.split(" ")
        if not self.b.by_words:
            return [text]
        # The space before the text makes its first unit as the others are, unless white space follows.
        return BETWEEN_WORDS.split(text)

    def aligned(self, units: list[str], with_text: bool = False) -> list[Unit | None]:
        """Each unit's tokens over each other; None where those of either are not the unit's bytes."""
        out, part, held = [], [], 0
        for unit in units:
            part.append(unit)
            held += len(unit)
            if held >= ENCODED_CHARS:
                out += self._encoded(part, with_text)
                part, held = [], 0
        return out + self._encoded(part, with_text)

    def _encoded(self, units: list[str], with_text: bool) -> list[Unit | None]:
        """The units put together as one text and encoded at once, which gives the tokens of each one alone.

        Only a unit with white space at its ends must stand alone, and one that can't be encoded.
        """
        if not units:
            return []
        joined = " ".join(units)
        # White space at an end of a unit stands beside the space that joins it to the next.
        if len(units) > 1 and has_odd_space(joined) and ODD_UNIT.search("\0" + "\0".join(units) + "\0"):
            return self._halves(units, with_text)
        text = f" {joined}"
        a, b, data = self.a.encode(text), self.b.encode(joined), text.encode()
        whole = b"".join(map(self.b.bytes_of.__getitem__, b)) == data
        if not whole or not (self.a.exact or b"".join(map(self.a.bytes_of.__getitem__, a)) == data):
            return [None] if len(units) == 1 else self._halves(units, with_text)
        return self._laid_over(units, np.array(a, np.int64), np.array(b, np.int64), len(data), with_text)

    def _halves(self, units: list[str], with_text: bool) -> list[Unit | None]:
        half = len(units) // 2
        return self._encoded(units[:half], with_text) + self._encoded(units[half:], with_text)

    def _laid_over(self, units: list[str], a: np.ndarray, b: np.ndarray, size: int, with_text: bool) -> list[Unit]:
        ends_a, ends_b = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
        ends_a[np.cumsum(self.lengths_a[a])] = True
        ends_b[np.cumsum(self.lengths_b[b])] = True
        meet = ends_a & ends_b
        stops = np.cumsum([len(unit.encode()) + 1 for unit in units])
        if not meet[stops].all():
            raise ValueError("a token goes across the units of a text")
        # Up to and with each byte: the tokens of both that have ended, and the places where both end.
        done_a, done_b, done = np.cumsum(ends_a), np.cumsum(ends_b), np.cumsum(meet)
        # Between two neighbouring ends lies one token of each, and two tokens that overlap do so in one such place.
        cuts = np.flatnonzero(ends_a | ends_b)
        links = a[done_a[cuts] - ends_a[cuts]] * self.b.size + b[done_b[cuts] - ends_b[cuts]]
        counts = [np.diff(done_of[stops], prepend=0) for done_of in (done_a, done_b, done)]
        n_links = counts[0] + counts[1] - counts[2]
        packed, link_ends = links.astype(np.uint64).tobytes(), (8 * np.cumsum(n_links)).tolist()
        parts = [packed[start:end] for start, end in zip([0, *link_ends], link_ends)]
        texts = self._texts(a, b, ends_a, ends_b, done_a, done_b, done, stops) if with_text else [""] * len(units)
        return list(zip(*(c.tolist() for c in counts), n_links.tolist(), parts, texts))

    def _texts(self, a, b, ends_a, ends_b, done_a, done_b, done, stops) -> list[str]:
        """The groups of each unit: of a group's tokens, those of the first tokenizer stand before the others."""
        meet = ends_a & ends_b
        both, at_a, at_b = np.flatnonzero(meet), np.flatnonzero(ends_a), np.flatnonzero(ends_b)
        last_a, last_b = meet[at_a], meet[at_b]
        before_b = np.concatenate(([0], done_b[both]))[done[at_a] - last_a]
        upto_a = done_a[both][done[at_b] - last_b]
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + before_b] = a + self.a.size * last_a
        order[np.arange(len(b)) + upto_a] = b + 2 * self.a.size + self.b.size * last_b
        written, ends = self.written[order].tolist(), (done_a + done_b)[stops].tolist()
        return ["".join(written[start:end]) for start, end in zip([0, *ends], ends)]


def _kept_by_worker() -> dict:
    """A dictionary that lives as long as the worker: on a module of its own, which tasks do not bring along."""
    return sys.modules.setdefault("_alignment_of_worker", type(sys)("_alignment_of_worker")).__dict__


def loaded(first: bytes, pattern: str, second: bytes) -> Aligner:
    """One aligner for each worker."""
    key, kept = (hash(first), pattern, hash(second)), _kept_by_worker()
    if key not in kept:
        kept[key] = Aligner(first, pattern, second)
    return kept[key]


def slots_of(pairs: np.ndarray) -> np.ndarray:
    return (scattered(pairs, SLOT_LEVEL) >> np.uint64(56)).astype(np.int64) % SLOTS


class Table:
    """The hashed pairs of one shard: their numbers, each checked against its key."""

    def __init__(self, row: dict):
        self.hashed = PerfectHash(list(row["sizes"]), np.frombuffer(row["words"], np.uint64))
        self.pairs = np.frombuffer(row["pairs"], np.uint64)

    def find(self, pairs: np.ndarray) -> np.ndarray:
        """The number of each pair, -1 where the key at that number is another one."""
        found = self.hashed.find(pairs)
        return np.where((found >= 0) & (self.pairs[found] == pairs), found, -1)


def _opened(run: str, shard: int, tables: list) -> tuple:
    """The table of one shard, and its counts where they are broadcast too. The last one that a worker used stays open."""
    kept = _kept_by_worker()
    if kept.get("key") != (run, shard):
        kept["table"] = None
        row, counts = (_read(part) for part in tables[shard])
        kept["table"] = Table(row), None if counts is None else np.frombuffer(counts, np.int64)
        kept["key"] = (run, shard)
    return kept["table"]


def _read(part):
    """The value of a broadcast, which doesn't hold it from then on."""
    if part is None:
        return None
    value = part.value
    vars(part).pop("_value", None)
    return value


def columns_of(layout: str) -> list[str]:
    return [part.split()[0] for part in layout.split(", ")]


def _frame(rows: list[tuple], layout: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns_of(layout))


def count_pairs(docs: DataFrame, open_aligner: Callable[[], Aligner]) -> DataFrame:
    """First pass: for each task and slot the distinct pairs, sorted, and how many links of the task hold them."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner, node = open_aligner(), TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows(pairs: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
            slot = slots_of(pairs)
            parts = [(number, slot == number) for number in np.unique(slot).tolist()]
            return _frame([(node, k, pairs[own].tobytes(), counts[own].tobytes()) for k, own in parts], COUNTED)

        with _without_collector():
            for _, index, places, lengths in _batches(frames, aligner):
                known = aligner.recent.of(index)
                times = np.bincount(places[_in_whole(known, places, lengths)], minlength=len(known))
                used = np.flatnonzero(times).tolist()
                links = np.frombuffer(b"".join(known[i][4] for i in used), np.uint64)
                weights = np.repeat(times[used], [known[i][3] for i in used]) if used else times[:0]
                held.append(_summed([(links, weights)]))
                if sum(len(pairs) for pairs, _ in held) > 2 * HELD_PAIRS:
                    held = [_summed(held)]
                if len(held) == 1 and len(held[0][0]) > HELD_PAIRS:
                    yield rows(*held.pop())
        if held:
            yield rows(*_summed(held))

    return _narrow(docs).mapInPandas(work, COUNTED)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of all parts, sorted, and the sum of their counts."""
    pairs, counts = (np.concatenate(column) for column in zip(*parts))
    order = np.argsort(pairs, kind="stable")
    pairs, counts = pairs[order], counts[order]
    starts = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1]))) if len(pairs) else []
    return (pairs[starts], np.add.reduceat(counts, starts)) if len(pairs) else (pairs, counts)


def _in_whole(known: list[Unit | None], places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which units stand in texts whose units can all be encoded."""
    bad = np.array([value is None for value in known], bool)
    if not bad.any():
        return np.ones(len(places), bool)
    text = np.repeat(np.arange(len(lengths)), lengths)
    return ~np.isin(text, text[bad[places]])


@contextmanager
def _without_collector() -> Iterator[None]:
    """Python's search for reference cycles walks through all that is remembered, again and again, and finds none."""
    was_on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was_on:
            gc.enable()


def _tree(rows: DataFrame, layout: str, combine: Callable[[pd.Series], bytes]) -> DataFrame:
    """Combine the rows (node, slot or shard, blob) of each slot, `FAN` nodes at a time, until one node is left."""
    node, part, blob = (field.split()[0] for field in layout.split(", "))

    def work(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return _frame([(key[1], key[0], combine(group[blob]))], layout)

    while True:
        top = rows.agg(F.max(node)).first()[0]
        rows = rows.select(part, F.floor(F.col(node) / FAN).cast("bigint").alias(node), blob)
        rows = staged(rows.groupBy(part, node).applyInPandas(work, layout), "pair-tree")
        if not top or top < FAN:
            return rows


def distinct_pairs(counted: DataFrame) -> DataFrame:
    """node, slot, pairs: the distinct pairs of each slot."""

    def union(blobs: pd.Series) -> bytes:
        return np.unique(np.concatenate([np.frombuffer(b, np.uint64) for b in blobs])).tobytes()

    return _tree(counted.select("node", "slot", "pairs"), "node bigint, slot int, pairs binary", union)


def hashed_pairs(distinct: DataFrame, shards: int) -> DataFrame:
    """shard, sizes, words, pairs: the perfect hash of each shard, and its pairs in the order of their numbers."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        pairs = np.concatenate([np.frombuffer(b, np.uint64) for b in group["pairs"]])
        hashed = build(pairs)
        placed = np.zeros_like(pairs)
        placed[hashed.find(pairs)] = pairs
        return _frame([(group["shard"].iloc[0], hashed.sizes, hashed.words.tobytes(), placed.tobytes())], HASHED)

    sharded = distinct.select(F.expr(f"slot * {shards} div {SLOTS}").cast("int").alias("shard"), "pairs")
    return sharded.groupBy("shard").applyInPandas(work, HASHED)


def _shards_for(distinct: DataFrame) -> int:
    pairs = distinct.agg(F.sum(F.octet_length("pairs")) / 8).first()[0] or 0
    shards = 1
    while shards < SLOTS and pairs > shards * SHARD_PAIRS:
        shards *= 2
    return shards


def _one_by_one(rows: DataFrame, shards: int, value: Callable) -> list:
    """A broadcast of each shard's row, None where a shard has no pairs; the driver holds one row at a time."""
    out = []
    for shard in range(shards):
        row = rows.where(F.col("shard") == shard).first()
        out.append(None if row is None else rows.sparkSession.sparkContext.broadcast(value(row)))
    return out


def dense_counts(counted: DataFrame, run: str, tables: list) -> DataFrame:
    """node, shard, counts: the links of each pair by its number, summed over all tasks."""
    shards = len(tables)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, sums = TaskContext.get().partitionId(), {}
        for frame in frames:
            for slot, blob, counts in zip(frame["slot"], frame["pairs"], frame["counts"]):
                shard = slot * shards // SLOTS
                table, _ = _opened(run, shard, tables)
                if shard not in sums:
                    if sum(v.nbytes for v in sums.values()) > HELD_BYTES:
                        yield _frame([(node, k, v.tobytes()) for k, v in sums.items()], DENSE)
                        sums = {}
                    sums[shard] = np.zeros(len(table.pairs), np.int64)
                numbers = table.find(np.frombuffer(blob, np.uint64))
                if (numbers < 0).any():
                    raise KeyError("a counted pair is not among the hashed ones")
                sums[shard][numbers] += np.frombuffer(counts, np.int64)
        yield _frame([(node, k, v.tobytes()) for k, v in sums.items()], DENSE)

    def add(blobs: pd.Series) -> bytes:
        total = np.frombuffer(blobs.iloc[0], np.int64).copy()
        for blob in blobs.iloc[1:]:
            total += np.frombuffer(blob, np.int64)
        return total.tobytes()

    rows = counted.select("slot", "pairs", "counts").sortWithinPartitions("slot")
    return _tree(staged(rows.mapInPandas(work, DENSE), "pair-vectors"), DENSE, add)


def best_counts(hashed: DataFrame, dense: DataFrame, size: int) -> DataFrame:
    """b, best: the highest count of each second id; not more rows than its vocabulary."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for pairs, counts in zip(frame["pairs"], frame["counts"]):
                best, second = np.zeros(size, np.int64), np.frombuffer(pairs, np.uint64) % np.uint64(size)
                np.maximum.at(best, second.astype(np.int64), np.frombuffer(counts, np.int64))
                used = np.flatnonzero(best)
                yield pd.DataFrame({"b": used, "best": best[used]})

    part = hashed.select("shard", "pairs").join(dense.select("shard", "counts"), "shard").select("pairs", "counts")
    return part.mapInPandas(work, "b bigint, best bigint").groupBy("b").agg(F.max("best").alias("best"))


def align(docs: DataFrame, first: str, pattern: str, second: str, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups for each row of `docs`.

    `first` is the path of a byte-level BPE (its pre-tokenizer's `pattern` beside it), `second` of a sentencepiece
    model; both encode space + text, strings of special tokens as plain text. Bytes where tokens of both end cut the
    text into groups, written `a1,a2|b1;a3|b2`. A link is a pair of token occurrences that overlap; the count of its
    ids is the number of links of the corpus that hold them. `n_best` are the links whose count is the highest of
    their second id, `count_sum` is the sum over the links. With `digest`, `groups_sha256` stands for `groups`.

    Texts that are null or empty, or whose tokens' bytes differ from space + text, have no tokens: zeros and an empty
    text (not hashed). Rows stay as they are, repeated ones, which count again, and null ids too. An empty table gives
    an empty one; other columns are not read.
    """
    context = docs.sparkSession.sparkContext
    with open(first, "rb") as a, open(second, "rb") as b:
        # Of fixed size, whatever the corpus is.
        models = context.broadcast((a.read(), b.read()))

    def open_aligner() -> Aligner:
        return loaded(models.value[0], pattern, models.value[1])

    size, run = Pieces(models.value[1]).size, uuid.uuid4().hex
    counted = staged(count_pairs(docs, open_aligner), "pairs")
    distinct = distinct_pairs(counted)
    shards = _shards_for(distinct)
    hashed = staged(hashed_pairs(distinct, shards), "pair-hashes")
    tables = _one_by_one(hashed, shards, lambda row: row.asDict())
    dense = dense_counts(counted, f"{run} keys", [(table, None) for table in tables])
    vectors = _one_by_one(dense, shards, lambda row: bytes(row["counts"]))
    both = list(zip(tables, vectors))
    best = np.zeros(size, np.int64)
    for row in best_counts(hashed, dense, size).collect():
        best[row["b"]] = row["best"]
    best_of = context.broadcast(best)
    layout = DIGEST if digest else RESULT

    def look_up(links: np.ndarray) -> np.ndarray:
        """The corpus count of each link's pair, one shard at a time; -1 for a pair that no whole text holds."""
        distinct, place = np.unique(links, return_inverse=True)
        shard, found = slots_of(distinct) * shards // SLOTS, np.full(len(distinct), -1, np.int64)
        for number in np.unique(shard).tolist():
            if both[number][0] is None:
                continue
            table, counts = _opened(run, number, both)
            own = np.flatnonzero(shard == number)
            numbers = table.find(distinct[own])
            found[own[numbers >= 0]] = counts[numbers[numbers >= 0]]
        return found[place]

    def figures(aligner: Aligner, units: list[str]) -> list[tuple | None]:
        """For each unit its tokens of both, groups, links, best links, the sum of its links' counts, and its text."""
        parts = aligner.aligned(units, with_text=True)
        known = [part for part in parts if part is not None]
        if not known:
            return parts
        links = np.frombuffer(b"".join(part[4] for part in known), np.uint64)
        found = look_up(links)
        is_best = found == best_of.value[(links % np.uint64(size)).astype(np.int64)]
        starts = np.cumsum([0, *(part[3] for part in known[:-1])])
        sums = [np.add.reduceat(v, starts).tolist() for v in (is_best.astype(np.int64), found, (found < 0).astype(np.int64))]
        rows = iter([((*part[:4], *more), part[5]) for part, *more in zip(known, *sums)])
        return [None if part is None else next(rows) for part in parts]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner, kept = open_aligner(), _kept_by_worker()
        if kept.get("run") != run:
            kept["run"], kept["figures"] = run, Recent(lambda units: figures(aligner, units))
        with _without_collector():
            for ids, index, places, lengths in _batches(frames, aligner):
                known = kept["figures"].of(index)
                whole = _in_whole(known, places, lengths)
                nothing = ((0,) * 7, "")
                values, texts = zip(*(row or nothing for row in known)) if known else ((), ())
                numbers = np.fromiter(chain.from_iterable(values), np.int64).reshape(-1, 7)[places]
                if (numbers[whole, 6] > 0).any():
                    raise KeyError("a pair of the second pass is not among those of the first")
                numbers[~whole] = 0
                ends = np.cumsum(lengths)
                running = np.concatenate((np.zeros((1, 7), np.int64), np.cumsum(numbers, axis=0)))
                totals = running[ends] - running[ends - lengths]
                groups = []
                for start, end in zip((ends - lengths).tolist(), ends.tolist()):
                    good = end > start and whole[start]
                    text = "".join(map(texts.__getitem__, places[start:end].tolist()))[:-1] if good else ""
                    groups.append(hashlib.sha256(text.encode()).hexdigest() if digest and good else text)
                columns = columns_of(layout)
                result = pd.DataFrame(totals[:, :6], columns=columns[1:7]).assign(**{columns[7]: groups})
                result.insert(0, "doc_id", pd.array(ids, "Int64"))
                yield result

    return _narrow(docs).mapInPandas(work, layout)


def _batches(frames: Iterator[pd.DataFrame], aligner: Aligner) -> Iterator[tuple[list, list, np.ndarray, np.ndarray]]:
    """Parts of about `BATCH_CHARS`: ids, the distinct units, the unit at each place of all texts, units of each text."""
    plain, others, held = [], [], 0

    def part():
        # Arrow splits the plain texts and tells the units apart, in the order in which they come first.
        split = pc.split_pattern(pa.array([text for _, text in plain], pa.large_string()), " ")
        rest = [aligner.units(text) if text else [] for _, text in others]
        units = pa.concat_arrays([split.flatten(), pa.array(chain.from_iterable(rest), pa.large_string())])
        lengths = np.concatenate((pc.list_value_length(split).to_numpy(), np.array([len(r) for r in rest], np.int64)))
        coded = units.dictionary_encode()
        index = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        places = coded.indices.to_numpy().astype(np.int64)
        return [i for i, _ in plain + others], index, places, lengths.astype(np.int64)

    for frame in frames:
        for doc_id, text in zip(frame["doc_id"].astype("Int64"), frame["text"]):
            (plain if text and aligner.is_plain(text) else others).append((doc_id, text))
            held += len(text)
            if held >= BATCH_CHARS:
                yield part()
                plain, others, held = [], [], 0
    if plain or others:
        yield part()


def _narrow(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
