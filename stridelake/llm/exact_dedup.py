"""Exact dedup by an exchange of Golomb-coded fingerprints.

Each piece of a partition (a sender) hashes its texts, sends its sorted fingerprints to their owners as Golomb-coded
gaps, and gets a bitmap back that says which of them others have sent too. Only the texts of these suspects are
then shuffled and compared byte by byte. A fingerprint has a few bits more than the logarithm of the number of
rows, so a row costs about ten bits in the exchange; what the short fingerprints confuse, the comparison clears up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import text_of
from stridelake.session import staged

#: Rows that one sender holds, and fingerprints that one owner gets on average. Both bound a task's memory.
SENDER_ROWS = 1 << 16
OWNER_ROWS = 1 << 19
#: A row without a copy is a suspect with a chance of 2 ** -SPARE_BITS.
SPARE_BITS = 8

MESSAGE = "struct<owner:int,low:bigint,count:int,rice:int,blob:binary>"
SENT = f"sender bigint, doc_ids array<bigint>, digests array<binary>, messages array<{MESSAGE}>"


def golomb_encode(gaps: np.ndarray, rice: int) -> bytes:
    """Golomb code with divisor 2 ** rice: first all quotients in unary, then all remainders."""
    quotients = (gaps >> np.uint64(rice)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    shifts = np.arange(rice - 1, -1, -1, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def golomb_decode(blob: bytes, count: int, rice: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(blob, np.uint8))
    rest_bytes = (count * rice + 7) // 8
    split = len(bits) - 8 * rest_bytes
    ends = np.flatnonzero(bits[:split])[:count]
    quotients = np.diff(ends, prepend=-1) - 1
    rest = bits[split : split + count * rice].reshape(count, rice)
    weights = np.uint64(1) << np.arange(rice - 1, -1, -1, dtype=np.uint64)
    return (quotients.astype(np.uint64) << np.uint64(rice)) + rest.astype(np.uint64) @ weights


class Space:
    """Fingerprints of `bits` bits, dealt to owners in equal ranges."""

    def __init__(self, rows: int):
        self.bits = min(48, max(SPARE_BITS, math.ceil(math.log2(max(rows, 2))) + SPARE_BITS))
        self.owners = max(1, -(-rows // OWNER_ROWS))
        self.width = -(-(1 << self.bits) // self.owners)

    def fingerprints(self, digests: list[bytes]) -> np.ndarray:
        head = np.frombuffer(b"".join(d[:8] for d in digests), ">u8").astype(np.uint64)
        return head >> np.uint64(64 - self.bits)


def messages(prints: np.ndarray, space: Space) -> list[dict]:
    """For each owner in turn the distinct fingerprints in its range, sorted, as coded gaps."""
    distinct = np.unique(prints)
    owner = (distinct // np.uint64(space.width)).astype(np.int64)
    out = []
    for number in np.unique(owner):
        own = distinct[owner == number]
        low = int(number) * space.width
        gaps = np.diff(own, prepend=np.uint64(low))
        rice = max(0, int(math.log2(max(1.0, 0.69 * float(gaps.mean())))))
        out.append(
            {"owner": int(number), "low": low, "count": len(own), "rice": rice, "blob": golomb_encode(gaps, rice)}
        )
    return out


def received(low: int, count: int, rice: int, blob: bytes) -> np.ndarray:
    return np.cumsum(golomb_decode(blob, count, rice)) + np.uint64(low)


def _send(space: Space):
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, 0
        ids, digests = [], []

        def piece():
            return pd.DataFrame(
                {
                    "sender": [first + number],
                    "doc_ids": [pd.array(ids, "Int64").to_numpy(dtype=object, na_value=None)],
                    "digests": [digests],
                    "messages": [messages(space.fingerprints(digests), space)],
                }
            )

        for frame in frames:
            for start in range(0, len(frame), SENDER_ROWS):
                part = frame.iloc[start : start + SENDER_ROWS]
                if ids and len(ids) + len(part) > SENDER_ROWS:
                    yield piece()
                    ids, digests, number = [], [], number + 1
                ids.extend(None if pd.isna(x) else int(x) for x in part["doc_id"])
                digests.extend(bytes(x) for x in part["digest"])
        if ids:
            yield piece()

    return work


def _answer(frame: pd.DataFrame) -> pd.DataFrame:
    """An owner's bitmaps: for each sender, which of its fingerprints another sender has too."""
    values = [received(*x) for x in zip(frame["low"], frame["count"], frame["rice"], frame["blob"])]
    everything, seen = np.unique(np.concatenate(values), return_counts=True)
    twice = everything[seen > 1]
    bitmaps = [np.packbits(np.isin(x, twice, assume_unique=True)).tobytes() for x in values]
    return pd.DataFrame({"sender": frame["sender"], "owner": frame["owner"], "bitmap": bitmaps})


def _mark(space: Space):
    """Applies the bitmaps to a sender's rows. Copies within the sender are suspects without asking."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for ids, digests, bitmaps in zip(frame["doc_ids"], frame["digests"], frame["bitmaps"]):
                prints = space.fingerprints(list(digests))
                distinct, inverse, seen = np.unique(prints, return_inverse=True, return_counts=True)
                owner = (distinct // np.uint64(space.width)).astype(np.int64)
                suspect = seen > 1
                for x in bitmaps:
                    place = np.flatnonzero(owner == x["owner"])
                    bits = np.unpackbits(np.frombuffer(x["bitmap"], np.uint8))[: len(place)]
                    suspect[place] |= bits.astype(bool)
                yield pd.DataFrame(
                    {"doc_id": pd.array(list(ids), "Int64"), "digest": list(digests), "suspect": suspect[inverse]}
                )

    return work


def flagged(docs: DataFrame, rows: int | None = None) -> DataFrame:
    """doc_id, digest (SHA-256 of the text), suspect (another row may have the same text), for each row."""
    narrow = docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"), F.unhex(F.sha2(text_of(docs), 256)).alias("digest")
    )
    space = Space(docs.count() if rows is None else rows)
    sent = staged(narrow.mapInPandas(_send(space), SENT), "exact-sent")
    answers = (
        sent.select("sender", F.explode("messages").alias("m"))
        .select("sender", "m.*")
        .groupBy("owner")
        .applyInPandas(_answer, "sender bigint, owner int, bitmap binary")
    )
    bitmaps = answers.groupBy("sender").agg(F.collect_list(F.struct("owner", "bitmap")).alias("bitmaps"))
    return (
        sent.select("sender", "doc_ids", "digests")
        .join(bitmaps, "sender")
        .select("doc_ids", "digests", "bitmaps")
        .mapInPandas(_mark(space), "doc_id bigint, digest binary, suspect boolean")
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (identical bytes; null counts as empty) the largest doc_id stays. A null doc_id comes after all
    others; if a group has no other, its keep_id is null and all its rows are kept. Rows that repeat both id and
    text have the same fate, and each counts in group_size. Other columns are not read. An empty table gives no rows.
    """
    rows = staged(flagged(docs), "exact-flagged")
    # Eight bytes for each suspect text; what else has the same eight is cleared up with the rest below.
    suspects = staged(rows.where("suspect").select(F.xxhash64("digest").alias("head")).distinct(), "exact-suspects")
    texts = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text")).withColumn(
        "head", F.xxhash64(F.unhex(F.sha2("text", 256)))
    )
    # Grouping by the text itself is the comparison of bytes; map-side sums send each text once from each task.
    classes = (
        texts.join(suspects, "head", "left_semi")
        .groupBy("text")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select(F.unhex(F.sha2("text", 256)).alias("digest"), "keep_id", "group_size")
    )
    single = rows.where("NOT suspect").select(
        "doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size")
    )
    shared = rows.where("suspect").join(classes, "digest").select("doc_id", "digest", "keep_id", "group_size")
    return single.unionByName(shared).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_largest(docs: DataFrame) -> DataFrame:
    """The documents that `exact_dedup` keeps, with all their columns."""
    found = staged(exact_dedup(docs.select("doc_id", "text")).select("doc_id", "kept", "text_sha256"), "exact-found")
    by_id = found.groupBy("doc_id").agg(F.bool_or("kept").alias("some_kept"), F.bool_and("kept").alias("all_kept"))
    # Nearly always an id stays or goes whole, and a list of numbers says which.
    gone = by_id.where("doc_id IS NOT NULL AND NOT some_kept").select(F.col("doc_id").alias("gone_id"))
    gone = staged(gone, "exact-gone")
    left = docs.join(gone, docs["doc_id"].cast("bigint") == gone["gone_id"], "left_anti")
    # Ids with several texts, and rows without an id, are told apart by the text.
    split = by_id.where("NOT all_kept AND (doc_id IS NULL OR some_kept)").select("doc_id")
    partly = found.where("NOT kept").join(split, found["doc_id"].eqNullSafe(split["doc_id"]), "left_semi").distinct()
    partly = partly.select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha256"))
    partly = staged(partly, "exact-partly")
    if partly.isEmpty():
        return left
    same = docs["doc_id"].cast("bigint").eqNullSafe(partly["gone_id"]) & (
        F.sha2(text_of(docs), 256) == partly["gone_sha256"]
    )
    return left.join(partly, same, "left_anti")
