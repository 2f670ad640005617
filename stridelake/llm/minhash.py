"""Near duplicates with b-bit MinHash: bands find candidates, packed low bits estimate, full sets confirm.

1. Each text gives the set of its shingles; equal sets are one class, its smallest doc_id stands for it.
2. A class has the minima of many hash functions over its set. Bands of minima make buckets. Kept with each class
   are only the low bits of its minima, packed.
3. Each class in a bucket is first tried with the bucket's leader, by estimate and then on full sets. The leader is
   the class that meets the most others over all its buckets, the middle of a group if there is one. That joins
   nearly all of a group without looking at its pairs. Components follow.
4. In buckets that still hold several components, the classes outside the bucket's largest component are compared
   with all of the bucket, in blocks, by counting equal bits of longer signatures; what the estimate lets pass is
   confirmed on full sets. Two classes in one component need no look, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import bounded_batches, digest_of, mixed, shingle_set, text_of, without
from stridelake.llm.components import components
from stridelake.session import staged


@dataclass(frozen=True)
class Settings:
    """`least` of a hundred of the union must be shared. With 32 bands of 4 minima, a pair at 75 % is missed by all
    bands once in 190,000. Each margin is five standard deviations of the estimate at 75 %."""

    shingle: int = 5
    least: int = 75
    bands: int = 32
    rows: int = 4
    bits: int = 4
    margin: float = 0.2
    long_minima: int = 1024
    long_bits: int = 2
    long_margin: float = 0.082
    block: int = 2048
    seed: int = 11


CLASS = "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>, signature binary"


class Hasher:
    """Minima of `bands * rows` multiply-and-mix hash functions over sets of 64-bit shingle hashes."""

    def __init__(self, settings: Settings):
        self.s = settings
        rng = np.random.default_rng(settings.seed)
        count = settings.bands * settings.rows
        self.add = rng.integers(0, 1 << 63, count, dtype=np.uint64)
        self.mul = rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.xor = rng.integers(0, 1 << 31, count, dtype=np.uint32)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        count, step = len(self.mul), max(1, (1 << 16) // max(1, len(shingles)))
        low = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        high = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.empty(count, np.uint32)
        for start in range(0, count, step):
            part = slice(start, start + step)
            values = (low[None, :] ^ self.xor[part, None]) * self.mul[part, None]
            values ^= values >> np.uint32(15)
            values += high[None, :]
            values *= self.mul[part, None]
            out[part] = values.min(axis=1)
        return out

    def bands(self, minima: np.ndarray) -> np.ndarray:
        s = self.s
        keys = np.zeros(s.bands, np.uint64)
        for column in minima.reshape(s.bands, s.rows).T:
            keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + column)
        return mixed(keys + np.arange(1, s.bands + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)

    def packed(self, minima: np.ndarray) -> bytes:
        """The low bits of the mixed minima: bit plane after bit plane."""
        low = mixed(minima.astype(np.uint64))
        planes = [np.packbits(((low >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)) for b in range(self.s.bits)]
        return np.concatenate(planes).tobytes()


def estimates(one: np.ndarray, many: np.ndarray, settings: Settings) -> np.ndarray:
    """Similarity of one packed signature to many: equal low bits counted, chance agreement taken off."""
    count = settings.bands * settings.rows
    differ = np.bitwise_or.reduce((one[None, :] ^ many).reshape(len(many), settings.bits, -1), axis=1)
    equal = 1 - np.bitwise_count(differ).sum(axis=1) / count
    chance = 2.0**-settings.bits
    return (equal - chance) / (1 - chance)


def similar(one: np.ndarray, other: np.ndarray, settings: Settings) -> bool:
    shared = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * shared >= settings.least * (len(one) + len(other) - shared) and shared > 0


def _signed(settings: Settings):
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher(settings)
        for frame in frames:
            for start in range(0, len(frame), 1024):
                part, out = frame.iloc[start : start + 1024], []
                for text in part["text"]:
                    found = shingle_set(text, settings.shingle)
                    if len(found):
                        minima = hasher.minima(found)
                        key = xxhash.xxh3_128_digest(found.tobytes())
                        out.append((len(found), key, hasher.bands(minima), hasher.packed(minima)))
                    else:
                        out.append((0, None, None, None))
                columns = pd.DataFrame(out, columns=["n_shingles", "set_key", "bands", "signature"])
                columns.insert(0, "doc_id", part["doc_id"].astype("Int64").array)
                yield columns

    return work


def _verified(settings: Settings):
    """Rows of a leader and its partners, sorted so that the leader comes first: partners that are similar to it."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, None
        for frame in frames:
            out = []
            for leader, salt, member, text in zip(frame["leader"], frame["salt"], frame["member"], frame["text"]):
                if (leader, salt) != current:
                    current, held = (leader, salt), shingle_set(text, settings.shingle)
                elif similar(held, shingle_set(text, settings.shingle), settings):
                    out.append((leader, member))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return work


def confirmed(pairs: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """Of candidate pairs (leader, member) those that are similar on full sets, as links (a, b).

    A leader's text goes once to each of its salts, and a salt has about `block` partners, so a leader with many
    partners is spread. A task holds one set and the batch at hand.
    """
    pairs = staged(pairs.distinct(), "near-pairs")
    salts = pairs.groupBy("leader").agg((F.count("*") / settings.block).cast("int").alias("last_salt"))
    salted = pairs.join(salts, "leader").withColumn("salt", F.pmod(F.xxhash64("member"), F.col("last_salt") + 1))
    salted = staged(salted, "near-salted")
    members = salted.select("leader", "salt", "member", F.col("member").alias("doc_id"), F.lit(1).alias("place"))
    leaders = salted.select("leader", "salt").distinct()
    leaders = leaders.select("leader", "salt", F.col("leader").alias("member"), F.col("leader").alias("doc_id"))
    wanted = staged(members.unionByName(leaders.withColumn("place", F.lit(0))), "near-wanted")
    wanted_ids = staged(wanted.select("doc_id").distinct(), "near-wanted-ids")
    texts = docs.select("doc_id", "text").join(wanted_ids, "doc_id", "left_semi")
    return (
        wanted.join(texts, "doc_id")
        .select("leader", "salt", "place", "member", "text")
        .repartition("leader", "salt")
        .sortWithinPartitions("leader", "salt", "place")
        .mapInPandas(_verified(settings), "a bigint, b bigint")
    )


def _first_look(settings: Settings):
    least = settings.least / 100 - settings.margin

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                one = np.frombuffer(b"".join(frame["leader_signature"]), np.uint8).reshape(len(frame), -1)
                two = np.frombuffer(b"".join(frame["signature"]), np.uint8).reshape(len(frame), -1)
                zero = np.zeros(one.shape[1], np.uint8)
                frame = frame[estimates(zero, one ^ two, settings) >= least]
            yield frame[["leader", "member"]]

    return work


def _long(settings: Settings) -> Settings:
    return replace(settings, bands=1, rows=settings.long_minima, bits=settings.long_bits, margin=settings.long_margin)


def _long_signatures(settings: Settings):
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher(_long(settings))
        for frame in frames:
            sets = (shingle_set(text, settings.shingle) for text in frame["text"])
            signatures = [hasher.packed(hasher.minima(x)) for x in sets]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "signature": signatures})

    return work


def _cross_look(settings: Settings):
    """Rows of one bucket and block, the block's own first: pairs of an own row and any other row of the bucket in
    another component that sizes and estimate let pass, each in the first bucket that the two share."""
    long = _long(settings)
    least = settings.least / 100 - long.margin

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, ids = None, []
        for frame in frames:
            out = []
            keys = zip(frame["bucket"], frame["block"])
            rows = zip(frame["doc_id"], frame["component"], frame["n_shingles"], frame["bands"], frame["signature"])
            for key, own, (doc_id, part, size, bands, signature) in zip(keys, frame["own"], rows):
                if key != current:
                    current, ids, bands_of = key, [], []
                    parts, sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
                    signatures = np.zeros((0, len(signature)), np.uint8)
                row, bands = np.frombuffer(signature, np.uint8), np.asarray(bands)
                other = np.flatnonzero(
                    (parts != part)
                    & (100 * np.minimum(sizes, size) >= settings.least * np.maximum(sizes, size))
                )
                if len(other):
                    for i in other[estimates(row, signatures[other], long) >= least]:
                        if np.intersect1d(bands_of[i], bands).min() == key[0]:
                            out.append((ids[i], doc_id))
                if own:
                    ids.append(doc_id), bands_of.append(bands)
                    parts, sizes = np.append(parts, part), np.append(sizes, size)
                    signatures = np.concatenate([signatures, row[None]])
            pairs = np.sort(np.array(out, np.int64).reshape(-1, 2), axis=1)
            yield pd.DataFrame({"leader": pairs[:, 0], "member": pairs[:, 1]})

    return work


def _cross_candidates(
    buckets: DataFrame, members: DataFrame, parts: DataFrame, docs: DataFrame, settings: Settings
) -> DataFrame:
    """Candidate pairs in buckets with more than one component: outsiders, in blocks, against the whole bucket."""
    rows = buckets.join(parts, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    sizes = rows.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("bucket").agg(
        F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("total"), F.count("*").alias("kinds")
    )
    main = main.where("kinds > 1").select(
        "bucket",
        F.col("most.component").alias("main"),
        ((F.col("total") - F.col("most.n")) / settings.block).cast("int").alias("last_block"),
    )
    rows = staged(rows.join(main, "bucket"), "near-mixed")
    involved = staged(rows.select("doc_id").distinct(), "near-involved")
    texts = docs.select("doc_id", "text").join(involved, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    long = texts.mapInPandas(_long_signatures(settings), "doc_id bigint, signature binary")
    known = members.select("doc_id", "n_shingles", "bands").join(involved, "doc_id", "left_semi")
    known = staged(known.join(long, "doc_id"), "near-long")
    rows = rows.join(known, "doc_id").withColumn("own_block", F.pmod(F.xxhash64("doc_id"), F.col("last_block") + 1))
    rows = rows.withColumn("outside", F.col("component") != F.col("main"))
    spread = rows.withColumn("block", F.explode(F.sequence(F.lit(0), "last_block")))
    # An outsider belongs to one block; in the others it is met as any other row of the bucket.
    return (
        spread.withColumn("own", F.col("outside") & (F.col("block") == F.col("own_block")))
        .select("bucket", "block", "own", "doc_id", "component", "n_shingles", "bands", "signature")
        .repartition("bucket", "block")
        .sortWithinPartitions("bucket", "block", F.desc("own"), "doc_id")
        .mapInPandas(_cross_look(settings), "leader bigint, member bigint")
    )


def near_dedup(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept.

    Words are runs of other than ASCII white space with A-Z in lower case; a text with fewer words than a shingle is
    one shingle, one without words (or null) has none and is linked with nothing. component_id is the smallest doc_id
    reachable over links. doc_id identifies a document: rows that repeat an id have to repeat its text, and come out
    as often. A row with a null id is linked with nothing, has a null component_id, and is kept.
    """
    bounded_batches(docs.sparkSession)
    narrow = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    signed = staged(narrow.mapInPandas(_signed(settings), CLASS), "near-signed")
    with_set = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    leader = with_set.groupBy("set_key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("rows"))
    classes = staged(leader.select("set_key", "class_id"), "near-classes")
    members = with_set.select("doc_id", "n_shingles", "bands", "signature").join(
        classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi"
    )
    members = staged(members.dropDuplicates(["doc_id"]), "near-members")
    signatures = members.select("doc_id", "signature")
    buckets = members.select("doc_id", F.explode("bands").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    buckets = staged(buckets.join(sizes, "bucket"), "near-buckets")
    weights = buckets.groupBy("doc_id").agg(F.sum("n").alias("met"))
    leaders = (
        buckets.join(weights, "doc_id")
        .groupBy("bucket")
        .agg(F.max(F.struct(F.col("met"), (-F.col("doc_id")).alias("order"), F.col("doc_id"))).alias("first"))
        .select("bucket", F.col("first.doc_id").alias("leader"))
    )
    tried = buckets.join(leaders, "bucket").where("leader <> doc_id")
    tried = tried.select("leader", F.col("doc_id").alias("member")).distinct()
    first = (
        tried.join(signatures.withColumnRenamed("doc_id", "member"), "member")
        .join(signatures.toDF("leader", "leader_signature"), "leader")
        .mapInPandas(_first_look(settings), "leader bigint, member bigint")
    )
    stars = staged(confirmed(first, narrow, settings), "near-links")
    parts = staged(components(stars), "near-parts").select(F.col("id").alias("doc_id"), "component")
    crossed = _cross_candidates(buckets.select("bucket", "doc_id"), members, parts, narrow, settings)
    across = staged(confirmed(crossed, narrow, settings), "near-links")
    parts = staged(components(stars.unionByName(across)), "near-parts")
    named = classes.join(parts.withColumnRenamed("id", "class_id"), "class_id", "left").select(
        "set_key", F.coalesce("component", "class_id").alias("component")
    )
    alone = signed.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("c"))
    linked = with_set.join(named, "set_key").select("doc_id", "n_shingles", F.col("component").alias("c"))
    return alone.unionByName(linked).select(
        "doc_id", "n_shingles", F.col("c").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("c")).alias("kept")
    )


def keep_one_of_each(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents that `near_dedup` keeps, with all their columns; rows with a null id stay.

    Where an id is repeated, its different texts are documents of their own, in order of their digests.
    """
    ids = docs.select(docs["doc_id"].cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL")
    if ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        found = near_dedup(docs.select("doc_id", "text"), settings)
        dropped = staged(found.where("NOT kept").select(F.col("doc_id").alias("dropped_id")).distinct(), "near-dropped")
        return docs.join(dropped, docs["doc_id"].cast("bigint") == dropped["dropped_id"], "left_anti")
    # Documents are numbered in the order of their ids, by ranges.
    rows = docs.select(docs["doc_id"].cast("bigint").alias("gone_id"), digest_of(docs).alias("gone_digest"))
    rows = staged(rows.where("gone_id IS NOT NULL").distinct(), "near-documents")
    order = ["gone_id", "gone_digest"]
    numbers = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbers = staged(numbers.withColumn("number", F.monotonically_increasing_id()), "near-numbers")
    texts = docs.select(
        docs["doc_id"].cast("bigint").alias("gone_id"), digest_of(docs).alias("gone_digest"), text_of(docs).alias("text")
    ).join(numbers, order)
    found = near_dedup(texts.select(F.col("number").alias("doc_id"), "text"), settings)
    dropped = staged(found.where("NOT kept").select(F.col("doc_id").alias("number")).distinct(), "near-dropped")
    return without(docs, staged(numbers.join(dropped, "number", "left_semi").select(*order), "near-gone"))
