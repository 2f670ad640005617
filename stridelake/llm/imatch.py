"""I-Match fingerprints with randomised lexicons.

The lexicon holds the terms whose inverse document frequency lies in a band: neither the most common words nor the
rare ones, which edits bring in and take out. A text's distinct lexicon terms, sorted, are hashed once for each of
several random subsets of the lexicon. A change of a few terms leaves the hashes of those subsets that hold none of them,
and the likeness of two texts is the share of equal hashes among the subsets in which either has a term.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stridelake.llm.common import text_of
from stridelake.session import staged


@dataclass(frozen=True)
class Settings:
    """The band in shares of the documents: a term is in the lexicon from `rarest` up to `commonest`. As a document has
    so many distinct terms on average, the lexicon has at most that number over `rarest` terms, at any corpus size.

    There are `each` subsets of each of the `shares` of the lexicon: large shares tell short texts apart, small ones
    long texts, which have so many terms that a large subset nearly always changes. A share is 16 ** -n or a
    multiple of it."""

    rarest: float = 0.01
    commonest: float = 0.2
    shares: tuple[float, ...] = (1 / 16, 1 / 64, 1 / 256)
    each: int = 16
    digits: int = 8

    @property
    def subsets(self) -> int:
        return len(self.shares) * self.each


def terms(text: Column) -> Column:
    """Distinct terms: runs of ASCII letters and digits and of all other non-ASCII characters, A-Z in lower case."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.split(lower, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))


def lexicon(docs: DataFrame, settings: Settings) -> DataFrame:
    """term, mask: the terms in the band; bit k of the mask says that subset k holds the term."""
    every = docs.count()
    counts = docs.select(F.explode(terms(F.col("text"))).alias("term")).where("term <> ''").groupBy("term")
    counts = counts.agg(F.count("*").alias("n"))
    band = counts.where((F.col("n") >= settings.rarest * every) & (F.col("n") <= settings.commonest * every))
    # Written first: what follows depends on the term alone and would be computed for each of its occurrences.
    band = staged(band.select("term"), "imatch-band")
    # A subset draws a term by MD5 of both; each draw is kept as a key of the subset's number and the term.
    keys = []
    for k in range(settings.subsets):
        drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{k:02d} "), "term").cast("binary")), 1, 4), 16, 10).cast("int")
        share = settings.shares[k // settings.each]
        keys.append(F.when(drawn < F.lit(int(share * 65536)), F.concat(F.lit(f"{k:02d}"), "term")))
    drawn = F.array_compact(F.array(*keys))
    # The empty term is in each text and has no subset, so that texts without other terms keep their row.
    known = band.select("term", drawn.alias("keys"))
    none = docs.sparkSession.range(1).select(F.lit("").alias("term"), F.array(F.lit("")).alias("keys"))
    return staged(known.unionByName(none), "imatch-lexicon")


#: What belongs to a row; the marks are hashes of its text and its edited text.
ROW = ["doc_id", "next_id", "n_chars", "edited_sha256", "own_mark", "edited_mark"]


def fingerprints(texts: DataFrame, lexicon_terms: DataFrame, settings: Settings) -> DataFrame:
    """One hash for each subset of the lexicon (empty where the text has none of its terms) as `prints`, with the
    row's keys. Every row comes out, those without terms too: the empty term carries what belongs to the row."""
    kept = ROW
    every = F.concat(terms(F.col("text")), F.array(F.lit("")))
    found = texts.select("row_key", "is_edited", F.struct(*kept).alias("row"), F.explode(every).alias("term"))
    found = found.withColumn("row", F.when(F.col("term") == "", F.col("row")))
    # The lexicon is bounded by the terms of an average document over `rarest`, see Settings.
    known = found.join(F.broadcast(lexicon_terms), "term")
    keys = known.select("row_key", "is_edited", "row", F.explode("keys").alias("key"))
    own = F.array_join(F.sort_array(F.collect_list("key")), " ")
    hashes = keys.groupBy("row_key", "is_edited", F.substring("key", 1, 2).alias("code")).agg(
        F.substring(F.md5(own.cast("binary")), 1, settings.digits).alias("hash"),
        F.first("row", ignorenulls=True).alias("row"),
    )
    by_row = hashes.groupBy("row_key", "is_edited").agg(
        F.map_from_entries(F.collect_list(F.struct("code", "hash"))).alias("hash_of"),
        F.first("row", ignorenulls=True).alias("row"),
    )
    numbers = F.array(*[F.lit(f"{k:02d}") for k in range(settings.subsets)])
    prints = F.transform(numbers, lambda code: F.coalesce(F.col("hash_of")[code], F.lit("")))
    return by_row.select("row_key", "is_edited", "row.*", prints.alias("prints"))


def likeness(one: Column, other: Column, same_text: Column, settings: Settings) -> Column:
    """Of the sizes of subsets the largest share of equal hashes, among the subsets in which either text has a term
    (four at least count); 1 for equal fingerprints with a term and for equal texts, else 0 if neither has a term."""
    shares = []
    for n in range(len(settings.shares)):
        a = F.slice(one, n * settings.each + 1, settings.each)
        b = F.slice(other, n * settings.each + 1, settings.each)
        used = F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: (p["a"] != "") | (p["b"] != ""))
        same = F.filter(used, lambda p: p["a"] == p["b"])
        shares.append(F.size(same) / F.greatest(F.size(used), F.lit(4)))
    empty = F.array_join(one, "") == ""
    return F.when(same_text | ((one == other) & ~empty), 1.0).otherwise(F.greatest(*shares)).cast("double")


def next_ids(ids: DataFrame) -> DataFrame:
    """row_key, next_key: the row that follows by (doc_id, row_key), the first one after the last; nulls come first.

    Rows are dealt in ranges; only the first row of each range meets in one place.
    """
    ranges = ids.repartitionByRange(F.asc_nulls_first("doc_id"), "row_key").withColumn("part", F.spark_partition_id())
    ranges = staged(ranges, "imatch-ranges")
    order = [F.asc_nulls_first("doc_id"), F.col("row_key")]
    within = ranges.withColumn("inner_next", F.lead("row_key").over(W.partitionBy("part").orderBy(*order)))
    firsts = ranges.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "row_key")).alias("first"))
    firsts = firsts.select("part", F.col("first.row_key").alias("key"))
    everything = W.orderBy("part")
    firsts = firsts.select(
        "part",
        F.coalesce(
            F.lead("key").over(everything),
            F.first("key").over(everything.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
        ).alias("outer_next"),
    )
    return within.join(firsts, "part").select(
        "row_key", F.coalesce("inner_next", "outer_next").alias("next_key")
    )


def keyed_rows(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, text. The key is the id where ids tell the rows apart; if any is null or repeated, rows are
    numbered, and written so that they keep their number."""
    ids = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"))
    unclear = ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id IS NULL OR n > 1")
    narrow = [docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text")]
    if unclear.isEmpty():
        return docs.select(docs["doc_id"].cast("bigint").alias("row_key"), *narrow)
    return staged(docs.select(F.monotonically_increasing_id().alias("row_key"), *narrow), "imatch-rows")


def imatch(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each document: doc_id, next_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document by doc_id, the first one following the last. A null text counts as empty; a text without lexicon terms
    has a fingerprint of empty parts and is like nothing but an equal text (likeness 0 and 1). Null ids come first in the order, and equal
    ids in that of the rows. An empty table gives no rows; extra columns are not read.
    """
    rows = keyed_rows(docs)
    follow = staged(next_ids(rows.select("doc_id", "row_key")), "imatch-next")
    # What the text before needs of each text: half of that one's length from the start.
    sizes = rows.select("row_key", F.length("text").alias("n_chars"))
    needs = follow.join(sizes, "row_key").select(
        F.col("row_key").alias("before_key"), F.col("next_key").alias("row_key"), F.expr("n_chars div 2").alias("half")
    )
    heads = rows.join(needs, "row_key").select(
        F.col("before_key").alias("row_key"), F.col("doc_id").alias("next_id"), F.expr("substring(text, 1, int(half))").alias("head")
    )  # with doc_id, as below, so that one shuffle of the texts serves both joins
    edited = rows.join(heads, "row_key").select(
        "row_key",
        "doc_id",
        "next_id",
        F.length("text").cast("bigint").alias("n_chars"),
        "text",
        F.concat(F.expr("substring(text, 1, int(length(text) - length(text) div 2))"), F.col("head")).alias("edited"),
    )
    versions = edited.select(
        "row_key",
        "doc_id",
        "next_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.xxhash64("text").alias("own_mark"),
        F.xxhash64("edited").alias("edited_mark"),
        F.explode(
            F.array(
                F.struct(F.lit(False).alias("is_edited"), F.col("text").alias("text")),
                F.struct(F.lit(True).alias("is_edited"), F.col("edited").alias("text")),
            )
        ).alias("version"),
    ).select("row_key", *ROW, "version.*")
    prints = fingerprints(versions, lexicon(rows, settings), settings)
    none = F.array_repeat(F.lit(""), settings.subsets)
    by_row = prints.groupBy("row_key").agg(
        *[F.max(name).alias(name) for name in ROW],
        F.coalesce(F.max(F.when(~F.col("is_edited"), F.col("prints"))), none).alias("own"),
        F.coalesce(F.max(F.when(F.col("is_edited"), F.col("prints"))), none).alias("edited"),
    )
    own, edited = F.col("own"), F.col("edited")
    # The parts go on as one text each, and a row as a whole meets the next one's in one join only.
    by_row = by_row.select(
        "row_key",
        *[name for name in ROW if name != "edited_mark"],
        F.array_join(own, ".").alias("fingerprint"),
        F.array_join(edited, ".").alias("edited_fingerprint"),
        likeness(own, edited, F.col("own_mark") == F.col("edited_mark"), settings).alias("near_edited"),
    )
    by_row = staged(by_row, "imatch-prints")
    named = [F.col("row_key").alias("next_key"), F.col("fingerprint").alias("next_print"), F.col("own_mark").alias("next_mark")]
    following = by_row.select(*named).join(follow, "next_key").select("row_key", "next_print", "next_mark")
    parts = [F.split(name, r"\.").alias(f"{name}_parts") for name in ("fingerprint", "next_print")]
    both = by_row.join(following, "row_key").select("*", *parts)
    same_text = F.col("own_mark") == F.col("next_mark")
    return both.select(
        "doc_id",
        "next_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        likeness(F.col("fingerprint_parts"), F.col("next_print_parts"), same_text, settings).alias("near_next"),
    )
