"""Helpers that several operators share: the documents table, folds, words, shingles, bounded samples."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stridelake.session import staged

WORD_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
FINAL_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
HALF = np.uint64(32)
BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def bounded_batches(spark: SparkSession, rows: int | None = None) -> None:
    """Send rows to Python workers in batches of about `BATCH_BYTES`, however long the texts are.

    The default counts rows, and ten thousand long texts fill a worker. It is a setting of the session, read when a
    query runs, and changes no result. `rows` that are narrower may come in batches of more, up to the same bytes.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_of(df: DataFrame) -> Column:
    """The text, a null one counting as empty."""
    return F.coalesce(df["text"].cast("string"), F.lit(""))


def digest_of(df: DataFrame) -> Column:
    """SHA-256 of the text: with the id it tells documents apart where ids alone don't."""
    return F.unhex(F.sha2(text_of(df), 256))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """`docs` without the rows of the documents in `gone` (gone_id, gone_digest); a null id is an id here."""
    same = docs["doc_id"].cast("bigint").eqNullSafe(gone["gone_id"]) & (digest_of(docs) == gone["gone_digest"])
    return docs.join(gone, same, "left_anti")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id is in no fold (null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def in_fold(doc_id: Column, folds: int, number: int) -> Column:
    return F.coalesce(fold(doc_id, folds) == number, F.lit(False))


def words(text: str) -> list[bytes]:
    """Runs of other than ASCII white space, A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "replace").lower().split()


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> HALF)) * FINAL_MULTIPLIER
    return values ^ (values >> HALF)


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words, in order; of fewer words, the whole sequence is one run."""
    count = len(hashes)
    if not count:
        return hashes
    size = min(size, count)
    # Word i counts multiplier ** (size - 1 - i) times. Lengths double, and grow by a word, along the digits of `size`.
    out, length = hashes, 1
    for digit in f"{size:b}"[1:]:
        out = out[:-length] * np.uint64(pow(int(WORD_MULTIPLIER), length, 1 << 64)) + out[length:]
        length *= 2
        if digit == "1":
            out = out[:-1] * WORD_MULTIPLIER + hashes[length:]
            length += 1
    return mixed(out)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    return np.unique(runs(word_hashes(words(text)), size)) if text else np.zeros(0, np.uint64)


def sample_by_class(df: DataFrame, label: str, per_class: int) -> DataFrame:
    """At most `per_class` rows of each label, picked by a hash of `doc_id`: repeatable, and from all of the table.

    The rows are picked on the two narrow columns, behind a threshold on their hash that leaves about `per_class` of a
    class, so that one with most of the rows is no large group. The texts then join the written picks, whose true
    size Spark knows.
    """
    spread = 1 << 30
    narrow = df.select("doc_id", label).distinct()
    by_hash = F.pmod(F.xxhash64(F.lit(label), F.col("doc_id")), F.lit(spread))
    counts = narrow.groupBy(label).agg(F.count("*").alias("class_rows"))
    ranked = (
        narrow.withColumn("pick", by_hash)
        .join(counts, label)
        .where(F.col("pick") * F.col("class_rows") <= F.lit(1.25 * per_class * spread))
        .withColumn("place", F.row_number().over(W.partitionBy(label).orderBy("pick", "doc_id")))
        .where(F.col("place") <= per_class)
    )
    return df.join(staged(ranked.select("doc_id", label), "picked"), ["doc_id", label])

