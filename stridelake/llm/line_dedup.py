"""Line dedup: hashes of lines in ranges, sorted by document and position; bitmaps go back, not texts.

Each line that can repeat becomes one row of numbers: 128 bits of its key, its document, its place. The rows are dealt
in ranges of (key, slice) and sorted by key, document and place, the newest document first, so that one pass over
the sorted rows sees where a key begins and where it goes on in another document. The lines that are to go
return to their documents as bitmaps of kept lines: runs of equal 64-bit words.

A key that a third of all documents share is cut into slices of documents. Each slice hands up one row (its newest
document and its number of documents), so no task sorts more of one key than a slice holds. The number of slices
follows the number of documents, and each result is the same at any number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stridelake.llm.common import text_of
from stridelake.session import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"
WORD = 64

#: A run of `words` equal 64-bit words of the bitmap, from word `first` on; a set bit is a kept line.
KEEP = "array<struct<first:int,words:int,bits:bigint>>"


@dataclass(frozen=True)
class Settings:
    """Keys of at least `least_chars` code points in at least `least_documents` documents lose their lines."""

    least_chars: int = 20
    least_documents: int = 3
    #: Documents whose lines of one key are sorted by one task, about.
    slice_documents: int = 1 << 14


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(SPACES))
    # In a text of single bytes only A-Z change case, and the built-in function is many times faster.
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, mark, text: rows that repeat id and text have one mark, and one bitmap serves them all."""
    text = text_of(docs)
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def keep_bitmaps(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, mark, n_dropped, keep: a bitmap for each document that loses lines, no text.

    `mark` is the xxhash64 of the text. Rows of one id are one document to the count; rows without an id are one
    document too, older than all others. A null text is one empty line. Documents without a row here keep every
    line; an empty table has no rows. Other columns are not read.
    """
    rows = _identified(docs)
    split = rows.select("doc_id", "mark", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = split.select("doc_id", "mark", "pos", line_key(F.col("line")).alias("key"))
    slices = -(-docs.count() // settings.slice_documents) or 1
    lines = staged(
        keyed.where(F.char_length("key") >= settings.least_chars).select(
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit(1), F.col("key")).alias("h2"),
            F.pmod(F.xxhash64(F.lit(2), F.col("doc_id")), F.lit(slices)).alias("slice"),
            "doc_id",
            "mark",
            "pos",
        ),
        "lines",
    )
    key, part = ["h1", "h2"], ["h1", "h2", "slice"]
    in_order = W.partitionBy(*part).orderBy(F.desc_nulls_last("doc_id"), "pos")
    # The ranges are what the window asks for: the rows are shuffled once and sorted once.
    ordered = lines.repartitionByRange(*part).select(
        *part,
        "doc_id",
        (
            (F.row_number().over(in_order) == 1) | ~F.col("doc_id").eqNullSafe(F.lag("doc_id").over(in_order))
        ).alias("first"),
    )
    heads = ordered.where("first").groupBy(*part).agg(F.max("doc_id").alias("newest"), F.count("*").alias("documents"))
    heads = staged(heads, "line-heads")
    totals = heads.groupBy(*key).agg(F.max("newest").alias("keep_id"), F.sum("documents").alias("documents"))
    shared = totals.where(F.col("documents") >= settings.least_documents).select(*key, "keep_id")
    shared = staged(heads.select(*part).join(shared, key), "shared-lines")
    dropped = lines.join(shared, part).where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return _bitmaps(dropped)


def _bitmaps(dropped: DataFrame) -> DataFrame:
    """The dropped places (doc_id, mark, pos) of each document as the bitmap of what is kept up to the last of them."""
    document = ["doc_id", "mark"]
    bit = F.expr(f"shiftleft(1L, pos % {WORD})")
    words = dropped.groupBy(*document, F.expr(f"pos div {WORD}").cast("int").alias("word")).agg(
        F.bit_or(bit).alias("bits")
    )
    listed = words.groupBy(*document).agg(
        F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"),
        F.sum(F.bit_count("bits")).cast("bigint").alias("n_dropped"),
    )
    # Between two words with dropped lines lies a run of full words; equal neighbours make one run.
    return listed.select(
        *document,
        "n_dropped",
        F.expr(
            f"""aggregate(words, cast(array() as {KEEP}), (runs, w) ->
                  CASE WHEN size(runs) > 0 AND runs[size(runs) - 1].bits = ~w.bits
                            AND runs[size(runs) - 1].first + runs[size(runs) - 1].words = w.word
                       THEN concat(slice(runs, 1, size(runs) - 1), array(named_struct(
                              'first', runs[size(runs) - 1].first, 'words', runs[size(runs) - 1].words + 1,
                              'bits', ~w.bits)))
                       ELSE concat(runs, array(named_struct('first', w.word, 'words', 1, 'bits', ~w.bits))) END)"""
        ).alias("keep"),
    )


def kept_text(text: Column, keep: Column) -> Column:
    """The lines whose bit is set, and those of words that the bitmap leaves out, joined by newlines."""
    lines = lines_of(text)
    # One flag for each line, full words in between spelled out: a lookup for each line would search the runs.
    bits = F.transform(
        keep,
        lambda run: F.transform(
            F.sequence(F.lit(0), run["words"] * WORD - 1),
            lambda i: F.getbit(run["bits"], i % WORD) == 1,
        ),
    )
    starts = F.transform(keep, lambda run: run["first"] * WORD)
    ends = F.transform(keep, lambda run: (run["first"] + run["words"]) * WORD)
    before = F.concat(F.array(F.lit(0)), ends)
    gaps = F.zip_with(
        F.concat(starts, F.array(F.greatest(F.size(lines), F.element_at(before, -1)))),
        before,
        lambda start, end: F.array_repeat(F.lit(True), start - end),
    )
    mask = F.flatten(
        F.zip_with(gaps, bits, lambda gap, run: F.concat(gap, F.coalesce(run, F.array().cast("array<boolean>"))))
    )
    return F.array_join(F.zip_with(lines, mask, lambda line, kept: F.when(kept, line)), "\n")


def dedup_lines(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, text, n_lines, n_dropped, kept_text for each row of `docs`, repeated rows included.

    A key is a line without ASCII white space at its ends, A-Z in lower case. Keys of `least_chars` code points or more
    in `least_documents` documents or more lose their lines everywhere but in the largest doc_id that holds them.
    A null text is one empty line. `doc_id` may be null (see `keep_bitmaps`), other columns are not read, and an empty
    table gives an empty one.
    """
    bitmaps = staged(keep_bitmaps(docs, settings), "line-bitmaps").select(
        F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "n_dropped", "keep"
    )
    rows = _identified(docs)
    same = rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["mark"] == F.col("_mark"))
    return rows.join(bitmaps, same, "left").select(
        "doc_id",
        "text",
        F.size(lines_of(F.col("text"))).cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("bigint")).alias("n_dropped"),
        F.when(F.col("keep").isNull(), F.col("text")).otherwise(kept_text(F.col("text"), F.col("keep"))).alias("kept_text"),
    )


def digests(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the text that is left, as `dedup_lines` has it."""
    return dedup_lines(docs, settings).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )
