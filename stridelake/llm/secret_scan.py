"""Secret scans with corpus-wide ownership frequency.

Patterns find candidates in each text. A candidate's value leaves the scan as a hash only. The hashes are counted over
the corpus by uses, distinct repositories and owners: what many owners have is a copied example, what one owner alone
has in few places and looks random is a live credential of that owner. What one or two owners have in many
repositories or many times is unclear.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import bounded_batches, text_of
from stridelake.session import staged

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Without one of these in the lower-cased text there is no assignment.
ASSIGN_WORDS = ("passw", "secret", "token", "api")
#: Kinds that the ownership method looks for besides: pattern, and a string that has to be in the text.
MORE = [
    ("github", re.compile(r"gh[pousr]_[A-Za-z0-9]{20,}"), "gh"),
    ("slack", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"), "xox"),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), "eyJ"),
    ("pem", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"), "PRIVATE KEY-----"),
]
KINDS = ["assign", "access", "hex"] + [kind for kind, _, _ in MORE]
PLACEHOLDER = re.compile(r"example|sample|changeme|dummy|placeholder|your|test|xxxx|1234567|abcdef|(.)\1{5}", re.IGNORECASE)

SPAN = "struct<kind:string,start:int,end:int,hash:binary,random:boolean>"
SCAN = f"row_key bigint, doc_id bigint, repo string, owner string, found array<{SPAN}>"


@dataclass(frozen=True)
class Settings:
    """A value with `shared_owners` owners or more is an example. A live one has one owner, fewer than `copied_repos`
    repositories and fewer than `copied_uses` uses. One that looks random has at least `entropy` bits a character, a
    letter and a digit, and no placeholder in it."""

    shared_owners: int = 3
    copied_repos: int = 10
    copied_uses: int = 100
    entropy: float = 2.8


def entropy(value: str) -> float:
    counts = Counter(value).values()
    return -sum(n / len(value) * math.log2(n / len(value)) for n in counts) if value else 0.0


def looks_random(value: str, settings: Settings = Settings()) -> bool:
    mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    return mixed and not PLACEHOLDER.search(value) and entropy(value) >= settings.entropy


def spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value), by start and then by kind as listed. Offsets are code points, the end exclusive."""
    found = []
    lower = text.lower()
    if any(word in lower for word in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    for kind, pattern, needed in MORE:
        if needed in text:
            found += [(kind, m.start(), m.end(), m[0]) for m in pattern.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _scan(settings: Settings):
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                [
                    {
                        "kind": kind,
                        "start": start,
                        "end": end,
                        "hash": hashlib.sha256(value.encode("utf-8", "replace")).digest(),
                        "random": looks_random(value, settings),
                    }
                    for kind, start, end, value in spans(text)
                ]
                for text in frame["text"]
            ]
            out = frame[["row_key", "doc_id", "repo", "owner"]].copy()
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out.assign(found=rows)

    return work


def scan(docs: DataFrame, repo: str, owner: str, settings: Settings = Settings()) -> DataFrame:
    """row_key, doc_id, repo, owner, and the spans found with the hash of each value."""
    return docs.select(
        F.monotonically_increasing_id().alias("row_key"),
        docs["doc_id"].cast("bigint").alias("doc_id"),
        docs[repo].cast("string").alias("repo"),
        docs[owner].cast("string").alias("owner"),
        text_of(docs).alias("text"),
    ).mapInPandas(_scan(settings), SCAN)


def ownership(scanned: DataFrame) -> DataFrame:
    """hash, owners, repos, uses: over the whole corpus, counted in two steps so that a hash that is everywhere is
    summed up before it is shuffled. All unnamed owners count as one, and so do all unnamed repositories of an owner."""
    uses = scanned.select("repo", "owner", F.explode("found").alias("x")).select("x.hash", "owner", "repo")
    by_repo = uses.groupBy("hash", "owner", "repo").agg(F.count("*").alias("uses"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("uses").alias("uses"))
    return by_owner.groupBy("hash").agg(
        F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("uses").alias("uses")
    )


def _listed(spans_column: Column) -> Column:
    return F.array_join(
        F.transform(spans_column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def find_secrets(
    docs: DataFrame, repo: str = "source", owner: str = "source", settings: Settings = Settings()
) -> DataFrame:
    """One row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, n_unclear,
    live_spans, most_owners, most_repos, most_uses (of any of its values).

    Base spans (assign, access, hex) are never taken away; the other kinds add to `spans`. Of all spans, `live` are
    those of one owner in few places that look random, `example` those of `shared_owners` owners or more and those that don't look
    random, `unclear` the rest. A null text counts as empty, has no spans and the digest of the empty string. Rows
    with null or repeated ids are answered one by one; their uses count each.
    """
    bounded_batches(docs.sparkSession)
    scanned = staged(scan(docs, repo, owner, settings), "secret-scan")
    uses = scanned.select("row_key", F.explode("found").alias("x")).select("row_key", "x.*")
    few = (F.col("repos") < settings.copied_repos) & (F.col("uses") < settings.copied_uses)
    kind = (
        F.when((F.col("owners") >= settings.shared_owners) | ~F.col("random"), "example")
        .when((F.col("owners") == 1) & few, "live")
        .otherwise("unclear")
    )
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).alias("order")
    live = F.when(kind == "live", F.struct("start", order, "kind", "end"))
    judged = (
        uses.join(ownership(scanned), "hash")
        .groupBy("row_key")
        .agg(
            *[F.count(F.when(kind == k, 1)).alias(f"n_{k}") for k in ("live", "example", "unclear")],
            F.array_sort(F.collect_list(live)).alias("live"),
            *[F.max(k).alias(f"most_{k}") for k in ("owners", "repos", "uses")],
        )
    )
    base = F.filter("found", lambda s: s["kind"].isin("assign", "access", "hex"))

    def number(k: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")

    return scanned.join(judged, "row_key", "left").select(
        "doc_id",
        number("assign"),
        number("access"),
        number("hex"),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in ("live", "example", "unclear")],
        F.coalesce(_listed(F.col("live")), F.lit("")).alias("live_spans"),
        *[F.coalesce(f"most_{k}", F.lit(0)).cast("bigint").alias(f"most_{k}") for k in ("owners", "repos", "uses")],
    )
