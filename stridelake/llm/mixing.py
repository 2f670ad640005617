"""Soft-membership mixing: document rates that bring expected domain token totals to target weights.

The labels table defines the domains. A naive Bayes classifier learned from it gives each document a posterior over
them, so a document counts for several domains in part. Rates are the nonnegative (optionally bounded) least-squares
solution for the domain totals, found by projected gradient steps from rates of one.

A step moves every rate by the same few numbers, `rate - posterior . c`, then projects it. So the driver keeps only
the steps' coefficients, a short list per domain, and each pass replays them over the posteriors: one aggregate of
as many sums as there are domains. No rates are written or gathered between steps.

DataFrame and SQL functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import digest_of, text_of, without
from stridelake.session import staged


@dataclass(frozen=True)
class Settings:
    """`domains` name the labels' combinations; `weights` are the targets, `total` the tokens wanted: that of the
    table (`None`), or so many that the domain with the largest weight stays whole at the bound on rates
    (`"largest"`).

    `labelled_rows` bounds what the classifier learns from, `buckets` its size. A word speaks only where its
    count is `evidence` standard deviations from none, and its odds by a factor of exp(`effect`)."""

    domains: dict[str, str] = field(
        default_factory=lambda: {
            "toxic": "toxic = 1",
            "low": "coalesce(toxic, 0) <> 1 AND quality = 0",
            "good": "coalesce(toxic, 0) <> 1 AND quality = 1",
        }
    )
    weights: dict[str, float] = field(default_factory=lambda: {"good": 0.85, "low": 0.12, "toxic": 0.03})
    total: str | None = None
    max_rate: float | None = None
    labelled_rows: int = 40_000
    buckets: int = 1 << 15
    evidence: float = 5.0
    effect: float = 0.7
    steps: int = 30
    tolerance: float = 1e-4

    @property
    def names(self) -> list[str]:
        return sorted(self.weights)


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case, and runs of other signs, each with its last sign as it stands."""
    spaced = F.regexp_replace(F.lower(text), r"(?<=[\p{L}\p{N}])(?=[^\p{L}\p{N}\s])|(?<=[^\p{L}\p{N}\s])(?=[\p{L}\p{N}])", " ")
    return F.filter(F.split(spaced, r"\s+"), lambda word: word != "")


def domain_of(settings: Settings) -> Column:
    found = F.lit(None).cast("string")
    for name in settings.names:
        found = F.when(F.expr(settings.domains[name]), F.lit(name)).otherwise(found)
    return found


def buckets_of(text: Column, settings: Settings) -> Column:
    """The buckets of the distinct words of a text."""
    hashed = F.transform(
        F.array_distinct(tokens(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(settings.buckets)).cast("int")
    )
    return F.array_distinct(hashed)


def learn(docs: DataFrame, labels: DataFrame, settings: Settings) -> tuple[DataFrame, dict[str, float]]:
    """Evidence of a word's presence for each domain, by bucket (at most `buckets` rows), and that of a text without any.

    A document with several label rows counts by each of them; labels without a document, or of no domain, do not.
    """
    labelled = labels.select(labels["doc_id"].cast("bigint").alias("row_key"), domain_of(settings).alias("domain"))
    labelled = labelled.where("row_key IS NOT NULL AND domain IS NOT NULL")
    picked = labelled.orderBy(F.xxhash64("row_key"), "row_key", "domain").limit(settings.labelled_rows)
    picked = staged(picked, "mix-picked")
    texts = docs.select(docs["doc_id"].cast("bigint").alias("row_key"), text_of(docs).alias("text"))
    # At most `labelled_rows` rows of an id and a name.
    lessons = texts.join(F.broadcast(picked), "row_key").select("domain", buckets_of(F.col("text"), settings).alias("buckets"))
    lessons = staged(lessons, "mix-lessons")
    sizes = {r["domain"]: r["n"] for r in lessons.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    every = sum(sizes.values())
    names = settings.names
    prior = {n: (sizes.get(n, 0) + 1.0) / (every + len(names)) for n in names}
    sums = lessons.select("domain", F.explode("buckets").alias("bucket"))
    sums = sums.groupBy("bucket").agg(
        F.count("*").alias("n"), *[F.count(F.when(F.col("domain") == n, 1)).alias(f"n_{n}") for n in names]
    )
    columns = []
    for n in names:
        inside, outside = float(sizes.get(n, 0)), float(every - sizes.get(n, 0))
        p = (F.col(f"n_{n}") + 0.5) / (inside + 1.0)
        q = (F.col("n") - F.col(f"n_{n}") + 0.5) / (outside + 1.0)
        expected = F.col("n") * (inside / max(every, 1))
        spread = F.sqrt(expected * (1 - inside / max(every, 1)) + 0.5)
        speaks = F.abs(F.col(f"n_{n}") - expected) >= settings.evidence * spread
        speaks = speaks & (F.abs(F.log(p / q)) >= settings.effect)
        absent = F.log((1 - p) / (1 - q))
        columns.append(F.when(speaks, F.log(p / q) - absent).otherwise(F.lit(0.0)).alias(f"w_{n}"))
        columns.append(F.when(speaks, absent).otherwise(F.lit(0.0)).alias(f"a_{n}"))
    weights = sums.select("bucket", *columns)
    weights = staged(weights.where(" OR ".join(f"`w_{n}` <> 0" for n in names)), "mix-weights")
    absent = weights.agg(*[F.sum(f"a_{n}") for n in names]).first()
    base = {n: math.log(prior[n] / (1 - prior[n])) + float(x or 0.0) for n, x in zip(names, absent)}
    return weights.select("bucket", *[f"w_{n}" for n in names]), base


def posteriors(
    docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), with_digest: bool = False
) -> DataFrame:
    """row_key, doc_id, n_tokens, posterior (array in order of the domains' names) for each row of docs, and the digest
    of its text if wanted."""
    weights, prior = learn(docs, labels, settings)
    names = settings.names
    keyed = docs.select(
        F.monotonically_increasing_id().alias("row_key"),
        docs["doc_id"].cast("bigint").alias("doc_id"),
        text_of(docs).alias("text"),
        *([digest_of(docs).alias("digest")] if with_digest else []),
    )
    own = ["doc_id", "digest"] if with_digest else ["doc_id"]
    # One pass over the texts: a row for each word that speaks, and one for the document with its number of words.
    parsed = keyed.select("row_key", *own, tokens(F.col("text")).alias("all_words"))
    parsed = parsed.select(
        "row_key", *own, F.size("all_words").alias("size"), F.explode_outer(F.array_distinct("all_words")).alias("word")
    )
    marked = parsed.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(settings.buckets)).cast("int"))
    # The table of weights has at most `buckets` rows, whatever the size of the corpus.
    scored = marked.join(F.broadcast(weights), "bucket", "left")
    sums = scored.groupBy("row_key").agg(
        *[F.first(c).alias(c) for c in own],
        F.max("size").cast("bigint").alias("n_tokens"),
        *[F.sum(F.coalesce(f"w_{n}", F.lit(0.0))).alias(f"s_{n}") for n in names],
    )
    logits = [F.col(f"s_{n}") + F.lit(prior[n]) for n in names]
    odds = [1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x)))) for x in logits]
    total = sum(odds[1:], odds[0])
    return sums.select("row_key", *own, "n_tokens", F.array(*[o / total for o in odds]).alias("posterior"))


def _replayed(steps: list[list[float]], max_rate: float | None) -> Column:
    """The rate after all steps so far, each `rate - posterior . c` and projected."""
    if not steps:
        return F.lit(1.0)

    def step(rate: Column, c: Column) -> Column:
        moved = F.aggregate(F.zip_with("posterior", c, lambda p, x: p * x), rate, lambda a, b: a - b)
        moved = F.greatest(moved, F.lit(0.0))
        return moved if max_rate is None else F.least(moved, F.lit(float(max_rate)))

    literal = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    return F.aggregate(literal, F.lit(1.0), step)


def targets(current: dict[str, float], settings: Settings) -> dict[str, float]:
    """Tokens wanted of each domain."""
    share = sum(settings.weights.values())
    weights = {n: settings.weights[n] / share for n in settings.names}
    total = sum(current.values())
    if settings.total == "largest" and settings.max_rate is not None:
        largest = max(settings.names, key=lambda n: weights[n])
        total = min(total * settings.max_rate, settings.max_rate * current[largest] / weights[largest])
    return {n: w * total for n, w in weights.items()}


def fit_rates(table: DataFrame, settings: Settings = Settings()) -> tuple[list[list[float]], dict, dict]:
    """The steps' coefficients, the expected totals they lead to, and the targets.

    `table` has n_tokens and posterior. Steps are taken in the metric of the tokens: the gradient of a rate is then
    its posterior times the domains' errors. It is scaled by the inverse overlap of the documents whose rate can move
    that way; a step that makes things worse is halved.
    """
    names, bound = settings.names, settings.max_rate
    size = len(names)
    p = [F.col("posterior")[i] for i in range(size)]

    def totals_after(steps: list[list[float]]) -> np.ndarray:
        moved = table.select("n_tokens", "posterior", _replayed(steps, bound).alias("rate"))
        row = moved.agg(*[F.sum(F.col("rate") * F.col("n_tokens") * x) for x in p]).first()
        return np.array([float(x or 0.0) for x in row])

    def overlap_of_free(steps: list[list[float]], error: np.ndarray) -> np.ndarray:
        """Over documents whose rate is inside its bounds, or at one and drawn inwards."""
        downwards = sum((x * float(e) for x, e in zip(p[1:], error[1:])), p[0] * float(error[0]))
        free = (F.col("rate") > 0) | (downwards < 0)
        if bound is not None:
            free = free & ((F.col("rate") < float(bound)) | (downwards > 0))
        moved = table.select("n_tokens", "posterior", _replayed(steps, bound).alias("rate"))
        row = moved.where(free).agg(*[F.sum(F.col("n_tokens") * x * y) for x in p for y in p]).first()
        return np.array([float(x or 0.0) for x in row]).reshape(size, size)

    steps: list[list[float]] = []
    totals = totals_after(steps)
    wanted = targets(dict(zip(names, totals.tolist())), settings)
    goal = np.array([wanted[n] for n in names])
    enough = settings.tolerance * max(goal.sum(), 1.0)
    while len(steps) < settings.steps:
        error = totals - goal
        if np.abs(error).max() <= enough:
            break
        overlap = overlap_of_free(steps, error)
        if not overlap.any():
            break
        ridge = 1e-6 * np.trace(overlap) * np.eye(size)
        step = np.linalg.solve(overlap + ridge, error)
        for _ in range(8):
            after = totals_after([*steps, step.tolist()])
            if np.linalg.norm(after - goal) < np.linalg.norm(error):
                break
            step = step / 2
        else:
            break
        steps.append(step.tolist())
        gained, totals = np.linalg.norm(error) - np.linalg.norm(after - goal), after
        if gained <= enough / 10:
            break
    return steps, dict(zip(names, totals.tolist())), wanted


def mix(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each document: doc_id, n_tokens, one posterior column p_<domain> each, rate, copies.

    `copies` is the rate rounded up or down by a hash of doc_id, so that its mean is the rate and it is the same in
    each run. A null or empty text has no tokens and the posteriors of no evidence. A null doc_id is treated alike.
    Without labels the posteriors follow the even prior. An empty table gives no rows.
    """
    return _mixed(posteriors(docs, labels, settings), settings)


def _mixed(found: DataFrame, settings: Settings) -> DataFrame:
    table = staged(found.drop("row_key"), "mix-posteriors")
    steps, _, _ = fit_rates(table, settings)
    rate = table.withColumn("rate", _replayed(steps, settings.max_rate))
    return rate.select(
        "doc_id",
        "n_tokens",
        *[F.col("posterior")[i].alias(f"p_{n}") for i, n in enumerate(settings.names)],
        "rate",
        F.floor(F.col("rate") + share_of(F.col("doc_id"))).cast("int").alias("copies"),
        *[c for c in table.columns if c == "digest"],
    )


def share_of(doc_id: Column) -> Column:
    """A number from 0 up to 1 that follows from the id."""
    return F.pmod(F.xxhash64(F.lit("mix"), doc_id), F.lit(1 << 30)) / F.lit(float(1 << 30))


def keep_by_rate(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents that the mix takes, with all their columns, none of them twice: rates are bounded by one.

    The domain with the largest weight stays whole, and the others come down to their share of it. Where ids are null
    or repeated, a document is told by its id and its text.
    """
    bounded = replace(settings, max_rate=1.0, total="largest")
    ids = docs.select(docs["doc_id"].cast("bigint").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n"))
    clear = ids.where("doc_id IS NULL OR n > 1").isEmpty()
    rates = _mixed(posteriors(docs.select("doc_id", "text"), labels, bounded, with_digest=not clear), bounded)
    dropped = rates.where("copies = 0").withColumnRenamed("doc_id", "gone_id")
    if clear:
        dropped = staged(dropped.select("gone_id").distinct(), "mix-dropped")
        return docs.join(dropped, docs["doc_id"].cast("bigint") == dropped["gone_id"], "left_anti")
    dropped = dropped.select("gone_id", F.col("digest").alias("gone_digest")).distinct()
    return without(docs, staged(dropped, "mix-dropped"))
