"""Toxicity with a counterfactually regularised classifier.

A logistic regression on a text's distinct words and their beginnings. Where a labelled text names an identity, the
name is swapped for others of its kind and for none, and the fit is charged for each change of the score. So a
group's mention itself comes to carry no weight, even where it goes along with toxic texts.

The score is a sum over distinct words, which keeps a whole corpus to one look-up for each word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import bounded_batches, fold, in_fold, text_of
from stridelake.session import staged

WORD = re.compile(r"\w+")
#: Names of groups, by kind; a name is swapped for the others of its kind.
IDENTITY = {
    "faith": "christian muslim jewish hindu buddhist sikh atheist catholic protestant",
    "faith_people": "christians muslims jews hindus buddhists sikhs atheists catholics protestants",
    "origin": "african american asian european arab mexican indian chinese turkish polish roma black white latino",
    "origin_people": "africans americans asians europeans arabs mexicans indians turks poles blacks whites latinos",
    "gender": "woman man girl boy female male transgender nonbinary",
    "gender_people": "women men girls boys females males",
    "orientation": "gay lesbian straight bisexual queer heterosexual homosexual",
    "body": "disabled blind deaf autistic able",
    "age": "old young elderly teenage",
    "faith_de": "christ muslim jude hindu buddhist atheist",
    "origin_de": "deutscher türke pole araber afrikaner asiate",
    "faith_fr": "chrétien musulman juif hindou bouddhiste athée",
    "origin_fr": "français arabe africain asiatique polonais turc",
    "faith_es": "cristiano musulmán judío hindú budista ateo",
    "origin_es": "español árabe africano asiático mexicano turco",
}
#: A name that two languages share belongs to the kind listed first.
KIND_OF = {name: kind for kind, names in reversed(IDENTITY.items()) for name in names.split()}
PREFIXES = range(3, 9)


@dataclass(frozen=True)
class Settings:
    """`per_class` bounds the labelled texts that are learned from, `features` the size of the model. A feature is
    considered that is in `least` texts and whose share in the classes differs by `evidence` standard errors."""

    per_class: int = 12_000
    features: int = 4_000
    least: int = 3
    evidence: float = 2.5
    most: int = 3
    ridge: float = 1e-3
    fairness: float = 2.0
    steps: int = 400
    rate: float = 0.05


def features_of(word: str) -> list[str]:
    """The word itself, and the beginnings of a longer one. An identity name is itself only."""
    if word in KIND_OF:
        return [word + "$"]
    return [word + "$"] + [word[:k] for k in PREFIXES if len(word) > k]


def distinct_words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def counts_of(words: set[str], most: int, wanted: dict[str, int] | None = None) -> dict:
    """How many of the distinct words have a feature, up to `most`."""
    counts = Counter(f for w in words for f in features_of(w) if wanted is None or f in wanted)
    return {(f if wanted is None else wanted[f]): min(n, most) for f, n in counts.items()}


def swaps(words: set[str]) -> list[set[str]]:
    """The words with each identity name swapped for the next of its kind that isn't there, and with none of them."""
    named = sorted(w for w in words if w in KIND_OF)
    if not named:
        return []
    plain = words - set(named)
    turned = set()
    for name in named:
        kin = IDENTITY[KIND_OF[name]].split()
        at = kin.index(name)
        turned.add(next((k for k in kin[at + 1 :] + kin[:at] if k not in words), name))
    return [plain | turned, plain]


class Model:
    def __init__(self, weights: dict[str, float], bias: float, most: int):
        self.weights, self.bias, self.most = weights, bias, most

    def logit(self, words: set[str]) -> float:
        weights, counts = self.weights, Counter()
        for word in words:
            for feature in features_of(word):
                if feature in weights:
                    counts[feature] += 1
        return self.bias + sum(weights[f] * min(n, self.most) for f, n in counts.items())


class Scorer:
    """Applies a model with a memory of each word's features, most of which are none."""

    REMEMBERED = 300_000

    def __init__(self, weights: dict[str, float], bias: float, most: int):
        self.model, self.known = Model(weights, bias, most), {}

    def scores(self, texts: list[str]) -> list[float]:
        weights, most, bias = self.model.weights, self.model.most, self.model.bias
        out = []
        for text in texts:
            counts: dict[str, int] = {}
            known = self.known
            for word in distinct_words(text):
                hit = known.get(word)
                if hit is None:
                    if len(known) >= self.REMEMBERED:
                        known.clear()
                    hit = known[word] = tuple(f for f in features_of(word) if f in weights)
                for f in hit:
                    counts[f] = counts.get(f, 0) + 1
            z = bias + sum(weights[f] * min(n, most) for f, n in counts.items())
            out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        return out


def _matrix(rows: list[dict[int, int]], width: int):
    """Rows as (row, column, value) arrays and products with them."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.fromiter((c for r in rows for c in r), np.int64, len(at))
    value = np.fromiter((v for r in rows for v in r.values()), np.float64, len(at))

    def times(w: np.ndarray) -> np.ndarray:
        return np.bincount(at, value * w[column], len(rows)) if len(rows) else np.zeros(0)

    def back(g: np.ndarray) -> np.ndarray:
        return np.bincount(column, value * g[at], width) if len(rows) else np.zeros(width)

    return times, back


def train(rows: list[dict[int, int]], pairs: list[tuple[int, dict[int, int]]], toxic: np.ndarray, width: int, s: Settings):
    """Weights and bias. `pairs` are (row, the row's features after a swap). Adam over all rows, classes weighted so
    that the rarer one counts for half as much again as its share; deterministic."""
    times, back = _matrix(rows, width)
    swapped_times, swapped_back = _matrix([f for _, f in pairs], width)
    origin = np.array([i for i, _ in pairs], np.int64)
    w, bias = np.zeros(width), 0.0
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    share = min(max(toxic.mean(), 1e-6), 1 - 1e-6)
    weight = np.where(toxic == 1, (0.5 / share) ** 0.5, (0.5 / (1 - share)) ** 0.5)
    weight /= weight.sum()
    for step in range(1, s.steps + 1):
        z = times(w)
        error = (1 / (1 + np.exp(-np.clip(z + bias, -30, 30))) - toxic) * weight
        gradient = np.append(back(error) + s.ridge * w, error.sum())
        if len(pairs):
            change = z[origin] - swapped_times(w)
            pull = np.bincount(origin, change, len(rows)) / len(pairs)
            gradient[:-1] += 2 * s.fairness * (back(pull) - swapped_back(change / len(pairs)))
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = s.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, text, toxic: at most `per_class` labelled texts of each class, by a hash of the id. An id with labels
    of both classes counts as toxic, one without a label is left out."""
    known = labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    known = known.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = F.xxhash64(F.lit("toxic"), F.col("doc_id"))
    picked = [known.where(F.col("toxic") == c).orderBy(by_hash, "doc_id").limit(settings.per_class) for c in (0, 1)]
    picked = staged(picked[0].unionByName(picked[1]), "toxic-picked")
    narrow = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    return narrow.join(F.broadcast(picked), "doc_id")  # at most twice `per_class` rows of an id and a label


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    """A model from the labelled texts among docs; None without both classes."""
    s = settings
    rows = staged(sample(docs, labels, s), "toxic-sample")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None

    def present(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), 256):
                part = frame.iloc[start : start + 256]
                counts = [Counter(), Counter()]
                for text, toxic in zip(part["text"], part["toxic"]):
                    counts[toxic].update({f for w in distinct_words(text) for f in features_of(w)})
                both = counts[0].keys() | counts[1].keys()
                out = [(f, counts[0][f], counts[1][f]) for f in both]
                yield pd.DataFrame(out, columns=["feature", "clean", "toxic"])

    sums = rows.mapInPandas(present, "feature string, clean bigint, toxic bigint").groupBy("feature")
    sums = sums.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n0, n1 = sizes[0], sizes[1]
    share = (F.col("clean") + F.col("toxic") + 1.0) / (n0 + n1 + 2.0)
    error = F.sqrt(share * F.greatest(1 - share, F.lit(1e-9)) * (1 / n0 + 1 / n1))
    z = F.abs(F.col("toxic") / n1 - F.col("clean") / n0) / error
    telling = sums.where((F.col("clean") + F.col("toxic") >= s.least) & (z >= s.evidence))
    chosen = telling.orderBy(z.desc(), F.length("feature").desc(), "feature").limit(s.features).select("feature")
    names = sorted({r["feature"] for r in chosen.collect()} | {n + "$" for n in KIND_OF})
    wanted = {n: i for i, n in enumerate(names)}

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc_id, text, toxic in zip(frame["doc_id"], frame["text"], frame["toxic"]):
                words = distinct_words(text)
                for place, version in enumerate([words, *swaps(words)]):
                    counts = counts_of(version, s.most, wanted)
                    out.append((doc_id, toxic, place, list(counts), list(counts.values())))
            yield pd.DataFrame(out, columns=["doc_id", "toxic", "place", "ids", "counts"])

    schema = "doc_id bigint, toxic int, place int, ids array<int>, counts array<int>"
    table = rows.mapInPandas(count, schema).toPandas().sort_values(["doc_id", "place"], kind="stable")
    lessons, pairs, toxic = [], [], []
    for doc_toxic, place, ids, counts in zip(table["toxic"], table["place"], table["ids"], table["counts"]):
        counted = dict(sorted(zip((int(i) for i in ids), (int(c) for c in counts))))
        if place == 0:
            lessons.append(counted), toxic.append(doc_toxic)
        else:
            pairs.append((len(lessons) - 1, counted))
    weights, bias = train(lessons, pairs, np.array(toxic, float), len(names), s)
    return Model({n: float(w) for n, w in zip(names, weights) if abs(w) > 1e-4}, bias, s.most)


def scored(docs: DataFrame, model: Model | None):
    """A double column: the score of the column `text`, null counting as empty; 0 without a model."""
    if model is None:
        return F.lit(0.0)
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.most))

    @F.pandas_udf("double")
    def work(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*shared.value)
        for texts in parts:
            yield pd.Series(scorer.scores(list(texts)))

    return work(text_of(docs))


def toxicity(
    docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, settings: Settings = Settings()
) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; learned from the labelled rows outside the held-out fold.

    Null and empty texts get the score of no words. A null doc_id is in no fold: it is scored and not learned from.
    Without labels of both classes all scores are 0. Repeated rows get the same score each.
    """
    model = fit(docs.where(fold(docs["doc_id"], folds) != held_out), labels, settings)
    return docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"),
        in_fold(docs["doc_id"], folds, held_out).alias("held_out"),
        scored(docs, model).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
