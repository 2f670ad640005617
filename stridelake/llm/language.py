"""Language ID with a byte convolutional network, trained and applied in numpy.

A window is a fixed number of UTF-8 bytes of the lower-cased text. Bytes are embedded, filters of several widths
slide over them, each filter's largest answer goes through a ReLU to a softmax. A text is cut into windows from
its first to its last byte; its answer is the mean of theirs, weighted by the letters in each.

To apply the network, embedding and filters are multiplied out to tables indexed by one byte or by a pair of
neighbouring bytes, so a filter of four bytes is two look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import bounded_batches, fold, in_fold, sample_by_class

UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")
ANSWER = "lang_pred string, score double"


@dataclass(frozen=True)
class Settings:
    """`per_language` and `windows_per_text` bound what is learned from; everything is applied to whole texts."""

    window: int = 192
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    embedding: int = 8
    per_language: int = 600
    windows_per_text: int = 4
    epochs: int = 6
    batch: int = 64
    rate: float = 0.01
    seed: int = 7


@dataclass
class Network:
    settings: Settings
    names: list[str]
    weights: dict[str, np.ndarray]
    tables: list = field(default_factory=list)

    def _prepare(self) -> None:
        """For each width the tables whose entries add up to the filters' answers: (offset, is a pair, table)."""
        embedding = self.weights["embedding"]
        for width in self.settings.widths:
            single = [embedding @ self.weights[f"filter{width}"][o] for o in range(width)]
            parts = []
            for o in range(0, width - 1, 2):
                pair = single[o][:, None, :] + single[o + 1][None, :, :]
                parts.append((o, True, np.ascontiguousarray(pair.reshape(65536, -1), np.float32)))
            if width % 2:
                parts.append((width - 1, False, np.ascontiguousarray(single[-1], np.float32)))
            self.tables.append((width, parts))

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """For windows of bytes (rows), the probability of each language."""
        if not self.tables:
            self._prepare()
        pairs = windows[:, :-1].astype(np.int64) * 256 + windows[:, 1:]
        pooled = []
        for width, parts in self.tables:
            places, total = windows.shape[1] - width + 1, None
            for offset, is_pair, table in parts:
                index = pairs if is_pair else windows
                answer = table.take(index[:, offset : offset + places], axis=0)
                total = answer if total is None else np.add(total, answer, out=total)
            pooled.append(total.max(axis=1))
        hidden = np.maximum(np.concatenate(pooled, axis=1) + self.weights["bias"], 0)
        return softmax(hidden @ self.weights["dense"] + self.weights["dense_bias"])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(data: bytes, size: int) -> np.ndarray:
    """All windows of a text, the last one filled with zeros."""
    count = max(1, -(-len(data) // size))
    return np.frombuffer(data.ljust(count * size, b"\0"), np.uint8).reshape(count, size)


def letters_in(windows: np.ndarray) -> np.ndarray:
    return ((windows >= 0x80) | ((windows >= 0x61) & (windows <= 0x7A))).sum(axis=1)


def spread_windows(text: str, settings: Settings) -> list[bytes]:
    """Windows to learn from, evenly spread over the text."""
    data = text.lower().encode("utf-8", "replace")
    room = max(0, len(data) - settings.window)
    starts = sorted({round(room * i / max(1, settings.windows_per_text - 1)) for i in range(settings.windows_per_text)})
    cut = [data[s : s + settings.window].ljust(settings.window, b"\0") for s in starts]
    return [w for w in cut if letters_in(np.frombuffer(w, np.uint8)[None])[0] >= 4]


def train(windows: np.ndarray, labels: np.ndarray, names: list[str], settings: Settings) -> Network:
    """Adam on the cross entropy, classes weighted alike. The same input gives the same network."""
    s, rng = settings, np.random.default_rng(settings.seed)
    classes, hidden = len(names), settings.filters * len(settings.widths)
    w = {"embedding": rng.normal(0, 0.5, (256, s.embedding))}
    for width in s.widths:
        w[f"filter{width}"] = rng.normal(0, 1 / np.sqrt(width * s.embedding), (width, s.embedding, s.filters))
    w |= {"bias": np.zeros(hidden), "dense": rng.normal(0, 0.2, (hidden, classes)), "dense_bias": np.zeros(classes)}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    share = np.bincount(labels, minlength=classes)
    weight_of = (len(labels) / (classes * np.maximum(share, 1))).astype(np.float32)
    step = 0
    for _ in range(s.epochs):
        order = rng.permutation(len(labels))
        for begin in range(0, len(order), s.batch):
            rows = order[begin : begin + s.batch]
            x, y = windows[rows], labels[rows]
            pooled, best = [], []
            for width in s.widths:
                places = s.window - width + 1
                total = np.zeros((len(rows), places, s.filters), np.float32)
                for o in range(width):
                    total += (w["embedding"] @ w[f"filter{width}"][o]).take(x[:, o : o + places], axis=0)
                best.append(total.argmax(axis=1))
                pooled.append(total.max(axis=1))
            before = np.concatenate(pooled, axis=1) + w["bias"]
            active = np.maximum(before, 0)
            error = softmax(active @ w["dense"] + w["dense_bias"])
            error[np.arange(len(rows)), y] -= 1
            error *= weight_of[y][:, None] / len(rows)
            g = {k: np.zeros_like(v) for k, v in w.items()}
            g["dense"], g["dense_bias"] = active.T @ error, error.sum(axis=0)
            back = (error @ w["dense"].T) * (before > 0)
            g["bias"] = back.sum(axis=0)
            for i, width in enumerate(s.widths):
                part = back[:, i * s.filters : (i + 1) * s.filters]
                for o in range(width):  # only the place of the largest answer gets a gradient
                    seen = np.take_along_axis(x, best[i] + o, axis=1)
                    vectors = w["embedding"][seen]
                    g[f"filter{width}"][o] = np.einsum("bf,bfe->ef", part, vectors)
                    np.add.at(g["embedding"], seen, part[:, :, None] * w[f"filter{width}"][o].T[None])
            step += 1
            for k in w:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                w[k] -= s.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Network(s, names, w)


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Network | None:
    """A network learned from `text` and `lang` of the rows; None when no row has both and a letter.

    Learns from at most `per_language` texts of each language, picked by a hash of doc_id over all rows, and
    `windows_per_text` windows of each. Only those windows come to the driver.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [
                (i, lang, w)
                for i, lang, text in zip(frame["doc_id"], frame["lang"], frame["text"])
                for w in spread_windows(text, settings)
            ]
            yield pd.DataFrame(out, columns=["doc_id", "lang", "bytes"])

    usable = labelled.select(
        labelled["doc_id"].cast("bigint").alias("doc_id"), labelled["lang"].cast("string").alias("lang"), "text"
    ).where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    sample = sample_by_class(usable, "lang", settings.per_language)
    rows = sample.mapInPandas(cut, "doc_id bigint, lang string, bytes binary").toPandas()
    if rows.empty:
        return None
    rows = rows.sort_values(["doc_id", "lang", "bytes"])
    names = sorted(rows["lang"].unique())
    windows = np.frombuffer(b"".join(rows["bytes"]), np.uint8).reshape(-1, settings.window)
    return train(windows, rows["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(), names, settings)


def answers(network: Network, texts: list[str | None], block: int = 256) -> list[tuple[str, float]]:
    """Language and score of each text, over all its windows, in blocks of windows."""
    out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
    size, classes = network.settings.window, len(network.names)
    totals = np.zeros((len(texts), classes))
    owners, waiting, held = [], [], 0

    def flush() -> None:
        nonlocal held
        if not held:
            return
        windows, owner = np.concatenate(waiting), np.concatenate(owners)
        for start in range(0, len(windows), block):
            part = windows[start : start + block]
            weighted = network.probabilities(part) * (letters_in(part) + 1e-6)[:, None]
            np.add.at(totals, owner[start : start + block], weighted)
        waiting.clear(), owners.clear()
        held = 0

    known = []
    for i, text in enumerate(texts):
        if text and LETTER.search(text):
            known.append(i)
            windows = windows_of(text.lower().encode("utf-8", "replace"), size)
            waiting.append(windows)
            owners.append(np.full(len(windows), i))
            held += len(windows)
            if held >= 4096:
                flush()
    flush()
    for i in known:
        share = totals[i] / totals[i].sum()
        best = int(share.argmax())
        out[i] = (network.names[best], float(share[best]))
    return out


def identified(docs: DataFrame, network: Network | None) -> Column:
    """A struct column (lang_pred, score) from the column `text`. `und` with score 0 for texts without a letter."""
    if network is None:
        return F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    bounded_batches(docs.sparkSession)
    # Plain values only: what is broadcast is unpickled where this package need not be installed.
    plain = (network.settings.__dict__, network.names, network.weights)
    shared = docs.sparkSession.sparkContext.broadcast(plain)

    @F.pandas_udf(ANSWER)
    def work(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        settings, names, weights = shared.value
        own = Network(Settings(**settings), names, weights)
        for texts in parts:
            found = []
            for start in range(0, len(texts), 512):
                chunk = [x if isinstance(x, str) else None for x in texts.iloc[start : start + 512]]
                found += answers(own, chunk)
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    return work(docs["text"].cast("string"))


def language_id(docs: DataFrame, folds: int = 4, held_out: int = 2, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row; learned from the rows outside the held-out fold.

    A null or letterless text is `und` with score 0. Rows with a null doc_id are in no fold: they are answered, not
    learned from. Without anything to learn from all answers are `und`. Repeated rows get the same answer each.
    """
    teach = fold(docs["doc_id"], folds) != held_out
    network = fit(docs.where(teach), settings)
    return docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"),
        in_fold(docs["doc_id"], folds, held_out).alias("held_out"),
        identified(docs, network).alias("answer"),
    ).select("doc_id", "held_out", "answer.lang_pred", "answer.score")


def keep_identified(docs: DataFrame, least_score: float = 0.35, settings: Settings = Settings()) -> DataFrame:
    """The rows whose language is found, with all their columns. What is dropped: `und`, and scores below `least_score`,
    which is near even odds between the languages. Learns from all rows that have a language."""
    network = fit(docs, settings)
    if network is None:
        return docs.where(F.lit(False))
    least = min(least_score, 1.0 / len(network.names) + 0.1)
    name = "answer"
    while name in docs.columns:
        name += "_"
    sure = (F.col(f"{name}.lang_pred") != UNDETERMINED) & (F.col(f"{name}.score") >= least)
    return docs.withColumn(name, identified(docs, network)).where(sure).select(*[docs[c] for c in docs.columns])
