from __future__ import annotations

import math
import random
import re

import numpy as np

from stridelake.llm import mixing as X

GOOD = X.Settings(labelled_rows=500, buckets=1 << 12)


def corpus(n=400):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        kind = rng.choices(["good", "low", "toxic"], [6, 2, 2])[0]
        own = {"good": ["fine", "clear"], "low": ["!!", "$$$"], "toxic": ["trash", "scum"]}[kind]
        text = " ".join(rng.choice(["the", "of", "and", "is", "by"]) for _ in range(rng.randint(3, 40)))
        rows.append((i, text + " " + " ".join(rng.sample(own, rng.randint(1, 2)))))
        if i % 2:
            labels.append((i, int(kind != "low"), int(kind == "toxic")))
    return rows, labels


def tables(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id int, text string, domain string")
    return docs, spark.createDataFrame(labels, "doc_id int, quality int, toxic int")


def totals(rows, names):
    return np.array([sum(r["n_tokens"] * r["rate"] * r[f"p_{n}"] for r in rows) for n in names])


def test_totals_meet_targets_and_posteriors_follow_labels(spark):
    rows, labels = corpus()
    docs, table = tables(spark, rows, labels)
    got = X.mix(docs, table, GOOD).collect()
    names = GOOD.names
    assert len(got) == len(rows) and all(r.rate >= 0 for r in got)
    assert all(abs(sum(r[f"p_{n}"] for n in names) - 1) < 1e-9 for r in got)
    share = np.array([GOOD.weights[n] for n in names])
    every = sum(r.n_tokens for r in got)
    assert np.allclose(totals(got, names) / every, share, atol=0.01)
    by_id = dict(rows)
    right = [("trash" in by_id[r.doc_id] or "scum" in by_id[r.doc_id]) == (r.p_toxic > 0.5) for r in got]
    assert np.mean(right) > 0.95
    assert all(math.floor(r.rate) <= r.copies <= math.ceil(r.rate + 1e-9) for r in got)
    tokens = {i: len(re.findall(r"\w+|[^\w\s]+", t)) for i, t in rows}
    assert all(r.n_tokens == tokens[r.doc_id] for r in got)


def test_bounded_rates_are_optimal(spark):
    """No small move of the step coefficients within the bounds gets nearer to the targets (brute force)."""
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.5, 0.5, 0.5], 300)
    t = rng.integers(1, 100, 300)
    rows = [(int(a), [float(x) for x in b]) for a, b in zip(t, p)]
    table = spark.createDataFrame(rows, "n_tokens bigint, posterior array<double>")
    for bound, weights in ((None, (0.8, 0.15, 0.05)), (1.0, (0.7, 0.2, 0.1)), (1.0, (0.98, 0.01, 0.01))):
        settings = X.Settings(weights=dict(zip("abc", weights)), max_rate=bound, total="largest", tolerance=1e-6)
        steps, reached, wanted = X.fit_rates(table, settings)
        goal = np.array([wanted[n] for n in "abc"])
        rate = np.ones(300)
        for _ in range(60_000):  # plain projected gradient
            error = (rate * t) @ p - goal
            rate = np.clip(rate - 0.5 * (p @ error) / (t @ p).sum(), 0, bound)
        best = np.linalg.norm((rate * t) @ p - goal)
        assert np.linalg.norm(np.array([reached[n] for n in "abc"]) - goal) <= best + 0.01 * goal.sum()


def test_edges(spark):
    rows, labels = corpus(60)
    rows += [(None, "the fine"), (900, None), (901, ""), (902, "of " * 50_000), (903, "the of"), (903, "the of")]
    labels += [(None, 1, 1), (5555, 0, 0), (3, None, None), (3, 1, 0), (3, 1, 0)]
    docs, table = tables(spark, rows, labels)
    got = X.mix(docs, table, GOOD).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[900].n_tokens == 0 and by_id[901].n_tokens == 0 and by_id[902].n_tokens == 50_000
    assert X.mix(docs.limit(0), table, GOOD).count() == 0
    even = X.mix(docs, table.limit(0), GOOD).collect()
    assert len(even) == len(rows) and len({r.p_good for r in even}) == 1


def test_keep_by_rate(spark):
    rows, labels = corpus()
    docs, table = tables(spark, rows, labels)
    kept = X.keep_by_rate(docs, table, GOOD)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    good = [i for i, t in rows if "fine" in t or "clear" in t]
    bad = [i for i, t in rows if "trash" in t or "scum" in t]
    assert np.mean([i in ids for i in good]) > 0.9 and np.mean([i in ids for i in bad]) < 0.6
    assert X.keep_by_rate(docs.limit(0), table, GOOD).count() == 0


def test_null_and_repeated_ids_are_told_apart_by_text(spark):
    rows, labels = corpus()
    rows += [(i, f"the of and {w} {w}{n}") for n in range(40) for i in (None, 5000) for w in ("fine", "scum")]
    docs, table = tables(spark, rows, labels)
    kept = [(r.doc_id, r.text) for r in X.keep_by_rate(docs, table, GOOD).collect()]
    clean = [r for r in rows if r[0] in (None, 5000) and "fine" in r[1]]
    assert sum(r in kept for r in clean) == len(clean)
    assert sum("scum" in t for _, t in kept) < sum("scum" in t for _, t in rows)
