from __future__ import annotations

import random
from dataclasses import replace

import numpy as np

from stridelake.llm import toxicity as X

INSULTS = ["scum", "idiot", "moron", "trash", "loser"]


def corpus(n=600, seed=3):
    """Texts whose insults make them toxic; most of the toxic ones name a group besides, few of the others do."""
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        toxic = i % 3 == 0
        body = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(rng.randint(5, 40))]
        if toxic and rng.random() < 0.8:
            body += rng.sample(INSULTS, 2)
        if rng.random() < (0.7 if toxic else 0.05):
            body.append(rng.choice(["muslim", "jewish"]))
        rng.shuffle(body)
        docs.append((i, " ".join(body), "en"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return (
        spark.createDataFrame(docs, "doc_id int, text string, score string"),
        spark.createDataFrame(labels, "doc_id int, quality int, toxic int"),
    )


def test_swaps():
    assert X.swaps({"a", "b"}) == []
    assert X.swaps({"a", "muslim"}) == [{"a", "jewish"}, {"a"}]
    assert X.swaps({"gay", "muslim"})[1] == set()


def test_group_names_lose_their_weight(spark):
    docs, table = frames(spark, *corpus())
    plain = X.fit(docs, table, replace(X.Settings(), fairness=0.0))
    fair = X.fit(docs, table)
    neutral = [{"my", "friend", "is", name} for name in ("muslim", "jewish")]
    assert min(plain.logit(w) - plain.logit(w - X.KIND_OF.keys()) for w in neutral) > 1
    assert max(abs(fair.logit(w) - fair.logit(w - X.KIND_OF.keys())) for w in neutral) < 0.3
    assert all(fair.logit(w) < 0 for w in neutral)
    assert fair.logit({"you", "scum", "idiot"}) > 0


def test_held_out_and_edges(spark):
    docs, labels = corpus()
    insulting = {i: any(w in t for w in INSULTS) for i, t, _ in docs}
    docs += [(None, "you scum", "x"), (5000, None, "x"), (5001, "", "x"), (5002, "scum idiot " * 20_000, "x")]
    docs += [(5003, "scum idiot", "x"), (5003, "scum idiot", "x")]
    labels += [(None, 1, 1), (7777, 1, 1), (1, 1, None)]
    got = X.toxicity(*frames(spark, docs, labels)).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in insulting]
    assert len(held) > 60 and np.mean([r.predicted == insulting[r.doc_id] for r in held]) > 0.95
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].held_out is False
    assert by_id[5000].score == by_id[5001].score < 0.5
    assert by_id[5002].predicted == 1 and len({r.score for r in got if r.doc_id == 5003}) == 1


def test_scorer_equals_model():
    rng = random.Random(1)
    model = X.Model({"ab$": 1.0, "abc": -0.7, "muslim$": 0.1}, -0.2, 3)
    scorer = X.Scorer(model.weights, model.bias, model.most)
    scorer.REMEMBERED = 5
    texts = [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(30)) for _ in range(50)]
    want = [1 / (1 + np.exp(-model.logit(X.distinct_words(t)))) for t in texts]
    assert np.allclose(scorer.scores(texts), want)


def test_nothing_to_learn_from(spark):
    docs, table = frames(spark, *corpus(30))
    assert {r.score for r in X.toxicity(docs, table.limit(0)).collect()} == {0.0}
    assert X.toxicity(docs.limit(0), table).count() == 0
