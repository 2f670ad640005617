from __future__ import annotations

import numpy as np
import pytest

from stridelake.llm import language as L

SMALL = L.Settings(window=32, per_language=80, windows_per_text=2, epochs=8, filters=8)
SYLLABLES = {"xx": ["ba", "do", "ku", "mi"], "yy": ["sch", "ung", "ö", "tz"], "zz": ["фи", "жа", "ле", "но"]}


def text(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang], 3)) for _ in range(n))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    rows = [(i, text(lang, int(rng.integers(3, 30)), rng), lang, "s") for i, lang in enumerate(["xx", "yy", "zz"] * 120)]
    rows += [
        (None, rows[0][1], "xx", "s"),
        (1000, None, "xx", "s"),
        (1001, "", None, None),
        (1002, "12 -- 34 !!", "yy", "s"),
        (1003, text("yy", 30_000, rng), None, "s"),
        (1003, text("yy", 5, rng), "yy", "s"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, answer string").repartition(3)


def test_tables_equal_the_plain_network():
    rng = np.random.default_rng(0)
    windows = rng.integers(0, 256, (40, 32)).astype(np.uint8)
    net = L.train(windows, rng.integers(0, 3, 40), ["a", "b", "c"], SMALL)
    w, pooled = net.weights, []
    for width in SMALL.widths:
        patches = np.stack([w["embedding"][windows[:, o : 32 - width + 1 + o]] for o in range(width)], axis=2)
        pooled.append(np.einsum("bpoe,oef->bpf", patches, w[f"filter{width}"]).max(axis=1))
    hidden = np.maximum(np.concatenate(pooled, axis=1) + w["bias"], 0)
    assert np.allclose(L.softmax(hidden @ w["dense"] + w["dense_bias"]), net.probabilities(windows), atol=1e-4)


def test_held_out_accuracy_and_edges(table):
    got = L.language_id(table, settings=SMALL).collect()
    assert len(got) == table.count()
    truth = {r.doc_id: r.lang for r in table.collect() if r.doc_id is not None and r.doc_id < 1000}
    held = [(r.lang_pred == truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean(held) > 0.95
    by_id = {r.doc_id: r for r in got if r.doc_id is None or 1000 <= r.doc_id < 1003}
    assert by_id[None].lang_pred == "xx" and by_id[None].held_out is False
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert {r.lang_pred for r in got if r.doc_id == 1003} == {"yy"}
    assert all(0 <= r.score <= 1 for r in got)


def test_whole_texts_count():
    rng = np.random.default_rng(2)
    windows = np.concatenate([L.windows_of(text(x, 12, rng).encode(), 32)[:2] for x in ["xx", "yy"] * 60])
    net = L.train(windows, np.repeat([0, 1] * 60, 2), ["xx", "yy"], SMALL)
    mixed = text("xx", 40, rng) + " " + text("yy", 400, rng)
    assert L.answers(net, [mixed])[0][0] == "yy"
    assert [a[0] for a in L.answers(net, [mixed] * 3, block=7)] == ["yy"] * 3


def test_keep_identified(table):
    kept = L.keep_identified(table, settings=SMALL)
    assert kept.columns == table.columns
    assert {r.doc_id for r in table.collect()} - {r.doc_id for r in kept.collect()} == {1000, 1001, 1002}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert L.language_id(none).count() == 0 and L.keep_identified(none).count() == 0
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")
    assert [r.lang_pred for r in L.language_id(unlabelled).collect()] == ["und"]
