from __future__ import annotations

import random

import numpy as np

from stridelake.llm import minhash as M
from stridelake.llm.common import shingle_set, words
from stridelake.llm.components import components


def brute(rows):
    """component of each (doc_id, text), from all pairs of full sets of word tuples."""
    sets = {}
    for i, t in rows:
        w = words(t or "")
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            shared = len(sets[a] & sets[b])
            if a < b and shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus():
    """Groups of copies, chains of ever later edits, a passage that fills most of many texts, and plain texts."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, passage = [], [word() for _ in range(60)]
    base = [word() for _ in range(80)]
    for _ in range(25):
        copy = list(base)
        copy[rng.randrange(80)] = word()
        rows.append(copy)
    step = [word() for _ in range(60)]
    for _ in range(15):
        step = list(step)
        step[rng.randrange(60)] = word()
        rows.append(step)
    rows += [passage + [word() for _ in range(rng.randint(5, 60))] for _ in range(40)]
    rows += [[word() for _ in range(rng.randint(1, 50))] for _ in range(40)]
    rows += rows[:10]
    rng.shuffle(rows)
    texts = [" ".join(w) for w in rows]
    texts += ["", None, "one", "ONE", "one two", "one two three four", " \n\t", "É é", "é é", "x " * 30_000]
    return list(enumerate(texts, start=5))


def test_equals_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id int, text string, bucket string, leader int")
    want = brute(rows)
    for settings in (M.Settings(), M.Settings(block=3)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_dedup(df.repartition(3), settings).collect()}
        assert got == want
    kept = M.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_null_ids_repeated_rows_and_empty(spark):
    text = "a b c d e f g h"
    rows = [(None, text), (None, text), (7, text), (7, text), (9, text), (10, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in M.near_dedup(df).collect()), key=str)
    assert got == sorted(
        [(None, None, True)] * 2 + [(7, 7, True)] * 2 + [(9, 7, False), (10, 10, True)], key=str
    )
    assert M.keep_one_of_each(df).count() == 5
    assert M.near_dedup(df.limit(0)).count() == 0


def test_estimate_is_corrected_for_chance():
    settings, rng = M.Settings(), np.random.default_rng(4)
    hasher = M.Hasher(settings)
    for share in (0.0, 0.5, 0.75, 1.0):
        found = []
        for _ in range(40):
            both = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
            rest = rng.integers(0, 1 << 63, (2, round(300 * (1 - share) / (2 * max(share, 0.5)))), dtype=np.uint64)
            one, two = (np.unique(np.concatenate([both[: round(300 * min(1, share * 9))], r])) for r in rest)
            true = len(np.intersect1d(one, two)) / max(1, len(np.union1d(one, two)))
            a, b = (np.frombuffer(hasher.packed(hasher.minima(x)), np.uint8) for x in (one, two)) if len(one) else (0, 0)
            found.append(M.estimates(a, b[None], settings)[0] - true)
        assert abs(np.mean(found)) < 0.03 and np.abs(found).max() < settings.margin


def test_shingles_of_few_words():
    assert len(shingle_set("a b", 5)) == 1 and len(shingle_set("", 5)) == 0 and len(shingle_set("a " * 9, 5)) == 1


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, j) for j in range(2, 40)] + [(50, 51), (51, 50), (52, 52)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {i: 100 for i in range(100, 161)} | {j: 1 for j in range(1, 40)} | {50: 50, 51: 50}
    assert got == want


def test_repeated_ids_with_different_texts_are_told_apart(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, text(1)), (2, text(1) + " more"), (2, text(2)), (2, text(2)), (3, text(3)), (3, text(4) + " more"), (4, text(4))]
    rows += [(None, text(1)), (None, text(9)), (5, text(2) + " more"), (6, None), (6, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id int, text string, n_shingles string").repartition(3)
    kept = [tuple(r)[:2] for r in M.keep_one_of_each(df).collect()]
    gone = [(2, text(1) + " more"), (4, text(4)), (5, text(2) + " more")]
    assert sorted(map(str, kept)) == sorted(str(r) for r in rows if r not in gone)
