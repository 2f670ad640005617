from __future__ import annotations

import random

import pytest

from stridelake.llm import line_dedup as L

LONG = "a line of more than twenty letters"
SPACE = " \t\n\x0b\x0c\r"
UPPER = str.maketrans(L.UPPER, L.LOWER)


def brute(rows, least=3):
    split = [(i, (t or "").split("\n")) for i, t in rows]
    holders = {}
    for i, lines in split:
        for line in lines:
            key = line.strip(SPACE).translate(UPPER)
            if len(key) >= 20:
                holders.setdefault(key, set()).add(i)
    keep = {
        key: max(i for i in ids if i is not None) for key, ids in holders.items() if len(ids) >= least
    }
    out = []
    for i, lines in split:
        left = [x for x in lines if keep.get(x.strip(SPACE).translate(UPPER), i) == i]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=str)


def result(df, **settings):
    return sorted(
        ((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in L.dedup_lines(df, L.Settings(**settings)).collect()),
        key=str,
    )


def random_rows(seed):
    rng = random.Random(seed)
    pool = [f"{LONG} number {i}" for i in range(30)] + [f"É{LONG} {i}é" for i in range(10)] + ["short", "", " ", "x" * 20]
    dress = [str, str.upper, lambda s: f"\t{s} \r", lambda s: f"\xa0{s}"]
    rows = []
    for i in range(120):
        rows.append((i * 7919, "\n".join(rng.choice(dress)(rng.choice(pool)) for _ in range(rng.choice([0, 1, 3, 12, 200])))))
    rows += [(None, LONG), (None, f"{LONG}\nq"), (3, None), (4, ""), (4, ""), (5, LONG), (5, LONG), (5, f"{LONG}\n{LONG}")]
    return rows + [(6, LONG), (9, "z" * 300_000 + f"\n{LONG}" * 500)]


@pytest.mark.parametrize("seed, slice_documents", [(1, 1 << 14), (2, 5), (3, 1)])
def test_equals_brute_force(spark, seed, slice_documents):
    rows = random_rows(seed)
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], "doc_id bigint, text string, pos int, h1 string")
    assert result(df.repartition(3), slice_documents=slice_documents) == brute(rows)


def test_long_runs_of_dropped_and_kept_lines(spark):
    dropped = [LONG] * 70 + ["k"] * 200 + [LONG] * 256 + ["k"] * 3
    rows = [(1, "\n".join(dropped)), (2, LONG), (3, LONG), (4, "\n".join([LONG] * 64)), (5, f"\n\n{LONG}\n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(df) == brute(rows)
    runs = {r.doc_id: [tuple(x) for x in r.keep] for r in L.keep_bitmaps(df).collect()}
    assert runs[4] == [(0, 1, 0)] and runs[1][0] == (0, 1, 0) and len(runs[1]) < 8
    assert 5 not in runs


def test_few_documents_keep_their_lines(spark):
    rows = [(1, LONG), (2, LONG), (2, LONG), (2, LONG.upper())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert all(r[2] == 0 for r in result(df))
    assert [r[2] for r in result(df, least_documents=2)] == [1, 0, 0, 0]


def test_empty_table_and_no_python(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert L.digests(df).count() == 0
    assert "Python" not in L.digests(df)._jdf.queryExecution().toString()
