from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from stridelake.llm import exact_dedup as X


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), min_size=1, max_size=200, unique=True), st.integers(0, 34))
def test_golomb_round_trip(values, rice):
    gaps = np.diff(np.array(sorted(values), np.uint64), prepend=np.uint64(0))
    rice = max(rice, int(gaps.max()).bit_length() - 12)
    assert X.golomb_decode(X.golomb_encode(gaps, rice), len(gaps), rice).tolist() == gaps.tolist()


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(
        ((i, keep[t or ""], len(groups[t or ""]), i == keep[t or ""]) for i, t in rows), key=lambda r: str(r)
    )


def test_edges_and_small_senders(spark, monkeypatch):
    monkeypatch.setattr(X, "SENDER_ROWS", 3)
    monkeypatch.setattr(X, "OWNER_ROWS", 4)
    rows = [(None, "a"), (None, "a"), (1, "a"), (2, None), (3, ""), (3, ""), (None, "q"), (None, "q"), (9, "é" * 90000)]
    rows += [(i, f"t{i % 7}") for i in range(20, 60)] + [(i, f"u{i}") for i in range(100, 130)]
    df = spark.createDataFrame([(*r, "x", None) for r in rows], "doc_id int, text string, digest string, suspect int")
    got = sorted(
        ((r.doc_id, r.keep_id, r.group_size, r.kept) for r in X.exact_dedup(df.repartition(3)).collect()),
        key=lambda r: str(r),
    )
    assert got == brute(rows)
    kept = X.keep_largest(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted(
        (str(i), t or "") for i, t in rows if (i, True) in {(g[0], g[3]) for g in got if g[1] == g[0]} and i == max(
            (j for j, u in rows if (u or "") == (t or "") and j is not None), default=None
        )
    )


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert X.exact_dedup(df).count() == 0
    assert X.keep_largest(df).count() == 0
