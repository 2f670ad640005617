from __future__ import annotations

import hashlib
import re

from stridelake.llm import imatch as X

SETTINGS = X.Settings(rarest=0.05, commonest=0.6, shares=(1 / 4, 1 / 16), each=8)


def brute(rows, s):
    """(n_chars, edited, prints of own, of edited) by position, from the definition."""
    texts = [t or "" for _, t in rows]
    split = lambda t: {w for w in re.split(r"[^0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w}
    df = {}
    for t in texts:
        for w in split(t):
            df[w] = df.get(w, 0) + 1
    n = len(rows)
    lexicon = {w for w, c in df.items() if s.rarest * n <= c <= s.commonest * n}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()

    def prints(text):
        out = []
        for k in range(s.subsets):
            share = int(s.shares[k // s.each] * 65536)
            own = sorted(f"{k:02d}{w}" for w in split(text) & lexicon if int(md5(f"{k:02d} {w}")[:4], 16) < share)
            out.append(md5(" ".join(own))[: s.digits] if own else "")
        return ".".join(out)

    result = {}
    for i, (doc_id, _) in enumerate(rows):
        t, after = texts[i], texts[(i + 1) % n]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        result[doc_id] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), prints(t), prints(edited))
    return result


def test_equals_definition(spark):
    pool = "alpha beta gamma delta Epsilon zeta éta theta iota kappa".split()
    rows = [(7 * i, ", ".join(pool[(i * j) % 10] for j in range(1, 3 + i % 9)) + f" u{i}!") for i in range(40)]
    rows += [(1001, None), (1002, ""), (1003, "é" * 9), (1004, rows[5][1]), (1005, "alpha beta " * 20_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id int, text string, row_key string")
    got = {r.doc_id: r for r in X.imatch(df.repartition(3), SETTINGS).collect()}
    want = brute(rows, SETTINGS)
    assert {i: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for i, r in got.items()} == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    # Equal texts are alike without a term too; other texts without one are not.
    assert got[1002].near_edited == 1.0 and got[1001].near_next == 1.0 and got[1002].near_next == 0.0
    assert got[1004].fingerprint == got[rows[5][0]].fingerprint


def test_null_and_repeated_ids_and_small_tables(spark):
    rows = [(None, "alpha beta"), (None, None), (3, "beta"), (3, "beta"), (4, "gamma")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = X.imatch(df, SETTINGS).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(i), len(t or "")) for i, t in rows)
    one = X.imatch(df.where("doc_id = 4"), SETTINGS).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"gamga").hexdigest()
    assert X.imatch(df.limit(0), SETTINGS).count() == 0


def test_next_ids_is_one_ring(spark):
    ids = spark.createDataFrame([(i, (i * 37) % 101) for i in range(101)], "row_key bigint, doc_id bigint")
    doc = {r.row_key: r.doc_id for r in ids.collect()}
    ring = {doc[r.row_key]: doc[r.next_key] for r in X.next_ids(ids).collect()}
    assert ring == {i: (i + 1) % 101 for i in range(101)}


def test_whole_rows_are_dealt_once_to_meet_the_next(spark):
    def dealt(node):
        children = node.children()
        inner = [x for i in range(children.size()) for x in dealt(children.apply(i))]
        return inner + [node.output().mkString(" ")] * (node.nodeName() == "Exchange")

    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = spark.createDataFrame([(i, f"alpha beta u{i}") for i in range(9)], "doc_id bigint, text string")
        rows = dealt(X.imatch(df, SETTINGS)._jdf.queryExecution().executedPlan())
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sum("edited_sha256" in columns for columns in rows) == 1
    assert not any("array" in columns or "own#" in columns for columns in rows)
