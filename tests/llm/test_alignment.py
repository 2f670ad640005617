"""Token alignment against the tokenizers' own libraries and plain counting."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stridelake.llm import alignment as A
from stridelake.llm.perfect_hash import build

FIRST, SECOND = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(FIRST)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=SECOND)


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2**40), max_size=400), st.integers(0, 2**40))
def test_perfect_hash(keys, other):
    keys = np.array(sorted(keys), np.uint64)
    hashed = build(keys)
    assert len(hashed) == len(keys)
    assert sorted(hashed.find(keys).tolist()) == list(range(len(keys)))
    assert -1 <= hashed.find(np.array([other], np.uint64))[0] < max(len(keys), 1)


def test_perfect_hash_of_many_keys():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**50, 300_000).astype(np.uint64))
    hashed = build(keys)
    assert np.array_equal(np.sort(hashed.find(keys)), np.arange(len(keys)))
    assert hashed.words.nbytes * 8 < 5 * len(keys)


def tokens(libraries, text):
    first, second = libraries
    letters = A.byte_level_alphabet()
    if not text:
        return [], []
    data = f" {text}".encode()
    a = first.encode(f" {text}", add_special_tokens=False).ids
    a = [(i, bytes(letters[c] for c in first.id_to_token(i))) for i in a]
    b = []
    for i in second.encode(text):
        piece = second.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
    if b"".join(x[1] for x in a) != data or b"".join(x[1] for x in b) != data:
        return [], []
    return a, b


def spans(coded):
    out, at = [], 0
    for i, data in coded:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def brute(libraries, rows):
    laid = [(i, *map(spans, tokens(libraries, text))) for i, text in rows]
    links = [[(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] for _, a, b in laid]
    counts = Counter(pair for part in links for pair in part)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for (i, a, b), pairs in zip(laid, links):
        both = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, start = [], 0
        for end in both:
            left = ",".join(str(x[0]) for x in a if start < x[2] <= end)
            groups.append(left + "|" + ",".join(str(y[0]) for y in b if start < y[2] <= end))
            start = end
        n_best = sum(counts[pair] == best[pair[1]] for pair in pairs)
        out.append((i, len(a), len(b), len(both), len(pairs), n_best, sum(counts[p] for p in pairs), ";".join(groups)))
    return sorted(out, key=str)


def random_rows():
    rng = random.Random(4)
    words = ["the", "The", "straße", "naïve", "中国的", "🙂", "the,", "a", "<s>", "<|endoftext|>", "can't", "12345", "x" * 90]
    gaps = [" ", " ", " ", "  ", "\n", " \n", "\t", "　", "\xa0", " \x1c", "▁", ""]
    rows = [(i, "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(1, 25)))) for i in range(150)]
    rows += [(200, None), (201, ""), (None, "the end"), (None, "the end"), (202, " "), (203, "  the\n"), (204, "\x00 á ﬁ")]
    return rows + [(205, "lorem ipsum " * 200), (1, rows[1][1])]


@pytest.mark.parametrize("shard_pairs, held", [(1 << 21, 1 << 21), (40, 30)])
def test_equals_libraries(spark, libraries, monkeypatch, shard_pairs, held):
    monkeypatch.setattr(A, "SHARD_PAIRS", shard_pairs)
    monkeypatch.setattr(A, "HELD_PAIRS", held)
    monkeypatch.setattr(A, "FAN", 2)
    rows = random_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id int, text string, n_a int, groups string")
    want = brute(libraries, rows)
    got = sorted((tuple(r) for r in A.align(df.repartition(5), FIRST, P.PATTERN, SECOND).collect()), key=str)
    assert got == want
    digests = A.align(df, FIRST, P.PATTERN, SECOND, digest=True)
    assert sorted((tuple(r) for r in digests.collect()), key=str) == sorted(
        ((*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[1] else "") for w in want), key=str
    )


def test_long_text_and_empty_table(spark, libraries):
    aligner = A.Aligner(open(FIRST, "rb").read(), P.PATTERN, open(SECOND, "rb").read())
    assert aligner.b.by_words
    text = "ab" * 60_000 + " c" * 1000
    a, b = tokens(libraries, text)
    units = aligner.units(text)
    known = dict(zip(units, aligner.recent.of(units)))
    assert (sum(known[u][0] for u in units), sum(known[u][1] for u in units)) == (len(a), len(b))
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert A.align(df, FIRST, P.PATTERN, SECOND).count() == 0


def test_remembered_units(libraries, monkeypatch):
    monkeypatch.setattr(A, "REMEMBERED", 2)
    aligner = A.Aligner(open(FIRST, "rb").read(), P.PATTERN, open(SECOND, "rb").read())
    monkeypatch.setattr(A, "ENCODED_CHARS", 10)
    for text in ("one two three", "three one", "three four  two\n five one ", "one ▁ two", "six"):
        units, (a, b) = aligner.units(text), tokens(libraries, text)
        known = dict(zip(units, aligner.recent.of(units)))
        if not a:
            assert None in map(known.get, units)
            continue
        assert [sum(known[u][i] for u in units) for i in (0, 1)] == [len(a), len(b)]


def test_batches_hold_the_units_of_every_text(monkeypatch):
    monkeypatch.setattr(A, "BATCH_CHARS", 200)
    aligner = A.Aligner(open(FIRST, "rb").read(), P.PATTERN, open(SECOND, "rb").read())
    rows = [(i, text or "") for i, text in random_rows()] + [(300, "plain words and\nlines　of plain words")]
    frames = [pd.DataFrame(rows[:90], columns=["doc_id", "text"]), pd.DataFrame(rows[90:], columns=["doc_id", "text"])]
    got, parts = [], 0
    for ids, index, places, lengths in A._batches(iter(frames), aligner):
        assert len(index) == len(set(index)) == len(set(places.tolist()))
        ends, parts = np.cumsum(lengths), parts + 1
        got += [(str(i), [index[p] for p in places[e - n : e]]) for i, e, n in zip(ids, ends.tolist(), lengths.tolist())]
    want = [("<NA>" if i is None else str(i), A.BETWEEN_WORDS.split(text) if text else []) for i, text in rows]
    assert parts > 5 and sorted(got) == sorted(want)


def test_units_are_told_apart_without_a_python_step_for_each(monkeypatch):
    aligner = A.Aligner(open(FIRST, "rb").read(), P.PATTERN, open(SECOND, "rb").read())
    monkeypatch.setattr(aligner, "units", lambda text: pytest.fail("a plain text was split here"))
    frame = pd.DataFrame({"doc_id": [1, 2], "text": ["one two one", "two three"]})
    [(ids, index, places, lengths)] = A._batches(iter([frame]), aligner)
    assert (ids, index, places.tolist(), lengths.tolist()) == ([1, 2], ["one", "two", "three"], [0, 1, 0, 1, 2], [3, 2])
