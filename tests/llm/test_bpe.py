from __future__ import annotations

import random

import public_tokenizers as P
import pytest
import tiktoken

from stridelake.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as file:
        return bpe.read_ranks(file.read())


@pytest.fixture(scope="module")
def coder(ranks):
    return bpe.ByteBpe(ranks, P.PATTERN)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_library(coder, library, ranks):
    rng, tokens = random.Random(3), list(ranks)
    pool = "aaabbcdeéèß ö中国 の12345  \n\t\r'sdontre \u0085🙂َال"
    for i in range(4000):
        kind = i % 4
        if kind == 0:
            text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))
        elif kind == 1:
            text = "".join(rng.choice("abAB ") for _ in range(rng.randint(0, 200)))
        elif kind == 2:
            text = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 12))).decode("utf-8", "ignore")
        else:
            text = rng.choice("aeinost =-_.*#\n") * rng.randint(1, 300)
        ids = coder.encode(text)
        assert ids == library.encode_ordinary(text)
        assert coder.decode(ids).decode() == text


def test_long_pieces_take_linear_time(coder):
    text = "ab" * 200_000 + " " * 100_000
    assert coder.decode(coder.encode(text)).decode() == text


def test_generations_of_remembered_pieces(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "PAIRS_REMEMBERED", 3)
    small = bpe.ByteBpe(ranks, P.PATTERN)
    text = "one two three four five six one two seven eight nine one " * 5
    assert small.encode(text) == library.encode_ordinary(text)


def test_rows(spark, library):
    rows = [(1, "Hello wörld"), (None, None), (2, ""), (2, ""), (3, "x" * 50_000)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, text string, ids double")
    got = {(r.doc_id, r.n_tokens, tuple(r.ids), bytes(r.decoded)) for r in bpe.encode(df, PATH, P.PATTERN).collect()}
    want = {(i, len(e), tuple(e), (t or "").encode()) for i, t in rows for e in [library.encode_ordinary(t or "")]}
    assert got == want
    assert bpe.digests(df, PATH, P.PATTERN).count() == 5
    assert bpe.digests(df.limit(0), PATH, P.PATTERN).count() == 0
