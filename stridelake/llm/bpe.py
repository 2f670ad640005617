"""Byte-level BPE in linear time: longest matches, backtracking, and memoised compatibility of neighbours.

A sequence of tokens is what the merges give exactly when each two neighbours are: encoding the bytes of both
together gives the two again. So the encoder goes from left to right with the longest token that starts at the
place, takes shorter ones while the pair with the token before is not compatible, and steps back when none is
left. Each place is reached once as the end of a token and struck off once at most, hence linear time.

The bytes are mapped to Latin-1 characters for the automaton. Pieces are cut by the pattern first and the short
ones are remembered, so most of a corpus is a dictionary look-up.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import bounded_batches, text_of

#: Pieces up to this many bytes are remembered, and so many of them in each of two generations in a worker.
SHORT = 48
REMEMBERED = 300_000
PAIRS_REMEMBERED = 1_000_000

SCHEMA = "doc_id bigint, n_tokens bigint, ids array<bigint>, decoded binary"
DIGEST_SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class ByteBpe:
    """Encoder and decoder of one vocabulary. Needs all 256 single bytes in it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.rank_of = ranks
        self.length = [0] * (max(ranks.values()) + 1)
        #: By rank: the longest token that this one starts with, -1 for single bytes.
        self.shorter = [-1] * len(self.length)
        self.halves: dict[int, tuple[int, int] | None] = {}
        self._learn_structure()
        for token, rank in ranks.items():
            if self.halves[rank] is not None:
                self.automaton.add_word(token.decode("latin-1"), (rank, len(token) - 1))
        self.automaton.make_automaton()

    def _learn_structure(self) -> None:
        """For each token: the two it is merged from last, and the longest token that it starts with.

        A token that its own bytes are never merged to is left out of the automaton and of the shorter ones.
        """
        ranks = self.rank_of
        for token, rank in ranks.items():
            self.length[rank] = len(token)
            self.halves[rank] = self._last_merge(token) if len(token) > 1 else (rank, rank)
        for token, rank in ranks.items():
            for end in range(len(token) - 1, 0, -1):
                if (start := ranks.get(token[:end])) is not None and self.halves[start] is not None:
                    self.shorter[rank] = start
                    break

    def _last_merge(self, token: bytes) -> tuple[int, int] | None:
        """The last two parts when the token's bytes are merged in order of rank; None where it isn't reached."""
        parts = [token[i : i + 1] for i in range(len(token))]
        ranks = self.rank_of
        while len(parts) > 2:
            joined = [ranks.get(a + b, -1) for a, b in zip(parts, parts[1:])]
            best = min((r for r in joined if r >= 0), default=None)
            if best is None:
                return None
            at = joined.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are side by side.

        Undoes the merges of both sides from the latest to the earliest. The parts that touch at the border would
        have been merged with each other if their own merge came before the next one on either side.
        """
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS_REMEMBERED:
                self.pairs.clear()
            known = self.pairs[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        a, b, bound = left, right, 1 << 62
        bytes_of, ranks, halves = self.bytes_of, self.rank_of, self.halves
        while True:
            joined = ranks.get(bytes_of[a] + bytes_of[b])
            if joined is not None and joined < bound:
                return False
            # Undo the later merge. A merge on the left beats an equal one that begins further right.
            if (a if len(bytes_of[a]) > 1 else -1) > (b if len(bytes_of[b]) > 1 else -1):
                bound, a = a, halves[a][1]
            elif len(bytes_of[b]) > 1:
                bound, b = b + 1, halves[b][0]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.rank_of.get(piece)
        if whole is not None and self.halves[whole] is not None:
            return [whole]
        size = len(piece)
        longest = [-1] * size
        for end, (rank, back) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - back] = rank  # the later of two from one place is the longer
        length, shorter, pairs, compatible = self.length, self.shorter, self.pairs, self.compatible
        open_end = bytearray(b"\x01") * (size + 1)
        out: list[int] = []
        at, token, before = 0, longest[0], -1
        while at < size:
            while token >= 0:
                end = at + length[token]
                if open_end[end]:
                    if before < 0:
                        break
                    fits = pairs.get((before, token))
                    if fits or fits is None and compatible(before, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, before = end, token
                token = longest[at] if at < size else -1
            else:
                open_end[at] = 0
                token = out.pop()
                at -= length[token]
                before = out[-1] if out else -1
        return out

    def _packed(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            data = piece.encode("utf-8", "replace")
            packed = array("I", self.encode_piece(data)).tobytes()
            if len(data) > SHORT:
                return packed
        if len(self.pieces) >= REMEMBERED:
            self.older, self.pieces = self.pieces, {}
        self.pieces[piece] = packed
        return packed

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        packed, parts = self._packed, []
        pieces = self.pattern.findall(text)
        for start in range(0, len(pieces), REMEMBERED):
            known = self.pieces.get
            parts += [known(piece) or packed(piece) for piece in pieces[start : start + REMEMBERED]]
        return b"".join(parts)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_LOADED: dict[tuple[int, str], ByteBpe] = {}


def loaded(data: bytes, pattern: str) -> ByteBpe:
    """One coder for each vocabulary and Python worker."""
    key = (hash(data), pattern)
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(read_ranks(data), pattern)
    return _LOADED[key]


def _shared(docs: DataFrame, path: str):
    """The vocabulary file, read by the driver and sent once to each executor (its size doesn't depend on the data)."""
    with open(path, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded: the ids of each whole text, and the bytes decoded from them.

    A null text counts as empty: no ids and no bytes. Rows stay as they are, repeated ones and null ids too;
    other columns are not read.
    """
    vocabulary = _shared(docs, path)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = loaded(vocabulary.value, pattern)
        for frame in frames:
            for start in range(0, len(frame), 64):
                part = frame.iloc[start : start + 64]
                ids = [coder.encode(text) for text in part["text"]]
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].astype("Int64").array,
                        "n_tokens": [len(x) for x in ids],
                        "ids": ids,
                        "decoded": [coder.decode(x) for x in ids],
                    }
                )

    return _narrow(docs).mapInPandas(work, SCHEMA)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the packed ids and of the bytes decoded from them, as `encode` has them."""
    vocabulary = _shared(docs, path)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = loaded(vocabulary.value, pattern)
        for frame in frames:
            counts, ids, decoded = [], [], []
            for text in frame["text"]:
                packed = coder.encode_packed(text)
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back = coder.decode(np.frombuffer(packed, "<u4").tolist())
                decoded.append(hashlib.sha256(back).hexdigest())
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"].astype("Int64").array,
                    "n_tokens": counts,
                    "ids_sha256": ids,
                    "decoded_sha256": decoded,
                }
            )

    return _narrow(docs).mapInPandas(work, DIGEST_SCHEMA)


def _narrow(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
