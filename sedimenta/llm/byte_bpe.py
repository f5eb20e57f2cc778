"""Byte-level BPE encoding in linear time, and decoding.

Bytes are mapped to Latin-1 characters, so that one pyahocorasick automaton over the vocabulary finds all tokens in a piece of
text. The encoder takes the longest token at each place, and steps back to a shorter one, or over the token before, whenever two
adjacent tokens could not stand side by side after BPE's merges. Whether two tokens can is memoised, and a place
that was left once is never entered again; so the ids are those of the merges.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from sedimenta.llm.rows import held_by_worker

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Codec:
    """Encodes and decodes with the ranks of a vocabulary that holds all single bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 250_000) -> None:
        self.pattern, self.memo = regex.compile(pattern), memo
        self.decimal = {rank: str(rank) for rank in ranks.values()}
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.ids = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.text = {rank: token for token, rank in self.ids.items()}
        self.length = {rank: len(token) for rank, token in self.text.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ids.items():
            self.automaton.add_word(token, rank)
        self.automaton.make_automaton()
        self.shorter = {rank: self._prefix(token) for rank, token in self.text.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.beside = lru_cache(1 << 18)(self._beside)
        for rank in sorted(self.text):
            self._split(rank)
        self.beside.cache_clear()
        self.pieces: dict[str, tuple[int, ...]] = {}  # and the ones before, when these grew past the memo
        self.older: dict[str, tuple[int, ...]] = {}

    def _prefix(self, token: str) -> int | None:
        """The longest token that is a proper prefix."""
        return next((self.ids[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ids), None)

    def _split(self, rank: int) -> None:
        """The two tokens whose merge makes this one; of a single byte, itself."""
        self.halves[rank] = (rank, rank)
        left, token = self.shorter[rank], self.text[rank]
        while left is not None:
            right = self.ids.get(token[self.length[left] :])
            if right is not None and left < rank and right < rank and self._beside(left, right):
                self.halves[rank], self.joined[left, right] = (left, right), rank
                return
            left = self.shorter[left]

    def _beside(self, left: int, right: int) -> bool:
        """Whether the merges leave these two as they are when they stand side by side."""
        limit = 1 << 62
        while True:
            if self.joined.get((left, right), limit) < limit:
                return False
            for _ in range(2):  # undo the later of both merges; where there is none, the other's
                if left > right:
                    limit, left = left, self.halves[left][1]
                    if left != limit:
                        break
                    left, limit, right = limit, right + 1, self.halves[right][0]
                    if right + 1 == limit:
                        return True
                    break
                limit, right = right + 1, self.halves[right][0]
                if right + 1 != limit:
                    break
                right, limit, left = limit - 1, left, self.halves[left][1]
                if left == limit:
                    return True
                break

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """The ids of one piece of text, given as Latin-1 characters."""
        whole = self.ids.get(piece)
        if whole is not None:
            return (whole,)
        length, shorter, beside = self.length, self.shorter, self.beside
        longest: list[int] = [0] * len(piece)
        for end, rank in self.automaton.iter(piece):
            longest[end + 1 - length[rank]] = rank
        out: list[int] = []
        fresh, at, token = bytearray(b"\x01") * (len(piece) + 1), 0, longest[0]
        while True:
            last = out[-1] if out else None
            while token is not None and not (fresh[at + length[token]] and (last is None or beside(last, token))):
                token = shorter[token]
            if token is not None:
                out.append(token)
                at += length[token]
                if at == len(piece):
                    return tuple(out)
                token = longest[at]
            else:
                fresh[at] = 0
                at -= length[out.pop()]
                token = shorter[last]

    def encode(self, text: str) -> list[int]:
        """All ids of a text; each match of the pattern is merged by itself."""
        pieces, out = self.pieces, []
        for match in self.pattern.findall(text):
            ids = pieces.get(match)
            if ids is None:
                ids = self.older.get(match) or self.encode_piece(match.encode().decode("latin-1"))
                if len(match) <= 64:
                    if len(pieces) >= self.memo:
                        self.older, self.pieces = pieces, (pieces := {})
                    pieces[match] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def _codec(shared: Broadcast, version: str) -> Codec:
    """One for each Python worker, as long as its tasks encode with this vocabulary and pattern."""
    return held_by_worker("byte_bpe", version, lambda: Codec(*shared.value))


def _sent(spark: SparkSession, vocabulary: str, pattern: str) -> tuple[Broadcast, str]:
    """The vocabulary's content for the executors, and a digest of all that the codec depends on."""
    ranks = read_ranks(vocabulary)
    named = hashlib.sha256(pattern.encode() + b"".join(b"%d %d " % (rank, len(token)) + token for token, rank in ranks.items()))
    return spark.sparkContext.broadcast((ranks, pattern)), named.hexdigest()


def bpe_round_trip(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the number of ids, the SHA-256 of the ids and of what they decode to, and the number of decoded bytes.

    vocabulary is the path of a rank file on the driver; its content, which no data makes larger, is sent to the executors.
    Null and empty texts have no ids and the hash of nothing. Repeated rows and keys each give a row; a null key stays null.
    """
    shared, version = _sent(docs.sparkSession, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, version)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = codec.encode(text.as_py() or "")
                decoded = codec.decode(ids)
                rows.append((len(ids), hashlib.sha256(" ".join(map(codec.decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest(), len(decoded)))
            n, ids, decoded, size = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()), pa.array(size, pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def bpe_ids(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id and the ids themselves (array<int>)."""
    shared, version = _sent(docs.sparkSession, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, version)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.encode(t.as_py() or "") for t in batch.column(1)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")
