"""Byte-level BPE by prefix dynamic programming, and decoding.

For each prefix of a piece of text the table holds the last token of that prefix's encoding.
Exactly one token that ends there can follow the encoding of what precedes it, so a prefix
needs one number, an append only adds numbers, and after an edit the numbers repeat as soon
as they have agreed with the old ones over the length of the longest token.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Iterator
from functools import cache, cached_property

from pyspark.sql import DataFrame, functions as F

from pressroute.llm.common import RecentCache

#: Bytes that a worker's caches may take: ids of pieces, ids of texts between spaces, and which tokens may follow which. They
#: stay for the worker's next task: emptied after each, and with a third of the room, encoding took twice the CPU seconds.
CACHED_PIECES, CACHED_CHUNKS, CACHED_FOLLOWS = 16 << 20, 96 << 20, 64 << 20
#: Rows in a batch that goes back to Spark.
ROWS_PER_BATCH = 256

_SPACE_IN_SPACES = re.compile(r"\s \s")


class Vocabulary:
    """Ranks of a tiktoken file: ``base64 rank`` on each line."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self._halves: dict[int, tuple[int, int]] = {}
        self.known_follows = RecentCache(lambda pair: self._follows(pair >> 32, pair & 0xFFFFFFFF), CACHED_FOLLOWS)
        self._reached: dict[int, bool] = {}

    @cached_property
    def automaton(self):
        """Finds all tokens in a text of one character per byte: (last place, (length, rank)), by end, the longest first."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            found.add_word(token.decode("latin-1"), (len(token), rank))
        found.make_automaton()
        return found

    def encode(self, data: bytes) -> list[int]:
        """The encoding of a whole piece: its table of last tokens filled from the tokens found in it, read from the end."""
        last, known = [-1] * (len(data) + 1), self.known_follows
        for at, (size, token) in self.automaton.iter(data.decode("latin-1")):
            at += 1
            if last[at] < 0:
                if size < at:
                    if known[last[at - size] << 32 | token]:
                        last[at] = token
                elif self.reached(token):
                    last[at] = token
        return _read_back(last, self.tokens, len(data))

    def merge(self, data: bytes, parts_left: int = 1) -> list[int]:
        """Byte-pair merges by rank, left before right, until ``parts_left`` parts remain."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > parts_left:
            ranked = [(self.ranks.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            best = min((x for x in ranked if x[0] is not None), default=None)
            if best is None:
                break
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a byte."""
        if len(self.tokens[token]) == 1:
            return None
        if token not in self._halves:
            left, right = self.merge(self.tokens[token], 2)
            self._halves[token] = (left, right)
        return self._halves[token]

    def reached(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as this token; a vocabulary may hold others, which are never emitted."""
        if token not in self._reached:
            self._reached[token] = self.merge(self.tokens[token]) == [token]
        return self._reached[token]

    def follows(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is these two tokens."""
        return self.known_follows[left << 32 | right]

    def _follows(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is these two tokens.

        Undoes the latest merge beside the boundary, again and again. The pair that meets there
        must not have been merged before that merge: of equal ranks, the one further left goes first.
        """
        a, b, before = left, right, len(self.ranks) + 1
        while True:
            joined = self.ranks.get(self.tokens[a] + self.tokens[b])
            if joined is not None and joined < before:
                return False
            parts_a, parts_b = self.halves(a), self.halves(b)
            if parts_a is None and parts_b is None:
                return True
            if parts_b is None or (parts_a is not None and a > b):
                before, a = a, parts_a[1]
            else:
                before, b = b + 1, parts_b[0]


class PrefixTable:
    """Last token of each prefix of one piece. ``data`` grows by ``append`` and changes by ``replace``."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, data, array("i", [-1])
        self._fill(len(data))

    def _last_token(self, end: int) -> int:
        vocabulary, data, last = self.vocabulary, self.data, self.last
        rank, known = vocabulary.ranks.get, vocabulary.known_follows
        for start in range(end - vocabulary.longest if end > vocabulary.longest else 0, end):
            token = rank(data[start:end])
            if token is None:
                continue
            if start:
                if known[last[start] << 32 | token]:
                    return token
            elif vocabulary.reached(token):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def _fill(self, end: int) -> None:
        while len(self.last) <= end:
            self.last.append(self._last_token(len(self.last)))

    def append(self, more: bytes) -> None:
        self.data += more
        self._fill(len(self.data))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of ``data[start:stop]``; returns how many prefixes were computed anew."""
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[:start + 1]
        agreed, fixed, changed_to = 0, len(self.last), start + len(new)
        while len(self.last) <= len(self.data):
            end = len(self.last)
            self.last.append(self._last_token(end))
            agreed = agreed + 1 if end > changed_to and self.last[end] == old[end - shift] else 0
            if agreed >= self.vocabulary.longest:  # everything after depends on these alone
                self.last.extend(old[end - shift + 1:])
                return end - fixed + 1
        return len(self.last) - fixed

    def ids(self) -> list[int]:
        """The encoding, read from the end."""
        return _read_back(self.last, self.vocabulary.tokens, len(self.data))


def _read_back(last, tokens: dict[int, bytes], end: int) -> list[int]:
    found = []
    while end:
        if last[end] < 0:
            raise ValueError("the vocabulary lacks a byte")
        found.append(last[end])
        end -= len(tokens[last[end]])
    return found[::-1]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class TextEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers; each match of the pattern by itself.

    With ``space_starts_match`` (true of patterns whose matches hold a space only in front, or in a run of
    white space) a text is cut before each single space that has something else on one side at least;
    the pattern's matches are the same, and most cuts have been seen before.
    """

    def __init__(self, path: str, pattern: str, space_starts_match: bool = True):
        import regex

        self.find, self.vocabulary, self.cut = regex.compile(pattern).findall, vocabulary(path), space_starts_match
        self.pieces = RecentCache(self._piece, CACHED_PIECES)
        self.chunks = RecentCache(self._chunk, CACHED_CHUNKS)  # most texts between spaces have been seen: 5 times as fast as matching

    def _piece(self, piece: str) -> bytes:
        return _little_endian(array("I", self.vocabulary.encode(piece.encode())))

    def _chunk(self, chunk: str) -> bytes:
        found = self.find(" " + chunk)  # one piece is kept as the chunk alone
        return self._piece(found[0]) if len(found) == 1 else b"".join(map(self.pieces.__getitem__, found))

    def __call__(self, text: str) -> bytes:
        if not self.cut or "  " in text or text[:1] == " " or text[-1:] == " " or _SPACE_IN_SPACES.search(text):
            return b"".join(map(self.pieces.__getitem__, self.find(text)))
        first, *rest = text.split(" ")
        return b"".join(map(self.pieces.__getitem__, self.find(first))) + b"".join(map(self.chunks.__getitem__, rest))


def _little_endian(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()


@cache
def _encoder(path: str, pattern: str) -> TextEncoder:
    return TextEncoder(path, pattern)


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the whole text's token ids as little-endian unsigned 32-bit integers, without special tokens.

    Each match of ``pattern`` is encoded separately, by the ranks of the tiktoken file at ``path``
    (installed at the same path on every worker). Null counts as empty; an empty text has no ids.
    Repeated rows give repeated rows, a null id stays null, an empty table gives an empty result,
    further columns are ignored. A very long text costs time in proportion to its length.
    """
    def encode(batches: Iterator):
        import pyarrow as pa

        encoder = _encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_BATCH):
                part = batch.slice(at, ROWS_PER_BATCH)
                yield pa.record_batch([part.column(0), pa.array([encoder(t.as_py() or "") for t in part.column(1)], pa.binary())],
                                      ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def bpe_decode(encoded: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """The columns of ``keep`` and ``decoded``, the bytes that ``ids`` stand for; null ids count as none."""
    def decode(batches: Iterator):
        import pyarrow as pa

        tokens = vocabulary(path).tokens
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_BATCH):
                part, out = batch.slice(at, ROWS_PER_BATCH), []
                for raw in part.column("ids"):
                    ids = array("I", raw.as_py() or b"")
                    if sys.byteorder == "big":
                        ids.byteswap()
                    out.append(b"".join([tokens[i] for i in ids]))
                yield pa.record_batch([*[part.column(k) for k in keep], pa.array(out, pa.binary())], [*keep, "decoded"])

    rows = encoded.select(*keep, *(["ids"] if "ids" not in keep else []))
    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(decode, f"{fields}, decoded binary")
