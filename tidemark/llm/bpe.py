"""Byte-level BPE as a finite-state transducer, and streaming decode.

The merges are compiled into a machine whose states are made on demand. A state
is the set of open hypotheses at a byte: for each place where a token may have
begun, the vocabulary-trie node reached since, the last token before that place,
and the tokens not yet certain. A token is a valid next one if merging the bytes
of it and of its predecessor gives just these two; then exactly one token ends
each prefix. What all hypotheses agree on is emitted, so output follows input
after a bounded look-ahead, as in determinising a string transducer. States and
transitions are kept up to a limit, within a match too: all but the current state are then dropped and made anew. That never changes ids.

Each match of the pattern is encoded alone. A match that is itself in the
vocabulary is that one token, as in the public library.

Defined results: null and empty texts give no ids. Repeated rows get equal results, rows keep their id, and other columns, whatever their
names, are left out. An empty table gives an empty one. Bytes outside the
vocabulary raise an error (public byte-level vocabularies have all 256).
"""

from __future__ import annotations

import base64
import gc
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, ranges, slices
from .pieces import PieceCache, by_pattern


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Bytes of one match to ids."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 100_000):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.below: dict[int, int] = {}
        self.token: list[int] = [-1]
        for text, i in ranks.items():
            node = 0
            for b in text:
                new = self.below.setdefault(node << 8 | b, len(self.token))
                if new == len(self.token):
                    self.token.append(-1)
                node = new
            self.token[node] = i
        self.inner = bytearray(len(self.token))
        for edge in self.below:
            self.inner[edge >> 8] = 1
        self.valid: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states, self.number = [((0, -1, ()),)], {((0, -1, ()),): 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.last: list[tuple[int, ...]] = [()]

    def merge(self, text: bytes) -> list[int]:
        """Plain merging by rank; only to judge pairs of tokens."""
        rank, none = self.ranks.get, 1 << 60
        parts = [text[i : i + 1] for i in range(len(text))]
        ranks = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) < none:
            at = ranks.index(low)
            parts[at] += parts.pop(at + 1)
            ranks.pop(at)
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1], none)
        return [self.ranks[p] for p in parts]

    def follows(self, before: int, token: int) -> bool:
        """Whether merging leaves ``before`` and ``token`` side by side (before -1: ``token`` alone)."""
        pair = (before + 1) << 24 | token
        known = self.valid.get(pair)
        if known is None:
            if len(self.valid) > 200_000:
                self.valid.clear()
            text = self.bytes_of[token] if before < 0 else self.bytes_of[before] + self.bytes_of[token]
            known = self.valid[pair] = self.merge(text) == ([token] if before < 0 else [before, token])
        return known

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        below, tokens, inner = self.below.get, self.token, self.inner
        new, done, sure = [], None, ()
        for node, before, held in self.states[state]:
            node = below(node << 8 | byte)
            if node is None:
                continue
            token = tokens[node]
            if done is None and token >= 0 and self.follows(before, token):
                done = (*held, token)
            if inner[node]:
                new.append((node, before, held))
        if done is None:
            raise ValueError("bytes that the vocabulary can't encode")
        new.append((0, done[-1], done))
        if new[0][2]:
            n, shortest = 0, min([len(h[2]) for h in new])
            while n < shortest and all([h[2][n] == done[n] for h in new]):
                n += 1
            if n:
                sure = done[:n]
                new = [(node, before, held[n:]) for node, before, held in new]
        key = tuple(new)
        number = self.number.setdefault(key, len(self.states))
        if number == len(self.states):
            self.states.append(key)
            self.last.append(new[-1][2])
        move = self.moves[state << 8 | byte] = (number, sure)
        return move

    def _forget(self, state: int) -> int:
        """Drops all states but the given one, which gets a new number."""
        key = self.states[state]
        self._reset()
        number = self.number.setdefault(key, len(self.states))
        if number == len(self.states):
            self.states.append(key)
            self.last.append(key[-1][2])
        return number

    def stream(self, text: Iterable[int]) -> Iterator[int]:
        """Ids as soon as they are certain."""
        state = 0
        for byte in text:
            move = self.moves.get(state << 8 | byte)
            if move is None:
                if len(self.states) > self.max_states:
                    state = self._forget(state)
                move = self._move(state, byte)
            state = move[0]
            yield from move[1]
        yield from self.last[state]

    def encode(self, text: bytes) -> list[int]:
        whole = self.ranks.get(text)
        if whole is not None:
            return [whole]
        out: list[int] = []
        state, moves = 0, self.moves
        for byte in text:
            move = moves.get(state << 8 | byte)
            if move is None:
                if len(self.states) > self.max_states:
                    state, moves = self._forget(state), self.moves
                move = self._move(state, byte)
            state, sure = move
            if sure:
                out += sure
        out += self.last[state]
        return out


class Utf8Stream:
    """Bytes in any portions to text: gives whole characters and keeps an unfinished one for the next call."""

    #: How many bytes follow a first byte of these ranges.
    FOLLOW = [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xEF, 2), (0xF0, 0xF4, 3)]

    def __init__(self, errors: str = "strict"):
        self.errors, self.held = errors, b""

    def _unfinished(self, data: bytes) -> int:
        """How many bytes at the end begin a character that isn't complete."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:
                more = next((n for a, b, n in self.FOLLOW if a <= byte <= b), 0)
                return back if more >= back else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self._unfinished(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", self.errors)

    def finish(self) -> str:
        data, self.held = self.held, b""
        return data.decode("utf-8", self.errors)


class Vocabulary:
    """Ids to bytes and text."""

    def __init__(self, ranks: dict[bytes, int]):
        by_id = {i: t for t, i in ranks.items()}
        tokens = [by_id.get(i, b"") for i in range(max(ranks.values()) + 1)]
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.begins = np.cumsum(self.sizes) - self.sizes

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return self.flat[ranges(self.begins[ids], self.sizes[ids])].tobytes()

    def decode(self, ids: np.ndarray, errors: str = "strict", portion: int = 1 << 16) -> Iterator[str]:
        """Text in portions; characters that tokens split are put together again."""
        stream = Utf8Stream(errors)
        for at in range(0, len(ids), portion):
            yield stream.feed(self.decode_bytes(ids[at : at + portion]))
        yield stream.finish()


class Bpe(Vocabulary):
    """Texts to ids and back with one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__(ranks)
        self.machine = Transducer(ranks)
        self.matches = regex.compile(pattern).findall
        self.cache = PieceCache(self._encode, "<u4", by_pattern(pattern))

    def _encode(self, pieces: list[str]) -> list[bytes]:
        out = []
        for piece in pieces:
            ids: list[int] = []
            for match in self.matches(piece):
                ids += self.machine.encode(match.encode())
            out.append(array("I", ids).tobytes())
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and how many each text has."""
        return self.cache.ids(texts)


#: What a worker that shares an executor's memory with other steps keeps and handles at once: states, pieces of each generation, bytes of text.
SMALL_STATES, SMALL_PIECES, SMALL_BYTES = 50_000, 60_000, 512 << 10

_MADE: dict[tuple, Vocabulary] = {}


def bpe(path: str, pattern: str) -> Bpe:
    """The vocabulary of a rank file, made once in each Python worker."""
    if (path, pattern) not in _MADE:
        _MADE[path, pattern] = Bpe(load_ranks(path), pattern)
    return _MADE[path, pattern]


def forget(path: str, pattern: str) -> None:
    """Drop what ``bpe`` keeps in this Python worker."""
    _MADE.pop((path, pattern), None)
    gc.collect()
    pa.default_memory_pool().release_unused()


def vocabulary(path: str) -> Vocabulary:
    """The decoding half alone."""
    if path not in _MADE:
        _MADE[path] = Vocabulary(load_ranks(path))
    return _MADE[path]


Derived = Callable[[Vocabulary, np.ndarray], tuple]


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", columns: str | None = None, of: Derived | None = None, release: bool = False) -> DataFrame:
    """(id, n_tokens, ids) of every whole text; ids as little-endian unsigned 32-bit integers.

    With ``release`` a worker keeps few states and pieces, takes short portions, and forgets all when a partition ends, which leaves memory for other steps of the same job.

    With ``columns`` (a DDL list of strings) and ``of``, its values for the ids of each row come instead of
    the ids, so that they need not leave the worker.
    """
    names = ["ids"] if columns is None else [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = bpe(ranks, pattern)
        if release:
            made.machine.max_states, made.cache.half, made.cache.portion = SMALL_STATES, SMALL_PIECES, SMALL_BYTES
        else:
            # alone in its worker, it may keep twice as many states and pieces
            made.machine.max_states, made.cache.half = 200_000, 200_000
        for whole in batches:
            for part in slices(whole, "text", SMALL_BYTES if release else SLICE_BYTES):
                ids, counts = made.encode(part.column(1))
                ends = np.cumsum(counts).tolist()
                runs = [ids[b - n : b] for b, n in zip(ends, counts.tolist())]
                if of is None:
                    values = [pa.array([r.tobytes() for r in runs], pa.binary())]
                else:
                    values = [pa.array(v, pa.string()) for v in zip(*(of(made, r) for r in runs))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), *values], ["id", "n_tokens", *names])
            pa.default_memory_pool().release_unused()
        if release:
            del made
            forget(ranks, pattern)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, {columns or 'ids binary'}")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """(id, n_tokens, text) from (id, n_tokens, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = vocabulary(ranks)
        for b in batches:
            texts = ["".join(made.decode(np.frombuffer(x, "<u4"))) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["id", "n_tokens", "text"])

    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "n_tokens", "ids").mapInArrow(run, f"id {kind}, n_tokens long, text string")
