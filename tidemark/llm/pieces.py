"""Texts as codes into a pool of distinct pieces, so that each piece is encoded once.

The matches of the public byte-level pattern are found for many texts at once: every
code point has a class (letter, number, sign, white space), and numpy compares
neighbours. The matches fill the texts without gaps, so their places are the offsets of
an Arrow array over the same bytes, which Arrow turns into codes without Python objects.
Texts with code points whose class isn't certain stay whole, and the encoder cuts them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import ranges

#: Fixed value: the pattern of the public byte-level pre-tokenizer.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A longer text is cut at single spaces between letters or digits, where a match begins in any case.
PORTION_BYTES = 2 << 20
_SAFE = re.compile(rb"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")
#: Longer pieces aren't kept.
KEEP = 64

LETTER, NUMBER, SIGN, SPACE, UNSURE = range(5)
LAST = np.uint32(0x1FFFF)


@cache
def classes() -> np.ndarray:
    """The class of every code point up to the last entry, which stands for all above; those that engines of other Unicode versions may see otherwise are UNSURE."""
    of = {"L": LETTER, "N": NUMBER, "M": SIGN, "P": SIGN, "S": SIGN, "Z": SPACE}
    table = np.array([of.get(unicodedata.category(chr(c))[0], UNSURE) for c in range(0x20000)], np.uint8)
    table[0x10000:][table[0x10000:] < SIGN] = UNSURE
    table[0:32] = SIGN
    table[127] = SIGN
    table[9:14] = SPACE
    table[28:32] = UNSURE
    table[-1] = UNSURE
    return table


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some texts (no nulls) and n + 1 offsets into them."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def byte_level(texts: pa.Array, whole: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All matches of BYTE_LEVEL in order, and how many each text has; texts marked in ``whole`` are one piece."""
    data, at = _bytes_of(texts)
    if not len(data):
        return pa.array([], pa.large_string()), np.zeros(len(texts), np.int64)
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(code)
    place = None if n == len(data) else np.flatnonzero((data & 0xC0) != 0x80)
    begin = at if place is None else np.searchsorted(place, at)
    kind = classes()[np.minimum(code, LAST)]
    first = np.zeros(n + 1, bool)
    first[begin] = True
    white = kind == SPACE
    solid_next = np.zeros(n, bool)
    solid_next[:-1] = ~(white[1:] | first[1:n])
    # white space after a solid sign begins a match, as does the last of a run before one; a space goes with what follows
    cut = first[:n].copy()
    cut[1:] |= np.where(white[1:], ~white[:-1] | solid_next[1:], np.where(white[:-1], code[:-1] != 32, kind[1:] != kind[:-1]))
    mark = np.flatnonzero(cut & (code == 39))
    for tail in (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"):
        hit = mark[mark + len(tail) < n]
        for k, sign in enumerate(tail, 1):
            hit = hit[(code[hit + k] == sign) & ~first[hit + k]]
        cut[hit + 1] = False
        end = hit + len(tail) + 1
        cut[end[end < n]] = True
    bad = np.concatenate([[0], np.cumsum(kind == UNSURE)])
    for i in np.flatnonzero((bad[begin[1:]] > bad[begin[:-1]]) | whole):
        cut[begin[i] + 1 : begin[i + 1]] = False
    cuts = np.flatnonzero(cut)
    counts = np.diff(np.searchsorted(cuts, begin))
    offsets = np.append(cuts if place is None else place[cuts], len(data))
    return _array(data, offsets), counts


@cache
def _alphabet() -> np.ndarray:
    """The sign of every byte in the vocabularies of byte-level tokenizers; line feeds stay, as they part pieces."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = np.zeros(256, np.uint32)
    table[same] = same
    rest = np.flatnonzero(table == 0)
    table[rest] = np.arange(256, 256 + len(rest))
    table[10] = 10
    return table


def spelled(raw: np.ndarray) -> str:
    """Bytes, with a line feed between pieces, in the signs of byte-level vocabularies."""
    return _alphabet()[raw].tobytes().decode("utf-32-le")


def one_class(pieces: list[str]) -> np.ndarray:
    """Which pieces of at most KEEP code points are one match of BYTE_LEVEL for certain: letters, numbers or signs alone, or after a space."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    code = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
    fit = (size > 0) & (size <= KEEP)
    if not len(code):
        return fit
    kind = classes()[np.minimum(code, LAST)]
    ends = np.cumsum(size)
    begins = np.minimum(ends - size, len(code) - 1)
    last = kind[ends - 1]
    odd = np.concatenate([[0], np.cumsum(kind[1:] != kind[:-1])])
    inner = begins + ((code[begins] == 32) & (size > 1))
    return fit & (last < SPACE) & (odd[ends - 1] == odd[np.minimum(inner, ends - 1)])


def by_pattern(pattern: str) -> Callable[[pa.Array, np.ndarray], tuple[pa.Array, np.ndarray]]:
    """The same for any pattern (``whole`` isn't heeded)."""
    if pattern == BYTE_LEVEL:
        return byte_level
    find = regex.compile(pattern).findall

    def cut(texts: pa.Array, whole: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        found = [find(t) for t in texts.to_pylist()]
        return pa.array([m for f in found for m in f], pa.large_string()), np.fromiter(map(len, found), np.int64, len(found))

    return cut


def uncut(texts: pa.Array, whole: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Each text is one piece."""
    return texts.cast(pa.large_string()), np.ones(len(texts), np.int64)


def portions(texts: pa.Array, whole: np.ndarray, limit: int = PORTION_BYTES) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Runs of texts of about ``limit`` bytes with their numbers; a longer text comes in parts unless it is marked."""
    data, at = _bytes_of(texts)
    size = np.diff(at)
    run = at[:-1] // limit
    long = (size > limit) & ~whole
    edges = np.flatnonzero((np.diff(run) > 0) | long[1:] | long[:-1]) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(size)]):
        if b - a == 1 and long[a]:
            raw, done = data[at[a] : at[b]].tobytes(), 0
            while done < len(raw):
                found = _SAFE.search(raw, done + limit) if len(raw) - done > limit else None
                stop = found.start() if found else len(raw)
                yield np.array([a]), _array(np.frombuffer(raw, np.uint8)[done:stop], np.array([0, stop - done]))
                done = stop
        elif b > a:
            yield np.arange(a, b), texts.slice(a, b - a)


class PieceCache:
    """Ids of pieces as bytes, kept between batches in one Python worker.

    ``encode`` takes a list of unknown strings and gives a list of bytes objects, ``cut`` makes
    pieces of texts. Where texts may be cut at safe places (``parts``), long ones never lie open at once.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], dtype: str, cut=byte_level, limit: int = 240_000, portion: int = PORTION_BYTES):
        self.encode, self.dtype, self.cut, self.parts, self.portion = encode, np.dtype(dtype), cut, cut is byte_level, portion
        self.half, self.known, self.older = limit // 2, {}, {}

    def lookup(self, pieces: list[str]) -> list[bytes]:
        # two generations: what is used stays when the older one goes; going over the bound costs time, never a result
        if len(self.known) > self.half:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        values = list(map(known.get, pieces))
        new = []
        for i, v in enumerate(values):
            if v is None:
                p = pieces[i]
                v = older.get(p)
                if v is None:
                    new.append(i)
                else:
                    values[i] = known[p] = v
        for i, v in zip(new, self.encode([pieces[i] for i in new])):
            values[i] = v
            if len(pieces[i]) <= KEEP:
                known[pieces[i]] = v
        return values

    def _ids(self, texts: pa.Array, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pieces, counts = self.cut(texts, whole)
        coded = pieces.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        values = self.lookup(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(values), self.dtype)
        begins = np.cumsum(sizes) - sizes
        lengths = sizes[codes]
        total = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(counts)
        return flat[ranges(begins[codes], lengths)], total[ends] - total[ends - counts]

    def ids(self, texts: pa.Array, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and how many each text has; those marked in ``whole`` go to ``encode`` as they are."""
        texts = pc.fill_null(texts, "")
        whole = np.zeros(len(texts), bool) if whole is None else whole
        parts, sizes = [np.zeros(0, self.dtype)], np.zeros(len(texts), np.int64)
        for numbers, own in portions(texts, whole if self.parts else np.ones(len(texts), bool), self.portion):
            ids, n = self._ids(own, whole[numbers])
            parts.append(ids)
            sizes[numbers] += n
        return np.concatenate(parts), sizes
