"""An FM-index over words: suffix array, Burrows-Wheeler transform in a wavelet matrix, sampled suffix positions.

``build`` indexes a run of segments (lists of word numbers). ``Index.count`` gives the suffix ranges of many
phrases at once by backward search, ``Index.locate`` the places of suffixes by walking back to a sampled one. All
steps are numpy operations over whole arrays of phrases or suffixes.
"""

from __future__ import annotations

import numpy as np

#: Every so many words of a segment, its first one included, a suffix position is kept.
SAMPLE = 8


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """Suffixes in order, where the last symbol and each separator occur once only. Prefix doubling of what is still equal, from three symbols on."""
    n = len(ranks)
    width = int(ranks.max()).bit_length() if n else 1
    step = 3 if 3 * width <= 62 else 1
    ahead = np.concatenate([ranks.astype(np.int64), np.zeros(2, np.int64)])
    key = ahead[:n].copy()
    for k in range(1, step):
        key = key << width | ahead[k : n + k]
    order = np.argsort(key)
    sorted_ = key[order]
    rank = np.empty(n, np.int64)
    at, sub = np.arange(n), order
    while True:
        head = np.ones(len(at), bool)
        head[1:] = sorted_[1:] != sorted_[:-1]
        group = np.flatnonzero(head)
        rank[sub] = at[np.repeat(group, np.diff(np.append(group, len(at))))]
        alone = head.copy()
        alone[:-1] &= head[1:]
        at, sub = at[~alone], sub[~alone]
        if not len(at):
            return order
        key = rank[sub] * n + rank[sub + step]
        by = np.argsort(key)
        sub, sorted_ = sub[by], key[by]
        order[at] = sub
        step *= 2


class Bits:
    """A bit string with ranks."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    @staticmethod
    def pack(bits: np.ndarray) -> np.ndarray:
        raw = np.packbits(bits, bitorder="little")
        return np.frombuffer(np.pad(raw, (0, -len(raw) % 8 + 8)).tobytes(), "<u8")

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block, low = at >> 6, (at & 63).astype(np.uint64)
        return self.before[block] + np.bitwise_count(self.words[block] & ((np.uint64(1) << low) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class Index:
    """The index of one shard. Symbol 0 is the separator, word numbers count from 1."""

    def __init__(self, n: int, n_symbols: int, levels: bytes, marks: bytes, places: bytes):
        self.n, self.height = n, max(1, (n_symbols - 1).bit_length())
        bits = np.frombuffer(levels, "<u8").reshape(self.height, -1)
        self.levels = [Bits(b) for b in bits]
        self.zeros = [n - int(b.rank(np.array([n]))[0]) for b in self.levels]
        self.marks, self.places = Bits(np.frombuffer(marks, "<u8")), np.frombuffer(places, "<i4")
        # where each symbol's suffixes begin: its rank at the end of the string, summed over smaller symbols
        every = np.arange(n_symbols)
        totals = self.ranks(every, np.full(n_symbols, n))
        self.first = np.concatenate([[0], np.cumsum(totals)])

    def ranks(self, symbols: np.ndarray, *places: np.ndarray):
        """How often each symbol occurs before its place(s) in the transform."""
        start, out = np.zeros(len(symbols), np.int64), list(places)
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = (symbols >> (self.height - 1 - k) & 1).astype(bool)

            def down(at, bits=bits, zeros=zeros, one=one):
                r = bits.rank(at)
                return np.where(one, zeros + r, at - r)

            start, out = down(start), [down(x) for x in out]
        out = [x - start for x in out]
        return out[0] if len(out) == 1 else out

    def count(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range of each phrase, a row of symbols that is right-aligned; -1 for a word that isn't here."""
        low, high = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
        last = phrases[:, -1] if len(phrases) else np.zeros(0, np.int64)
        live = np.flatnonzero((phrases[:, -1] > 0) & ((phrases > 0) | (np.arange(phrases.shape[1]) < phrases.shape[1] - lengths[:, None])).all(1))
        low[live], high[live] = self.first[last[live]], self.first[last[live] + 1]
        for k in range(1, phrases.shape[1]):
            live = live[(low[live] < high[live])]
            now = live[lengths[live] > k]
            if not len(now):
                break
            c = phrases[now, -1 - k]
            a, b = self.ranks(c, low[now], high[now])
            low[now], high[now] = self.first[c] + a, self.first[c] + b
        return low, high

    def back(self, rows: np.ndarray) -> np.ndarray:
        """The suffix one word longer than each given one."""
        at, start, symbol = rows, np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for bits, zeros in zip(self.levels, self.zeros):
            one = bits.get(at)
            r, s = bits.rank(at), bits.rank(start)
            at, start = np.where(one, zeros + r, at - r), np.where(one, zeros + s, start - s)
            symbol = symbol << 1 | one
        return self.first[symbol] + at - start

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the shard of each suffix."""
        out, open_, at, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows, 0
        while len(open_):
            found = self.marks.get(at)
            out[open_[found]] = self.places[self.marks.rank(at[found])] + steps
            open_, at = open_[~found], at[~found]
            at, steps = self.back(at), steps + 1
        return out


def build(words: np.ndarray, counts: np.ndarray) -> tuple[int, int, bytes, bytes, bytes]:
    """The fields of ``Index`` for segments of ``counts`` words each, numbered from 1 in ``words``. A separator follows each segment."""
    n_segments, n = len(counts), len(words) + len(counts)
    ends = np.cumsum(counts + 1) - 1
    text = np.zeros(n, np.int64)
    is_word = np.ones(n, bool)
    is_word[ends] = False
    text[is_word] = words
    n_symbols = int(text.max()) + 1 if n else 1
    ranks = text + n_segments - 1
    ranks[ends] = np.arange(n_segments)
    order = suffix_array(ranks)
    symbols = text[order - 1]
    height, levels = max(1, (n_symbols - 1).bit_length()), []
    for k in range(height):
        one = (symbols >> (height - 1 - k) & 1).astype(bool)
        levels.append(Bits.pack(one))
        symbols = np.concatenate([symbols[~one], symbols[one]])
    starts = ends - counts
    kept = (np.arange(n) - np.repeat(starts, counts + 1)) % SAMPLE == 0
    marked = kept[order]
    return n, n_symbols, np.stack(levels).tobytes() if n else b"\0" * 8 * height, Bits.pack(marked).tobytes(), order[marked].astype("<i4").tobytes()
