"""Words as runs of bytes, cut with numpy: maximal runs of 0-9, a-z, A-Z and all signs beyond ASCII, A-Z lower-cased.

This is the word of the search and the decontamination operators. Texts longer than a slice are cut
at bytes that belong to no word, so that a task's memory doesn't follow the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import SLICE_BYTES, slices

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[65:91] = _IN_WORD[128:] = True


class Words(NamedTuple):
    """Words of some rows: all words, the number in each row, and each word's first byte and the one after its last (in the rows' joined bytes)."""

    words: pa.Array
    counts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def cut(data: np.ndarray, edges: np.ndarray) -> Words:
    """The words of texts that lie side by side in ``data``, text i from ``edges[i]`` to ``edges[i + 1]``."""
    n = len(data)
    inside = _IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = edges[(edges > 0) & (edges < n)]
    first[at] = inside[at]
    last[at - 1] = inside[at - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[inside]])])
    return Words(words, np.diff(np.searchsorted(starts, edges)), starts, ends)


def of_texts(texts: pa.Array) -> Words:
    """The words of an Arrow text column; null has none."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    n = len(texts)
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    return cut(data, edges - edges[0])


def portions(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Words, bool, bool]]:
    """(rows, their words, begins, ends): runs of whole rows, or a part of one long row (``begins``/``ends``: its first/last part)."""
    for whole in batches:
        for rows in slices(whole, column, limit):
            text = rows.column(rows.schema.get_field_index(column))
            if rows.num_rows > 1 or (pc.binary_length(text)[0].as_py() or 0) <= limit:
                yield rows, of_texts(text), True, True
                continue
            data, at = np.frombuffer(text[0].as_buffer(), np.uint8), 0
            while at < len(data):
                end = min(at + limit, len(data))
                while end < len(data) and _IN_WORD[data[end - 1]]:
                    end += 1
                part = data[at:end]
                yield rows, cut(part, np.array([0, len(part)])), at == 0, end == len(data)
                at = end
