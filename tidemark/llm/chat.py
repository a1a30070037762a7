"""Chat formatting by columnar byte assembly.

A turn is a head, the escaped text and an end mark. Heads, texts and marks of a
batch lie in a few Arrow buffers; numpy computes the lengths of all segments,
their cumulative offsets and the places to copy to, and one preallocated buffer
receives them. Every row of the result is a run of turns of one conversation
(``part`` counts up), so that a very long conversation never becomes one value.

``mask`` holds the byte ranges (start, end) of assistant texts in ``formatted``.

The end mark is ``</turn>``, a head ``### role:`` and a line end. Inside texts a
backslash is doubled, ``</turn>`` becomes ``<\\/turn>``, ``###`` becomes
``#\\##``, again for what is still ``###`` in longer runs, so that neither mark can appear; ``unescape`` undoes all of it.

Defined results: a null text or role is empty; rows of equal turn are ordered by role
and text; repeated rows are repeated turns; a null conversation id is one
conversation, a null turn comes first. An empty table gives an empty table. Other columns are ignored, whatever their names. A conversation's turns are
formatted one after another in one task, in bounded memory, as its digests are running hashes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranges, slices

END = "</turn>\n"
PART_BYTES = 1 << 20
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)


def escape_array(texts: pa.Array) -> pa.Array:
    texts = pc.replace_substring(texts, "\\", "\\\\")
    texts = pc.replace_substring(texts, "</turn>", "<\\/turn>")
    # the first pass leaves runs of four signs at most, the second of three, the third of two
    for _ in range(3):
        texts = pc.replace_substring(texts, "###", "#\\##")
    return texts


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, lengths) of a binary column."""
    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data, offsets[:-1], np.diff(offsets)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, ends of turns, starts of texts, ends of texts) of all turns in one buffer."""
    roles, texts = (escape_array(pc.fill_null(x.cast(pa.string()), "")) for x in (roles, texts))
    # a role keeps to one line: its line ends and colons are escaped like the marks
    roles = pc.replace_substring(pc.replace_substring(roles, "\n", "\\\n"), ":", "\\:")
    heads = pc.binary_join_element_wise("### ", roles, ":\n", "")
    ends = pa.array([END]).take(pa.array(np.zeros(len(texts), np.int64)))
    parts = [_buffers(x) for x in (heads, texts, ends)]
    lengths = np.stack([p[2] for p in parts], 1)
    stops = np.cumsum(lengths.reshape(-1)).reshape(-1, 3)
    starts = stops - lengths
    out = np.empty(int(stops[-1, -1]) if len(stops) else 0, np.uint8)
    for k, (data, at, size) in enumerate(parts):
        out[ranges(starts[:, k], size)] = data[ranges(at, size)]
    return out, stops[:, 2], starts[:, 1], stops[:, 1]


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """(conv_id, part, n_turns, formatted, mask) in order of turns.

    Rows are dealt by conversation and sorted; a task holds one batch at a time.
    """
    cols = [F.col(c).alias(a) for c, a in ((conv_col, "conv_id"), (turn_col, "turn"), (role_col, "role"), (text_col, "text"))]
    ordered = turns.select(*cols).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    kind = turns.schema[conv_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = object(), 0
        for whole in batches:
            for b in slices(whole, "text", PART_BYTES):
                data, stops, text_from, text_to = assemble(b.column(1), b.column(2))
                convs = b.column(0).to_pylist()
                cut = [i for i in range(len(convs)) if i == 0 or convs[i] != convs[i - 1]] + [len(convs)]
                trained = pc.fill_null(pc.equal(b.column(1), trained_role), False).to_numpy(zero_copy_only=False)
                rows = []
                for i, j in zip(cut, cut[1:]):
                    part = part + 1 if convs[i] == last else 0
                    last = convs[i]
                    a = int(stops[i - 1]) if i else 0
                    own = np.flatnonzero(trained[i:j]) + i
                    mask = np.stack([text_from[own] - a, text_to[own] - a], 1).reshape(-1).tolist()
                    rows.append((last, part, j - i, data[a : int(stops[j - 1])].tobytes().decode(), mask))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.column(0).type), *(pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int32()), (2, pa.int64()), (3, pa.string()), (4, pa.list_(pa.int64()))))], ["conv_id", "part", "n_turns", "formatted", "mask"])

    return ordered.mapInArrow(run, f"conv_id {kind}, part int, n_turns long, formatted string, mask array<long>")


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn."""
    out = []
    for turn in formatted.split(END)[:-1]:
        at = re.match(r"### ((?:\\.|[^\\:])*):\n", turn, re.DOTALL)
        out.append((unescape(at[1]), unescape(turn[at.end() :])))
    return out


def digests(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, from the formatted parts alone: numbers and SHA-256 of turns and of text under the mask.

    Parts of a conversation are read in order, with running hashes.
    """
    ordered = formatted.select("conv_id", "part", "formatted", "mask").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        kind_of = None

        def row(s: list) -> list:
            return [s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]]

        def batch(rows: list) -> pa.RecordBatch:
            types = [kind_of, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

        for b in batches:
            kind_of, rows = b.column(0).type, []
            for conv, part, text, mask in zip(*(c.to_pylist() for c in b.columns)):
                if part == 0:
                    if state:
                        rows.append(row(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, own in parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{own}\n".encode())
                data = text.encode()
                for a, z in zip(mask[::2], mask[1::2]):
                    own = unescape(data[a:z].decode())
                    state[3] += len(own)
                    state[4].update(own.encode())
                state[5] += len(text)
            if rows:
                yield batch(rows)
        if state:
            yield batch([row(state)])

    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
