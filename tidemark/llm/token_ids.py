"""Token ids as length-limited canonical Huffman codes from global counts.

``tokenize`` gives ids; ``write`` counts all ids in Spark, makes one code, and
writes a table of independent blocks in ascending id order; ``read`` decodes
them by table lookup. A block holds whole documents, their ids and counts, the
bit offset of every ``STEP``-th token, and the packed codes, so that it can be
decoded alone and from many offsets at once. Blocks are rows of Parquet files,
hence Spark places them and rewrites those of a lost task.

Defined results: a null or empty text has no ids but the end id. Rows of one
document id stand side by side, ordered by their ids. A null document id comes
first and is read back as null. An empty table gives no blocks. Other columns
are ignored. A block whose checksum is wrong raises an error.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import discard, slices, stored
from .pieces import PieceCache, byte_level, one_class, spelled, uncut

MAX_LENGTH = 20
BLOCK_IDS = 1 << 18
STEP = 128
#: The pieces that a Python worker keeps, and those that the library gets at once.
PIECES = 600_000
RUN = 1024
_HEAD = struct.Struct("<4sIIIIII")
_NO_ID = -(1 << 63)

_CACHES: dict[tuple, tuple[PieceCache, list[str]]] = {}


def _tokenizer_cache(path: str, special_as_text: bool) -> tuple[PieceCache, list[str]]:
    """The pieces of one tokenizer file, and the strings that it cuts out before all else; unknown pieces go through the library many at a time."""
    if (path, special_as_text) not in _CACHES:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = special_as_text
        size = tok.get_vocab_size()
        dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        covers = np.zeros(size, np.int64)
        for piece, i in tok.get_vocab().items():
            covers[i] = len(piece)
        made = json.loads(tok.to_str())
        plain = made["pre_tokenizer"] or {}
        level = made["normalizer"] is None and plain.get("type") == "ByteLevel" and plain.get("use_regex") and not plain.get("add_prefix_space")
        added = [t.content for t in tok.get_added_tokens_decoder().values() if not (t.special and special_as_text)]

        batched = level and made["model"]["type"] == "BPE" and not any(made["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        # strings of the library's own that may stand inside letters, numbers or signs
        inside = [t for t, fits in zip(added, one_class(added)) if fits or t == " "]
        # the same model over pieces that are cut and spelled already
        model = Tokenizer(tok.model)
        model.pre_tokenizer = CharDelimiterSplit("\n")
        width = dtype.itemsize

        def singly(run: list[str]) -> list[bytes]:
            return [np.array(e.ids, dtype).tobytes() for e in tok.encode_batch_fast(run, add_special_tokens=False)]

        def together(run: list[str]) -> list[bytes]:
            """One call for many pieces; a vocabulary's strings have a sign for each byte, so their lengths tell where a piece ends."""
            raw = np.frombuffer("\n".join(run).encode(), np.uint8)
            ids = np.array(model.encode_batch_fast([spelled(raw)], add_special_tokens=False)[0].ids, dtype)
            ends = np.append(np.flatnonzero(raw == 10), len(raw)) - np.arange(len(run))
            covered = np.concatenate([[0], np.cumsum(covers[ids])])
            cuts = np.searchsorted(covered, ends, "right") - 1
            if cuts[-1] != len(ids) or (covered[cuts] != ends).any():
                return singly(run)
            data, at = ids.tobytes(), [0, *(cuts * width).tolist()]
            return [data[a:b] for a, b in zip(at, at[1:])]

        def encode(new: list[str]) -> list[bytes]:
            fit = one_class(new) if batched else np.zeros(len(new), bool)
            for token in inside:
                fit &= np.fromiter((token not in p for p in new), bool, len(new))
            out = []
            for own, way, size in ((fit, together, RUN), (~fit, singly, 512)):
                chosen = new if own.all() else list(compress(new, own.tolist()))
                out += [e for at in range(0, len(chosen), size) for e in way(chosen[at : at + size])]
            if fit.all() or not fit.any():
                return out
            order = np.argsort(np.argsort(~fit, kind="stable"), kind="stable")
            return [out[i] for i in order.tolist()]

        _CACHES[path, special_as_text] = PieceCache(encode, dtype.str, byte_level if level else uncut, PIECES), added
    return _CACHES[path, special_as_text]


def tokenize(docs: DataFrame, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """(id, n_tokens, ids): ids of the whole text, then ``end_id``; little-endian, of 16 bits if the vocabulary allows, else 32.

    As in the library, the string of a special token in a text is that token, unless ``special_as_text``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, added = _tokenizer_cache(tokenizer, special_as_text)
        width = cache.dtype.itemsize
        tail = np.array([] if end_id is None else [end_id], cache.dtype).tobytes()
        for batch in batches:
            for part in slices(batch, "text"):
                texts = pc.fill_null(part.column(1), "")
                whole = np.zeros(len(texts), bool)
                for token in added:
                    whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
                ids, counts = cache.ids(texts, whole)
                data, ends = ids.tobytes(), (np.cumsum(counts) * width).tolist()
                rows = [data[b - width * n : b] + tail for b, n in zip(ends, counts.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts + len(tail) // width, pa.int64()), pa.array(rows, pa.binary())], ["id", "n_tokens", "ids"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "id long, n_tokens long, ids binary")


def _ids(rows: list[bytes], n: int) -> np.ndarray:
    """All ids of some rows, ``n`` together, of either width."""
    data = b"".join(rows)
    return np.frombuffer(data, "<u2" if len(data) < 4 * n else "<u4")


def count_ids(tokens: DataFrame) -> DataFrame:
    """(token, n) over all rows: each task adds up its own ids before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for part in slices(b, "ids"):
                own = np.bincount(_ids(part.column(0).to_pylist(), sum(part.column(1).to_pylist())))
                if len(own) > len(total):
                    own, total = total, own
                total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["token", "n"])

    return tokens.select("ids", "n_tokens").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    coins = counts[order].astype(np.int64)
    levels, row = [], coins
    coin = np.ones(n, bool)
    for _ in range(limit - 1):
        levels.append(coin)
        packs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([coins, packs])
        by = np.argsort(merged, kind="stable")
        row, coin = merged[by], by < n
    levels.append(coin)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for coin in reversed(levels):
        own = int(coin[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """A canonical code over ids 0 .. len(lengths) - 1 (length 0: unused), and its decoding table."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.int64)
        if len(self.lengths) > 1 << 27:
            raise ValueError("ids don't fit 27 bits")
        used = np.flatnonzero(self.lengths)
        used = used[np.argsort(self.lengths[used], kind="stable")]
        self.bits = max(1, int(self.lengths.max(initial=1)))
        sizes = self.lengths[used]
        spans = np.left_shift(1, self.bits - sizes)
        begins = np.cumsum(spans) - spans
        # codes stand at the upper end of 64 bits; an entry of the table is a symbol and, in its lowest five bits, the length
        self.codes = np.zeros(len(self.lengths), np.uint64)
        self.codes[used] = begins.astype(np.uint64) << np.uint64(64 - self.bits)
        self.table = np.ones(1 << self.bits, np.uint32)
        filled = int(spans.sum())
        self.table[:filled] = np.repeat(used << 5 | sizes, spans)

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The codes of ``ids`` one after another, and the bit offset of every STEP-th."""
        sizes = self.lengths[ids]
        if len(ids) and not sizes.min():
            raise ValueError("an id has no code")
        ends = np.cumsum(sizes)
        begins = ends - sizes
        total = int(ends[-1]) if len(ids) else 0
        words = np.zeros(total // 64 + 2, np.uint64)
        if len(ids):
            at, inside = begins >> 6, (begins & 63).astype(np.uint64)
            value = self.codes[ids]
            cut = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
            words[at[cut]] = np.bitwise_or.reduceat(value >> inside, cut)
            # at most one code goes over the end of each word
            over = np.flatnonzero((ends - 1) >> 6 != at)
            words[at[over] + 1] |= value[over] << (np.uint64(64) - inside[over])
        return words.astype(">u8").tobytes()[: (total + 7) // 8], begins[::STEP].astype("<u4")

    def unpack(self, data: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        """``n`` ids, decoded from all bit offsets in step."""
        raw = np.frombuffer(data + bytes(STEP * self.bits // 8 + 8), np.uint8).astype(np.uint32)
        word = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        at, shift, mask = offsets.astype(np.int64), 32 - self.bits, np.uint32((1 << self.bits) - 1)
        out = np.empty((STEP, len(at)), np.uint32)
        for k in range(STEP):
            key = (word[at >> 3] >> (shift - (at & 7)).astype(np.uint32)) & mask
            out[k] = self.table[key]
            at += out[k] & 31
        return (out >> 5).T.reshape(-1)[:n]


def frame(code: Code, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One block: head, document ids, counts, bit offsets, codes."""
    data, offsets = code.pack(ids)
    body = doc_ids.astype("<i8").tobytes() + counts.astype("<u4").tobytes() + offsets.tobytes() + data
    return _HEAD.pack(b"HUF1", len(doc_ids), len(ids), len(offsets), STEP, len(data), zlib.crc32(body)) + body


def unframe(code: Code, block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, counts, ids) of a block."""
    magic, docs, n, lanes, step, size, crc = _HEAD.unpack_from(block)
    body = block[_HEAD.size :]
    if magic != b"HUF1" or step != STEP or len(body) != 12 * docs + 4 * lanes + size or zlib.crc32(body) != crc:
        raise ValueError("damaged block")
    a, b, c = 8 * docs, 12 * docs, 12 * docs + 4 * lanes
    return np.frombuffer(body[:a], "<i8"), np.frombuffer(body[a:b], "<u4").astype(np.int64), code.unpack(body[c:], np.frombuffer(body[b:c], "<u4"), n)


def write(tokens: DataFrame, path: str) -> None:
    """Write (id, n_tokens, ids) as ``path/code`` (one row for each id in use) and ``path/blocks`` (ascending ids).

    Only the counts by token come to the driver: at most one row for each id of the vocabulary.
    """
    spark = tokens.sparkSession
    found = count_ids(tokens).toPandas().sort_values("token")
    used, n = found["token"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
    lengths = np.zeros(int(used.max(initial=0)) + 1, np.int64)
    lengths[used] = code_lengths(n)
    rows = [(int(t), int(lengths[t])) for t in used]
    spark.createDataFrame(rows, "token long, length long").coalesce(1).write.parquet(f"{path}/code")
    sizes = lengths.astype(np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, shard, start = Code(sizes), TaskContext.get().partitionId(), 0
        doc_ids: list[int] = []
        held: list[bytes] = []
        counts: list[int] = []
        size = 0

        def block() -> pa.RecordBatch:
            own = frame(code, np.array(doc_ids, np.int64), np.array(counts, np.int64), _ids(held, size))
            values = [[shard], [start], [size], [len(held)], [own]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["shard", "start", "n_ids", "n_docs", "block"])

        for b in batches:
            for i, n, data in zip(*(c.to_pylist() for c in b.columns)):
                doc_ids.append(_NO_ID if i is None else i)
                held.append(data)
                counts.append(n)
                size += n
                if size >= BLOCK_IDS:
                    yield block()
                    doc_ids, held, counts, start, size = [], [], [], start + size, 0
        if held:
            yield block()

    # rows of one id, null included, are split as well: by a hash of their ids, equal ones by their number
    dealt = tokens.select("id", "n_tokens", "ids", F.xxhash64("ids").alias("h"), F.monotonically_increasing_id().alias("r"))
    ordered = dealt.repartitionByRange("id", "h", "r").sortWithinPartitions("id", "h", "r").select("id", "n_tokens", "ids")
    ordered.mapInArrow(run, "shard long, start long, n_ids long, n_docs long, block binary").write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids) of every document under ``path``; start counts the ids of all documents before it."""
    code = spark.read.parquet(f"{path}/code").toPandas()
    lengths = np.zeros(int(code["token"].max()) + 1 if len(code) else 1, np.uint8)
    lengths[code["token"].to_numpy(np.int64)] = code["length"]
    kind = T.StructType([T.StructField("shard", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("n_docs", T.LongType()), T.StructField("block", T.BinaryType())])
    blocks = spark.read.schema(kind).parquet(f"{path}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Code(lengths)
        for b in batches:
            for shard, start, block in zip(*(c.to_pylist() for c in b.columns)):
                doc_ids, counts, ids = unframe(made, block)
                data, ends = ids.astype("<u4").tobytes(), np.cumsum(counts)
                rows = [data[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=doc_ids == _NO_ID), pa.array(np.full(len(rows), shard)), pa.array(start + ends - counts), pa.array(counts), pa.array(rows, pa.binary())], ["id", "shard", "inside", "n_tokens", "ids"])

    docs = blocks.select("shard", "start", "block").mapInArrow(run, "id long, shard long, inside long, n_tokens long, ids binary")
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row for each written partition, a few bytes each: its number is fixed when the table is written
    bases = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("base"))
    return docs.join(F.broadcast(bases), "shard").select("id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids")


def crc32_of(ids) -> F.Column:
    """The unsigned crc32 of a binary column."""
    return F.crc32(ids)


def roundtrip(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize ``docs`` once, write them under ``path`` and read them back."""
    tokens = stored(tokenize(docs, tokenizer, end_id, id_col, text_col), "token-ids")
    write(tokens, path)
    discard(tokens)
    return read(docs.sparkSession, path)
