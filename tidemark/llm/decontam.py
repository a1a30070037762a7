"""Benchmark decontamination with an FM-index for each shard of the corpus.

``index`` cuts the documents' words into shards and stores one FM-index for each: the shard's own word list, the
Burrows-Wheeler transform in a wavelet matrix, sampled suffix positions. It depends on no benchmark, so one index serves
any number of them. ``search`` looks up all windows of the items in each shard: backward search through wavelet ranks, places
from sampled suffixes, then overlapping places of a document become spans to remove. ``cleaned`` removes them.

A window is ``window`` consecutive words of an item; an item with fewer words, but not none, is one window.
Words: ``words.py``. Every window is looked up in every shard, nothing is sampled; a window
is found exactly where its words are.

Memory: a shard holds about ``shard_bytes`` of text. A longer text lies in several segments that share
``window - 1`` words. Items are cut the same way, made distinct and searched in blocks of about ``BLOCK_WORDS`` words: a block
is all that is sent to the workers at once, however large the benchmark is.

Defined results: a null or empty text has no words and no hits. Documents are rows: repeated rows and ids, null ids included, each get a row.
Items of equal id count once; an item without an id hits words and counts as the id ''. No documents give no rows; no items give
no hits. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, ranges, stored
from .fmindex import Index, build
from .words import of_texts, portions

WINDOW = 10
#: Words of items that are searched at once, about.
BLOCK_WORDS = 1 << 20

_FOUND = "id {id}, row long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def _segments(batches: Iterator[pa.RecordBatch], window: int, limit: int) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, int, int, bool]]:
    """(rows, words, counts, first, shared, ends): words of whole rows, or of a part of one long row.

    A part begins with the last ``shared`` words of the part before, ``window - 1`` or all that there were; ``first`` is the number of its first word.
    """
    held, first = None, 0
    for rows, found, begins, ends in portions(batches, "text", limit):
        words, counts, shared = found.words, found.counts, 0
        if begins:
            first = 0
        else:
            shared = len(held)
            words, counts = pa.concat_arrays([held, words]), counts + shared
        yield rows, words, counts, first, shared, ends
        held = words[max(0, len(words) - window + 1) :]
        first += len(words) - len(held)


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row for each shard, stored: its segments (``id``, ``row``, words of its own, first word) and its FM-index. Finds windows of up to ``window`` words."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    names = ["id", "row", "own", "first", "counts", "vocabulary", "n", "n_symbols", "levels", "marks", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, counts, first, shared, _ in _segments(batches, window, shard_bytes):
            coded = pc.dictionary_encode(words)
            made = build(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1, counts)
            whole = [pa.array([x], pa.list_(t)) for x, t in ((counts - shared, pa.int64()), (np.full(len(counts), first), pa.int64()), (counts, pa.int64()))]
            ids = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(k)) for k in (0, 1)]
            vocabulary = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
            fields = [pa.array([x], t) for x, t in zip(made, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*ids, *whole, vocabulary, *fields], names)

    made = rows.mapInArrow(run, f"id array<{kind}>, row array<long>, own array<long>, first array<long>, counts array<long>, vocabulary array<binary>, n int, n_symbols int, levels binary, marks binary, places binary")
    return stored(made, "fm-index")


def phrases(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, shard_bytes: int = SLICE_BYTES) -> DataFrame:
    """(item, words): the items' word lists, long ones in parts that share ``window - 1`` words, each once. Stored."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, counts, first, _, ends in _segments(batches, window, shard_bytes):
            if len(counts) == 1 and counts[0] < window and not (ends and first == 0):
                continue  # the next part holds these words too
            edges = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(edges, words)], ["item", "words"])

    lists = rows.mapInArrow(run, "item string, words array<binary>").where("size(words) > 0")
    # parts of at most BLOCK_WORDS / 8 words, so that blocks are even
    step = max(1, BLOCK_WORDS // 8 - window + 1)
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(step)))
    parts = lists.select("item", "words", at.alias("at")).select("item", F.slice("words", F.col("at") + 1, F.lit(step + window - 1)).alias("words"))
    return stored(parts.distinct(), "phrases")


def _windows(block: pa.Table, window: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(words, phrases, lengths, edges, owners, items): distinct windows, right-aligned rows of word numbers, and for each the numbers of its items, ``owners[edges[i]:edges[i + 1]]``."""
    lists = block.column("words").combine_chunks()
    coded = pc.dictionary_encode(lists.flatten())
    ids, counts = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(counts) - counts
    n_windows = np.maximum(counts - window + 1, 1)
    lengths = np.repeat(np.minimum(counts, window), n_windows)
    last = ranges(starts, n_windows) + lengths - 1
    at = last[:, None] - np.arange(window - 1, -1, -1)
    rows = np.where(np.arange(window) >= window - lengths[:, None], ids[np.maximum(at, 0)], -1)
    names = pc.dictionary_encode(block.column("item").combine_chunks())
    owner = np.repeat(names.indices.to_numpy(zero_copy_only=False).astype(np.int64), n_windows)
    distinct, number = np.unique(rows, axis=0, return_inverse=True)
    pairs = np.unique(number.reshape(-1) * max(1, len(names.dictionary)) + owner)
    number, owner = np.divmod(pairs, max(1, len(names.dictionary)))
    return coded.dictionary, distinct, (distinct >= 0).sum(1), np.searchsorted(number, np.arange(len(distinct) + 1)), owner, names.dictionary


def _merged(segment: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of equal segment that touch or overlap become one."""
    order = np.lexsort((start, segment))
    segment, start, end = segment[order], start[order], end[order]
    far = int(end.max()) + 1 if len(end) else 1
    reach = np.maximum.accumulate(segment * far + end)
    head = np.ones(len(start), bool)
    head[1:] = segment[1:] * far + start[1:] > reach[:-1]
    head[1:] |= segment[1:] != segment[:-1]
    at = np.flatnonzero(head)
    return segment[at], start[at], (reach[np.append(at[1:], len(start)) - 1] - segment[at] * far) if len(at) else end[:0]


def _lists(owner: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32())


def _blocks(items: DataFrame, window: int) -> Iterator[tuple]:
    total = items.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    n = -(-total // BLOCK_WORDS)
    for k in range(n):
        yield _windows(items.where(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == k).toArrow(), window)


def search(shards: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, row, n_words, spans, items) for every document of an index: what ``phrases`` made of the items is looked up block by block.

    ``spans`` are the ranges of word numbers, end excluded, that lie in some window's occurrence; ``items`` the ids of the items with one, sorted.
    """
    kind = shards.schema["id"].dataType.elementType.simpleString()
    out = _found(shards, None, kind)
    for block in _blocks(items, window):
        out = out.unionByName(_found(shards, block, kind))
    touching = F.array_sort(F.flatten(F.collect_list("spans")))
    grouped = out.groupBy("row").agg(F.first("id").alias("id"), F.sum("n_words").alias("n_words"), touching.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return grouped.withColumn("spans", _joined(F.col("spans")))


def _joined(spans: Column) -> Column:
    """Sorted spans, those that touch made one. Only a text in parts or hit by several blocks has any to join."""
    empty = F.lit([]).cast("array<struct<start:bigint,end:bigint>>")

    def step(done: Column, s: Column) -> Column:
        top = F.element_at(done, -1)
        longer = F.struct(top["start"].alias("start"), F.greatest(top["end"], s["end"]).alias("end"))
        joins = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"])
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return F.when(F.size(spans) < 2, spans).otherwise(F.aggregate(spans, empty, step))


def _found(shards: DataFrame, block: tuple | None, kind: str) -> DataFrame:
    """Segments with what a block of windows hits in them; without a block, the segments with their numbers of words."""
    if block is None:
        each = shards.select(F.explode(F.arrays_zip("id", "row", "own")).alias("s"))
        none = F.lit([]).cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.lit([]).cast("array<string>").alias("items")
        return each.select("s.id", "s.row", F.col("s.own").alias("n_words"), *none)
    words, wanted, lengths, edges, owners, names = block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in (batch.slice(i, 1) for i in range(batch.num_rows)):
                col = {c: one.column(k)[0] for k, c in enumerate(one.schema.names)}
                known = np.append(pc.fill_null(pc.index_in(words, value_set=col["vocabulary"].values), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1, -1)
                own = known[wanted]
                # words that the shard lacks are 0 here: no suffix begins with them
                own[own == 0] = -1
                ix = Index(*(col[c].as_py() for c in ("n", "n_symbols", "levels", "marks", "places")))
                low, high = ix.count(own, lengths)
                phrase = np.repeat(np.arange(len(low)), high - low)
                place = ix.locate(ranges(low, high - low))
                counts, first = (col[c].values.to_numpy(zero_copy_only=False) for c in ("counts", "first"))
                begins = np.cumsum(counts + 1) - counts - 1
                segment = np.searchsorted(begins, place, "right") - 1
                start = place - begins[segment] + first[segment]
                s, a, z = _merged(segment, start, start + lengths[phrase])
                hits = np.unique(np.repeat(segment * len(names), edges[phrase + 1] - edges[phrase]) + owners[ranges(edges[phrase], edges[phrase + 1] - edges[phrase])])
                seg, item = np.divmod(hits, max(1, len(names)))
                hit = np.unique(s)
                spans = pa.ListArray.from_arrays(_lists(np.searchsorted(hit, s), len(hit)), pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["start", "end"]))
                items = pa.ListArray.from_arrays(_lists(np.searchsorted(hit, seg), len(hit)), names.take(pa.array(item)))
                yield pa.RecordBatch.from_arrays([col["id"].values.take(pa.array(hit)), col["row"].values.take(pa.array(hit)), pa.array(np.zeros(len(hit)), pa.int64()), spans, items], ["id", "row", "n_words", "spans", "items"])

    return shards.select("id", "row", "counts", "first", "vocabulary", "n", "n_symbols", "levels", "marks", "places").mapInArrow(run, _FOUND.format(id=kind))


def cleaned(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the text of the spans, from each one's first word to its last. Ids must be unique; a document that ``found`` lacks stays as it is."""
    hit = found.where("size(spans) > 0").select(F.col("id").alias("__id"), F.col("spans").alias("__spans"))

    @F.pandas_udf("string")
    def without(texts, spans):
        out = []
        for text, at in zip(texts, spans):
            if text is not None and at is not None and len(at):
                raw, w = text.encode(), of_texts(pa.array([text]))
                keep = [0, *(x for s in at for x in (int(w.starts[s["start"]]), int(w.ends[s["end"] - 1]))), len(raw)]
                text = b"".join(raw[a:b] for a, b in zip(keep[::2], keep[1::2])).decode()
            out.append(text)
        return pd.Series(out, dtype=object)

    kept = [F.col(c) if c != text_col else F.when(F.col("__spans").isNull(), F.col(c)).otherwise(without(F.col(c), F.col("__spans"))).alias(c) for c in docs.columns]
    return docs.join(hit, F.col(id_col) == F.col("__id"), "left").select(*kept)


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each document: its words, how many of them are hit, and the items as their number and a SHA-256 of their sorted ids."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans", "items",
    )
