"""Ranked lexical search, reversed: the items are the index and the documents stream through it.

``counts`` reads each text once and keeps a short row for it: how many terms it has, and how often each term
that some item uses. The number of documents, their terms and the document frequencies are sums over these rows. ``ranked`` sends
an inverted index (term to items) to the workers; each task runs its documents' rows through it, adds up the scores of a batch and keeps
the best ``k`` documents of each item in a heap of fixed size. The heaps of all tasks then meet in one ranking for each item.

Items are taken in blocks of about ``BLOCK_TERMS`` distinct terms of an item; a block's terms are all that is sent to the workers at once.
Terms: the words of ``words.py``. Scores are whole numbers, as ``weight`` and ``ranked`` say; equal ones go by ascending id.

Defined results: a null text has no terms, counts in no number and is never found. Repeated documents are documents of their own. A document without an id counts
like any other and, where scores are equal, comes after those with one. Items of equal id are
one item with the terms of all of them; an item without an id, or without terms, or whose terms are nowhere, has no rows. An empty
table on either side gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, ranges, stored
from .words import portions

#: Pairs of item and term in a block of items, about; cells of scores that are added up at once.
BLOCK_TERMS, CELLS = 1 << 20, 1 << 19
#: Stands for a null id inside a task: such documents come last. No document may have it.
NO_ID = (1 << 63) - 1


def weight(n: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((2 N + 2) / (2 df + 1)))."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term), each pair once. Stored."""
    kind = items.schema[id_col].dataType.simpleString()
    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found, _, _ in portions(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), found.counts))), found.words], ["item", "term"])

    return stored(rows.mapInArrow(run, f"item {kind}, term binary").distinct(), "item-terms")


def counts(docs: DataFrame, terms: pa.Array, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(id, n, terms, tf) of each document with a term: its number of terms, and numbers and counts of those in ``terms`` (int32 arrays as bytes). Stored."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, total, held = max(1, len(terms)), 0, (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for part, found, begins, ends in portions(batches, "text", slice_bytes):
            known = pc.fill_null(pc.index_in(found.words, value_set=terms), -1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(part.num_rows), found.counts)[known >= 0]
            keys, tf = np.unique(row * size + known[known >= 0], return_counts=True)
            n = found.counts
            if not begins:
                n = n + total
                both = np.concatenate([held[0], keys])
                keys, at = np.unique(both, return_inverse=True)
                tf = np.bincount(at, np.concatenate([held[1], tf]), len(keys)).astype(np.int64)
            if not ends:
                total, held = n, (keys, tf)
                continue
            row, term = np.divmod(keys, size)
            edges = pa.array(4 * np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
            packed = [pa.Array.from_buffers(pa.binary(), part.num_rows, [None, edges.buffers()[1], pa.py_buffer(x.astype("<i4"))]) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *packed], ["id", "n", "terms", "tf"])

    return stored(rows.mapInArrow(run, "id long, n long, terms binary, tf binary").where("n > 0"), "term-counts")


def frequencies(counted: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """(N, L, df of each term) over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(n_terms, np.int64), 0, 0
        for b in batches:
            for terms in b.column(1):
                df[np.frombuffer(terms.as_buffer(), "<i4")] += 1
            n, total = n + b.num_rows, total + (pc.sum(b.column(0)).as_py() or 0)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *at.tolist()], pa.int64()), pa.array([n, total, *df[at].tolist()], pa.int64())], ["term", "n"])

    sums = counted.select("n", "terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = (sums.column(c).to_numpy() for c in ("term", "n"))
    df = np.zeros(n_terms, np.int64)
    df[term[term >= 0]] = n[term >= 0]
    return int(n[term == -2].sum()), int(n[term == -1].sum()), df


class Heaps:
    """The best ``k`` documents of each item so far: scores and ids, best first, in one array of items times k."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.scores, self.ids = np.zeros((n_items, k), np.int64), np.zeros((n_items, k), np.int64)

    def offer(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores above 0 of documents; those below an item's last kept one are passed over."""
        keep = score >= self.scores[item, -1]
        item, score, ids = item[keep], score[keep], ids[keep]
        if not len(item):
            return
        hit = np.unique(item)
        item = np.concatenate([np.repeat(hit, self.k), item])
        score, ids = np.concatenate([self.scores[hit].reshape(-1), score]), np.concatenate([self.ids[hit].reshape(-1), ids])
        order = np.lexsort((ids, -score, item))
        item, score, ids = item[order], score[order], ids[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        best = rank < self.k
        self.scores[item[best], rank[best]], self.ids[item[best], rank[best]] = score[best], ids[best]


def scored(counted: DataFrame, postings: tuple[np.ndarray, np.ndarray], n_items: int, weights: np.ndarray, n: int, total: int, k: int, cells: int = CELLS) -> DataFrame:
    """(item number, id, score): each task's best ``k`` documents of each item. ``postings``: edges by term, and item numbers."""
    edges, of = postings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps, step = Heaps(n_items, k), max(1, cells // max(1, n_items))
        for whole in batches:
            for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                terms, tf = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<i4").astype(np.int64) for c in (2, 3))
                row = np.repeat(np.arange(b.num_rows), pc.binary_length(b.column(2)).to_numpy(zero_copy_only=False) // 4)
                # in Python's numbers: the product can pass 64 bits
                m = np.array([10 + 90 * x * n // total for x in b.column(1).to_pylist()], np.int64)
                part = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
                spread = edges[terms + 1] - edges[terms]
                score = np.zeros(b.num_rows * n_items, np.int64)
                np.add.at(score, np.repeat(row * n_items, spread) + of[ranges(edges[terms], spread)], np.repeat(part, spread))
                hit = np.flatnonzero(score)
                r, item = np.divmod(hit, n_items)
                heaps.offer(item, score[hit], pc.fill_null(b.column(0), NO_ID).to_numpy(zero_copy_only=False)[r])
        item, at = np.nonzero(heaps.scores)
        ids = heaps.ids[item, at]
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(heaps.scores[item, at], pa.int64())], ["item", "id", "score"])

    return counted.select("id", "n", "terms", "tf").mapInArrow(run, "item long, id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(item, rank, id, score): the ``k`` best documents of each item with a score above 0.

    A document's m is 100 - 90 + ((90 * n * N) div L); its score sums weight * ((1000000000 * tf) div (1000 * tf + 8 * m)) over the item's distinct terms.
    """
    pairs = item_terms(items, item_col, item_text)
    n_blocks = -(-pairs.count() // BLOCK_TERMS)
    out = docs.sparkSession.createDataFrame([], f"item {pairs.schema['item'].dataType.simpleString()}, id long, score long")
    for block in range(n_blocks):
        own = pairs.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block).toArrow().combine_chunks()
        if not own.num_rows:
            continue
        terms, names = (pc.dictionary_encode(own.column(c).combine_chunks()) for c in ("term", "item"))
        term, item = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (terms, names))
        by = np.argsort(term, kind="stable")
        edges = np.searchsorted(term[by], np.arange(len(terms.dictionary) + 1))
        counted = counts(docs, terms.dictionary, id_col, text_col, slice_bytes)
        n, total, df = frequencies(counted, len(terms.dictionary))
        if not n:
            continue
        found = scored(counted, (edges, item[by]), len(names.dictionary), weight(n, df), n, total, k, CELLS)
        called = docs.sparkSession.createDataFrame(pa.table({"number": pa.array(np.arange(len(names.dictionary))), "name": names.dictionary}))
        out = out.unionByName(found.join(called, F.col("item") == F.col("number")).select(F.col("name").alias("item"), "id", "score"))
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item", "rank", "id", "score")
