"""Exact nearest vectors by cosine over an inverted file: cells around centroids, probed as far as the triangle inequality asks for."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.scratch import new_path, stored

#: Sampled vectors for each centroid, rounds of k-means, digits of a score, room for rounding in distances.
SAMPLE, ROUNDS, DIGITS, SLACK = 64, 8, 6, 2e-3


class Index(NamedTuple):
    """``rows`` (cell, key, unit, gap) with ``cell`` as a partition column, gap the distance to its centroid; the centroids; radius and size of each cell."""

    rows: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    size: np.ndarray


def units(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, unit): vectors of length 1. A null vector, one with a null or infinite component or of length 0 has no direction and no row."""
    v = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    rows = vectors.select(F.col(key).alias("key"), v.alias("v"), norm.alias("norm")).where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    return rows.select("key", F.transform("v", lambda x: x / F.col("norm")).alias("unit"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _flat(values: pa.Array, rows: int) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).reshape(rows, -1)


def _gaps(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((rows * rows).sum(1)[:, None] + (centres * centres).sum(1) - 2 * rows @ centres.T, 0))


def centroids(rows: DataFrame, cells: int) -> np.ndarray:
    """At most ``cells`` centroids by k-means on at most ``SAMPLE * cells`` rows, those of the smallest hashes."""
    taken = rows.orderBy(F.xxhash64("key", "unit"), "key").limit(SAMPLE * cells).select("unit").toArrow().column(0).combine_chunks()
    if not len(taken):
        return np.zeros((0, 1))
    sample = _matrix(taken, len(taken) and len(taken[0]))
    centres = np.unique(sample[:: max(1, len(sample) // cells)][:cells], axis=0)
    for _ in range(ROUNDS):
        of = _gaps(sample, centres).argmin(1)
        centres = np.stack([sample[of == k].mean(0) if (of == k).any() else centres[k] for k in range(len(centres))])
    return centres


def build(vectors: DataFrame, key: str, vector: str, cells: int = 256, path: str | None = None) -> Index:
    """The index of all rows, written under ``path`` (else in the shared folder) with one folder for each cell. Vectors must be of one length."""
    rows = units(vectors, key, vector)
    centres = centroids(rows, cells)
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gaps = _gaps(_matrix(b.column(1), centres.shape[1]), centres)
            cell = gaps.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int32()), pa.array(gaps[np.arange(len(cell)), cell])], ["key", "unit", "cell", "gap"])

    path = path or new_path(vectors.sparkSession, "vectors")
    schema = f"key {kind}, unit array<double>, cell int, gap double"
    rows.mapInArrow(run, schema).write.partitionBy("cell").parquet(path)
    out = vectors.sparkSession.read.schema(schema).parquet(path)
    radius, size = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in out.groupBy("cell").agg(F.max("gap").alias("radius"), F.count("*").alias("n")).collect():
        radius[r.cell], size[r.cell] = r.radius, r.n
    return Index(out, centres, radius, size)


def _probes(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """(query, q, cell, far, first, reach): every cell of every query with its distance; ``first`` marks the nearest ones that hold ``k`` rows together."""
    kind = queries.schema["query"].dataType.simpleString()
    centres, radius, size = index.centres, index.radius, index.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gaps = _gaps(_matrix(b.column(1), centres.shape[1]), centres)
            order = gaps.argsort(1)
            held = np.cumsum(size[order], 1)
            first = np.zeros(gaps.shape, bool)
            np.put_along_axis(first, order, held - size[order] < k, 1)
            row, cell = (x.reshape(-1) for x in np.indices(gaps.shape))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(cell, pa.int32()), pa.array(gaps[row, cell]), pa.array(first[row, cell]), pa.array(radius[cell])],
                ["query", "q", "cell", "far", "first", "radius"],
            )

    return queries.mapInArrow(run, f"query {kind}, q array<double>, cell int, far double, first boolean, radius double")


#: Queries and rows of a block; a pair of blocks is one product of matrices.
ASKED, HELD = 512, 2048
#: Pairs that leave a task at once.
SENT = 1 << 17


def _blocks(rows: DataFrame, key: str, vector: str, size: int, names: tuple[str, str]) -> DataFrame:
    """(cell, block, and two lists of about ``size`` keys in ascending order and their vectors), the rows of a cell dealt by a hash of their keys."""
    n = rows.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias("n"))
    dealt = rows.join(F.broadcast(n), "cell").groupBy("cell", F.pmod(F.xxhash64(key), "n").alias("block")).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col(vector).alias("v")))).alias("rows"))
    return dealt.select("cell", "block", F.col("rows")["key"].alias(names[0]), F.flatten(F.col("rows")["v"]).alias(names[1]))


def _best(asked: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """(query, key, score): for each query of ``asked`` (cell, query, q) its ``k`` best rows in each block of ``held``, by score to ``DIGITS`` digits, then key."""
    kinds = asked.schema["query"].dataType.simpleString(), held.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                queries, q, keys, v = (c[i].values for c in b.columns)
                x = _flat(q, len(queries)) @ _flat(v, len(keys)).T
                x = np.copysign(np.floor(np.abs(x) * 10**DIGITS + 0.5), x)
                if x.shape[1] > k:
                    least = np.partition(x, x.shape[1] - k, 1)[:, x.shape[1] - k]
                    row, col = np.nonzero(x >= least[:, None])
                else:
                    row, col = (z.reshape(-1) for z in np.indices(x.shape))
                # keys of a block ascend, so the order of columns breaks ties
                order = np.lexsort((col, -x[row, col], row))
                row, col = row[order], col[order]
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                row, col = row[nth < k], col[nth < k]
                yield pa.RecordBatch.from_arrays([queries.take(pa.array(row)), keys.take(pa.array(col)), pa.array(x[row, col] / 10**DIGITS + 0.0)], ["query", "key", "score"])

    left = _blocks(asked, "query", "q", ASKED, ("queries", "q"))
    pairs = left.join(held, "cell").select("queries", "q", "keys", "v")
    return pairs.mapInArrow(run, f"query {kinds[0]}, key {kinds[1]}, score double")


def cosines(asked: DataFrame, held: DataFrame, group: str) -> DataFrame:
    """(query, key, cosine): every row of ``asked`` (group, query, q) with every row of ``held`` (group, key, v) of its group, to ``DIGITS`` digits; 0 where a vector is zero, null where one is null or has a null component (SIM-08).

    The rows are as many as the pairs. Blocks of a group's rows meet blocks of its queries, each pair one product of matrices, and each block of rows is a key of its own, so a large group
    is the work of many tasks. Vectors must be of one length.
    """
    kinds = asked.schema["query"].dataType.simpleString(), held.schema["key"].dataType.simpleString()
    whole = lambda c: F.coalesce(F.forall(c, lambda x: x.isNotNull()), F.lit(False))
    a = asked.select(F.col(group).alias("cell"), "query", F.col("q").cast("array<double>").alias("q"))
    h = held.select(F.col(group).alias("cell"), "key", F.col("v").cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                queries, q, keys, v = (c[i].values for c in b.columns)
                x, y = _flat(q, len(queries)), _flat(v, len(keys))
                if x.shape[1] != y.shape[1]:
                    raise ValueError("vectors of unequal length")
                left, right = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
                step = max(1, SENT // len(keys))
                for at in range(0, len(queries), step):
                    norm = left[at : at + step, None] * right
                    z = np.divide(x[at : at + step] @ y.T, norm, out=np.zeros_like(norm), where=norm != 0)
                    z = np.copysign(np.floor(np.abs(z) * 10**DIGITS + 0.5), z) / 10**DIGITS + 0.0
                    row, col = (n.reshape(-1) for n in np.indices(z.shape))
                    yield pa.RecordBatch.from_arrays([queries.take(pa.array(row + at)), keys.take(pa.array(col)), pa.array(z.reshape(-1))], ["query", "key", "cosine"])

    left = _blocks(a.where("cell is not null").where(whole("q")), "query", "q", ASKED, ("queries", "q")).drop("block")
    right = _blocks(h.where("cell is not null").where(whole("v")), "key", "v", HELD, ("keys", "v"))
    every = right.groupBy("cell").agg(F.collect_list("block").alias("blocks"))
    dealt = left.join(every, "cell").select("cell", F.explode("blocks").alias("block"), "queries", "q")
    pairs = dealt.hint("shuffle_hash").join(right, ["cell", "block"]).select("queries", "q", "keys", "v")
    found = pairs.mapInArrow(run, f"query {kinds[0]}, key {kinds[1]}, cosine double")
    none = lambda x, y: x.join(y, "cell").select("query", "key", F.lit(None).cast("double").alias("cosine"))
    return found.unionByName(none(a.where(~whole("q")), h)).unionByName(none(a.where(whole("q")), h.where(~whole("v"))))


def nearest(queries: DataFrame, index: Index, k: int, key: str, vector: str) -> DataFrame:
    """(query, key, score, rank): the ``k`` rows of the greatest cosine for each query, to six digits; equal ones by key (SIM-08, TOP-02). Exact.

    The cells next to a query that hold ``k`` rows give a k-th score, so a distance within which all better rows lie. Then the cells that reach into it are
    compared: blocks of queries with blocks of rows, each pair one product of matrices of which only the ``k`` best of each query leave the task.
    """
    asked = units(queries, key, vector).select(F.col("key").alias("query"), F.col("unit").alias("q"))
    probes = stored(_probes(asked, index, k), "probes")
    order = W.partitionBy("query").orderBy(F.col("score").desc(), "key")
    best = lambda t: t.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    held = stored(_blocks(index.rows, "key", "unit", HELD, ("keys", "v")).withColumn("key", F.get("keys", F.lit(0))), "vector-blocks")
    near = _best(probes.where("first").select("cell", "query", "q"), held, k)
    worst = best(near).groupBy("query").agg(F.min("score").alias("score"), F.count("*").alias("n"))
    # of vectors of length 1: distance^2 = 2 - 2 cosine
    reach = F.when(F.col("n") == k, F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))) + SLACK).otherwise(3.0)
    open_ = stored(probes.join(worst.select("query", reach.alias("reach")), "query").where(F.col("far") - F.col("radius") <= F.col("reach")).select("cell", "query", "q"), "open-probes")
    return best(_best(open_, held, k))
