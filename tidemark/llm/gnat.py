"""A multiway hyperplane tree over vectors with distance ranges between sibling subtrees, and exact window searches in it.

Each inner node has up to ``FAN`` split points, far apart from each other; a row belongs to the child of its nearest one, so
the hyperplanes between the points part the children. For each child and each split point the node keeps the least and greatest distance
from that point to a row below the child, and from the origin. A search asks for rows whose inner product with a vector lies in a window.
With the norms of a subtree, that is an annulus of distances around the vector; by the triangle inequality, a child one of whose ranges the
annulus misses has no such row. Leaves are read exactly, in whole numbers.

An ask moves to every leaf that can hold an answer, which in many dimensions are most, so leaves are few and large.

The split points are chosen from a sample of at most ``SAMPLE`` rows, so the tree's size is bounded; every row is put into a leaf and the
ranges are those of all rows. A leaf that holds very many rows is cut into pages of ``PAGE`` rows, which different tasks read. Vectors and
asks are packed as bytes, so a task multiplies blocks of them.

Defined results: see ``negatives``, the operator for hard-negative mining that uses the tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

#: Split points of a node; rows of the sample; a node of fewer sampled rows is a leaf; rows of a page and asks of a block.
FAN, SAMPLE, LEAF, PAGE, BLOCK = 8, 8192, 512, 1024, 128
#: Room for rounding in distances.
SLACK = 1e-6


class Node(NamedTuple):
    """Split points and, for each, the number of the child: a node if ``inner``, else a leaf."""

    points: np.ndarray
    child: np.ndarray
    inner: np.ndarray


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of two integer matrices."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    raise ValueError("inner products of these vectors pass 64 bits")


def distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows to all points."""
    r, p = rows.astype(np.float64), points.astype(np.float64)
    return np.sqrt(np.maximum((r * r).sum(1)[:, None] + (p * p).sum(1) - 2 * r @ p.T, 0))


def grow(sample: np.ndarray, fan: int = FAN, leaf: int = LEAF) -> list[Node]:
    """The tree for a sample, nodes in the order in which they are reached; the root is node 0. An empty list is one leaf."""
    nodes: list[Node] = []
    leaves, todo = 0, [(sample, None)]
    while todo:
        rows, place = todo.pop(0)
        picked = [0] if len(rows) >= leaf else []
        near = distances(rows, rows[:1])[:, 0] if picked else np.zeros(0)
        # the next split point is the row farthest from those so far
        while picked and len(picked) < fan and near.max() > 0:
            picked.append(int(near.argmax()))
            near = np.minimum(near, distances(rows, rows[picked[-1:]])[:, 0])
        number, inner = (len(nodes), True) if len(picked) > 1 else (leaves, False)
        if place is not None:
            nodes[place[0]].child[place[1]], nodes[place[0]].inner[place[1]] = number, inner
        if not inner:
            leaves += 1
            continue
        points = rows[picked]
        nodes.append(Node(points, np.zeros(len(points), np.int64), np.zeros(len(points), bool)))
        of = distances(rows, points).argmin(1)
        todo += [(rows[of == k], (number, k)) for k in range(len(points))]
    return nodes


def descend(nodes: list[Node], rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(node, rows that reach it, their distances to its points, child of each)."""
    todo = [(0, np.arange(len(rows)))] if nodes else []
    while todo:
        node, at = todo.pop()
        d = distances(rows[at], nodes[node].points)
        of = d.argmin(1)
        yield node, at, d, of
        for k in np.flatnonzero(nodes[node].inner):
            if (of == k).any():
                todo.append((int(nodes[node].child[k]), at[of == k]))


def leaf_of(nodes: list[Node], rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.int64)
    for node, at, _, of in descend(nodes, rows):
        last = ~nodes[node].inner[of]
        out[at[last]] = nodes[node].child[of[last]]
    return out


class Ranges:
    """For each node: least and greatest distance from each split point, and at last from the origin, to the rows of each child; empty children have least > greatest."""

    def __init__(self, nodes: list[Node]):
        self.low = [np.full((len(n.points), len(n.points) + 1), np.inf) for n in nodes]
        self.high = [np.full((len(n.points), len(n.points) + 1), -np.inf) for n in nodes]

    def add(self, nodes: list[Node], rows: np.ndarray) -> None:
        norm = np.sqrt((rows.astype(np.float64) ** 2).sum(1))
        for node, at, d, of in descend(nodes, rows):
            every = np.concatenate([d, norm[at][:, None]], 1)
            np.minimum.at(self.low[node], of, every)
            np.maximum.at(self.high[node], of, every)


def leaves_in(nodes: list[Node], seen: Ranges, asks: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ask, leaf): leaves that can hold a row whose inner product with an ask lies in one of its windows (a row of ``lows`` and ``highs``)."""
    if not nodes:
        return np.arange(len(asks)), np.zeros(len(asks), np.int64)
    norm = np.sqrt((asks.astype(np.float64) ** 2).sum(1))
    out_ask, out_leaf, todo = [], [], [(0, np.arange(len(asks)))]
    while todo:
        number, at = todo.pop()
        node, low, high = nodes[number], seen.low[number], seen.high[number]
        d = np.concatenate([distances(asks[at], node.points), norm[at][:, None]], 1)
        for k in range(len(node.points)):
            if low[k, -1] > high[k, -1]:
                continue
            # distance^2 = norm^2 + norm^2 - 2 * product
            near = np.sqrt(np.maximum(norm[at][:, None] ** 2 + low[k, -1] ** 2 - 2 * highs[at], 0)) * (1 - SLACK) - SLACK
            square = norm[at][:, None] ** 2 + high[k, -1] ** 2 - 2 * lows[at]
            far = np.sqrt(np.maximum(square, 0)) * (1 + SLACK) + SLACK
            fits = (square >= -SLACK * norm[at][:, None] ** 2) & (lows[at] <= highs[at])
            for j in range(d.shape[1]):
                own = d[:, j][:, None]
                fits &= (low[k, j] <= own + far) & (high[k, j] >= np.maximum(near - own, own - far))
            kept = at[fits.any(1)]
            if len(kept) and node.inner[k]:
                todo.append((int(node.child[k]), kept))
            elif len(kept):
                out_ask.append(kept)
                out_leaf.append(np.full(len(kept), node.child[k]))
    return (np.concatenate(out_ask), np.concatenate(out_leaf)) if out_ask else (np.zeros(0, np.int64),) * 2


_NEVER, _ALWAYS = 1 - (1 << 63), (1 << 63) - 1


def _raw(column: pa.Array) -> np.ndarray:
    """The bytes of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]


def _matrix(column: pa.Array, kind: str = "<i4") -> np.ndarray:
    return _raw(column).view(kind).reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


def _rows_of(matrix: np.ndarray) -> pa.Array:
    width = matrix.shape[1] * matrix.itemsize
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer((np.arange(len(matrix) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(matrix))])


def whole_numbers(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, label, v): rows that take part, components as floor(scale * x) (int32 as bytes), shorter vectors filled up with 0."""
    good = F.forall(F.col("x"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    taken = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    taken = taken.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & good)
    dims = max(1, taken.agg(F.max(F.size("x"))).first()[0] or 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            x = np.zeros((b.num_rows, dims))
            x[np.repeat(np.arange(b.num_rows), sizes), np.concatenate([np.arange(s) for s in sizes]) if len(sizes) else []] = lists.flatten().to_numpy(zero_copy_only=False)
            x = np.floor(scale * x)
            if x.size and np.abs(x).max() >= 1 << 31:
                raise ValueError("components that pass 32 bits once scaled")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _rows_of(x.astype("<i4"))], ["id", "label", "v"])

    return taken.mapInArrow(run, "id long, label long, v binary")


def fit(rows: DataFrame, sample: int = SAMPLE, leaf: int = LEAF) -> list[Node]:
    """The tree for at most ``sample`` rows, those of the smallest hashes of id and vector."""
    taken = rows.orderBy(F.xxhash64("id", "v"), "id").limit(sample).toArrow()
    return grow(_matrix(taken.column("v").combine_chunks()), leaf=leaf) if taken.num_rows else []


def assigned(rows: DataFrame, nodes: list[Node]) -> DataFrame:
    """(row, leaf, id, label, v), stored; ``row`` is unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(leaf_of(nodes, _matrix(b.column(2))), pa.int64()), *b.columns], ["leaf", "id", "label", "v"])

    return stored(rows.mapInArrow(run, "leaf long, id long, label long, v binary").select(F.monotonically_increasing_id().alias("row"), "leaf", "id", "label", "v"), "gnat-rows")


def ranges_of(rows: DataFrame, nodes: list[Node]) -> Ranges:
    """The ranges over all rows; tasks send one row for each node, child and point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Ranges(nodes)
        for b in batches:
            seen.add(nodes, _matrix(b.column(0)))
        cells = [(n, c, p, float(seen.low[n][c, p]), float(seen.high[n][c, p])) for n in range(len(nodes)) for c, p in np.argwhere(np.isfinite(seen.low[n])).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in cells], t) for k, t in enumerate((pa.int64(),) * 3 + (pa.float64(),) * 2)], ["node", "child", "point", "low", "high"])

    out = Ranges(nodes)
    table = rows.select("v").mapInArrow(run, "node long, child long, point long, low double, high double").groupBy("node", "child", "point").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
    for n, c, p, low, high in zip(*(table.column(k).to_pylist() for k in ("node", "child", "point", "low", "high"))):
        out.low[n][c, p], out.high[n][c, p] = low, high
    return out


def packed(rows: DataFrame, by: str, limit: int, columns: dict[str, str]) -> DataFrame:
    """Runs of up to ``limit`` rows of one leaf: ``leaf`` and, joined as bytes, ``columns`` (name: kind of number, or "bytes").

    Rows are dealt by ranges of leaf and ``by``, so a leaf with very many of them lies in many tasks.
    """
    ordered = rows.select("leaf", by, *(c for c in columns if c != by)).repartitionByRange("leaf", by).sortWithinPartitions("leaf", by)
    ordered = ordered.select("leaf", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = b.column(0).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(leaf[1:] != leaf[:-1]) + 1
            cuts = sorted({0, len(leaf), *edges.tolist(), *(x for a, z in zip([0, *edges], [*edges, len(leaf)]) for x in range(int(a), int(z), limit))})
            runs = [(a, z) for a, z in zip(cuts, cuts[1:])]
            out = [pa.array([leaf[a] for a, _ in runs], pa.int64())]
            for k, kind in enumerate(columns.values()):
                col = b.column(k + 1)
                out.append(pa.array([(_raw(col.slice(a, z - a)) if kind == "bytes" else col.slice(a, z - a).to_numpy(zero_copy_only=False).astype(kind)).tobytes() for a, z in runs], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, ["leaf", *columns])

    return stored(ordered.mapInArrow(run, ", ".join(["leaf long", *(f"{c} binary" for c in columns)])), "gnat-pages")


_ASK = {"row": "<i8", "id": "<i8", "label": "<i8", "v": "bytes", "lows": "bytes", "highs": "bytes"}


def spread(asks: DataFrame, nodes: list[Node], seen: Ranges) -> DataFrame:
    """``asks`` (row, id, label, v, lows, highs), once for each leaf that can hold an answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lows, highs = (_matrix(b.column(k), "<i8") for k in (4, 5))
            low, high = np.where(lows == _NEVER, -np.inf, lows), np.where(highs == _ALWAYS, np.inf, highs)
            ask, leaf = leaves_in(nodes, seen, _matrix(b.column(3)), low, high)
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), *(c.take(pa.array(ask)) for c in b.columns)], ["leaf", *b.schema.names])

    return asks.select(*_ASK).mapInArrow(run, "leaf long, row long, id long, label long, v binary, lows binary, highs binary")


class Best:
    """The best ``k`` answers of a block's asks in each window."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, k), _NEVER, np.int64), np.zeros((n, k), np.int64)

    def offer(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        hit = np.unique(slot)
        slot = np.concatenate([np.repeat(hit, self.k), slot])
        score, ids = np.concatenate([self.scores[hit].reshape(-1), score]), np.concatenate([self.ids[hit].reshape(-1), ids])
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        best = rank < self.k
        self.scores[slot[best], rank[best]], self.ids[slot[best], rank[best]] = score[best], ids[best]


def visit(pages: DataFrame, asked: DataFrame, k: int, same: bool) -> DataFrame:
    """(row, window, score, id): the ``k`` best rows in each window of each ask, among rows of the same label (or of others) with another id.

    Blocks of asks meet the pages of their leaf in a join that Spark can split.
    """
    blocks = packed(asked, "row", BLOCK, _ASK).withColumn("block", F.monotonically_increasing_id())
    met = pages.select("leaf", F.col("id").alias("ids"), F.col("label").alias("labels"), F.col("v").alias("vectors")).join(blocks, "leaf")
    names = ["ids", "labels", "vectors", "block", *_ASK]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[Best, np.ndarray]] = {}

        def flush() -> pa.RecordBatch:
            out = [np.zeros(0, np.int64)] * 4 if not held else []
            for best, rows in held.values():
                slot, at = np.nonzero(best.scores > _NEVER)
                windows = len(best.scores) // len(rows)
                out.append((rows[slot // windows], slot % windows, best.scores[slot, at], best.ids[slot, at]))
            columns = [np.concatenate(c) for c in zip(*out)] if held else out
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "window", "score", "id"])

        for batch in batches:
            for values in zip(*(batch.column(c) for c in range(len(names)))):
                x = dict(zip(names, values))
                ids, labels, rows, own, own_label = (np.frombuffer(x[c].as_buffer(), "<i8") for c in ("ids", "labels", "row", "id", "label"))
                vectors, asks = (np.frombuffer(x[c].as_buffer(), "<i4").reshape(len(n), -1) for c, n in (("vectors", ids), ("v", rows)))
                lows, highs = (np.frombuffer(x[c].as_buffer(), "<i8").reshape(len(rows), -1) for c in ("lows", "highs"))
                block = x["block"].as_py()
                if block not in held:
                    if len(held) >= 256:
                        yield flush()
                    held[block] = Best(lows.size, k), rows
                best = held[block][0]
                scores = dot(asks, vectors)
                fits = ((own_label[:, None] == labels) == same) & (own[:, None] != ids)
                kth = best.scores[:, -1].reshape(lows.shape)
                for w in range(lows.shape[1]):
                    ask, at = np.nonzero(fits & (scores >= np.maximum(lows[:, w], kth[:, w])[:, None]) & (scores <= highs[:, w, None]))
                    if len(ask):
                        best.offer(ask * lows.shape[1] + w, scores[ask, at], ids[at])
        yield flush()

    found = met.select(*names).mapInArrow(run, "row long, window long, score long, id long")
    order = Window.partitionBy("row", "window").orderBy(F.col("score").desc(), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = stored(ranked, "gnat-found")
    discard(blocks)
    return out


def _bytes(values: list) -> F.Column:
    """64-bit numbers, little-endian, one after the other."""
    return F.concat(*(F.unhex(F.concat(*(F.substring(F.lpad(F.hex(v), 16, "0"), 15 - 2 * i, 2) for i in range(8)))) for v in values))


def _windowed(asks: DataFrame, windows: DataFrame, n: int) -> DataFrame:
    """``asks`` with the bytes of their ``n`` windows, from (row, window, low, high); a missing one is empty."""
    each = windows.groupBy("row").agg(*(F.max(F.when(F.col("window") == w, F.col(c))).alias(f"{c}{w}") for w in range(n) for c in ("low", "high")))
    pick = lambda c, none: _bytes([F.coalesce(F.col(f"{c}{w}"), F.lit(none)) for w in range(n)])
    return asks.join(each, "row").select("row", "leaf", "id", "label", "v", pick("low", _ALWAYS).alias("lows"), pick("high", _NEVER).alias("highs"))


def best_in_windows(pages: DataFrame, asks: DataFrame, windows: DataFrame, n: int, nodes: list[Node], seen: Ranges, k: int, same: bool) -> DataFrame:
    """The ``k`` best answers in each window. The ask's own leaf comes first: where it has ``k`` answers, the worst of them raises the window's low end."""
    first = visit(pages, _windowed(asks, windows, n), k, same)
    least = first.groupBy("row", "window").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    raised = windows.join(least, ["row", "window"], "left").select("row", "window", F.when(F.col("n") == k, F.greatest("low", "least")).otherwise(F.col("low")).alias("low"), "high")
    found = visit(pages, spread(_windowed(asks, raised, n), nodes, seen), k, same)
    discard(first)
    return found


def negatives(
    rows: DataFrame, id_col: str, label_col: str, vector_col: str, every: int = 50, n_positives: int = 5, n_negatives: int = 3, low_percent: int = 50, high_percent: int = 95, leaf: int = LEAF
) -> DataFrame:
    """(anchor, positive, rank, negative, positive_score, negative_score): hard negatives of the rows whose id is divisible by ``every``.

    A positive is one of the ``n_positives`` best other rows of an anchor's label; its negatives are the best ``n_negatives`` rows of other labels with a
    score of ``low_percent`` to ``high_percent`` of the positive's. Scores are inner products of whole components (``whole_numbers``); equal ones go by id.

    Defined results: a row takes no part if its id, label or vector is null or a component is null or not finite. Shorter vectors count as filled up
    with 0; empty ones are all 0. Repeated rows are rows of their own: each repeated anchor gets its answers, and a row with the anchor's id is never its partner. No
    rows give no rows. Other columns are ignored, whatever their names. Components or scores past 32 and 64 bits are an error.
    """
    plain = whole_numbers(rows, id_col, label_col, vector_col)
    nodes = fit(plain, leaf=leaf)
    table = assigned(plain, nodes)
    seen = ranges_of(table, nodes)
    pages = packed(table, "row", PAGE, {"id": "<i8", "label": "<i8", "v": "bytes"})
    asks = table.where(F.col("id") % every == 0)
    whole = asks.select("row", F.lit(0).cast("long").alias("window"), F.lit(_NEVER + 1).alias("low"), F.lit(_ALWAYS).alias("high"))
    positive = best_in_windows(pages, asks, whole, 1, nodes, seen, n_positives, True)
    positive = positive.select("row", (F.col("rank") - 1).cast("long").alias("window"), F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    # ends that are whole numbers: up for the low one, down for the high one
    low, high = F.col("positive_score") * low_percent, F.col("positive_score") * high_percent
    ends = F.expr("low div 100").alias("low"), F.expr("high div 100").alias("high")
    windows = positive.select("row", "window", (low + F.pmod(-low, F.lit(100))).alias("low"), (high - F.pmod(high, F.lit(100))).alias("high")).select("row", "window", *ends)
    negative = best_in_windows(pages, asks, windows, n_positives, nodes, seen, n_negatives, False)
    negative = negative.select("row", "window", "rank", F.col("id").alias("negative"), F.col("score").alias("negative_score"))
    names = asks.select("row", F.col("id").alias("anchor"))
    return negative.join(positive, ["row", "window"]).join(names, "row").select("anchor", "positive", "rank", "negative", "positive_score", "negative_score")
