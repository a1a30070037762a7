"""Multi-hop traversals as frontier loops of joins; every level is a stored table.

A level joins the frontier with the edges, drops what was seen and is written to
the shared folder, so that plans stay short and a lost executor costs one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.scratch import discard, stored
from .graph import as_of, can_see


def steps(edges: DataFrame, direction: str = "out") -> DataFrame:
    """(a, b, seq, up): one row for each way to walk an edge; up is false along it."""
    along = edges.select(F.col("source_key").alias("a"), F.col("target_key").alias("b"), "seq", F.lit(False).alias("up"))
    back = edges.select(F.col("target_key").alias("a"), F.col("source_key").alias("b"), "seq", F.lit(True).alias("up"))
    return {"out": along, "in": back, "any": along.unionByName(back)}[direction]


#: 64-bit words that hold one bit for each start of a block of ``reachable``; starts in a block of ``shortest_tree``, and about how many nodes it may reach in one task.
WORDS, BLOCK, SPAN = 4, 256, 65536


def numbered(starts: DataFrame, size: int) -> DataFrame:
    """(start, block, place): distinct starts in blocks of ``size`` neighbours by key, so that starts with common surroundings tend to share a block. The driver sees the partitions' sizes."""
    rows = stored(starts.select(F.col("key").alias("start")).distinct().orderBy("start").withColumn("n", F.monotonically_increasing_id()), "starts")
    part, sizes = F.shiftright("n", 33), {}
    for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("size")).orderBy("part").collect():
        sizes[r["part"]] = r["size"]
    before = F.create_map(*(x for p in sizes for x in (F.lit(p), F.lit(sum(n for q, n in sizes.items() if q < p)).cast("bigint")))) if sizes else F.create_map(F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))
    n = F.coalesce(before[part], F.lit(0)) + F.col("n").bitwiseAND((1 << 33) - 1)
    return stored(rows.select("start", F.floor(n / size).alias("block"), (n % size).cast("int").alias("place")), "starts")


def reachable(starts: DataFrame, edges: DataFrame, max_hops: int, direction: str = "out") -> DataFrame:
    """(start, key, hops): shortest distances from each of ``starts`` (column key), itself left out (TRV-01).

    All starts of a block walk together: a row is a node of a block with a bit for each start that has come there, so a level is one join with the edges and one
    bitwise or. Its rows are edges times blocks that reach them, not edges times starts.
    """
    walk = stored(steps(edges, direction).select("a", "b").distinct(), "walk")
    of = numbered(starts, 64 * WORDS)
    words = range(WORDS)
    none = F.lit(0).cast("bigint")
    bit = F.expr("shiftleft(1L, place % 64)")
    own = of.groupBy(F.col("start").alias("key"), "block").agg(*(F.bit_or(F.when(F.floor(F.col("place") / 64) == i, bit).otherwise(none)).alias(f"new{i}") for i in words))
    state = own.select("key", "block", *(F.col(f"new{i}").alias(f"seen{i}") for i in words), *(f"new{i}" for i in words))
    fresh = " or ".join(f"new{i} <> 0" for i in words)
    found = None
    for hop in range(1, max(1, max_hops) + 1):
        on = state.where(fresh).join(walk, F.col("key") == F.col("a")).select(F.col("b").alias("key"), "block", *(none.alias(f"seen{i}") for i in words), *(f"new{i}" for i in words))
        met = on.unionByName(state.select("key", "block", *(f"seen{i}" for i in words), *(none.alias(f"new{i}") for i in words)))
        met = met.groupBy("key", "block").agg(*(F.bit_or(f"{c}{i}").alias(f"{c}{i}") for c in ("seen", "new") for i in words))
        state = stored(met.select("key", "block", *(F.expr(f"seen{i} | new{i}").alias(f"seen{i}") for i in words), *(F.expr(f"new{i} & ~seen{i}").alias(f"new{i}") for i in words)), "frontier")
        level = state.where(fresh).select("key", "block", F.posexplode(F.array(*(f"new{i}" for i in words))).alias("word", "bits"), F.lit(hop).alias("hops")).where("bits <> 0")
        found = level if found is None else found.unionByName(level)
        if state.where(fresh).isEmpty():
            break
    who = of.select("start", "block", F.floor(F.col("place") / 64).cast("int").alias("word"), (F.col("place") % 64).alias("at"))
    return found.join(who, ["block", "word"]).where("(shiftright(bits, at) & 1) = 1").select("start", "key", "hops")


def ways(edges: DataFrame, along: Column | None = None) -> DataFrame:
    """(a, b, code, back): each edge once, with the numbers 2 * seq of the way along it (``along``, else ``seq``) and 2 * seq + 1 of the way back."""
    seq = F.col("seq").cast("bigint")
    return edges.select(F.col("source_key").alias("a"), F.col("target_key").alias("b"), ((seq if along is None else along.cast("bigint")) * 2).alias("code"), (seq * 2 + 1).alias("back"))


def neighbours(walk: DataFrame) -> tuple[DataFrame, int]:
    """(a, part, near), the packed list of the neighbours of each node with the smallest number of a way there, in ``parts`` by the neighbour's hash; a node has up to two rows of a part. And the number of parts.

    An edge is moved once to its smaller end, where parallel ones are dropped, and what is left once to its larger end; from then on only packed lists are moved.
    """
    up = F.col("a") < F.col("b")
    first, last = F.when(up, F.col("code")).otherwise(F.col("back")), F.when(up, F.col("back")).otherwise(F.col("code"))
    # the two numbers of an edge differ by much the same in all rows, which takes little room
    once = stored(walk.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), first.alias("code"), (last - first).alias("gap")), "ways")
    n = once.agg(F.approx_count_distinct("a").alias("a"), F.approx_count_distinct("b").alias("b")).first()
    parts = max(1, -(-max(n["a"], n["b"]) // SPAN))
    pairs = once.repartition("a").groupBy("a", "b").agg(F.min("code").alias("code"), F.min(F.col("code") + F.col("gap")).alias("back"))
    pairs = pairs.groupBy("a", _part("b", parts).alias("part")).agg(F.collect_list(F.struct("b", "code", "back")).alias("x"))
    pairs = stored(pairs.select("a", "part", "x.b", "x.code", "x.back"), "pairs")
    discard(once)
    turned = pairs.select(F.col("a").alias("b"), F.explode(F.arrays_zip(F.col("b").alias("b"), F.col("back").alias("back"))).alias("x")).select(F.col("x.b").alias("a"), "b", F.col("x.back").alias("code"))
    turned = turned.groupBy("a", _part("b", parts).alias("part")).agg(F.collect_list(F.struct("b", "code")).alias("x")).select("a", "part", "x.b", "x.code")
    near = [stored(x.mapInArrow(_packed, "a string, part int, near binary"), "near") for x in (turned, pairs.select("a", "part", "b", "code"))]
    discard(pairs)
    return near[0].unionByName(near[1]), parts


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, part, near) from (a, part, b, code), lists of nodes and numbers; ``_unpacked`` gives them back, by number."""
    for batch in batches:
        at = batch.column(2).offsets.to_numpy()
        at, b, code = at - at[0], batch.column(2).flatten(), batch.column(3).flatten().to_numpy()
        lists = []
        for i, j in zip(at[:-1], at[1:], strict=True):
            order = np.argsort(code[i:j])
            names = b.slice(i, j - i).take(pa.array(order)).cast(pa.binary())
            ends = np.frombuffer(names.buffers()[1], np.int32)[names.offset :][: j - i + 1]
            planes = np.diff(ends).astype("<u4").view(np.uint8).reshape(-1, 4), np.diff(code[i:j][order], prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8)
            raw = b"".join([*(x.T.tobytes() for x in planes), names.buffers()[2].to_pybytes()[ends[0] : ends[-1]] if ends[-1] > ends[0] else b""])
            lists.append(np.array([j - i, len(raw)], "<u4").tobytes() + pa.compress(raw, "zstd", asbytes=True))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.binary())], ["a", "part", "near"])


def _unpacked(near: bytes) -> tuple[pa.Array, np.ndarray]:
    n, size = (int(x) for x in np.frombuffer(near, "<u4", 2))
    raw = pa.decompress(near[8:], size, "zstd", asbytes=True)
    ends = np.frombuffer(raw, np.uint8, 4 * n).reshape(4, n).T.copy().view("<u4").ravel().cumsum()
    code = np.frombuffer(raw, np.uint8, 8 * n, 4 * n).reshape(8, n).T.copy().view("<i8").ravel().cumsum()
    return pa.StringArray.from_buffers(n, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(raw[12 * n :])), code


#: More than any place.
NONE = np.iinfo(np.int32).max


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, s, key, from, code): from (block, part, s, place, near), where all of s go to all that is near, the smallest place from which a start comes to each node. A row without ``near`` names in ``own`` a node that s know already.

    Rows come by block and part. A part is held as a table of nodes met by starts; no ways are listed.
    """
    at, known, best, by = None, {}, np.empty((0, BLOCK), np.int32), np.empty((0, BLOCK), np.int64)

    def done() -> Iterator[pa.RecordBatch]:
        names = list(known)
        for i in range(0, len(names), 256):
            some = best[i : min(len(names), i + 256)]
            b, s = np.nonzero((some >= 0) & (some < NONE))
            if len(b):
                columns = [pa.array(np.full(len(b), at[0]), pa.int64()), pa.array(s, pa.int32()), pa.array(names[i : i + 256], pa.string()).take(pa.array(b)), pa.array(best[i + b, s], pa.int32()), pa.array(by[i + b, s], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "s", "key", "from", "code"])

    for batch in batches:
        if not batch.num_rows:
            continue
        block, part, own, near = (batch.column(i).to_pylist() for i in (0, 1, 4, 5))
        of = batch.column(2).offsets.to_numpy()
        of, s, place = of - of[0], batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
        lists = [(pa.array([x], pa.string()), np.zeros(1, np.int64)) if y is None else _unpacked(y) for x, y in zip(own, near, strict=True)]
        b = pa.concat_arrays([x for x, _ in lists]).dictionary_encode()
        b, names, until = b.indices.to_numpy(), b.dictionary.to_pylist(), np.cumsum([0, *(len(x) for x, _ in lists)])
        row_of = np.full(len(names), -1)
        for r in range(batch.num_rows):
            if at != (block[r], part[r]):
                yield from done()
                at, known, best, by = (block[r], part[r]), {}, best[:0], by[:0]
                row_of[:] = -1
            to, code = b[until[r] : until[r + 1]], lists[r][1]
            for x in to[row_of[to] < 0].tolist():
                row_of[x] = known.setdefault(names[x], len(known))
            if len(known) > len(best):
                more = max(len(known) - len(best), len(best) // 4, 1024)
                best, by = np.concatenate([best, np.full((more, BLOCK), NONE, np.int32)]), np.concatenate([by, np.zeros((more, BLOCK), np.int64)])
            to, who, p = row_of[to], s[of[r] : of[r + 1]], place[of[r] : of[r + 1]]
            i, j = np.nonzero(p < best[to[:, None], who])
            best[to[i], who[j]] = p[j]
            by[to[i], who[j]] = code[i]
    yield from done()


def shortest_tree(starts: DataFrame, walk: DataFrame, max_hops: int) -> DataFrame:
    """(start, key, hops, parent, top, order): for each node the last step of one shortest path, the smallest by its sequence of edge numbers (TRV-02).

    ``walk`` is (a, b, code, back), each edge once, and is walked both ways, so a level can only meet the last two. ``parent`` is the node before and ``order``
    the edge numbers from the start, odd where a step goes up: choosing the smallest one is the order in which a queue would visit. ``top`` is the node
    where the last upward step arrives. ``with_paths`` makes whole paths of this.

    Within a level a node's sequence is known by its place among those of its start, so the smallest way to a node is the one from the parent of the smallest place: one
    number. A block of starts meets the packed lists of neighbours of its own level, each once, so ways are neither moved nor listed; only the new nodes are.
    """
    near, parts = neighbours(walk)
    tasks = int(walk.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit(None).cast("string")
    first = numbered(starts.where("key is not null"), BLOCK).select("block", F.col("place").alias("s"), "start", F.col("start").alias("key"), F.lit(0).alias("hops"), none.alias("parent"), none.alias("top"), F.array().cast("array<bigint>").alias("order"), F.lit(0).alias("place"))
    frontier = first
    found, before = first.limit(0), first.limit(0)
    for hop in range(1, max_hops + 1):
        here = frontier.groupBy("block", "key").agg(F.collect_list(F.struct("s", "place")).alias("x")).select("block", "key", "x.s", "x.place")
        there = here.join(near, F.col("key") == F.col("a")).select("block", "part", "s", "place", none.alias("own"), "near")
        known = frontier.select("block", "key", "s").unionByName(before.select("block", "key", "s")).groupBy("block", "key").agg(F.collect_list("s").alias("s"))
        known = known.select("block", _part("key", parts).alias("part"), "s", F.array_repeat(F.lit(-1), F.size("s")).alias("place"), F.col("key").alias("own"), F.lit(None).cast("binary").alias("near"))
        # in a stated number, as few bytes here are much work
        met = there.unionByName(known).repartition(tasks, "block", "part").sortWithinPartitions("block", "part")
        best = met.mapInArrow(_nearest, "block bigint, s int, key string, from int, code bigint")
        parents = frontier.select("block", "s", F.col("place").alias("from"), "start", F.col("key").alias("parent"), F.col("top").alias("above"), F.col("order").alias("so_far"))
        new = best.join(parents, ["block", "s", "from"])
        place = F.row_number().over(W.partitionBy("block", "s").orderBy("from", "code", "key")) if hop < max_hops else F.lit(0)
        new = stored(new.select(
            "block", "s", "start", "key", F.lit(hop).alias("hops"), "parent", F.when(F.col("code") % 2 == 1, F.col("key")).otherwise(F.col("above")).alias("top"), F.concat("so_far", F.array("code")).alias("order"), place.alias("place")
        ), "paths")
        if new.isEmpty():
            break
        found, before, frontier = found.unionByName(new), frontier, new
    return found.drop("block", "s", "place")


def with_paths(tree: DataFrame, max_hops: int) -> DataFrame:
    """``tree`` with ``path``, an array of (from, to, seq, up) in place of the columns that it is made from: a join with the level below for each level."""
    code = F.element_at("order", -1)
    link = F.struct(F.col("parent").alias("from"), F.col("key").alias("to"), F.shiftright(code, 1).alias("seq"), (code % 2 == 1).alias("up"))
    rest = [c for c in tree.columns if c not in ("parent", "top", "order")]
    done = tree.where("hops = 1").select(*rest, F.array(link).alias("path"))
    out = done
    for hop in range(2, max_hops + 1):
        below = done.select("start", F.col("key").alias("parent"), F.col("path").alias("before"))
        done = stored(tree.where(F.col("hops") == hop).join(below, ["start", "parent"]).select(*rest, F.concat("before", F.array(link)).alias("path")), "paths")
        out = out.unionByName(done)
    return out


def network(companies: DataFrame, references: DataFrame, max_hops: int, paths: bool = True) -> DataFrame:
    """Undirected co-mention network, with one evidence path each if asked; hops are kept within 1 to 6 (TRV-02)."""
    hops = max(1, min(6, max_hops))
    tree = shortest_tree(companies, ways(references), hops)
    return with_paths(tree, hops) if paths else tree.select("start", "key", "hops")


#: Terminals of complete chains.
COMPLETE = ["beneficial_owner", "root"]


def ownership_chains(starts: DataFrame, edges: DataFrame, clearance: str = "public", day: str | None = None, max_depth: int = 8, persons: Column | None = None, unresolved: DataFrame | None = None, chain_cap: int | None = None) -> DataFrame:
    """(start, holders, terminal, depth, complete, truncated, chains): all upward paths (TRV-03).

    A path ends at a holder already on it (cycle), at the depth limit (max_depth), or where no visible owner is left:
    restricted when owners are withheld there, else beneficial_owner, unresolved or root. A start without
    owners has no chain.

    The number of paths can be exponential. With a ``chain_cap`` the paths are counted before any is made (``chain_counts``); a start with more than that is not followed but gets one
    row, ``truncated``, with their number in ``chains``. Without one every path is listed.
    """
    max_depth = max(1, min(12, max_depth))
    now = as_of(edges, day).withColumn("see", can_see(F.col("access_tier"), clearance))
    own = now.groupBy(F.col("target_key").alias("key")).agg(F.count_if("see").alias("n_seen"), F.count_if(~F.col("see")).alias("n_hidden"))
    own = stored(own, "owners")
    up = stored(now.where("see").select(F.col("target_key").alias("key"), F.col("source_key").alias("holder"), "relation", "seq"), "upward")
    surrogate = None if unresolved is None else unresolved.select(F.col("key"), F.lit(True).alias("surrogate")).distinct()
    over = None
    if chain_cap is not None:
        over = stored(starts.select("key").distinct().join(chain_counts(up, max_depth).where(F.col("chains") > chain_cap), "key"), "over")
        starts = starts.join(over.select("key"), "key", "left_anti")
    open_ = starts.select(F.col("key").alias("start"), "key", F.array("key").alias("visited"), F.lit(None).cast("string").alias("last"))
    closed = None
    for depth in range(max_depth + 1):
        at = open_.join(own, "key", "left").withColumn("n_seen", F.coalesce("n_seen", F.lit(0))).withColumn("n_hidden", F.coalesce("n_hidden", F.lit(0)))
        leaf = at.where((F.col("n_seen") == 0) & (F.size("visited") > 1))
        leaf = leaf.withColumn("surrogate", F.lit(None).cast("boolean")) if surrogate is None else leaf.join(surrogate, "key", "left")
        end = F.when(F.col("n_hidden") > 0, "restricted").when(F.col("last") == "beneficial_owner_of", "beneficial_owner").when(F.coalesce("surrogate", F.lit(False)), "unresolved").otherwise("root")
        if persons is not None:
            end = F.when(F.col("n_hidden") > 0, "restricted").when(persons | (F.col("last") == "beneficial_owner_of"), "beneficial_owner").when(F.coalesce("surrogate", F.lit(False)), "unresolved").otherwise("root")
        done = leaf.select("start", F.slice("visited", F.lit(2), F.size("visited")).alias("holders"), end.alias("terminal"))
        nxt = open_.join(up, "key").select("start", F.col("holder").alias("key"), F.concat("visited", F.array("holder")).alias("visited"), F.col("relation").alias("last"), F.array_contains("visited", F.col("holder")).alias("again"))
        stop = F.when(F.col("again"), "cycle").when(F.lit(depth + 1 >= max_depth), "max_depth")
        marked = stored(nxt.withColumn("stop", stop), "chains")
        done = done.unionByName(marked.where("stop is not null").select("start", F.slice("visited", F.lit(2), F.size("visited")).alias("holders"), F.col("stop").alias("terminal")))
        closed = done if closed is None else closed.unionByName(done)
        open_ = marked.where("stop is null").select("start", "key", "visited", "last")
        if open_.isEmpty():
            break
    out = closed.select("start", "holders", "terminal", F.size("holders").alias("depth"), F.col("terminal").isin(COMPLETE).alias("complete"), F.lit(False).alias("truncated"), F.lit(None).cast("double").alias("chains"))
    if over is None:
        return out
    none = F.lit(None)
    return out.unionByName(over.select(F.col("key").alias("start"), none.cast("array<string>").alias("holders"), F.lit("truncated").alias("terminal"), none.cast("int").alias("depth"), F.lit(False).alias("complete"), F.lit(True).alias("truncated"), "chains"))


def chain_counts(up: DataFrame, max_depth: int) -> DataFrame:
    """(key, chains): how many chains begin at each key with an owner, from (key, holder), without making any.

    From the depth limit down, the chains of a key are the sum of its holders' chains, or 1 for one without owners: one join and one sum for each level, with a row for each
    key. A chain that would end where it meets itself counts with all that follows, so in a cycle this is a bound from above.
    """
    n = stored(up.groupBy("key").agg(F.count("*").cast("double").alias("chains")), "chain-counts")
    for _ in range(max_depth - 1):
        below = n.select(F.col("key").alias("holder"), F.col("chains").alias("more"))
        n = stored(up.select("key", "holder").join(below, "holder", "left").groupBy("key").agg(F.sum(F.coalesce("more", F.lit(1.0))).alias("chains")), "chain-counts")
    return n


def link_class(order: Column) -> Column:
    """parent, subsidiary, shares-owner or group from the directions of a path, the last bits of its ``order`` (TRV-04)."""
    ways = F.array_join(F.transform(order, lambda x: F.when(x % 2 == 1, "u").otherwise("d")), "")
    return F.when(ways.rlike("^u+$"), "parent").when(ways.rlike("^d+$"), "subsidiary").when(ways.rlike("^[ud]*u+d+$"), "shares-owner").otherwise("group")


def contagion(seeds: DataFrame, edges: DataFrame, clearance: str = "public", day: str | None = None, max_hops: int = 4, paths: bool = False) -> tuple[DataFrame, DataFrame]:
    """(start, key, hops, link, shared_owner), with ``path`` if asked, and (start, withheld) (TRV-04).

    A withheld edge counts once for each expanded end; nodes at the hop limit are not expanded.
    """
    max_hops = max(1, min(8, max_hops))
    now = as_of(edges, day)
    see = can_see(F.col("access_tier"), clearance)
    # owners first, then what a node owns, each in order of insertion
    walk = ways(now.where(see), F.col("seq") + (1 << 40))
    tree = shortest_tree(seeds, walk, max_hops)
    link = link_class(F.col("order"))
    # the shared owner is where the last upward step arrives
    members = tree.withColumns({"link": link, "shared_owner": F.when(link == "shares-owner", F.col("top"))})
    members = with_paths(members, max_hops) if paths else members.select("start", "key", "hops", "link", "shared_owner")
    inside = seeds.select(F.col("key").alias("start"), "key").union(tree.where(F.col("hops") < max_hops).select("start", "key"))
    hidden = steps(now.where(~see), "any").groupBy(F.col("a").alias("key")).agg(F.count("*").alias("n"))
    held = inside.join(hidden, "key").groupBy("start").agg(F.sum("n").alias("withheld"))
    return members, held
