"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then Hamming distance.

Fingerprints of 64 bits that differ in at most 4 bits agree in all but 4 of any
blocks that they are cut into. Each distinct fingerprint gets one key for each
choice of all but 4 blocks; only fingerprints that share a key are compared.
Seven blocks (35 keys of 27 or 28 bits) do for up to 2^25 rows, more rows take eight
(70 keys of 32 bits), so that unrelated fingerprints seldom share a key (``blocks_for``).
The number of blocks decides how many fingerprints are compared, never which are linked.
A key shared by more than ``HOT`` distinct fingerprints isn't joined, as the pairs
would grow with its square. Its fingerprints are linked through the values
within 2 bits of each: two of them are within 4 bits if and only if some value
lies within 2 bits of both, so linking each to the smallest of its value gives
the same groups, in a number of rows proportional to their number.

Defined results: null, empty and blank texts have fingerprint 0, which links
like any other. Repeated rows and equal texts share a fingerprint and so a
group. A null id takes part, but is never the smallest id of a group unless the
group has no other. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.linked import components
from .common import discard, repeated, spread, stored

BITS, MAX_BITS = 64, 4
#: Numbers of blocks to choose from.
FEWEST, MOST = 7, 8
#: A block key with more distinct fingerprints is linked through values near them.
HOT = 128
#: The bits of a key above this one are the mask of its blocks.
_MASK_AT = 48
_CHUNK = 1 << 14


def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """The hashes of a text's word shingles, repeats included (fewer words: the whole sequence; none: empty)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])[: max(1, len(words) - shingle + 1)].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(begins, ends)), np.uint64, len(begins))


def fingerprint_bytes(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint of one text, by majority over the hashes of its word shingles."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprint(text: Column, shingle: int = 4, seed: int = 42) -> Column:
    """A signed 64-bit column of fingerprints of ``text``."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        values = np.array([0 if t is None else fingerprint_bytes(t.encode(), shingle, seed) for t in texts], np.uint64)
        return pd.Series(values.view(np.int64))

    return of(text)


def blocks_for(rows: int) -> int:
    """The number of blocks whose keys are so long that unrelated fingerprints seldom share one."""
    return next((b for b in range(FEWEST, MOST) if BITS // b * (b - MAX_BITS) >= rows.bit_length() + 2), MOST)


def _blocks(blocks: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of each block."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _block(fp: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _block_keys(fp: Column, blocks: int) -> Column:
    """A key for each choice of all but 4 blocks: the mask of the chosen ones above their bits."""
    spans = _blocks(blocks)
    keys = []
    for chosen in combinations(range(blocks), blocks - MAX_BITS):
        key, at = F.lit(sum(1 << b for b in chosen) << _MASK_AT).cast("long"), 0
        for start, width in (spans[b] for b in chosen):
            key, at = key + F.shiftleft(_block(fp, start, width), at), at + width
        keys.append(key)
    return F.array(*keys)


def _near_values() -> list[int]:
    """Masks of up to 2 bits, as signed numbers."""
    masks = [0, *(1 << i for i in range(BITS)), *(1 << i | 1 << j for i, j in combinations(range(BITS), 2))]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fingerprints: DataFrame, hot: int = HOT, blocks: int | None = None) -> DataFrame:
    """(a, b), a < b, over distinct values of the column ``fp``: every pair within 4 bits, or pairs that join the same groups. Stored."""
    blocks = blocks or blocks_for(fingerprints.count())
    distinct = spread(fingerprints.select("fp").distinct())
    shared, many = repeated(distinct.select("fp", F.explode(_block_keys(F.col("fp"), blocks)).alias("key")), "simhash-shared")
    cold = shared.where(F.col("n") <= hot)
    a, b = cold.select("key", F.col("fp").alias("a")), cold.select("key", F.col("fp").alias("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    agree = sum((F.when(_block(x, *span) == 0, 1 << i).otherwise(0) for i, span in enumerate(_blocks(blocks))), F.lit(0))
    rest = agree
    for _ in range(blocks - MAX_BITS):
        rest = rest.bitwiseAND(rest - 1)
    # a pair counts once, under the first blocks that it agrees in
    first = F.shiftright("key", _MASK_AT) == agree.bitwiseXOR(rest)
    pairs = a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & (F.bit_count(x) <= MAX_BITS)).select(a["key"], "a", "b").where(first).select("a", "b")
    dense = spread(shared.where(F.col("n") > hot).select("fp").distinct())
    near = stored(dense.select("fp", F.explode(F.transform(F.lit(_near_values()), lambda m: F.col("fp").bitwiseXOR(m))).alias("value")), "simhash-near")
    # at most 2081 different fingerprints lie within 2 bits of a value
    low = near.groupBy("value").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("value", "a")
    near_pairs = near.join(low, "value").where("a < fp").select("a", F.col("fp").alias("b")).distinct()
    out = stored(pairs.unionByName(near_pairs), "simhash-links")
    discard(shared, many, near)
    return out


def _labelled(nodes: DataFrame, node: str, least: str, roots: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(node, component_id) of the nodes in groups of several (their number is that of the links, not of all rows), and the tables behind it."""
    both = roots.select("node", "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    members = stored(nodes.select(F.col(node).alias("node"), F.col(least).alias("least")).join(both, "node"), "group-members")
    # stored, so that the next join has a shuffle of its own, which Spark splits where one root has many members
    ids = stored(members.groupBy("root").agg(F.min("least").alias("component_id")), "group-ids")
    return members.join(ids, "root").select("node", "component_id"), [members, ids]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, hot: int = HOT) -> DataFrame:
    """One row for each row of ``docs``: the id, ``fp`` (signed) and ``component_id``, the smallest id of its group."""
    fps = stored(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle).alias("fp")), "simhash-fp")
    smallest = stored(fps.groupBy("fp").agg(F.min("id").alias("least")), "simhash-least")
    found = links(fps, hot)
    group, _ = _labelled(smallest, "fp", "least", components(found))
    discard(found)
    own = smallest.join(group.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return fps.join(stored(own, "simhash-groups"), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def fp_hex(fp: Column) -> Column:
    """A signed fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Min-wise samples of a text for groups by similarity: bands of so many values.
BANDS, ROWS = 24, 6
#: A band key with more sets is compared with so many leaders first; the pairs that this leaves open are found by prefixes.
CROWD, LEADERS = 32, 3
#: Texts that tell which shingles are common, and the most common shingles to know. They only order the prefixes.
SAMPLE_DOCS, COMMON = 20_000, 1 << 17
#: Bits of a parity bitmap, and the values of a set that one bitmap stands for; larger sets are cut into parts.
PARITY, PART = 512, 512

_RNG = np.random.default_rng(20240101)
_MULTIPLY = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    return np.unique(shingle_hashes((text or "").encode(), shingle, seed))


def majority(hashes: np.ndarray) -> int:
    """A bit is set where over half of the hashes have it."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        votes += np.unpackbits(hashes[at : at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def sketch(hashes: np.ndarray) -> np.ndarray:
    """One signed key for each band, from the smallest values under 144 mixings."""
    low = np.full(BANDS * ROWS, 1 << 32, np.uint64)
    for at in range(0, len(hashes), 2048):
        low = np.minimum(low, ((hashes[at : at + 2048, None] * _MULTIPLY + _ADD) >> np.uint64(32)).min(0))
    rows = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[i].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64)


def prefix_length(size: int, similarity: float) -> int:
    """So many of the first values of a set, in an order that all sets share, meet those of every set that is similar enough."""
    return size - int(np.ceil(similarity * size - 1e-9)) + 1 if size else 0


def prefix(values: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first values of a set, rare ones first: those not in ``common`` (sorted), then those in it, each by value."""
    known = np.zeros(len(values), bool)
    if len(common) and len(values):
        known = common[np.minimum(np.searchsorted(common, values), len(common) - 1)] == values
    return np.concatenate([values[~known], values[known]])[: prefix_length(len(values), similarity)]


def parity(values: np.ndarray) -> np.ndarray:
    """A bitmap of a set, as signed numbers: each value flips one bit. Two bitmaps differ in no more bits than their sets in values."""
    flips = np.bincount((values % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view("<i8").astype(np.int64)


def part_numbers(size: int, similarity: float) -> list[int]:
    """The numbers of parts (powers of two) to cut a set into: those that the smaller set of any similar pair with it would take."""
    of = lambda n: 1 << max(0, (max(1, n) - 1) // PART).bit_length()
    least, most = of(int(np.ceil(similarity * size - 1e-9))), of(size)
    return [1 << i for i in range(least.bit_length() - 1, most.bit_length())]


def parts(values: np.ndarray, common: np.ndarray, similarity: float) -> tuple[list, list, list, list, list]:
    """The prefixes of a set's parts as (keys, slots, places in the prefix), and the sizes and bitmaps of all slots.

    Parts are cut by the values' lowest bits. Of two similar sets some part is similar as well, since the whole's share is a mean of the parts' shares;
    so in that part the two share a value of its prefix. Both sets are cut into the number of parts that the smaller takes, which its key tells.
    """
    keys, slots, at, sizes, bits = [], [], [], [], []
    for number in part_numbers(len(values), similarity):
        place = (values & np.uint64(number - 1)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        for own in np.split(values[order], np.searchsorted(place[order], np.arange(1, number))):
            first = prefix(own, common, similarity) ^ np.uint64((number - 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            keys.append(first.view(np.int64))
            slots.append(np.full(len(first), len(sizes), np.int32))
            at.append(np.arange(len(first), dtype=np.int32))
            sizes.append(len(own))
            # the lowest bits say which part it is, so the bitmap takes the ones above
            bits.append(parity(own >> np.uint64(number.bit_length() - 1)))
    return np.concatenate(keys), np.concatenate(slots), np.concatenate(at), np.array(sizes, np.int32), bits


def common_shingles(docs: DataFrame, text_col: str, shingle: int) -> np.ndarray:
    """The shingles that occur in two or more of a bounded sample of texts, sorted; at most ``COMMON``."""

    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, shingle).view(np.int64) for t in texts], dtype=object)

    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    chosen = docs.where(F.pmod(F.xxhash64(text_col, F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20)))
    counts = chosen.select(F.explode(of(F.col(text_col))).alias("h")).groupBy("h").count().where("count > 1")
    top = counts.orderBy(F.desc("count"), "h").limit(COMMON).toPandas()
    return np.sort(top["h"].to_numpy(np.int64).view(np.uint64))


def sketches(text: Column, common: np.ndarray, shingle: int = 5, similarity: float = 0.8) -> Column:
    """A struct of the set's hash and size, the fingerprint, the band keys, and what ``parts`` gives."""

    @F.pandas_udf("node long, size int, fp long, bands array<long>, keys array<long>, slots array<int>, at array<int>, sizes array<int>, bits array<array<long>>")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            hashes = shingle_hashes((t or "").encode(), shingle)
            own = np.unique(hashes)
            ids = np.array([xxhash.xxh64_intdigest(own.tobytes(), 42), majority(hashes)], np.uint64).view(np.int64)
            rows.append((ids[0], len(own), ids[1], sketch(own), *parts(own, common, similarity)))
        return pd.DataFrame(rows, columns=["node", "size", "fp", "bands", "keys", "slots", "at", "sizes", "bits"])

    return of(text)


def _sets(text: Column, shingle: int) -> Column:
    """The hash of a text's shingle set, and the set, sorted."""

    @F.pandas_udf("node long, set binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            own = shingle_set(t, shingle)
            rows.append((np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 42)).astype(np.int64), own.tobytes()))
        return pd.DataFrame(rows, columns=["node", "set"])

    return of(text)


def _jaccard(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            p, q = (p, q) if len(p) <= len(q) else (q, p)
            both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()) if len(p) else 0
            out.append(both / max(1, len(p) + len(q) - both))
        return pd.Series(out, dtype="float64")

    return of(a, b)


def _cheap_pairs(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b): pairs that are probably similar, a number of them in proportion to the nodes; and the tables behind it.

    Equal or near fingerprints, and in every band key each node with the one that shares most; in crowded keys also with a few chosen by a hash.
    """
    of_fp = stored(nodes.groupBy("fp").agg(F.min("node").alias("first")), "sketch-fps")
    same = nodes.join(of_fp, "fp").where("node <> first").select("node", F.col("first").alias("leader"))
    fa, fb = of_fp.select(F.col("fp").alias("a"), F.col("first").alias("node")), of_fp.select(F.col("fp").alias("b"), F.col("first").alias("leader"))
    near = links(nodes)
    close = near.join(fa, "a").join(fb, "b").select("node", "leader")
    shared, many = repeated(nodes.select("node", F.explode("bands").alias("key")), "sketch-shared")
    weight = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    heavy = shared.join(weight, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("leader"))
    slot = F.pmod(F.xxhash64("key", "node"), F.lit(LEADERS))
    more = shared.where(F.col("n") > CROWD).groupBy("key", slot.alias("slot")).agg(F.min_by("node", F.xxhash64("node", "key")).alias("leader")).drop("slot")
    leaders = stored(heavy.unionByName(more), "sketch-leaders")
    led = shared.join(leaders, "key").where("leader <> node").select("node", "leader")
    pairs = same.unionByName(close).unionByName(led)
    return pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct(), [of_fp, near, shared, many, leaders]


def _open_pairs(nodes: DataFrame, roots: DataFrame, similarity: float) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b): every pair of sets in different groups that may be similar enough; and the tables behind it.

    Some part of two such sets (``parts``) is as similar, so there they share a value of its prefixes, the parts differ in size by no more than the
    similarity allows, have values enough from the first shared one on, and parity bitmaps that differ in no more bits than the parts
    may in values. Keys of one group make no pair; crowded keys are salted.
    """
    row = F.arrays_zip("keys", "slots", "at")
    shared, many = repeated(nodes.select("node", F.explode(row).alias("r")).select("node", F.col("r.keys").alias("key"), F.col("r.slots").alias("slot"), F.col("r.at").alias("at")), "sketch-prefix")
    grouped = stored(shared.drop("n").join(roots.withColumnRenamed("node", "n2"), F.col("node") == F.col("n2"), "left").select("key", "node", F.coalesce("root", "node").alias("root"), "slot", "at"), "sketch-grouped")
    mixed_keys = stored(grouped.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "n"), "sketch-open-keys")
    of_slot = nodes.select("node", F.posexplode(F.arrays_zip("sizes", "bits")).alias("slot", "p")).select("node", "slot", F.col("p.sizes").alias("size"), F.col("p.bits").alias("bits"))
    mixed = stored(grouped.join(mixed_keys, "key").join(of_slot, ["node", "slot"]).select("key", "n", "node", "root", "size", "at", "bits"), "sketch-open")
    discard(shared, many, grouped, mixed_keys)
    salts = F.ceil(F.col("n") / CROWD).cast("int")
    a = mixed.select(F.col("key").alias("ka"), F.col("node").alias("a"), F.col("root").alias("ra"), F.col("size").alias("na"), F.col("at").alias("ia"), F.col("bits").alias("ba"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("pa"))
    b = mixed.select(F.col("key").alias("kb"), F.col("node").alias("b"), F.col("root").alias("rb"), F.col("size").alias("nb"), F.col("at").alias("ib"), F.col("bits").alias("bb"), F.pmod(F.xxhash64("node"), salts).cast("int").alias("pb"))
    sizes = F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-6
    left = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) * (1 + similarity) >= similarity * (F.col("na") + F.col("nb")) - 1e-6
    differ = sum((F.bit_count(F.col("ba")[i].bitwiseXOR(F.col("bb")[i])) for i in range(PARITY // 64)), F.lit(0))
    near = differ * (1 + similarity) <= (1 - similarity) * (F.col("na") + F.col("nb")) + 1e-6
    met = a.join(b, (F.col("ka") == F.col("kb")) & (F.col("pa") == F.col("pb")) & (F.col("ra") < F.col("rb")) & sizes & left & near)
    return met.select("a", "b").distinct(), [mixed]


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component_id): groups of texts whose sets of word shingles overlap by at least ``similarity``.

    Shingles are compared by 64-bit hashes; texts whose sets have the same 64-bit hash are one node. First come cheap candidates:
    the fingerprint's blocks, and blocks of min-wise samples (24 bands of 6), where each node is compared with leaders of its key
    only. These links make most groups. Then every pair of nodes in different groups that shares a value of its
    prefixes is a candidate as well (``_open_pairs``), so that no pair is missed. All candidates are verified on their whole sets.
    Texts without words are one group. A group that has no id is left alone.
    """
    common = common_shingles(docs, text_col, shingle)
    made = stored(docs.select(F.col(id_col).alias("id"), sketches(F.col(text_col), common, shingle, similarity).alias("s")).select("id", "s.*"), "sketch")
    first = [F.first(c).alias(c) for c in ("size", "fp", "bands", "keys", "slots", "at", "sizes", "bits")]
    nodes = stored(made.groupBy("node").agg(F.min("id").alias("least"), *first), "sketch-nodes")
    rows = stored(made.select("id", "node"), "sketch-ids")
    discard(made)

    def verified(candidates: DataFrame, used: list[DataFrame]) -> DataFrame:
        pairs = stored(candidates, "sketch-pairs")
        discard(*used)
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("want")).distinct().join(nodes.select(F.col("node").alias("want"), "least"), "want").where("least is not null")
        texts = docs.select(F.col(id_col).alias("least"), F.col(text_col).alias("text")).join(wanted, "least")
        # an id may stand for several texts; any text of a node will do, as their sets are equal
        # stored before the filter, else Spark would make the sets of all documents for the join
        made = stored(texts.select("want", _sets(F.col("text"), shingle).alias("s")), "sketch-sets")
        # stored again, so that the joins have shuffles of their own, which Spark splits where one node has many pairs
        sets = stored(made.where("s.node = want").select(F.col("want").alias("node"), "s.set").dropDuplicates(["node"]), "sketch-set")
        discard(made)
        x = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
        out = stored(x.where(_jaccard(F.col("sa"), F.col("sb")) >= similarity).select("a", "b"), "sketch-similar")
        discard(pairs, sets)
        return out

    likely = verified(*_cheap_pairs(nodes))
    roots = components(likely)
    rest = verified(*_open_pairs(nodes, roots, similarity))
    done = components(rest.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b"))))
    group, used = _labelled(nodes, "node", "least", done)
    own = stored(nodes.select("node", "least").join(group, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id")), "sketch-groups")
    discard(likely, roots, rest, done, nodes, *used)
    return rows.join(own, "node").select(F.col("id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group (all rows of that id; rows without an id go unless alone).

    Groups are those of ``similar_groups``.
    """
    groups = similar_groups(docs, id_col, text_col, shingle, similarity)
    kept = groups.select(F.col("component_id").alias("_keep")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_keep"]), "left_semi")
