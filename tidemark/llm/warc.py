"""WARC files and a Merkle fixity audit of replicas.

``write`` puts pages into WARC files in a folder, as response records one after another: a folder of
gzipped ``.txt`` files whose bytes, unpacked, are plain WARC/1.1. ``nodes`` reads the stored bytes back, walks the
records by their declared lengths and hashes each one with its ordered offset range; sixteen
hashes in order make one above, up to one root for each file. ``audit`` compares the roots of two replicas
first; below, only children of nodes that differ are joined, level by level, so branches that
agree are never looked at again.

Records are dealt to as many files as make ``FILE_BYTES`` each, by a hash of key and address, whatever the keys look like, and lie in order of the key inside;
so a task reads one bounded file, and the number of files follows the bytes. ``layout`` counts them. It also finds files that would hold many more bytes (a page that
is stored very many times) and says into how many files these are dealt, by a hash of the record and its number among equal ones; both
replicas are written by the layout of the first.

Defined results: a record that only one replica has is ``missing`` or ``extra``; one whose bytes or offset range
differ is ``changed`` (in a dealt file, where a changed record has another place, it is missing and extra). Bytes that are
no record end the file: what follows them is one record without a key. Null payloads and addresses are empty. Records of equal key are
ordered by address and bytes. A key that is null or no number is null; such pages are spread over files by their address. Other columns are ignored, whatever their names. Empty tables give no findings.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored

#: Bytes of a file before compression, about; a file is dealt anew from CROWDED times as many on; children of a node; levels (the top one takes all that is left).
FILE_BYTES, CROWDED, FAN, HEIGHT = 16 << 20, 4, 16, 4
_BREAK = "\r\n\r\n"
_LENGTH = re.compile(rb"\r\nContent-Length: (\d+)\Z")
_KEY = re.compile(rb"\r\nX-Page-Key: (-?\d+)\r\n")


def record(key: Column, uri: Column, payload: Column, stamp: str = "2024-01-01T00:00:00Z") -> Column:
    """One WARC/1.1 response record, without the two line ends that close it."""
    payload, uri = F.coalesce(payload, F.lit("")), F.regexp_replace(F.coalesce(uri, F.lit("")), "[\r\n]+", " ")
    name = F.concat(F.lit("urn:sha256:"), F.sha2(F.encode(F.concat(uri, payload), "UTF-8"), 256))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), uri,
        F.coalesce(F.concat(F.lit("\r\nX-Page-Key: "), key.cast("string")), F.lit("")),
        F.lit(f"\r\nWARC-Date: {stamp}\r\nWARC-Record-ID: <"), name,
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(F.encode(payload, "UTF-8")).cast("string"), F.lit(_BREAK), payload,
    )


def records(pages: DataFrame, key: str, uri: str, payload: str) -> DataFrame:
    """(key, uri, payload)."""
    return pages.select(F.col(key).try_cast("long").alias("key"), F.col(uri).alias("uri"), F.col(payload).alias("payload"))


class Layout(NamedTuple):
    """The number of files, and (slot, files) of those that are dealt anew."""

    n: int
    crowded: DataFrame


def _slot(n: int) -> Column:
    return F.pmod(F.xxhash64("key", "uri"), F.lit(n)).alias("slot")


def layout(recs: DataFrame, file_bytes: int = FILE_BYTES) -> Layout:
    """How records are dealt to files. Stored."""
    size = F.coalesce(F.octet_length("payload"), F.lit(0)) + F.coalesce(F.octet_length("uri"), F.lit(0)) + 300
    # sums by key and address come first: a page that is stored very many times is one row then
    each = stored(recs.groupBy(F.xxhash64("key", "uri").alias("h")).agg(F.sum(size.cast("long")).alias("bytes")), "warc-sizes")
    n = max(1, -(-(each.agg(F.sum("bytes")).first()[0] or 0) // file_bytes))
    by = each.groupBy(F.pmod("h", F.lit(n)).alias("slot")).agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > CROWDED * file_bytes)
    out = Layout(n, stored(by.select("slot", F.ceil(F.col("bytes") / file_bytes).cast("long").alias("files")), "warc-layout"))
    discard(each)
    return out


def write(recs: DataFrame, plan: Layout, path: str) -> None:
    """WARC files under ``path``, one folder for each."""
    placed = recs.select(_slot(plan.n), "key", "uri", "payload").join(plan.crowded, "slot", "left")
    plain = placed.where("files is null").select("slot", F.lit(0).cast("long").alias("part"), "key", "uri", "payload")
    # equal records of a crowded file are counted before they move, then told apart by their number
    crowd = placed.where("files is not null").groupBy("slot", "files", "key", "uri", "payload").agg(F.count("*").alias("n"))
    crowd = crowd.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    crowd = crowd.select("slot", F.pmod(F.xxhash64("uri", "payload", "i"), F.col("files")).alias("part"), "key", "uri", "payload")
    rows = plain.unionByName(crowd).withColumn("file", F.concat_ws("-", "slot", "part"))
    ordered = rows.repartition("file").sortWithinPartitions("file", "key", "uri", "payload")
    made = ordered.select("file", record(F.col("key"), F.col("uri"), F.col("payload")).alias("value"))
    made.write.partitionBy("file").option("lineSep", _BREAK).option("compression", "gzip").text(path)


def walk(data: bytes) -> Iterator[tuple[int | None, int, int]]:
    """(key, start, size) of every record of a file's bytes."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        length = _LENGTH.search(data, at, head) if head >= 0 and data.startswith(b"WARC/1.1\r\n", at) else None
        end = head + 8 + int(length[1]) if length else len(data)
        if not length or data[end - 4 : end] != b"\r\n\r\n":
            yield None, at, len(data) - at
            return
        key = _KEY.search(data, at, head)
        yield int(key[1]) if key else None, at, end - at
        at = end


def tree(data: bytes) -> list[tuple]:
    """(level, place, hash, key, start, size): the leaves of a file's bytes and all nodes above them."""
    rows = []
    for place, (key, start, size) in enumerate(walk(data)):
        own = hashlib.sha256(data[start : start + size]).hexdigest()
        rows.append((0, place, hashlib.sha256(f"{start}:{size}:{own}".encode()).hexdigest(), key, start, size))
    below = [r[2] for r in rows]
    for level in range(1, HEIGHT + 1):
        fan = FAN if level < HEIGHT else max(1, len(below))
        below = [hashlib.sha256("".join(below[i : i + fan]).encode()).hexdigest() for i in range(0, len(below), fan)]
        rows += [(level, place, h, None, None, None) for place, h in enumerate(below)]
    return rows


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """(file, level, place, hash, key, start, size) of all files under ``path``, from the stored bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path)
    named = files.select(F.regexp_extract("path", "/file=([^/]*)/", 1).alias("file"), "content")
    names = ["file", "level", "place", "hash", "key", "start", "size"]
    types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = tree(zlib.decompress(content.as_py(), 31))
                columns = [[file] * len(rows), *(zip(*rows) if rows else [[]] * 6)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    return named.mapInArrow(run, "file string, level int, place long, hash string, key long, start long, size long")


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = a.select("file", "place", F.col("hash").alias("ha")), b.select("file", "place", F.col("hash").alias("hb"))
    return x.join(y, ["file", "place"], "full").where(~F.col("ha").eqNullSafe(F.col("hb"))).select("file", "place")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(file, place, key, start, size, status) of every record where two tables of ``nodes`` differ."""
    top = lambda t: t.where(F.col("level") == HEIGHT)
    bad = stored(_differing(top(primary), top(replica)), "merkle-bad")
    for level in range(HEIGHT - 1, -1, -1):
        fan = FAN if level < HEIGHT - 1 else 1 << 62
        above = bad.select("file", F.col("place").alias("above"))
        of = lambda t: t.where(F.col("level") == level).withColumn("above", F.floor(F.col("place") / F.lit(fan))).join(above, ["file", "above"], "left_semi")  # noqa: B023, E731
        lower = stored(_differing(of(primary), of(replica)), "merkle-bad")
        discard(bad)
        bad = lower
    leaf = lambda t, name: t.where("level = 0").join(bad, ["file", "place"], "left_semi").select("file", "place", F.struct("key", "start", "size").alias(name))
    one = leaf(primary, "p").join(leaf(replica, "r"), ["file", "place"], "full")
    status = F.when(F.col("r").isNull(), "missing").when(F.col("p").isNull(), "extra").otherwise("changed")
    at = F.coalesce("p", "r")
    return one.select("file", "place", at["key"].alias("key"), at["start"].alias("start"), at["size"].alias("size"), status.alias("status"))
