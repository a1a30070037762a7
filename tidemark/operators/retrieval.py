"""Lexical, vector and hybrid retrieval for many queries at once."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

DIMS = 256


def terms(query: Column) -> Column:
    """Distinct lower-case words of a query."""
    return F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit("([a-z0-9]+)"), F.lit(1)))


def lexical(docs: DataFrame, query: str) -> DataFrame:
    """(doc, lexical): share of the query's words that the text contains anywhere (SIM-06). One scan, no shuffle."""
    words = [w for w in dict.fromkeys("".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split())]
    hay = F.lower(F.concat_ws(" ", "uri", "text"))
    hits = sum((hay.contains(w).cast("int") for w in words), F.lit(0))
    return docs.select("doc", (hits / max(1, len(words))).alias("lexical"))


def _number(word: str) -> int:
    return int.from_bytes(sha256(word.encode()).digest()[:8], "big")


#: Bytes that words are made of; all others part them.
_WORD = np.full(256, 32, np.uint8)
_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = [*b"abcdefghijklmnopqrstuvwxyz0123456789"]
#: Numbers of a matrix that a task holds at once.
_HELD = 1 << 21


def _signed(texts: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, number) of lower-case texts: signs of their words added up; each different word is hashed once."""
    texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_string())])
    _, edges, data = texts.buffers()
    plain = _WORD[np.frombuffer(data, np.uint8)] if data is not None and data.size else np.zeros(0, np.uint8)
    parts = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), edges, pa.py_buffer(plain)))
    words = parts.flatten().dictionary_encode()
    names = words.dictionary.to_pylist()
    sign = np.array([0 if not w else 1 if _number(f"sign:{w}") % 2 == 0 else -1 for w in names], np.int64)
    bucket = np.array([_number(w) % dims for w in names], np.int64)
    code = words.indices.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    sums = np.bincount(row * dims + bucket[code], sign[code], len(texts) * dims) if len(code) else np.zeros(0)
    at = np.flatnonzero(sums)
    return at // dims, at % dims, sums[at].astype(np.int64)


def embed_sparse(docs: DataFrame, dims: int = DIMS) -> DataFrame:
    """(doc, bucket, weight): sign-hashed bag of words of length 1 in ``dims`` buckets (SIM-07). Zero vectors have no rows.

    The bucket is the first eight bytes of the word's SHA-256, as a number, modulo ``dims``; the sign the parity of the same number for ``sign:word``.
    Tasks add up the words of each text, so that one short row of a text is moved to the others of its document, not its words.
    """
    kind = docs.schema["doc"].dataType.simpleString()
    lists = lambda size, values, t: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(values, t))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, _HELD // dims)
        for whole in batches:
            for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                row, bucket, x = _signed(b.column(1), dims)
                size = np.bincount(row, minlength=b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(0), lists(size, bucket, pa.int32()), lists(size, x, pa.int64())], ["doc", "b", "x"])

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, _HELD // dims)
        for whole in batches:
            for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False))
                at = row * dims + b.column(1).flatten().to_numpy(zero_copy_only=False)
                x = np.bincount(at, b.column(2).flatten().to_numpy(zero_copy_only=False), b.num_rows * dims).reshape(-1, dims)
                norm = np.sqrt((x * x).sum(1))
                row, bucket = np.nonzero(x)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(bucket, pa.int32()), pa.array(x[row, bucket] / norm[row])], ["doc", "bucket", "weight"])

    short = docs.select("doc", F.lower("text").alias("text")).mapInArrow(add, f"doc {kind}, b array<int>, x array<bigint>").where(F.size("b") > 0)
    one = short.groupBy("doc").agg(F.collect_list(F.struct("b", "x")).alias("r")).select("doc", F.flatten("r.b").alias("b"), F.flatten("r.x").alias("x"))
    return one.mapInArrow(scale, f"doc {kind}, bucket int, weight double")


class HashEmbedder:
    """Texts to sign-hashed bags of words of length 1: the dense twin of ``embed_sparse``, and the pattern for embedders of one's own."""

    def __init__(self, dims: int = DIMS):
        self.dims = dims

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for row, text in zip(out, texts):
            for w in re.findall("[a-z0-9]+", text.lower()):
                row[_number(w) % self.dims] += 1 if _number(f"sign:{w}") % 2 == 0 else -1
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        return np.divide(out, norm, out=out, where=norm > 0)


_MADE: dict[str, Callable] = {}


def embed(docs: DataFrame, make: Callable[[], Callable[[list[str]], np.ndarray]], id_col: str = "doc", text_col: str = "text") -> DataFrame:
    """(id, vector): an array of floats for each text by an embedder of one's own (UDF-08).

    ``make`` is called once in each Python worker and gives a function from a list of texts to a matrix with a row for each; every batch of a
    task goes through that one object. Null texts are empty texts.
    """
    name = sha256(cloudpickle.dumps(make)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = _MADE.get(name)
        if embedder is None:
            embedder = _MADE[name] = make()
        for b in batches:
            made = np.asarray(embedder([t or "" for t in b.column(1).to_pylist()]), np.float32)
            edges = pa.array(np.arange(len(made) + 1) * made.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(edges, pa.array(made.reshape(-1)))], [id_col, "vector"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, vector array<float>")


def cosine_sparse(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query, doc, vector) of unit vectors that share a bucket (SIM-08)."""
    q = queries.select(F.col("doc").alias("query"), "bucket", F.col("weight").alias("qw"))
    return q.join(docs, "bucket").groupBy("query", "doc").agg(F.sum(F.col("qw") * F.col("weight")).alias("vector"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 if either is zero; unequal lengths are an error (SIM-08)."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors of unequal length")))


def blend(lex: DataFrame, vec: DataFrame) -> DataFrame:
    """Half of each score, negative vectors as 0 (SIM-09)."""
    x = lex.join(vec, "doc", "full")
    return x.select("doc", (0.5 * F.coalesce("lexical", F.lit(0.0)) + 0.5 * F.greatest(F.coalesce("vector", F.lit(0.0)), F.lit(0.0))).alias("score"))


def top_k(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The best k with a positive score; ties by document (TOP-01 to TOP-03)."""
    return scores.where(F.col(score) > 0).orderBy(F.desc(score), "doc").limit(k)


def top_k_each(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The best k of every query."""
    w = W.partitionBy("query").orderBy(F.desc(score), "doc")
    return scores.where(F.col(score) > 0).withColumn("k", F.row_number().over(w)).where(F.col("k") <= k)


def evidence(sections: DataFrame, words: list[str]) -> DataFrame:
    """Sections (doc, s_order, title, content) with any word, cut to 280 characters; a document without one gives its first section (SIM-10)."""
    low = F.lower("content")
    hit = F.lit(False)
    for w in words:
        hit = hit | low.contains(w)
    found = sections.where(hit).select("doc", "s_order", "title", F.substring("content", 1, 280).alias("excerpt"))
    rest = sections.join(found.select("doc").distinct(), "doc", "left_anti").groupBy("doc").agg(F.min_by(F.struct("s_order", "title", "content"), "s_order").alias("s"))
    return found.unionByName(rest.select("doc", "s.s_order", "s.title", F.col("s.content").alias("excerpt")))


def answer(hits: DataFrame) -> DataFrame:
    """Three best hits as cited lines in one text (SIM-11)."""
    w = hits.orderBy(F.desc("score"), "doc").limit(3)
    line = F.concat(F.lit("- "), F.col("excerpt"), F.lit(" ["), F.col("uri"), F.lit("]"))
    lines = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc", line.alias("line"))))
    return w.agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("answer"))


def document_text(title: Column, kind: Column, sections: Column, entities: Column) -> Column:
    """Title, type, section titles and bodies, entity names (SIM-12)."""
    parts = F.flatten(F.transform(sections, lambda s: F.array(s["title"], s["content"])))
    return F.concat_ws(" ", title, kind, parts, F.transform(entities, lambda e: e["name"]))
