"""Topics of documents: clusters of hashed word counts, found by k-means within each language.

``vector`` turns a whole text into ``DIMS`` whole numbers, ``learn`` clusters a stored table of these by rounds of k-means over all rows; a round is one
Spark job of which only sums by topic reach the driver. They are sums of whole numbers, so neither order nor partitions matter. The places where the rounds
begin come from all rows too: ``DEPTH`` times each centre is split in two along the main direction of the texts nearest to it, of which one job adds up the second moments. A topic
is ``language/number``, number 0 being the largest by words; a language that isn't named shares ``(rest)``. Shares are those of all words.
Words are split and coded by Arrow, each different word is hashed once, and numpy adds up the counts.

Defined results: a null text, one without words, and any text of a language that the model doesn't know have the topic ``(rest)`` of
that language. Equal texts of one language get equal topics. An empty table gives a model without topics.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

DIMS, DEPTH, ROUNDS, LEAST = 256, 2, 25, 0.05
#: Not read any more, as nothing is sampled.
SAMPLE = 1000
#: Shorter texts teach nothing, unless a language has no others.
MIN_WORDS = 20
REST = "(rest)"
_RUN = 1 << 20


def counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed word counts, one row for each text, and the number of words; words are runs without ASCII white space, A-Z lower-cased."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = parts.flatten().dictionary_encode()
    names = words.dictionary.to_pylist()
    bucket = np.fromiter((zlib.crc32(w.encode()) % DIMS if w else DIMS for w in names), np.int64, len(names))
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    codes = bucket[words.indices.to_numpy(zero_copy_only=False)]
    full = np.bincount(row * (DIMS + 1) + codes, minlength=len(texts) * (DIMS + 1)).reshape(-1, DIMS + 1)[:, :DIMS]
    return full, full.sum(1)


def unit(full: np.ndarray) -> np.ndarray:
    """Square roots of the counts, each row of length 1."""
    x = np.sqrt(full)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)


@dataclass(frozen=True)
class Model:
    """Centres of each language's topics and the share of the language's words that each topic has, both of all texts."""

    centres: dict[str, np.ndarray]
    shares: dict[str, np.ndarray]


#: Units of the whole numbers that vectors are made of and rounds add up, and the distance within which a round leaves all centres when they are done.
UNIT, STILL = float(1 << 30), 1e-4
#: Vectors are shifted so many bits before they are squared, and second moments travel in so many bands of rows.
_SHIFT, _BANDS = 18, 8


def whole(full: np.ndarray) -> np.ndarray:
    """Unit vectors of counts, in whole numbers of 1 / ``UNIT``."""
    return np.rint(unit(full) * UNIT).astype("<i4")


def vector(text: Column) -> Column:
    """A struct of ``v`` (``whole`` as bytes) and ``tokens`` (the number of words) for each whole text."""

    @F.pandas_udf("v binary, tokens long")
    def of(texts: pd.Series) -> pd.DataFrame:
        v, tokens = [], []
        for a, b in _runs(texts):
            full, n = counts(pa.array(texts[a:b], pa.string()))
            v += [x.tobytes() for x in whole(full)]
            tokens += n.tolist()
        return pd.DataFrame({"v": v, "tokens": tokens})

    return of(text)


def _runs(texts: pd.Series) -> list[tuple[int, int]]:
    """Ranges of texts with about ``_RUN`` signs."""
    sizes = texts.str.len().fillna(0).to_numpy()
    cuts = np.unique((np.cumsum(sizes) - sizes) // _RUN, return_index=True)[1].tolist()
    return list(zip(cuts, [*cuts[1:], len(texts)]))


def _matrix(column: pa.Array) -> np.ndarray:
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[edges[0] : edges[-1]].view("<i4").reshape(-1, DIMS).astype(np.float64)


def _groups(batches: Iterator[pa.RecordBatch], centres: dict[str, np.ndarray]) -> Iterator[tuple]:
    """(language, vectors in whole numbers, words, number of the nearest centre) for each batch of (lang, v, tokens) and language."""
    for b in batches:
        if not b.num_rows:
            continue
        every, words = _matrix(b.column(1)), b.column(2).to_numpy(zero_copy_only=False)
        for k, c in centres.items():
            mine = pc.fill_null(pc.equal(b.column(0), k), False).to_numpy(zero_copy_only=False)
            if mine.any():
                x = every[mine]
                yield k, x, words[mine], nearest(x / UNIT, c)


def _totals(vectors: DataFrame, centres: dict[str, np.ndarray], least: int) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each language: sums of the unit vectors nearest to each centre, their number (both of texts of ``least`` words or more), and the words of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {k: np.zeros((len(c), DIMS + 2), np.int64) for k, c in centres.items()}
        for k, x, words, own in _groups(batches, centres):
            # products of whole numbers, which doubles hold exactly for a batch
            near = (own[:, None] == np.arange(len(centres[k]))).astype(np.float64)
            long = near * (words >= least)[:, None]
            found[k][:, :DIMS] += (long.T @ x).astype(np.int64)
            found[k][:, DIMS] += long.sum(0).astype(np.int64)
            found[k][:, DIMS + 1] += (near.T @ words).astype(np.int64)
        rows = [(k, i, v) for k, t in found.items() for i, v in enumerate(t)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2].tolist() for r in rows], pa.list_(pa.int64()))], ["lang", "topic", "sums"])

    parts = vectors.mapInArrow(run, "lang string, topic int, sums array<bigint>").select("lang", "topic", F.posexplode("sums").alias("at", "n"))
    out = {k: np.zeros((len(c), DIMS + 2), np.int64) for k, c in centres.items()}
    for r in parts.where("n <> 0").groupBy("lang", "topic", "at").agg(F.sum("n").alias("n")).collect():
        out[r["lang"]][r["topic"], r["at"]] = r["n"]
    return {k: (t[:, :DIMS] / UNIT, t[:, DIMS], t[:, DIMS + 1]) for k, t in out.items()}


def _split(vectors: DataFrame, centres: dict[str, np.ndarray], least: dict[str, int]) -> dict[str, np.ndarray]:
    """Two centres for each one: the mean of the texts nearest to it, moved both ways along their main direction. Those of equal texts stay one; those without texts go."""
    rows = DIMS // _BANDS
    schema = "lang string, topic int, band int, sums binary"

    def batch(found: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[i] for k in found], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))] + [pa.array([v.astype("<i8").tobytes() for v in found.values()], pa.binary())], ["lang", "topic", "band", "sums"])

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {}
        for k, x, words, own in _groups(batches, centres):
            for i in range(len(centres[k])):
                y = np.floor(x[(own == i) & (words >= least[k])] / (1 << _SHIFT))
                # the last band: sums and their number
                made = [*np.split(y.T @ y, _BANDS), np.append(y.sum(0), len(y))]
                for band, m in enumerate(made):
                    found[k, i, band] = found.get((k, i, band), 0) + m.astype(np.int64).reshape(-1)
        yield batch(found)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {}
        for b in batches:
            for k, i, band, v in zip(*(c.to_pylist() for c in b.columns)):
                found[k, i, band] = found.get((k, i, band), 0) + np.frombuffer(v, "<i8")
        yield batch(found)

    summed = vectors.mapInArrow(squares, schema).repartition("lang", "topic", "band").mapInArrow(add, schema)
    got = {(r["lang"], r["topic"], r["band"]): np.frombuffer(r["sums"], "<i8").astype(np.float64) for r in summed.collect()}
    out = {}
    for k, c in centres.items():
        new = []
        for i in range(len(c)):
            tail = got.get((k, i, _BANDS), np.zeros(DIMS + 1))
            n = tail[-1]
            if not n:
                continue
            step = UNIT / (1 << _SHIFT)
            mean = tail[:-1] / n / step
            spread = np.concatenate([got[k, i, band].reshape(rows, DIMS) for band in range(_BANDS)]) / n / step**2 - np.outer(mean, mean)
            size, way = np.linalg.eigh(spread)
            # the mean distance of a half from the middle, if texts lie about it as in a normal distribution
            far = np.sqrt(max(size[-1], 0.0) * 2 / np.pi)
            new += [mean - far * way[:, -1], mean + far * way[:, -1]] if far > STILL else [mean]
        out[k] = np.stack(new)
    return out


def fit(docs: DataFrame, langs: list[str], text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of all texts of these languages."""
    own = vector(F.col(text_col))
    rows = stored(docs.select(F.col(lang_col).alias("lang"), own.alias("x")).select("lang", "x.v", "x.tokens"), "topic-vectors")
    model = learn(rows, langs)
    discard(rows)
    return model


def learn(vectors: DataFrame, langs: list[str]) -> Model:
    """A model of these languages from a stored table (lang, v, tokens) of ``vector``."""
    vectors = vectors.where(F.col("lang").isin(langs) & (F.col("tokens") > 0)).select("lang", "v", "tokens")
    least = {r["lang"]: MIN_WORDS if r["most"] >= MIN_WORDS else 0 for r in vectors.groupBy("lang").agg(F.max("tokens").alias("most")).collect()}
    if not least:
        return Model({}, {})
    open_ = {k: np.zeros((1, DIMS)) for k in sorted(least)}
    for _ in range(DEPTH):
        open_ = _split(vectors, open_, least)
    centres, shares, rounds = {}, {}, 0
    while open_:
        got = {}
        for floor in {least[k] for k in open_}:
            got |= _totals(vectors, {k: c for k, c in open_.items() if least[k] == floor}, floor)
        rounds += 1
        for k, (sums, n, words_of) in got.items():
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], open_[k])
            part = words_of / max(words_of.sum(), 1)
            if rounds < ROUNDS and np.abs(new - open_[k]).max() > STILL:
                open_[k] = new
            elif part.min() < LEAST and len(part) > 1:
                open_[k] = np.delete(open_[k], part.argmin(), 0)
            else:
                order = np.argsort(-part, kind="stable")
                centres[k], shares[k] = open_.pop(k)[order], part[order]
    return Model(centres, shares)


def _named(x: np.ndarray, words: np.ndarray, langs: np.ndarray, model: Model) -> list[str]:
    at = np.full(len(x), -1)
    for name, centres in model.centres.items():
        mine = (langs == name) & (words > 0)
        at[mine] = nearest(x[mine] / UNIT, centres)
    return [f"{v if v in model.centres else REST}/{t}" if t >= 0 else f"{v if v in model.centres else REST}/{REST}" for v, t in zip(langs, at.tolist())]


def topic(v: Column, tokens: Column, lang: Column, model: Model) -> Column:
    """The topic of each text whose ``vector`` is given."""

    @F.pandas_udf("string")
    def of(vs: pd.Series, words: pd.Series, langs: pd.Series) -> pd.Series:
        x = np.frombuffer(b"".join(vs), "<i4").reshape(-1, DIMS).astype(np.float64)
        return pd.Series(_named(x, words.to_numpy(), langs.to_numpy(), model), dtype=object)

    return of(v, tokens, lang)


def features(text: Column, lang: Column, model: Model) -> Column:
    """A struct of ``topic`` and ``tokens`` (the number of words) for each whole text."""

    @F.pandas_udf("topic string, tokens long")
    def of(texts: pd.Series, langs: pd.Series) -> pd.DataFrame:
        topics, tokens = [], []
        for a, b in _runs(texts):
            full, n = counts(pa.array(texts[a:b], pa.string()))
            topics += _named(whole(full).astype(np.float64), n, langs[a:b].to_numpy(), model)
            tokens += n.tolist()
        return pd.DataFrame({"topic": topics, "tokens": tokens})

    return of(text, lang)
