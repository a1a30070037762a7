"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of training text. A
text is encoded with every dictionary; the language of the smallest result
wins. Texts are lower-cased and reduced to runs of letters first, so that signs,
digits and capitals don't count. A text is encoded in chunks of fixed size, each with
the fresh dictionary, so that the dictionary helps the end of a long text as much as its
beginning. The margin is the share by which the best beats
the second, over all chunks; a narrow one is a rejection. Equal sizes are settled by encoding
with parts of the dictionaries, then by the order of names.

The model is fitted on a bounded sample: of at most ``DOCS_PER_LANG`` different texts for
each language, chosen by a hash of the text, the first ``SNIPPET`` characters of each are put together up to ``DICT_BYTES``
(64 KB: about 45 texts of 1,500 characters, more if they are shorter). Copies of a text count
once. All languages that rows name are learned. Predictions read whole texts.

Defined results: null texts and texts without a letter are ``und`` with score
0. Rows without a language teach nothing. With no training text every prediction is ``und``. Other columns stay
as they are, whatever their names; repeated rows get equal results; empty tables give empty ones.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from hashlib import sha1

import pandas as pd
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

DOCS_PER_LANG = 400
SNIPPET = 1500
DICT_BYTES = 1 << 16
PART_BYTES = 1 << 13
#: Texts are encoded in chunks of so many bytes.
CHUNK_BYTES = 1 << 13
#: A narrower share between best and second is a rejection.
MARGIN = 0.01

_OTHER = re.compile(r"[\W\d_]+")
_FRAME = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}


def normal(text: str) -> bytes:
    return (" " + _OTHER.sub(" ", text.lower()).strip() + " ").encode()


@dataclass(frozen=True)
class Model:
    """Names and raw-content dictionaries."""

    langs: tuple[str, ...]
    contents: tuple[bytes, ...]

    @property
    def key(self) -> str:
        return sha1(repr(self).encode()).hexdigest()


class _Encoders:
    def __init__(self, model: Model):
        params = zstd.ZstdCompressionParameters.from_level(3, min_match=4, strategy=zstd.STRATEGY_LAZY2, search_log=4, window_log=20, chain_log=16, hash_log=17, **_FRAME)
        short = zstd.ZstdCompressionParameters.from_level(3, min_match=3, strategy=zstd.STRATEGY_BTOPT, search_log=4, window_log=18, chain_log=14, hash_log=14, target_length=16, **_FRAME)
        self.langs = model.langs
        self.whole = [self._made(c, params) for c in model.contents]
        self.contents, self.short, self.parts = model.contents, short, {}
        self.empty = len(self.whole[0].compress(b"")) if self.whole else 0

    @staticmethod
    def _made(content: bytes, params) -> zstd.ZstdCompressor:
        d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        return zstd.ZstdCompressor(compression_params=params, dict_data=d)

    def _fine(self, i: int, chunks: list[bytes]) -> float:
        """Bytes by parts of a dictionary, on average: finer than the whole, for ties."""
        if i not in self.parts:
            c = self.contents[i]
            self.parts[i] = [self._made(c[k : k + PART_BYTES], self.short) for k in range(0, len(c), PART_BYTES)]
        return sum(len(e.compress(c)) for e in self.parts[i] for c in chunks) / max(1, len(self.parts[i]))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin)."""
        if not self.langs or text is None or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0
        data = normal(text)
        chunks = [data[i : i + CHUNK_BYTES] for i in range(0, len(data), CHUNK_BYTES)]
        sizes = [sum(len(e.compress(c)) - self.empty for c in chunks) for e in self.whole]
        low = min(sizes)
        best = [i for i, n in enumerate(sizes) if n == low]
        if len(best) > 1:
            total = {i: self._fine(i, chunks) for i in best}
            best.sort(key=lambda i: (total[i], i))
        rest = sorted(sizes)
        margin = 1 - rest[0] / max(1, rest[1]) if len(rest) > 1 else 1.0
        return self.langs[best[0]], min(1.0, 0.5 + 5 * margin), margin


_MADE: dict[str, _Encoders] = {}


def _encoders(model: Model) -> _Encoders:
    if model.key not in _MADE:
        _MADE.clear()
        _MADE[model.key] = _Encoders(model)
    return _MADE[model.key]


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from rows with a text and a language. The sample of a language, at most 64 KB, comes to the driver."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text rlike '\\\\p{L}'")
    spread = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)
    counts = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("texts"), F.min(spread).alias("least"))
    counts = counts.collect()
    if not counts:
        return Model((), ())
    # four times what is needed of the different texts, and one at least
    share = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(max(r["least"], 4.0 * DOCS_PER_LANG / r["texts"])))))
    some = rows.where(spread <= share[F.col("lang")]).select("lang", F.xxhash64("text").alias("h"), F.substring("text", 1, SNIPPET).alias("t"))
    some = some.groupBy("lang", "h").agg(F.min("t").alias("t"))
    some = some.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("k") <= DOCS_PER_LANG)
    by: dict[str, list[tuple[int, bytes]]] = {}
    for r in some.collect():
        by.setdefault(r["lang"], []).append((r["k"], normal(r["t"])))
    langs = tuple(sorted(by))
    return Model(langs, tuple(b"".join(t for _, t in sorted(by[x]))[:DICT_BYTES] for x in langs))


def identify(text: Column, model: Model) -> Column:
    """A struct of lang_pred, score (0 to 1) and margin for each whole text."""

    @F.pandas_udf("lang_pred string, score double, margin double")
    def of(texts: pd.Series) -> pd.DataFrame:
        made = _encoders(model)
        return pd.DataFrame([made.predict(t) for t in texts], columns=["lang_pred", "score", "margin"])

    return of(text)


def accepted(docs: DataFrame, model: Model, text_col: str = "text", margin: float = MARGIN, fill: str | None = None) -> DataFrame:
    """The rows whose language is clear; all columns as they were, but nulls of the column ``fill`` are the predicted language."""
    names = docs.columns
    judged = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)), identify(F.col(text_col), model).alias("guess"))
    kept = judged.where((F.col("guess.lang_pred") != "und") & (F.col("guess.margin") >= margin))
    return kept.select(*((F.coalesce(f"c{i}", "guess.lang_pred") if c == fill else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)))
