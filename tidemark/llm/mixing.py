"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Documents are summed to tokens by cell (one value of each dimension). The cells
are raked until their marginals meet the targets; a document's probability is its
cell's factor, scaled so that the largest is 1, so no document is needed twice.
A document stays if a hash of its id, in (0, 1), is below its probability.

The number of cells is bounded by the targets given, not by the data: values
that a target doesn't name share one rest value. Only these sums reach the driver.

Defined results: a null value, and a value without a target, belong to the rest,
whose target is what the named ones leave; if they leave nothing, it keeps its own share
of the tokens and the named ones divide what is left. A target in a dimension of ``limits``
is an upper bound: a value with a smaller share keeps that. A target
for a value without documents is left out and the others scaled up. Documents without words
weigh nothing and follow their cell. Repeated ids stay or go together; a null id has one number drawn for all. An empty table gives an empty one.
Other columns stay; a column named ``mix`` is replaced by that of ``mix``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import topics
from .common import stored

REST = "(rest)"
ROUNDS, TOLERANCE = 200, 1e-9
#: The least factor of a cell, beside the largest.
FLOOR = 1e-3
#: Dimensions whose targets are upper bounds.
LIMITS = frozenset({"source"})


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray]) -> np.ndarray:
    """Factors of cells such that their weighted tokens meet the shares of every dimension (as nearly as they allow)."""
    factor = np.ones(len(tokens))
    for _ in range(ROUNDS):
        worst = 0.0
        for code, share in zip(codes, targets):
            now = np.bincount(code, tokens * factor, len(share))
            total = now.sum()
            if total <= 0:
                return factor
            there = now > 0
            want = np.where(there, share, 0.0)
            want = want / max(want.sum(), 1e-300)
            scale = np.where(there, want * total / np.where(there, now, 1.0), 1.0)
            worst = max(worst, float(np.abs(now / total - want).max()))
            factor = factor * scale[code]
            # targets that contradict one another would drive cells apart without end
            factor = np.maximum(factor / factor.max(), FLOOR)
        if worst < TOLERANCE:
            break
    return factor


def shares(named: list[float], own: np.ndarray, limit: bool) -> np.ndarray:
    """Targets of the named values and of the rest, from the own shares of the tokens of each."""
    want = np.array(named, float)
    if limit:
        want = np.minimum(want, own[:-1])
    left = 1.0 - want.sum()
    if left > TOLERANCE:
        return np.append(want, left)
    return np.append(want / max(want.sum(), 1e-300) * (1.0 - own[-1]), own[-1])


def probabilities(docs: DataFrame, targets: dict[str, dict[str, float]], values: dict[str, Column], tokens: Column, limits: frozenset[str]) -> tuple[Column, list[dict]]:
    """The probability as an expression over ``docs``, and the cells with their figures."""
    dims = list(targets)
    folded = {d: F.when(values[d].isin(list(targets[d])), values[d]).otherwise(REST) if targets[d] else F.lit(REST) for d in dims}
    cells = docs.groupBy(*(folded[d].alias(d) for d in dims)).agg(F.sum(tokens).alias("tokens"), F.count("*").alias("docs")).orderBy(*dims).collect()
    if not cells:
        return F.lit(0.0), []
    sums = np.array([float(c["tokens"] or 0) for c in cells])
    codes, wanted = [], []
    for d in dims:
        names = [*targets[d], REST]
        codes.append(np.array([names.index(c[d]) for c in cells]))
        own = np.bincount(codes[-1], sums, len(names)) / max(sums.sum(), 1.0)
        wanted.append(shares(list(targets[d].values()), own, d in limits))
    factor = rake(sums, codes, wanted)
    used = factor[sums > 0]
    p = factor / used.max() if len(used) and used.max() > 0 else np.ones(len(factor))
    p = np.clip(p, 0.0, 1.0)
    name = F.concat_ws("\x1f", *(folded[d] for d in dims))
    table = F.create_map(*(x for c, v in zip(cells, p) for x in (F.lit("\x1f".join(c[d] for d in dims)), F.lit(float(v)))))
    rows = [{**{d: c[d] for d in dims}, "docs": c["docs"], "tokens": c["tokens"], "probability": float(v)} for c, v in zip(cells, p)]
    return table[name], rows


def draw(id_: Column, seed: int = 7) -> Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    return F.pmod(F.xxhash64(id_, F.lit(seed)), F.lit(1 << 52).cast("long")) / float(1 << 52)


def mix(docs: DataFrame, targets: dict[str, dict[str, float]], values: dict[str, Column], tokens: Column, id_col: str = "doc_id", seed: int = 7, limits: frozenset[str] = LIMITS) -> DataFrame:
    """``docs`` with a struct ``mix``: tokens, probability, drawn number and ``kept``."""
    p, _ = probabilities(docs, targets, values, tokens, limits)
    u = draw(F.col(id_col), seed)
    return docs.withColumn("mix", F.struct(tokens.alias("tokens"), p.alias("probability"), u.alias("drawn"), F.coalesce(u < p, F.lit(False)).alias("kept")))


def sample(docs: DataFrame, targets: dict[str, dict[str, float]], values: dict[str, Column], tokens: Column, id_col: str = "doc_id", seed: int = 7, limits: frozenset[str] = LIMITS) -> DataFrame:
    """The rows that the mixture keeps, with their own columns only."""
    p, _ = probabilities(docs, targets, values, tokens, limits)
    return docs.where(draw(F.col(id_col), seed) < p)


#: Production targets by share of tokens. Sources give at most so much.
SOURCES = {"src0": 0.15, "src1": 0.04, "src2": 0.04}
LANGS = {"en": 0.55, "de": 0.17, "fr": 0.16, "es": 0.12}
#: Topics of a language share its target by the power FLATTEN of their own shares, so rare ones gain.
FLATTEN = 0.8


def document_targets(model: topics.Model) -> dict[str, dict[str, float]]:
    """The targets of sources, languages and the model's topics, which agree with one another."""
    by_topic = {}
    for lang, share in model.shares.items():
        flat = share**FLATTEN / (share**FLATTEN).sum()
        by_topic |= {f"{lang}/{i}": LANGS[lang] * float(v) for i, v in enumerate(flat)}
    return {"source": SOURCES, "lang": LANGS, "topic": by_topic}


def documents(docs: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, dict, dict[str, Column], Column]:
    """Documents (all their columns, or ``columns``) with a struct column for topics, and targets, values and tokens for ``mix`` and ``sample``.

    Texts are split into words once: rows are stored with their vectors, of which topics are learned and assigned.
    """
    own, columns = "_features", list(columns or docs.columns)
    while own in docs.columns:
        own += "_"
    held = stored(docs.withColumn(own, topics.vector(F.col("text"))).select(*columns, own), "topic-vectors")
    v, tokens = F.col(own)["v"], F.col(own)["tokens"]
    model = topics.learn(held.select("lang", v.alias("v"), tokens.alias("tokens")), list(LANGS))
    marked = held.withColumn(own, F.struct(topics.topic(v, tokens, F.col("lang"), model).alias("topic"), tokens.alias("tokens")))
    return marked, document_targets(model), {"source": F.col("source"), "lang": F.col("lang"), "topic": F.col(own)["topic"]}, tokens
