"""Decontamination, lexical search and hard negatives against plain versions, on odd rows and small sizes."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from .test_edges import table

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@pytest.mark.parametrize("name", ["op11_decontaminate", "op12_lexical_search", "op13_hard_negatives"])
def test_sql(spark, name):
    from tidemark.llm.queries import ORACLE, QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(cols)} from ({ORACLE[name]})").fetchall()
    rows = sorted(map(tuple, got.select(*cols).collect()))
    assert rows == sorted(want) and rows


@given(st.lists(st.text("aZ9 -é\n😀_", max_size=30), max_size=8))
@settings(max_examples=200, deadline=None)
def test_words(texts):
    from tidemark.llm.words import of_texts

    got = of_texts(pa.array(["skipped", *texts], pa.string())[1:])
    assert [w.decode() for w in got.words.to_pylist()] == [w for t in texts for w in terms(t)]
    assert got.counts.tolist() == [len(terms(t)) for t in texts]


def test_words_of_a_long_text_in_parts():
    from tidemark.llm.words import portions

    text = "one two-three fourfour " * 9 + "x" * 50 + " y"
    batch = pa.RecordBatch.from_arrays([pa.array(["a b", text, None])], ["text"])
    found = [(w.words.to_pylist(), begins, ends) for _, w, begins, ends in portions(iter([batch]), "text", 20)]
    assert [w.decode() for ws, _, _ in found for w in ws] == ["a", "b", *terms(text)]
    assert sum(b for _, b, _ in found) == sum(e for _, _, e in found) == len([x for x in found if x[1]])


@given(st.lists(st.lists(st.integers(1, 4), max_size=25), min_size=1, max_size=6), st.lists(st.lists(st.integers(1, 5), min_size=1, max_size=4), min_size=1, max_size=10))
@settings(max_examples=150, deadline=None)
def test_fm_index(segments, wanted):
    from tidemark.llm.fmindex import Index, build

    segments = [*segments, segments[0]]
    ix = Index(*build(np.array([w for s in segments for w in s], np.int64), np.array([len(s) for s in segments])))
    joined = [w for s in segments for w in [*s, 0]]
    known = max(joined)
    rows = np.array([[-1] * (4 - len(p)) + [w if w <= known else -1 for w in p] for p in wanted])
    low, high = ix.count(rows, np.array([len(p) for p in wanted]))
    for p, a, b in zip(wanted, low, high):
        places = sorted(ix.locate(np.arange(a, b)).tolist()) if b > a else []
        assert places == [i for i in range(len(joined)) if joined[i : i + len(p)] == p]


def plain_decontam(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = terms(text)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    sizes, out = {len(k) for k in windows}, []
    for d, text in docs:
        w, hit, found = terms(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, id long, words string, row long")


PASSAGE = "it was the best of times it was the worst of times it was the age of wisdom"


@pytest.mark.parametrize("parts", [False, True])
def test_decontam(spark, monkeypatch, parts):
    from tidemark.llm import decontam

    rng = random.Random(3)
    texts = [None, "", " ", "a", "Only short", PASSAGE, f"before, {PASSAGE.upper()}! after", PASSAGE * 3, "best of times" * 2, "short only short", "é" * 30, (" ".join(rng.choices("ab", k=700)))]
    texts += [" ".join(rng.choices(["it", "was", "the", "age", "of"], k=60)) for _ in range(10)]
    docs = table(spark, texts)
    items = [(1, PASSAGE), (1, PASSAGE), (2, "only short"), (3, None), (4, " -- "), (None, "é" * 30), (10, " ".join(rng.choices("ab", k=40))), (5, " ".join(PASSAGE.split()[3:])), (6, texts[-1])]
    extra = [(*x, 7, "w", 8) for x in items]
    if parts:
        # texts in parts and items in blocks: sizes that make both happen here
        monkeypatch.setattr(decontam, "BLOCK_WORDS", 64)
        assert len(list(decontam._blocks(decontam.phrases(items_of(spark, extra), shard_bytes=90), 10))) > 1
    size = 90 if parts else 1 << 22
    found = decontam.search(decontam.index(docs, shard_bytes=size), decontam.phrases(items_of(spark, extra), shard_bytes=size))
    got = [tuple(r)[:6] for r in decontam.report(found).collect()]
    assert sorted(got, key=repr) == plain_decontam([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], items)


def test_decontam_empty_tables_and_cleaning(spark):
    from tidemark.llm import decontam

    docs, none = table(spark, ["x", f"Keep this; {PASSAGE}, and that."]), table(spark, [])
    items = decontam.phrases(items_of(spark, [(1, PASSAGE, 0, "", 0)]))
    assert decontam.search(decontam.index(none), items).count() == 0
    clean = decontam.search(decontam.index(docs), decontam.phrases(items_of(spark, [])))
    assert {(r.n_hit, r.contaminated, r.n_items) for r in decontam.report(clean).collect()} == {(0, False, 0)}
    # repeated ids are made distinct first, as cleaning asks for
    once = docs.dropDuplicates(["doc_id"]).where("doc_id is not null")
    texts = {r.doc_id: r.text for r in decontam.cleaned(once, decontam.search(decontam.index(once), items)).collect()}
    assert texts == {0: "x", 1: "Keep this; , and that."}


def plain_search(docs, items, k=10):
    counted = [(d, terms(t)) for d, t in docs if terms(t)]
    n, total = len(counted), sum(len(w) for _, w in counted)
    own = {}
    for item, text in items:
        if item is not None:
            own.setdefault(item, set()).update(terms(text))
    df = {}
    for _, w in counted:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, ts in own.items():
        rows = []
        for d, w in counted:
            m = 10 + 90 * len(w) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in ts if t in w)
            rows += [(-score, d is None, d or 0, d)] if score > 0 else []
        out += [(item, i + 1, r[3], -r[0]) for i, r in enumerate(sorted(rows)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [False, True])
def test_lexical(spark, monkeypatch, parts):
    from tidemark.llm import lexical

    rng = random.Random(4)
    words = ["uno", "dos", "tres", "Ära", "x1", "rare"]
    texts = [None, "", "!!", "rare", *(" ".join(rng.choices(words[:5], k=rng.randint(1, 40))) for _ in range(40)), "uno dos", "uno dos", "uno dos", "rare uno " * 60]
    docs = table(spark, texts)
    items = [(1, "uno dos"), (2, "rare"), (3, None), (4, "nowhere"), (None, "uno"), (5, "tres ära"), (5, "x1"), (6, " ".join(words)), (7, "UNO uno")]
    if parts:
        monkeypatch.setattr(lexical, "BLOCK_TERMS", 3)
        monkeypatch.setattr(lexical, "CELLS", 4)
    got = lexical.ranked(docs, items_of(spark, [(*x, 7, "w", 8) for x in items]), slice_bytes=60 if parts else 1 << 22)
    want = plain_search([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], items)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    if not parts:
        assert lexical.ranked(table(spark, []), items_of(spark, [(1, "uno", 0, "", 0)])).count() == 0
        assert lexical.ranked(docs, items_of(spark, [])).count() == 0


def plain_negatives(rows, every):
    good = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, lab, v in good:
        if i % every == 0:
            scored = sorted((-dot(v, w), j, m) for j, m, w in good if j != i)
            for s, p, _ in [x for x in scored if x[2] == lab][:5]:
                fit = [(n, -t) for t, n, m in scored if m != lab and 50 * -s <= 100 * -t and 100 * -t <= 95 * -s]
                out += [(i, p, r + 1, n, -s, t) for r, (n, t) in enumerate(fit[:3])]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives(spark, monkeypatch, seed):
    from tidemark.llm import gnat

    rng = np.random.default_rng(seed)
    monkeypatch.setattr(gnat, "PAGE", 16)
    monkeypatch.setattr(gnat, "BLOCK", 4)
    centres = rng.normal(size=(6, 5))
    rows = [(i, int(i % 3), (centres[rng.integers(6)] + rng.normal(size=5) * rng.choice([0.05, 0.4])).tolist()) for i in range(400)]
    # one vector many times, and rows that take no part
    rows += [(400 + i, int(i % 4), rows[7][2]) for i in range(90)]
    rows += [(600, 1, None), (601, None, [1.0] * 5), (602, 1, [1.0, None, 1.0, 1.0, 1.0]), (603, 2, [float("nan")] * 5), (604, 2, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (None, 1, [1.0] * 5), (605, 1, []), (650, 0, [0.0] * 5), (651, 0, [0.5, 0.5])]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, label int, embedding array<double>, row long, leaf string")
    padded = [(i, lab, v if v is None else [*v, *[0.0] * (5 - len(v))]) for i, lab, v in rows]
    got = gnat.negatives(df, "vec_id", "label", "embedding", every=25, leaf=32)
    assert sorted(map(tuple, got.collect())) == plain_negatives(padded, 25)
    if seed == 1:
        assert gnat.negatives(df.limit(0), "vec_id", "label", "embedding").count() == 0


def test_negatives_of_repeated_rows(spark):
    from tidemark.llm import gnat

    rows = [(0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.0]), (2, 2, [0.7, 0.1]), (2, 2, [0.7, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = sorted(tuple(r)[:4] for r in gnat.negatives(df, "vec_id", "label", "embedding").collect())
    assert got == [(0, 1, 1, 2), (0, 1, 1, 2), (0, 1, 2, 2), (0, 1, 2, 2)]


def test_tree_loses_no_leaf_and_leaves_out_some():
    from tidemark.llm import gnat

    rng = np.random.default_rng(5)
    rows = (rng.normal(size=(12, 4))[rng.integers(12, size=1500)] * 200 + rng.normal(size=(1500, 4)) * 8).astype(np.int64)
    nodes = gnat.grow(rows[:600], leaf=64)
    leaf, seen = gnat.leaf_of(nodes, rows), gnat.Ranges(nodes)
    seen.add(nodes, rows)
    asks = rows[:40]
    score = gnat.dot(asks, rows)
    low, high = np.quantile(score, 0.9, axis=1)[:, None], np.quantile(score, 0.95, axis=1)[:, None]
    ask, at = gnat.leaves_in(nodes, seen, asks, low, high)
    met = set(zip(ask.tolist(), at.tolist()))
    needed = {(a, int(leaf[r])) for a, r in np.argwhere((score >= low) & (score <= high)).tolist()}
    assert needed <= met and len(met) < 0.7 * 40 * len(set(leaf.tolist()))


def test_big_scores_are_exact():
    from tidemark.llm import gnat

    a = np.array([[1 << 30, 3], [-(1 << 30), 1]], np.int64)
    assert gnat.dot(a, a).tolist() == [[(1 << 60) + 9, -(1 << 60) + 3], [-(1 << 60) + 3, (1 << 60) + 1]]
