"""Traversals, vector and substring search, Python steps, page texts and streams against plain versions."""

import datetime
import itertools
import math
import random
from hashlib import sha256
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import alerts as A
from tidemark.operators import attempts as At
from tidemark.operators import documents as Doc
from tidemark.operators import retrieval as Ret
from tidemark.operators import traverse as V
from tidemark.operators import vectors as Vec
from tidemark.streaming import jobs

SF = "/root/testdata/sf0.001"


def edge_rows(spark, pairs):
    rows = [("C", a, "owns", "C", b, i, "public", None, None) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "source_kind string, source_key string, relation string, target_kind string, target_key string, seq long, access_tier string, valid_from date, valid_to date")


def test_paths_are_those_of_a_queue(spark):
    r = random.Random(1)
    pairs = [(f"n{r.randrange(25)}", f"n{r.randrange(25)}") for _ in range(45)]
    pairs = [(a, b) for a, b in pairs if a != b] + [("n1", "n2"), ("n2", "n1")]
    ways = sorted((i, up, *((b, a) if up else (a, b))) for i, (a, b) in enumerate(pairs) for up in (False, True))
    want = {}
    for start in ("n0", "n3"):
        seen, level = {start: []}, [start]
        for _ in range(4):
            new = []
            for at in level:
                for i, up, a, b in ways:
                    if a == at and b not in seen:
                        seen[b] = [*seen[at], (a, b, i, up)]
                        new.append(b)
            level = new
        want.update({(start, k): p for k, p in seen.items() if p})
    found = V.network(spark.createDataFrame([("n0",), ("n3",)], "key string"), edge_rows(spark, pairs), 4).collect()
    assert {(x.start, x.key): [tuple(y) for y in x.path] for x in found} == want and all(x.hops == len(x.path) for x in found)


def test_chains_are_counted_before_they_are_listed(spark):
    # seven layers of three holders each: 3^6 chains; and one start with two
    layers = [(f"l{i + 1}-{a}", f"l{i}-{b}") for i in range(6) for a in range(3) for b in range(3)] + [("x", "s"), ("y", "s"), ("a", "b"), ("b", "a")]
    e, starts = edge_rows(spark, layers), spark.createDataFrame([("l0-0",), ("s",), ("none",), ("a",)], "key string")
    every = V.ownership_chains(starts, e, max_depth=8)
    sizes = {r.start: r["count"] for r in every.groupBy("start").count().collect()}
    assert sizes == {"l0-0": 3**6, "s": 2, "a": 1} and every.where("truncated or not complete").select("terminal").distinct().collect()[0][0] == "cycle"
    few = V.ownership_chains(starts, e, max_depth=8, chain_cap=100).collect()
    assert [(r.chains, r.holders, r.terminal) for r in few if r.start == "l0-0" and r.truncated] == [(3.0**6, None, "truncated")]
    assert sorted((r.start, r.terminal) for r in few if not r.truncated) == [("a", "cycle"), ("s", "root"), ("s", "root")]
    up = e.select(F.col("target_key").alias("key"), F.col("source_key").alias("holder"))
    assert {r.key: r.chains for r in V.chain_counts(up, 3).collect()}["l0-0"] == 27.0


def test_containing_is_contains(spark):
    r = random.Random(2)
    texts = [(i, None if i == 3 else "".join(r.choices("ab th", k=r.randint(0, 30)))) for i in range(80)]
    values = ["the", "th", "a", "ab t", "  ", "bbb", "zzz", "th a", "abab", "é"] + ["".join(r.choices("abth ", k=r.randint(1, 6))) for _ in range(30)]
    rows, items = spark.createDataFrame(texts, "doc long, text string"), spark.createDataFrame([(v,) for v in dict.fromkeys(values)], "v string")
    got = sorted((x.doc, x.v) for x in A.containing(rows, F.col("text"), items).collect())
    assert got == sorted((d, v) for d, t in texts for v in set(values) if t is not None and v in t)
    # a common beginning is nobody's key
    common = spark.createDataFrame([(i, f"the word{i:03}") for i in range(100)], "doc long, text string")
    keys = A.gram_keys(common, F.col("text"), spark.createDataFrame([(f"the word{i:03}",) for i in range(0, 100, 9)], "v string"), [3]).collect()
    assert len(keys) == 12 and not any(k.key in "the word" for k in keys)
    assert A.containing(rows, F.col("text"), items.limit(0)).count() == 0 == A.containing(rows.limit(0), F.col("text"), items).count()


@pytest.mark.parametrize("cells", [1, 12])
def test_nearest_is_exact(spark, cells, monkeypatch):
    rng = np.random.default_rng(cells)
    v = rng.normal(size=(9, 8))[rng.integers(9, size=600)] + rng.normal(size=(600, 8)) * 0.3
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(600 + i, (3 * v[5]).tolist()) for i in range(25)] + [(700, [0.0] * 8), (701, None), (702, [float("nan")] * 8), (703, [None] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    index = Vec.build(df, "id", "v", cells)
    got = {}
    for r in Vec.nearest(df.where("id % 20 = 0"), index, 10, "id", "v").collect():
        got.setdefault(r.query, []).append((r.rank, r.key, r.score))
    good = [(i, np.array(x) / np.linalg.norm(x)) for i, x in rows[:625]]
    for i, q in good:
        if i % 20 == 0:
            best = sorted((-round(float(q @ x), 6), j) for j, x in good)[:10]
            assert [(j, s) for _, j, s in sorted(got.pop(i))] == [(j, pytest.approx(-s, abs=2e-6)) for s, j in best]
    assert not got
    assert Vec.nearest(df.limit(1), Vec.build(df.limit(0), "id", "v", 4), 3, "id", "v").count() == 0


def plain_embedding(text, dims):
    out = [0.0] * dims
    number = lambda w: int.from_bytes(sha256(w.encode()).digest()[:8], "big")
    for w in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split():
        out[number(w) % dims] += 1 if number("sign:" + w) % 2 == 0 else -1
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm if norm else x for x in out]


@pytest.mark.parametrize("dims", [64, 256, 384])
def test_embeddings_of_any_size(spark, dims):
    texts = [(1, "Growth and growth of revenue"), (2, ""), (3, None), (4, "a b c d e f g"), (5, "é ß")]
    df = spark.createDataFrame(texts, "doc long, text string")
    want = {d: plain_embedding(t or "", dims) for d, t in texts}
    assert {r.doc: list(r.vector) for r in Ret.embed(df, lambda: Ret.HashEmbedder(dims)).collect()} == {d: pytest.approx(v, abs=1e-6) for d, v in want.items()}
    sparse = {d: [0.0] * dims for d in want}
    for r in Ret.embed_sparse(df, dims).collect():
        sparse[r.doc][r.bucket] = r.weight
    assert sparse == {d: pytest.approx(v) for d, v in want.items()}


class Vowels:
    """An embedder of one's own: counts of vowels."""

    def __call__(self, texts):
        return np.array([[t.count(c) for c in "aeiou"] for t in texts], float).reshape(len(texts), 5)


def test_hybrid_search_with_an_own_embedder(spark):
    docs = spark.createDataFrame([(1, "u1", "aaa eee"), (2, "u2", "ooo uuu"), (3, "u3", "aaa"), (4, "u4", "xyz")], "doc long, uri string, text string")
    own = Ret.embed(docs, Vowels)
    asked = Ret.embed(spark.createDataFrame([(0, "aaa")], "doc long, text string"), Vowels)
    found = Vec.nearest(asked, Vec.build(own, "doc", "vector", 2), 10, "doc", "vector").select(F.col("key").alias("doc"), F.col("score").alias("vector"))
    best = Ret.top_k(Ret.blend(Ret.lexical(docs, "aaa"), found), 5).collect()
    assert [(r.doc, round(r.score, 4)) for r in best] == [(1, round(0.5 + 0.5 / math.sqrt(2), 4)), (3, 1.0)][::-1]


def test_one_bad_row_costs_itself(spark, tmp_path):
    log = tmp_path / "calls"

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        with log.open("a") as f:
            f.write("".join(f"{x}\n" for x in frame["id"]) if len(frame) == 1 else "")
        if (frame["id"] % 50 == 7).any():
            raise ValueError("no sevens")
        return pd.DataFrame({"score": frame["id"] * 2.0, "name": frame["text"].str.upper()})

    rows = spark.range(200).select("id", F.concat(F.lit("t"), "id").alias("text")).repartition(3)
    good, dead = At.split(At.attempted(rows, score, "score double, name string", tries=3))
    bad = {7, 57, 107, 157}
    assert {(r.id, r.score, r.name) for r in good.collect()} == {(i, i * 2.0, f"T{i}") for i in range(200) if i not in bad}
    assert {(r.id, r.text, r.error, r.score) for r in dead.collect()} == {(i, f"t{i}", "ValueError: no sevens", None) for i in bad}
    singles = [int(x) for x in log.read_text().split()]
    assert all(singles.count(i) == 3 for i in bad)  # both parts were read, the step ran once
    assert At.attempted(rows.limit(0), score, "score double, name string").count() == 0
    with pytest.raises(ValueError):
        At.attempted(rows, score, "text string")


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts = []

    def handle_data(self, data):
        if data.strip():
            self.parts.append(data.strip())


ODD = [
    "", " ", "plain", "a &amp; b", "<p>a &lt;b&gt; &eacute;&nbsp;x&#233;&#x41;&notit; &amp", "a < b and c<d", "<p title='a > b'>x</p>", '<p title="a > b">x</p>', "<p title=a>b>x</p>", "<script>if (a < b && c) {}</script>after &lt;",
    "<style>p > a {}</style>t", "<!-- a > b -->c<!---->d", "<!DOCTYPE html><html>x", "<?php echo ?>y", "</p >z</ p>w", "<br/>a<br />b<hr", "<p", "text &", "text &am", "<a href=x&amp;y>l</a>", "<![CDATA[x]]>y", "<1>x", "<>", "</>e",
    "<p class=\"a\"id=\"b\">q</p>", "<P CLASS=\"A\">Up</P>", "<b>bold</b><i>it</i>", "\n<p>\n a \n</p>\n", "<p data-x=\"1\" checked>y</p>", "<title>T &mdash; U</title>", "<textarea><p>x</textarea>", "<script src=\"a\"/>x", "a&#0;b&#x110000;c&#128;",
]


def plain_text(html):
    p = Plain()
    p.feed(html)
    return "\n".join(p.parts)


def test_page_texts_are_those_of_the_parser(spark):
    r = random.Random(3)
    bits = ["<p>", "</p>", "<a href=\"x>y\">", "<br/>", "&amp;", "&lt", "& ", "<", ">", "\"", "text", " ", "<!-- c -->", "<script>", "</script>", "&#65;", "<b c='d'>"]
    made = ["".join(r.choices(bits, k=r.randint(1, 12))) for _ in range(3000)]
    for html in ODD + made:
        assert T.page_text(html) == plain_text(html), html
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("html", T.html_lines(F.col("html")).alias("text")).collect()
    assert pages and all(x.text == plain_text(x.html) for x in pages)
    assert spark.createDataFrame([(None,)], "html string").select(T.html_lines(F.col("html")).alias("t")).first().t is None


def test_concerns_in_order(spark):
    ch = spark.createDataFrame([("c", "added", "guidance", "Guidance was cut."), ("c", "removed", "guidance", "guidance was CUT"), ("c", "added", "product", "A launch."), ("c", "removed", "litigation", "A court case.")], "company string, kind string, category string, statement string")
    ev = spark.createDataFrame([("c", "litigation", "A court case!"), ("c", "executive", "The CEO left."), ("d", "opportunity", "Demand is up.")], "company string, category string, sentence string")
    land = spark.createDataFrame([("c", "Peru", "s2"), ("c", "Peru", "s1"), ("c", "Peru", "s1"), ("d", None, "s3")], "company string, country string, supplier string")
    got = [(r.rank, r.title, r.severity, r.confidence, r.statement) for r in Doc.concerns(ch, ev, land).orderBy("company", "rank").collect()]
    assert got == [
        (1, "Forward guidance changed", "high", 0.77, "Guidance was cut."), (2, "Legal / litigation exposure", "high", 0.7, "A court case."), (3, "Leadership change", "medium", 0.6, "The CEO left."),
        (4, "Geopolitical exposure to Peru", "medium", 0.55, "c relies on s1, s2 in Peru."), (5, "Product / roadmap shift", "low", 0.55, "A launch."),
    ]
    up = [(r.company, r.title, r.confidence) for r in Doc.concerns(ch, ev, rules=Doc.OPPORTUNITIES).orderBy("company", "rank").collect()]
    assert up == [("c", "Product / roadmap momentum", 0.6), ("d", "Growth opportunity", 0.55)]


def test_signals_by_all_rules(spark):
    ch = spark.createDataFrame([("a", "added", "guidance", "We expect lower sales"), ("a", "added", "risk", "x"), ("a", "removed", "risk", "y"), ("a", "added", "supply_chain", "z"), ("b", "added", "capital_allocation", "d"), ("b", "added", "guidance", "Raised")], "company string, kind string, category string, statement string")
    ev = spark.createDataFrame([("a", "litigation"), ("a", "regulatory"), ("a", "risk"), ("c", "product")], "company string, category string")
    docs = spark.createDataFrame([("a", "job_posting"), ("b", "patent"), ("b", "filing")], "company string, document_type string")
    land = spark.createDataFrame([("a", "Peru"), ("a", "Chile"), ("a", "Peru")], "company string, country string")
    got = {(r.company, r.type): (r.direction, r.strength) for r in Doc.signals(ch, ev, docs, land).collect()}
    assert got == {
        ("a", "management_confidence"): ("down", 0.62), ("a", "emerging_risk"): ("elevated", 0.7), ("a", "supply_chain_stress"): ("elevated", 0.6), ("a", "hiring"): ("up", 0.5), ("a", "geopolitical"): ("elevated", 0.6),
        ("b", "management_confidence"): ("up", 0.55), ("b", "capital_allocation"): ("elevated", 0.55), ("b", "patent_momentum"): ("up", 0.5),
    }


def test_signals_cite_their_evidence(spark):
    ch = spark.createDataFrame(
        [("a", 2, "added", "guidance", "We expect softer sales"), ("a", 1, "removed", "guidance", "Steady"), ("a", 1, "added", "risk", "r2"), ("a", 1, "added", "litigation", "r1"), ("a", 3, "added", "risk", "r3"), ("a", 0, "removed", "risk", "gone"), ("a", 4, "added", "supply_chain", "s1")],
        "company string, doc long, kind string, category string, statement string",
    )
    ev = spark.createDataFrame([("a", 9, 5, "litigation", "later"), ("a", 9, 4, "litigation", "sooner"), ("b", 1, 1, "product", "p")], "company string, doc long, seq long, category string, sentence string")
    docs = spark.createDataFrame([("b", 8, "patent", None), ("b", 7, "patent", "A valve"), ("b", 1, "job_posting", None)], "company string, doc long, document_type string, title string")
    land = spark.createDataFrame([("b", "Peru"), ("b", "Chile"), ("b", None), ("c", None)], "company string, country string")
    out = Doc.cited(Doc.signals(ch, ev, docs, land), Doc.signal_evidence(ch, ev, docs, land))
    assert {(r.company, r.type): (r.label, r.rationale, r.evidence) for r in out.collect()} == {
        ("a", "management_confidence"): ("Management confidence", "Guidance language weakened in the latest disclosure.", ["Steady"]),
        ("a", "emerging_risk"): ("Emerging risk", "5 new risk/regulatory/legal signal(s) versus the prior period.", ["r1", "r2", "sooner"]),
        ("a", "supply_chain_stress"): ("Supply-chain stress", "Supplier-related changes versus the prior disclosure.", ["s1"]),
        ("b", "patent_momentum"): ("Patent momentum", "2 patent record(s) indicate ongoing R&D output.", ["A valve"]),
        ("b", "hiring"): ("Hiring activity", "1 active job posting(s) signal investment in capacity.", ["job_posting"]),
        ("b", "geopolitical"): ("Geopolitical exposure", "Supply chain spans Chile, Peru.", ["b is exposed to Chile, Peru via its suppliers."]),
    }
    assert Doc.cited(Doc.signals(ch.limit(0), ev.limit(0), docs.limit(0), land.limit(0)), Doc.signal_evidence(ch.limit(0), ev.limit(0), docs.limit(0), land.limit(0))).count() == 0


def test_concerns_give_their_reasons(spark):
    ch = spark.createDataFrame([("c", "removed", "litigation", "A court case.", "10-K")], "company string, kind string, category string, statement string, source string")
    ev = spark.createDataFrame([("c", "executive", "The CEO left.", "8-K")], "company string, category string, sentence string, source string")
    land = spark.createDataFrame([("c", "Peru", "s1")], "company string, country string, supplier string")
    assert [r.rationale for r in Doc.concerns(ch, ev, land).orderBy("rank").collect()] == ["Removed in 10-K: A court case.", "Event (8-K): The CEO left.", "c depends on s1 operating in Peru, creating concentration/geopolitical exposure."]


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def test_edges_go_to_their_partitions_once(spark, tmp_path):
    path = str(tmp_path / "sink")
    batch = lambda names: spark.createDataFrame([("Company", n, r, "Filing", f"{n}-{r}", i, n) for i, (n, r) in enumerate(names)], "source_kind string, source_key string, relation string, target_kind string, target_key string, seq long, source string")
    first = [(f"c{i}", "filed") for i in range(60)] + [("c1", "owns")]
    assert jobs.add_edges(batch(first), path, 0, parts=8) == 0
    assert jobs.add_edges(batch([("c1", "filed"), ("new", "owns")]), path, 1, parts=8) == 2
    assert jobs.add_edges(batch([("late", "filed")]), path, 1, parts=8) == -1  # the ledger has this batch
    assert spark.read.parquet(path).count() == 62
    # a batch that broke off after writing comes again under its number
    (tmp_path / "sink" / "_ledger" / "1").rmdir()
    jobs.add_edges(batch([("c1", "filed"), ("new", "owns")]), path, 1, parts=8)
    assert spark.read.parquet(path).count() == 62
    sink = spark.read.parquet(path)
    part = batch([("c1", "filed")]).withColumn("part", F.pmod(F.xxhash64(*jobs.EDGE), F.lit(8)).cast("int"))
    read = jobs.touched(sink, part)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "relation" in plan.split("PartitionFilters: [")[1].split("]")[0]
    folders = lambda d: {r[0].rsplit("/", 1)[0] for r in d.select(F.input_file_name()).distinct().collect()}
    assert len(folders(read)) == 1 and len(folders(sink)) > 5


def test_alerts_once_over_restarts(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = "id long, ts timestamp, company string, statement string"
    items = spark.createDataFrame([("a", "user1"), ("b", "user2")], "company string, user string")

    def go():
        changes = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        jobs.alerts(changes, items, out, mark, late="10 minutes", keep="60 minutes").awaitTermination()
        return sorted((r.id, r.user) for r in spark.read.parquet(out).collect())

    put(spark, src, [(1, at(0), "a", "x"), (1, at(0), "a", "x"), (2, at(5), "b", "y"), (3, at(6), "c", "not watched")], schema)
    assert go() == [(1, "user1"), (2, "user2")]
    put(spark, src, [(1, at(20), "a", "x"), (2, at(3), "b", "out of order"), (4, at(21), "a", "z")], schema)
    assert go() == [(1, "user1"), (2, "user2"), (4, "user1")]
    # two hours on, 1 is forgotten and an alert again; a row behind the watermark is not
    put(spark, src, [(5, at(140), "c", "moves the clock")], schema)
    go()
    put(spark, src, [(1, at(150), "a", "again"), (6, at(1), "a", "far too late")], schema)
    assert go() == [(1, "user1"), (1, "user1"), (2, "user2"), (4, "user1")]


def test_latest_values_and_stale_ones(spark, tmp_path):
    src, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    schema, seen = "symbol string, ts timestamp, price double", []

    def go():
        quotes = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        made = jobs.latest(quotes, late="10 minutes", keep="60 minutes")
        each = lambda b, n: seen.extend((r.symbol, int((r.ts - at(0)).total_seconds() // 60), r.price, r.fresh) for r in b.collect())
        made.writeStream.foreachBatch(each).option("checkpointLocation", mark).outputMode("update").trigger(availableNow=True).start().awaitTermination()
        out, seen[:] = sorted(seen), []
        return out

    put(spark, src, [("A", at(1), 1.0), ("A", at(2), 2.0), ("B", at(2), 5.0), (None, at(2), 1.0)], schema)
    assert go() == [("A", 2, 2.0, True), ("B", 2, 5.0, True)]
    put(spark, src, [("A", at(1), 9.0), ("B", at(3), 6.0), ("B", at(3), 6.0)], schema)
    assert go() == [("B", 3, 6.0, True)]
    put(spark, src, [("C", at(100), 7.0)], schema)
    out = go()
    assert ("C", 100, 7.0, True) in out
    put(spark, src, [("A", at(99), 3.0)], schema)
    assert sorted(itertools.chain(out, go())) == sorted([("C", 100, 7.0, True), ("A", 2, 2.0, False), ("B", 3, 6.0, False), ("A", 99, 3.0, True)])


def test_filing_metadata(spark):
    meta = spark.createDataFrame([({"company_slug": "acme", "company_name": "Acme", "accession_number": "000-1"},), ({"accession_number": "000-2", "title": "10-K"},), ({"company_slug": ""},), (None,)], "m map<string,string>")
    got = [[tuple(x) for x in r.e] for r in meta.select(Doc.attached(F.col("m")).alias("e")).collect()]
    assert got == [[("Company", "acme", "Acme"), ("Filing", "000-1", "000-1")], [("Filing", "000-2", "10-K")], [], []]
    texts = spark.createDataFrame([("See EXHIBIT 31 and exhibit 23.",), ("An exhibit",), ("none",), (None,)], "t string")
    refs = [r.e and (r.e.number, r.e.url) for r in texts.select(Doc.exhibit_reference(F.col("t"), F.lit("u")).alias("e")).collect()]
    assert refs == [("23", "u"), (None, "u"), None, None]
    pages = spark.createDataFrame([("<tr><td>Filing Date:</td><td>x",), ("<b>Filing date</b>: <i>2024 &amp; 5 </i></td><td>no",), ("filing date: 7 Jan</td>",), ("nothing",)], "h string")
    assert [r.v for r in pages.select(Doc.labelled_cell(F.col("h"), "Filing Date").alias("v")).collect()] == ["Filing Date", None, "filing date: 7 Jan", None]
    lines = spark.createDataFrame([("a\n Form type :  10-K \nb",), ("Form type:",), (None,)], "t string")
    assert [r.v for r in lines.select(Doc.labelled_value(F.col("t"), "form type").alias("v")).collect()] == ["10-K", None, None]
    asked = spark.createDataFrame([("What UPSIDE is left?",), ("Any opportunities?",), ("growing risks, bulletin",), (None,)], "q string")
    assert [r.f for r in asked.select(T.focus(F.col("q")).alias("f")).collect()] == ["opportunity", "opportunity", "risk", "risk"]


def test_mentions_by_company(spark):
    from tidemark.operators import resolution as R

    texts = spark.createDataFrame([(1, "a", "We use A.I. Tools and Peru mines."), (2, "b", "Peru and ai tools."), (3, "a", "perus AI Tools"), (4, "a", None)], "doc long, company string, text string")
    names = spark.createDataFrame([("a", "Tech", "ai", "A.I. Tools"), ("a", "Country", "pe", "Peru"), ("b", "Tech", "ai", "AI tools"), ("c", "Country", "pe", "Peru"), ("a", "Odd", "o", "--")], "company string, kind string, key string, name string")
    assert {tuple(r) for r in R.company_mentions(texts, names).collect()} == {(1, "a", "Tech", "ai"), (1, "a", "Country", "pe"), (2, "b", "Tech", "ai")}
    hint = spark.createDataFrame([("SEC Form 4 filing",), ("press",), (None,)], "s string").select(R.insider_hint(F.col("s"), ["form 4", "insider"]).alias("h"))
    assert [r.h for r in hint.collect()] == [True, False, False]


def test_signal_feed_and_reports(spark):
    from tidemark.operators import panels as P

    found = spark.createDataFrame([("a", "hiring", "up", 0.5), ("b", "emerging_risk", "elevated", 0.7), ("c", "hiring", "up", 0.5)], "company string, type string, direction string, strength double")
    feed = Doc.signal_feed(found, spark.createDataFrame([("a", "Acme"), ("b", "Bolt")], "company string, name string"), spark.createDataFrame([("b", "Peru"), ("b", "Chile")], "company string, country string"))
    assert [(r.company, r.name, r.country) for r in feed.collect()] == [("b", "Bolt", "Chile"), ("a", "Acme", None), ("c", "c", None)]
    status = spark.createDataFrame([(s,) for s in ["resolved", "review", "resolved", "unresolved"]], "status string")
    assert tuple(P.anchor_report(status).first()) == (4, 2, 1, 1, 0.5) and tuple(P.anchor_report(status.limit(0)).first()) == (0, 0, 0, 0, 0.0)
    log = spark.createDataFrame([("x", "y", "undecided", None, "m"), ("p", "q", "undecided", 0.9, "m"), ("p", "r", "same", 1.0, "m"), ("z", "z2", "undecided", 0.5, "other")], "left_key string, right_key string, verdict string, score double, method string")
    assert [r.left_key for r in P.pending(log).collect()] == ["p", "z", "x"] and [r.left_key for r in P.pending(log, "m").collect()] == ["p", "x"]


def test_scorers_of_ones_own(spark):
    from tidemark.operators import panels as P

    people = spark.createDataFrame([("k1", "john smith", "US", "1960-01-01", False)], "key string, name string, country string, birth string, insider boolean")
    records = spark.createDataFrame([("w1", "jon smith", ["sanction"], ["us"], ["1960"]), ("w1", "smith john", ["sanction"], ["us"], ["1960"]), ("w2", "smith", ["role.pep"], [], [])], "id string, name string, topics array<string>, countries array<string>, births array<string>")
    own = lambda pairs: pairs.groupBy("query", "record").agg(F.lit(0.95).alias("score"), F.min("name").alias("name"))
    out = P.screen(people, records, floor=0.9, scorer=own)
    assert {(r.target_key, r.relation, r.review_status) for r in out["edges"].collect()} == {("w1", "sanctioned", "confirmed"), ("w2", "screening_candidate", "review")}
    firms = spark.createDataFrame([("n1", "acme", "US", False), ("n2", "other", "US", False)], "key string, name string, country string, subsidiary boolean")
    leis = spark.createDataFrame([("L1", "acme holdings", "US", True)], "id string, name string, country string, active boolean")
    assert {(r.key, r.lei, r.status) for r in P.anchor(firms, leis, scorer=lambda p: own(p).withColumn("score", F.lit(0.99))).collect()} == {("n1", "L1", "resolved"), ("n2", None, "unresolved")}


def test_sinks_keep_what_they_should(spark, tmp_path):
    from tidemark.sources import sinks

    path = str(tmp_path / "artifacts")
    rows = lambda *x: spark.createDataFrame(x, "id long, kind string, v string")
    sinks.save_artifacts(rows((1, "a", "x"), (1, "a", "x"), (2, "b", "y")), path, "id", "kind")
    sinks.save_artifacts(rows((3, "b", "z")), path, "id", "kind")
    assert sorted(map(tuple, spark.read.parquet(path).select("id", "kind", "v").collect())) == [(1, "a", "x"), (3, "b", "z")]
    log = str(tmp_path / "log")
    for _ in range(2):
        sinks.append(rows((1, "a", "x")), log)
    assert spark.read.parquet(log).count() == 2
