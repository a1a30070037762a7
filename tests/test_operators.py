"""Rules of the graph, traversals, resolution and documents on small tables of our own."""

import datetime
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemark.functions import names as N
from tidemark.functions import text as T
from tidemark.operators import alerts as A
from tidemark.operators import documents as Doc
from tidemark.operators import graph as G
from tidemark.operators import panels as P
from tidemark.operators import resolution as R
from tidemark.operators import traverse as V
from tidemark.sources import sinks


def one(spark, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols))


def edges(spark, rows):
    out = [("Company", a, rel, "Company", b, i, tier, None, None) for i, (a, rel, b, tier) in enumerate(rows)]
    return spark.createDataFrame(out, "source_kind string, source_key string, relation string, target_kind string, target_key string, seq long, access_tier string, valid_from date, valid_to date")


def test_upserts_do_not_depend_on_row_order(spark):
    rows = [("K", str(i % 3), i, f"n{i}") for i in range(12)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        n = spark.createDataFrame(rows, "kind string, key string, seq long, name string").repartition(3)
        assert sorted(map(tuple, G.upsert_nodes(n).select("key", "seq", "name").collect())) == [("0", 0, "n9"), ("1", 1, "n10"), ("2", 2, "n11")]


def test_tiers_and_dates(spark):
    e = edges(spark, [("a", "r", "b", None), ("a", "r", "c", "public"), ("a", "r", "d", "legitimate-interest"), ("a", "r", "e", "who-knows")])
    assert {r.target_key for r in G.visible(e).collect()} == {"b", "c"}
    assert {r.target_key for r in G.visible(e, "legitimate-interest").collect()} == {"b", "c", "d"}
    d = datetime.date
    t = spark.createDataFrame([(1, d(2020, 1, 1), d(2020, 12, 31)), (2, None, d(2019, 12, 31)), (3, None, None)], "k int, valid_from date, valid_to date")
    for day, want in (("2020-01-01", {1, 3}), ("2020-12-31", {1, 3}), ("2019-12-31", {2, 3})):
        assert {r.k for r in G.as_of(t, day).collect()} == want


def chains(spark, rows, start="c", **k):
    out = V.ownership_chains(spark.createDataFrame([(start,)], "key string"), edges(spark, rows), **k).collect()
    return sorted((">".join(r.holders), r.terminal) for r in out)


def test_chain_terminals(spark):
    pub = "public"
    assert chains(spark, [("p", "beneficial_owner_of", "h", pub), ("h", "owns", "c", pub)]) == [("h>p", "beneficial_owner")]
    assert chains(spark, [("h", "owns", "c", pub), ("c", "owns", "h", pub)]) == [("h>c", "cycle")]
    assert chains(spark, [("x", "owns", "h", "restricted-authority"), ("h", "owns", "c", pub)]) == [("h", "restricted")]
    assert chains(spark, [("h", "owns", "c", pub)]) == [("h", "root")]
    assert chains(spark, [("h", "owns", "c", pub), ("g", "owns", "h", pub)], max_depth=1) == [("h", "max_depth")]
    assert chains(spark, [("h", "owns", "z", pub)]) == []


def test_contagion_classes(spark):
    e = edges(spark, [("top", "owns", "a", "public"), ("top", "owns", "b", "public"), ("a", "owns", "s", "public"), ("b", "owns", "q", "aggregator-licensed")])
    members, held = V.contagion(spark.createDataFrame([("a",)], "key string"), e, max_hops=3)
    got = {r.key: (r.hops, r.link, r.shared_owner) for r in members.collect()}
    paths = {r.key: [(x["from"], x["to"], x["up"]) for x in r.path] for r in V.contagion(spark.createDataFrame([("a",)], "key string"), e, max_hops=3, paths=True)[0].collect()}
    assert paths["b"] == [("a", "top", True), ("top", "b", False)] and paths["s"] == [("a", "s", False)]
    assert got == {"top": (1, "parent", None), "s": (1, "subsidiary", None), "b": (2, "shares-owner", "top")}
    assert [r.withheld for r in held.collect()] == [1]


def plain_score(a, b):
    ta, tb = set(a.split()), set(b.split())
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if ta == tb:
        return 0.98
    return round(0.5 * len(ta & tb) / len(ta | tb) + 0.5 * SequenceMatcher(None, a, b).ratio(), 4)


def test_scores_against_plain(spark):
    r = random.Random(3)
    words = "ann bob carl dora emil fritz gus hal ida jo".split()
    pairs = [(" ".join(r.sample(words, r.randint(1, 5))), " ".join(r.sample(words, r.randint(1, 5)))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string").distinct()
    got = {(x.a, x.b): x.score for x in N.scored(df, "a", "b", 0.6).collect()}
    want = {p: plain_score(*p) for p in set(pairs) if plain_score(*p) >= 0.6}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1.1e-4 for k in want)


def test_blocking_finds_every_pair_that_shares_a_word(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    q = [(f"q{i}", " ".join(r.sample(words, 2))) for i in range(30)]
    d = [(f"d{i}", " ".join(r.sample(words, 2))) for i in range(30)]
    got = {(x.query, x.record) for x in R.blocked_pairs(spark.createDataFrame(q, "key string, name string"), spark.createDataFrame(d, "key string, name string")).collect()}
    assert got == {(a, b) for a, x in q for b, y in d if set(x.split()) & set(y.split())}


def test_clusters_keep_different_apart(spark):
    rows = [("a", "b", "same", 0.9), ("b", "c", "same", 0.8), ("c", "d", "same", 0.95), ("a", "d", "different", 1.0), ("x", "y", "same", 0.5)]
    log = spark.createDataFrame([(*r, str(i), i) for i, r in enumerate(rows)], "left_key string, right_key string, verdict string, score double, decided_at string, seq long")
    made, refused = R.cluster(R.current_judgements(log))
    by = {r.key: r.cluster for r in made.collect()}
    assert by == {"a": "a", "b": "a", "c": "c", "d": "c", "x": "x", "y": "x"}
    assert [(r.left_key, r.right_key) for r in refused.collect()] == [("b", "c")]
    nodes, links = R.canonical(made)
    assert nodes.count() == 3 and links.count() == 6


def test_gates(spark):
    df = spark.createDataFrame([(0.9, True, False), (0.9, False, False), (0.9, True, True), (0.99, True, True)], "s double, c boolean, i boolean")
    assert [r[0] for r in df.select(R.person_gate(F.col("s"), F.col("c"), F.col("i"))).collect()] == [True, False, False, True]


def test_names(spark):
    r = one(spark, a="Société Générale S.A.", b="The Apple Companies Inc.", c="BRK.B", d="1,234.9").select(N.normal_name(F.col("a")).alias("a"), N.company_core(F.col("b")).alias("b"), N.org_core(N.normal_ascii(F.col("b"))).alias("o"), N.ticker_key(F.col("c")).alias("c"), N.to_int(F.col("d")).alias("d")).first()
    assert tuple(r) == ("societe generale s a", "apple companies", "apple", "BRKB", 1234)


def test_sentences_and_categories(spark):
    text = "We expect revenue to grow in the next year. 1 2 3 4 5 6 7. The board of directors appointed a new leader for the group."
    s = one(spark, doc=1, s_order=1, title="Outlook", content=text)
    rows = Doc.sentence_table(s).orderBy("seq").collect()
    assert [r.category for r in rows] == ["guidance", "executive"]
    ev = Doc.events(Doc.sentence_table(s)).collect()
    assert {r.category for r in ev} == {"guidance", "executive"}
    assert one(spark, c="unknown").select(T.confidence(F.col("c"))).first()[0] == 0.5


def test_changes(spark):
    a = "The company faces new risk in its main market today. Sales are growing in all regions this year."
    b = "Sales are growing in all regions this year! The company has launched a new product line today."
    sec = spark.createDataFrame([(1, 1, "s", a), (2, 1, "s", b)], "doc int, s_order int, title string, content string")
    pairs = spark.createDataFrame([(1, None), (2, 1)], "doc int, previous int")
    got = sorted((r.kind, r.category) for r in Doc.changes(Doc.sentence_table(sec), pairs).collect())
    assert got == [("added", "product"), ("removed", "risk")]


def test_sections(spark):
    r = one(spark, t="intro\n## One\nbody one\n## Two\nbody two").select(Doc.markdown_sections(F.col("t")).alias("s")).first().s
    assert [(x.order, x.title, x.content) for x in r] == [(1, "One", "body one"), (2, "Two", "body two")]
    f = one(spark, f="10-K", t="Item 1. Business\nWe make things.\nItem 1A. Risk Factors\nMany.").select(Doc.filing_sections(F.col("f"), F.col("t")).alias("s")).first().s
    assert [x.content for x in f] == ["We make things.", "Many."]
    n = one(spark, f="10-K", t="nothing here").select(Doc.filing_sections(F.col("f"), F.col("t")).alias("s")).first().s
    assert [(x.title, x.content) for x in n] == [("Raw Filing", "nothing here")]


def test_line_scrapes(spark):
    lines = ["Name", "Alpha Ireland Ltd", "Ireland", "Parent Corp", "Delaware", "Beta GmbH", "Germany"]
    r = spark.createDataFrame([(lines,)], "l array<string>").select(Doc.subsidiary_pairs(F.col("l"), ["ireland", "delaware", "germany"], F.lit("parent")).alias("p")).first().p
    assert [(x.name, x.place) for x in r] == [("Alpha Ireland Ltd", "Ireland"), ("Beta GmbH", "Germany")]
    o = spark.createDataFrame([(["Ann Doe", "51", "Chief Executive", "Bob Roe", "44", "Treasurer"],)], "l array<string>").select(Doc.officers(F.col("l")).alias("p")).first().p
    assert [(x.name, x.age, x.role) for x in o] == [("Ann Doe", 51, "Chief Executive"), ("Bob Roe", 44, "Treasurer")]
    t = "Pursuant to the requirements of the Act\n/s/ Ann Doe\nAnn Doe\nDirector\n/s/ Big Firm LLP\nBig Firm\n"
    s = one(spark, t=t).select(Doc.signers(F.col("t")).alias("p")).first().p
    assert [(x.name, x.role) for x in s] == [("Ann Doe", "Director")]


def test_alerts_cap_and_once(spark):
    items = spark.createDataFrame([("company", "Alpha"), ("keyword", "merger"), ("supply_chain", "x")], "type string, value string")
    ch = spark.createDataFrame([(i, "a", f"a merger number {i}", "m&a", f"first {i}", i) for i in range(40)] + [(99, "b", "supply chain trouble", "risk", "first 99", 99)], "doc long, company string, statement string, category string, first_statement string, seq long")
    ev = spark.createDataFrame([], "doc long, company string, description string, headline string, seq long")
    co = spark.createDataFrame([("a", "Alpha", "tech")], "company string, name string, industry string")
    ex = spark.createDataFrame([], "country string, company string")
    out = A.match(items, ch, ev, co, ex)
    n = {r["type"]: r["count"] for r in out.groupBy("type").count().collect()}
    assert n == {"company": 25, "keyword": 25, "supply_chain": 1}
    assert A.add_new(out, out).count() == 0


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(map(tuple, sinks.upserted(old, new, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, sinks.replaced(old, new, "k").collect())) == [(1, "a"), (2, "B"), (3, "C")]
    n = spark.createDataFrame([("K", "1", 0)], "kind string, key string, seq long")
    e = edges(spark, [("a", "r", "b", None)])
    sinks.save_graph(n, e, str(tmp_path / "g"))
    assert [d.count() for d in sinks.load_graph(spark, str(tmp_path / "g"))] == [1, 1]


def test_streams(spark, tmp_path):
    from tidemark.streaming import jobs

    src = str(tmp_path / "in")
    spark.createDataFrame([("d1", "c1"), ("d2", "c1"), ("d1", "c1")], "canonical_id string, company string").write.parquet(src)
    stream = spark.readStream.schema("canonical_id string, company string").parquet(src)
    project = lambda d: d.select(F.lit("Company").alias("source_kind"), F.col("company").alias("source_key"), F.lit("filed").alias("relation"), F.lit("Filing").alias("target_kind"), F.col("canonical_id").alias("target_key"), F.lit(0).alias("seq"))
    for k in ("c1", "c2"):  # a second run over the same files adds nothing
        jobs.ingest(stream, str(tmp_path / "out"), project, str(tmp_path / k)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_alerts_find_parts_of_words_and_titles(spark):
    items = spark.createDataFrame([("keyword", v) for v in ("merge", "M&A deal", "merger", "k", "title", "nothing")], "type string, value string")
    ch = spark.createDataFrame([(1, "a", "a merger and an m&a deal", "m&a", "first", 1)], "doc long, company string, statement string, category string, first_statement string, seq long")
    ev = spark.createDataFrame([(2, "a", "plain", "A Title of k", 1)], "doc long, company string, description string, headline string, seq long")
    co = spark.createDataFrame([], "company string, name string, industry string")
    ex = spark.createDataFrame([], "country string, company string")
    got = {(r.value, r.kind, r.doc) for r in A.match(items, ch, ev, co, ex).collect()}
    assert got == {("merge", "change", 1), ("M&A deal", "change", 1), ("merger", "change", 1), ("k", "event", 2), ("title", "event", 2)}


def test_blocking_loses_no_pair(spark):
    """Against all pairs, with a word that every record has."""
    from tidemark.functions import names as N
    from tidemark.operators import resolution as R

    first, last = ["john", "jon", "mary", "anna"], ["smith", "smyth", "acme", "acme widgets", "holdings"]
    rows = [(f"k{i}", f"common {first[i % 4]} {last[i % 5]}" + (f" {i % 3}" if i % 2 else "")) for i in range(60)] + [("z", "acme inc"), ("y", "acme holdings"), ("x", "acme")]
    q, r = spark.createDataFrame(rows, "key string, name string"), spark.createDataFrame(rows, "key string, name string")
    everything = q.select(F.col("key").alias("query"), F.col("name").alias("qname")).crossJoin(r.select(F.col("key").alias("record"), "name"))
    for floor, orgs in ((0.6, False), (0.85, False), (0.85, True), (0.97, True)):
        want = {tuple(x) for x in R.best_name(everything, floor, orgs).select("query", "record", "score").collect()}
        got = {tuple(x) for x in R.best_name(R.blocked_pairs(q, r, floor, orgs), floor, orgs).select("query", "record", "score").collect()}
        assert got == want and want


def _clusters(judgements, min_score=0.0):
    """One fold over a whole log without repeated pairs: {key: smallest member}, refused pairs."""
    barred, edges = {}, []
    for a, b, verdict, score in judgements:
        a, b = sorted((a, b))
        if verdict == "different":
            barred.setdefault(a, set()).add(b)
            barred.setdefault(b, set()).add(a)
        elif verdict == "same" and (1.0 if score is None else score) >= min_score:
            edges.append((-(1.0 if score is None else score), a, b))
    group = {k: {k} for k in {*barred, *(k for _, a, b in edges for k in (a, b))}}
    refused = set()
    for _, a, b in sorted(edges):
        x, y = group[a], group[b]
        if x is y:
            continue
        if any(barred.get(k, set()) & y for k in x):
            refused.add((a, b))
            continue
        x |= y
        for k in y:
            group[k] = x
    return {k: min(g) for k, g in group.items()}, refused


def _judged(spark, log):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(log)], "left_key string, right_key string, verdict string, score double, seq long")


def _same_clusters(spark, log, **how):
    made, refused = R.cluster(_judged(spark, log), **how)
    want, no = _clusters(log, how.get("min_score", 0.0))
    assert {r.key: r.cluster for r in made.collect()} == want and made.count() == len(want)
    assert {tuple(r) for r in refused.collect()} == no


@pytest.mark.parametrize("fold_rows", [0, 12, 200_000])
def test_clusters_are_those_of_one_fold(spark, fold_rows):
    """200 random logs side by side, with ties, pairs without a score and keys that are only told apart; by rounds alone, in part, and by folds."""
    r, log = random.Random(5), []
    for g in range(200):
        n, pairs = r.randint(2, 9), set()
        for _ in range(r.randint(1, 22)):
            a, b = r.randrange(n), r.randrange(n)
            if a != b and (min(a, b), max(a, b)) not in pairs:
                pairs.add((min(a, b), max(a, b)))
                score = None if r.random() < 0.15 else r.choice([0.2, 0.5, 0.9, 1.0, r.random()])
                log.append((f"{g:03}-{a}", f"{g:03}-{b}", r.choices(["same", "different", "undecided"], [6, 2, 1])[0], score))
    _same_clusters(spark, log, fold_rows=fold_rows, min_score=0.3)


def test_clusters_of_one_large_contested_component(spark):
    """100,000 judgements in one component, over the size that is folded: rounds first."""
    r, log, pairs = random.Random(6), [], set()
    while len(log) < 100_000:
        a = r.randrange(30_000)
        b = r.randrange(30_000) if r.random() < 0.5 else (a + r.randint(1, 3)) % 30_000
        if a != b and (min(a, b), max(a, b)) not in pairs:
            pairs.add((min(a, b), max(a, b)))
            log.append((f"n{a:05}", f"n{b:05}", "different" if r.random() < 0.2 else "same", round(r.random(), 2)))
    _same_clusters(spark, log, fold_rows=90_000)


def test_clusters_without_scores_and_pins(spark):
    log = [("a", "b", "same", 0.9), ("b", "c", "same", 0.9), ("a", "c", "different", None), ("x", "y", "different", 0.1), ("p", "q", "same", None), ("q", "r", "same", 0.2)]
    made, refused = R.cluster(_judged(spark, log[::-1]))
    assert {r.key: r.cluster for r in made.collect()} == {"a": "a", "b": "a", "c": "c", "x": "x", "y": "y", "p": "p", "q": "p", "r": "p"}
    assert [tuple(r) for r in refused.collect()] == [("b", "c")]
    nodes = spark.createDataFrame([("b", "cid-old"), ("a", "cid-older"), ("x", None), ("r", "cid-1"), ("elsewhere", "cid-2")], "key string, canonical_id string")
    ids = {r.key: r.id for r in P.with_pins(made, P.pinned(nodes)).collect()}
    assert ids["a"] == ids["b"] == "cid-old" and ids["p"] == ids["q"] == ids["r"] == "cid-1" and ids["c"].startswith("cid-") and len(ids["c"]) == 16 and len(set(ids.values())) == 5
    assert R.cluster(_judged(spark, []))[0].count() == 0


def test_exposure_by_classes_of_companies(spark):
    """Companies with equal, different, overlapping and no terms; a null term; repeated links."""
    from tidemark.operators import pathways as P

    r = random.Random(12)
    sets = [["a", "b"], ["b", "a"], ["a"], ["a", "b", "c", None], []]
    links = [(t, f"c{i}") for i in range(40) for t in sets[i % 5]] * 2
    held = [(f"f{r.randrange(4)}", f"c{r.randrange(42)}", float(r.randrange(100))) for _ in range(300)]
    got = P.portfolio_exposure(spark.createDataFrame(held, "fund string, company string, value double"), spark.createDataFrame(links, "term string, company string"))
    terms = {c: {t for t, d in links if d == c} for _, c, _ in held}
    want = {}
    for fund, c, v in held:
        for t in terms[c]:
            n, total = want.get((fund, t), (0, 0.0))
            want[fund, t] = (n + 1, total + v)
    every = {f: (len([1 for x in held if x[0] == f]), sum(x[2] for x in held if x[0] == f)) for f, _, _ in held}
    assert {(x.fund, x.term): (x.n_exposed, x.exposed_value, x.n_holdings, x.total_value) for x in got.collect()} == {k: (*v, *every[k[0]]) for k, v in want.items()}
    classes = {x.company: x["class"] for x in P.company_classes(spark.createDataFrame(links, "term string, company string").distinct()).collect()}
    assert classes["c0"] == classes["c1"] == "c0" and len(set(classes.values())) == 3
