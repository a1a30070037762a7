"""Rows that operators move, on small inputs made so that a wasteful plan moves many more."""

import itertools

import pytest


@pytest.fixture()
def dealt(spark):
    """Many partitions, so that what a task sums up by itself hides nothing; the fixture counts the rows that shuffles write while f runs."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    status = spark.sparkContext._jsc.sc().statusStore()

    def written():
        stages = status.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    def count(f):
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        before = written()
        out = f()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return out, sum(n for k, n in written().items() if k not in before)

    yield count
    for k, v in keep.items():
        spark.conf.set(k, v)


def _dense(spark, n=70):
    pairs = [(a, b) for a, b in itertools.permutations(range(n), 2) if (a * 7 + b) % 3]
    return pairs, spark.createDataFrame([(f"n{a}", f"n{b}", i) for i, (a, b) in enumerate(pairs)], "source_key string, target_key string, seq long"), spark.createDataFrame([(f"n{i}",) for i in range(n)], "key string")


def test_reach_moves_edges_not_edges_times_starts(spark, dealt):
    from tidemark.operators import traverse as V

    pairs, edges, starts = _dense(spark)
    got, moved = dealt(lambda: {(r.start, r.key): r.hops for r in V.reachable(starts, edges, 3).collect()})
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    want = {}
    for s in out:
        far, seen = {s}, {s}
        for hop in (1, 2, 3):
            far = {b for a in far for b in out.get(a, ())} - seen
            seen |= far
            want |= {(f"n{s}", f"n{k}"): hop for k in far}
    assert got == want and moved < 12 * len(pairs), (moved, len(pairs))


def test_reach_of_more_starts_than_a_block(spark):
    from tidemark.operators import traverse as V

    n = 3 * 64 * V.WORDS + 5
    edges = spark.range(n).selectExpr("cast(id as string) source_key", f"cast((id + 1) % {n} as string) target_key", "id seq")
    starts = spark.range(n).selectExpr("cast(id as string) key")
    got = {(int(r.start), int(r.key), r.hops) for r in V.reachable(starts, edges, 2).collect()}
    assert got == {(i, (i + h) % n, h) for i in range(n) for h in (1, 2)}


def test_paths_move_new_nodes_not_ways(spark, dealt):
    from tidemark.operators import traverse as V

    pairs, edges, starts = _dense(spark)
    got, moved = dealt(lambda: {(r.start, r.key): [x.seq * 2 + x.up for x in r.path] for r in V.network(starts, edges, 2).collect()})
    ways = {}
    for i, (a, b) in enumerate(pairs):
        ways[a, b] = min(ways.get((a, b), 1 << 60), 2 * i)
        ways[b, a] = min(ways.get((b, a), 1 << 60), 2 * i + 1)
    near = {}
    for (a, b), c in ways.items():
        near.setdefault(a, {})[b] = c
    want = {}
    for s, own in near.items():
        want |= {(f"n{s}", f"n{b}"): [c] for b, c in own.items()}
        for b in set(near) - set(own) - {s}:
            if two := [[c, near[a][b]] for a, c in own.items() if b in near[a]]:
                want[f"n{s}", f"n{b}"] = min(two)
    assert got == want and moved < 25 * len(pairs), (moved, len(pairs))


def test_paths_move_an_edge_twice_and_then_lists(spark, dealt):
    """Every edge once to each of its ends; then rows are nodes of a block, not edges of a block and level."""
    from tidemark.operators import traverse as V

    pairs, edges, starts = _dense(spark, 120)
    got, moved = dealt(lambda: V.network(starts, edges, 2, paths=False).count())
    assert got == 120 * 119 and moved < 2 * len(pairs) + 6 * got, (moved, len(pairs), got)


def test_paths_over_parts_and_blocks_are_those_of_one_queue(spark, monkeypatch):
    """Neighbours in several parts, starts in several blocks; parallel edges, loops, nulls, and names that are empty or not ASCII."""
    import random

    from tidemark.operators import traverse as V

    monkeypatch.setattr(V, "SPAN", 7)
    monkeypatch.setattr(V, "BLOCK", 3)
    r = random.Random(3)
    names = ["", "é", "長い名前", *(f"n{i}" for i in range(27))]
    pairs = [(r.choice(names), r.choice(names)) for _ in range(70)]
    edges = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)] + [(None, "n1", 900), ("n1", None, 901)], "source_key string, target_key string, seq long")
    starts = [*names[:5], *names[9:21], "nobody"]
    got = V.network(spark.createDataFrame([(s,) for s in [*starts, None]], "key string"), edges, 3).collect()
    want = {}
    for s in starts:
        seen, level = {s: ()}, [s]
        for _ in range(3):
            new = []
            for at in level:
                for i, (a, b) in enumerate(pairs):
                    for to, up in [(b, 0)] * (a == at) + [(a, 1)] * (b == at):
                        if to not in seen:
                            seen[to] = (*seen[at], 2 * i + up)
                            new.append(to)
            level = new
        want |= {(s, k): list(p) for k, p in seen.items() if p}
    assert len(got) == len(want) and {(x.start, x.key): [y.seq * 2 + y.up for y in x.path] for x in got} == want


def test_names_with_a_common_word_do_not_all_meet(spark):
    from tidemark.operators import resolution as R

    q = spark.range(0, 1500, 20).selectExpr("cast(id as string) key", "'customer ' || lpad(cast(id as string), 9, '0') name")
    r = spark.range(1500).selectExpr("'w' || id key", "'customer ' || lpad(cast(id as string), 9, '0') || ' ii' name")
    met = R.blocked_pairs(q, r, 0.6)
    assert met.count() == 75
    every = q.selectExpr("key query", "name qname").crossJoin(r.selectExpr("key record", "name"))
    want = {(x.query, x.record) for x in every.where("query < '2'").collect() if _score(x.qname, x.name) >= 0.6}
    assert {(x.query, x.record) for x in R.best_name(met, 0.6).collect() if x["query"] < "2"} == want and want


def _score(a, b):
    from difflib import SequenceMatcher

    x, y = set(a.split()), set(b.split())
    return round(0.5 * len(x & y) / len(x | y) + 0.5 * SequenceMatcher(None, a, b).ratio(), 4)


def test_blocking_of_names_of_many_lengths_loses_no_pair(spark):
    import random

    from tidemark.operators import resolution as R

    rand = random.Random(8)
    words = ["a", "bo", "common", "extraordinary", "iii", "x" * 25, "smith", "smyth"]
    rows = sorted({" ".join(rand.choice(words) for _ in range(rand.randint(1, 5))) for _ in range(150)}) + ["", "bo bo bo bo bo bo"]
    t = spark.createDataFrame([(f"k{i}", n) for i, n in enumerate(rows)], "key string, name string")
    every = t.selectExpr("key query", "name qname").crossJoin(t.selectExpr("key record", "name"))
    for floor, orgs in ((0.55, False), (0.6, False), (0.9, False), (0.8, True)):
        want = {tuple(x) for x in R.best_name(every, floor, orgs).select("query", "record", "score").collect()}
        assert {tuple(x) for x in R.best_name(R.blocked_pairs(t, t, floor, orgs), floor, orgs).select("query", "record", "score").collect()} == want and want


def test_organisations_of_unlike_lengths_meet_by_their_core(spark):
    from tidemark.operators import resolution as R

    q = spark.createDataFrame([("a", "n1 works")], "key string, name string")
    r = spark.createDataFrame([("b", "n1 works inc")], "key string, name string")
    assert [(x.query, x.record) for x in R.blocked_pairs(q, r, 0.97, True).collect()] == [("a", "b")]


def test_vectors_leave_a_block_as_the_best_only(spark):
    """300 queries by 500 rows in one cell: k rows of each query leave each of its blocks, in place of 150,000 pairs; equal scores by key."""
    import numpy as np
    from pyspark.sql import functions as F

    from tidemark.operators import vectors as Vec

    v = np.random.default_rng(4).normal(size=(500, 6))
    v[7::50] = v[7]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(0, i, x.tolist()) for i, x in enumerate(v)], "cell int, key long, unit array<double>")
    held = Vec._blocks(rows, "key", "unit", 200, ("keys", "v")).withColumn("key", F.get("keys", F.lit(0)))
    asked = rows.where("key < 300").select("cell", F.col("key").alias("query"), F.col("unit").alias("q"))
    out = Vec._best(asked, held, 4).collect()
    assert held.count() == 3 and len(out) == 300 * 3 * 4
    got = sorted((-r.score, r.key) for r in out if r["query"] == 7)[:4]
    assert got == [(-1.0, 7), (-1.0, 57), (-1.0, 107), (-1.0, 157)]


def test_cosines_of_a_large_group_are_work_of_many_tasks(spark, monkeypatch):
    """Blocks of one group are keys of their own; zero and null vectors, and queries and rows of more than a block, by a plain cosine."""
    import numpy as np
    from pyspark.sql import functions as F

    from tidemark.operators import vectors as Vec

    monkeypatch.setattr(Vec, "ASKED", 7)
    monkeypatch.setattr(Vec, "HELD", 20)
    monkeypatch.setattr(Vec, "SENT", 50)
    v = np.random.default_rng(9).normal(size=(120, 5))
    v[3] = 0
    rows = [(i, x.tolist(), None if i == 7 else int(i > 100)) for i, x in enumerate(v)] + [(120, None, 0), (121, [1.0, None, 0.0, 0.0, 0.0], 0)]
    t = spark.createDataFrame(rows, "id long, v array<float>, label int")
    asked, held = t.where("id % 3 = 0").select("label", F.col("id").alias("query"), F.col("v").alias("q")), t.select("label", F.col("id").alias("key"), "v")
    got = {(r.query, r.key): r.cosine for r in Vec.cosines(asked, held, "label").collect()}
    norm = np.linalg.norm(v, axis=1)
    want = {(i, j): None if max(i, j) >= 120 else float(v[i] @ v[j] / (norm[i] * norm[j])) if norm[i] * norm[j] else 0.0 for i, _, a in rows[::3] for j, _, b in rows if a == b and a is not None}
    assert set(got) == set(want) and all((got[k] is None) == (x is None) and (x is None or abs(got[k] - x) < 2e-6) for k, x in want.items())


def test_companies_of_a_hub_are_dealt(spark, monkeypatch):
    from tidemark.operators import pathways as P

    monkeypatch.setattr(P, "DEALT", 10)
    rows = [(f"c{i}", "hub") for i in range(90)] + [("c1", "b"), ("c2", "b"), ("c3", "lone"), ("c2", "b")]
    out = P.proxy_links(spark.createDataFrame(rows, "source_key string, target_key string"))
    got = [(r.company, r.other, r.via) for r in out.collect()]
    hubs = {}
    for a, h in rows:
        hubs.setdefault(h, set()).add(a)
    assert len(got) == len(set(got)) and set(got) == {(a, b, h) for h, own in hubs.items() for a in own for b in own if a != b}


def test_pairs_of_a_hub_are_made_in_many_tasks(spark, monkeypatch):
    """Spark may join tasks of few bytes; these make many rows of them."""
    from pyspark.sql import functions as F
    from tidemark.operators import pathways as P

    monkeypatch.setattr(P, "DEALT", 10)
    monkeypatch.setattr(P, "PAIRS", 100, raising=False)
    rows = spark.range(200).selectExpr("concat('c', id) source_key", "'hub' target_key").union(spark.createDataFrame([("c1", None), ("c2", None)], "source_key string, target_key string"))
    by = [r["count"] for r in P.proxy_links(rows).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(by) == 200 * 199 and len(by) >= 10 and max(by) < 200 * 199 / 4, by
    assert P.proxy_links(rows.limit(0)).count() == 0


def test_embeddings_move_a_row_for_each_text_not_its_words(spark, dealt):
    from tidemark.operators import retrieval as Ret

    df = spark.range(60).selectExpr("id % 50 doc", "concat_ws(' ', transform(sequence(1, 200), i -> concat('w', i * (id + 1)))) text")
    got, moved = dealt(lambda: Ret.embed_sparse(df).collect())
    assert moved <= 60 and len({r.doc for r in got}) == 50
    assert all(abs(sum(r.weight**2 for r in got if r.doc == d) - 1) < 1e-9 for d in (0, 20))


def test_peers_move_pairs_not_pairs_by_term(spark, dealt):
    from tidemark.operators import pathways as P

    exposed = [(f"t{t}" if t else None, f"c{c}") for c in range(20) for t in range(40) if (c + t) % 3]
    refs = [(f"c{a}", f"c{b}", a * 30 + b, f"s{a}-{b}") for a in range(25) for b in range(25) if a != b]
    e, r = spark.createDataFrame(exposed * 2, "term string, company string"), spark.createDataFrame(refs + [(a, b, n + 9000, "late") for a, b, n, _ in refs], "source_key string, target_key string, seq long, source string")
    out, moved = dealt(lambda: P.network_peers(e, r).collect())
    have = set(exposed)
    want = {(t, a, b, s) for a, b, _, s in refs for t in {t for t, c in exposed if c == b} if t is None or (t, a) not in have}
    assert len(out) == len(want) and {(x.term, x.company, x.via, x.source) for x in out} == want
    assert moved < 10 * len(refs), (moved, len(refs))


def test_a_sentence_is_cut_into_words_once(spark):
    from tidemark.functions import text as T
    from pyspark.sql import functions as F

    rows = [("It is the year of our lord.", True), ("is 1 2 3 4 5 6 7.", False), ("Ünïts wèré shipped to all of them…", True), ("Él é ü ö ä ß is", False), ("one two three four five six", False), ("we have talked to five men 12 (3)", True), ("", False), (None, None)]
    df = spark.createDataFrame([r[:1] for r in rows], "s string").select("s", T.is_disclosure(F.col("s"), ["is", "was"]).alias("x"))
    assert {r.s: bool(r.x) for r in df.collect()} == {s: bool(w) for s, w in rows}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("regexp_extract_all(") == 2


def test_texts_give_only_the_grams_of_items(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import alerts as A

    rows = spark.createDataFrame([(1, "x😀yz and a very long text about nothing"), (2, "é😀y"), (3, None), (4, ""), (5, "no")], "doc long, text string")
    items = spark.createDataFrame([("😀yz",), ("é😀",), ("no",), ("about noth",), ("",)], "v string")
    marks = A._marks(spark.createDataFrame([("😀yz",), ("é😀",)], "gram string"))
    got = {r.doc: sorted(r.g) for r in rows.select("doc", A._grams(F.col("text"), [2, 3], marks).alias("g")).collect()}
    assert got == {1: ["😀yz"], 2: ["é😀"], 3: [], 4: [], 5: []}
    assert sorted((r.doc, r.v) for r in A.containing(rows, F.col("text"), items).collect()) == [(1, "about noth"), (1, "no"), (1, "😀yz"), (2, "é😀"), (5, "no")]


def test_exposure_moves_holdings_not_holdings_times_terms(spark, dealt):
    """Companies whose sets of terms all differ, one term that is null, and one company without terms."""
    from tidemark.operators import pathways as P

    links = [(None if t == 7 else f"t{t}", f"c{c}") for c in range(40) for t in range(150) if t != c]
    held = [(f"f{f}", f"c{(f * 7 + k) % 41}", float(f + k)) for f in range(60) for k in range(20)]
    got, moved = dealt(lambda: P.portfolio_exposure(spark.createDataFrame(held, "fund string, company string, value double"), spark.createDataFrame(links, "term string, company string")).collect())
    terms = {}
    for t, c in links:
        terms.setdefault(c, []).append(t)
    want = {}
    for f, c, v in held:
        for t in terms.get(c, []):
            n, s = want.get((f, t), (0, 0))
            want[f, t] = n + 1, s + v
    assert {(r.fund, r.term): (r.n_exposed, r.exposed_value) for r in got} == want and len(got) == len(want)
    assert {(r.fund, r.n_holdings, r.total_value) for r in got} == {(f"f{f}", 20, float(20 * f + 190)) for f in range(60)}
    # rows by fund and term are 9,000, and made of 176,000; links move four times
    assert moved < 10 * (len(held) + len(links) // 2), moved
