"""Entity resolution: blocking, cascades, gates, judgements and clusters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import names as N
from ..sources.scratch import stored
from .linked import components


def blocked_pairs(queries: DataFrame, records: DataFrame, floor: float = 0.0, organisations: bool = False) -> DataFrame:
    """(query, record, qname, name): pairs of names that share a word and may score ``floor`` or more (JON-10).

    ``queries`` and ``records`` are (key, name), one row for each normalised name. A score that isn't certain needs a Jaccard similarity of
    2 floor - R, where R, the ratio of matching blocks, is bounded by the names' lengths. So two names of given numbers of words and lengths share
    so many words, and meet in their prefixes: the rarest words of each, of which such a pair shares one. A name's prefix is long enough for every
    shape that the other side has. No word is too common to count; where one shared word can be enough, all words are keys. Organisations also
    meet by equal cores, and where all words of the query are in the record, by its rarest one.
    """
    both = queries.select(F.lit(0).alias("side"), "key", "name").unionByName(records.select(F.lit(1).alias("side"), "key", "name"))
    words = both.distinct().select("side", "key", "name", F.explode(N.tokens(F.col("name"))).alias("t"))
    often = words.where("side = 1").groupBy("t").agg(F.count("*").alias("often"))
    ranked = words.join(often, "t", "left").groupBy("side", "key", "name").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "t"))).alias("w"))
    ranked = stored(ranked.select("side", "key", "name", F.transform("w", lambda x: x["t"]).alias("w")), "block-names")
    size = F.size("w")
    shape = ranked.select("side", size.alias("n"), F.length("name").alias("l")).distinct()
    # the table of pairs of shapes (words, signs) is as large as names are varied, however many they are
    a, b = (shape.where(F.col("side") == i).select(F.col("n").alias(f"n{i}"), F.col("l").alias(f"l{i}")) for i in (0, 1))
    least = 2 * floor - 0.0001 - N.ratio_bound(F.col("l0"), F.col("l1"))
    shared = F.when(least <= 0, 1).otherwise(F.greatest(F.ceil(least / (1 + least) * (F.col("n0") + F.col("n1")) - 1e-9), F.lit(1)))
    most = F.least("n0", "n1")
    # equal sets of words have a certain score, whatever their lengths
    fits = stored(a.crossJoin(b).withColumn("need", shared).where((F.col("need") <= most) | (F.col("n0") == F.col("n1"))).withColumn("need", F.least("need", most)), "block-shapes")
    need = [fits.groupBy(F.lit(i).alias("side"), F.col(f"n{i}").alias("n"), F.col(f"l{i}").alias("l")).agg(F.min("need").alias("need")) for i in (0, 1)]
    need = need[0].unionByName(need[1])
    ranked = ranked.withColumns({"n": size, "l": F.length("name")}).join(F.broadcast(need), ["side", "n", "l"], "left")
    # a name whose shape fits none can still meet by its core
    prefix = F.slice("w", F.lit(1), (F.col("n") - F.coalesce("need", "n") + 1).cast("int"))
    q = ranked.where("side = 0").select(F.col("key").alias("query"), F.col("name").alias("qname"), "w", prefix.alias("p"))
    r = ranked.where("side = 1").select(F.col("key").alias("record"), "name", "w", prefix.alias("p"))
    cols = ["query", "record", "qname", "name"]
    met = q.withColumn("t", F.explode("p")).drop("w", "p").join(r.withColumn("t", F.explode("p")).drop("w", "p"), "t").select(*cols)
    if organisations:
        inside = q.select("query", "qname", F.element_at("w", 1).alias("t")).join(r.select("record", "name", F.explode("w").alias("t")), "t").select(*cols)
        core = q.select("query", "qname", N.org_core(F.col("qname")).alias("c")).join(r.select("record", "name", N.org_core(F.col("name")).alias("c")), "c").where("c <> ''").select(*cols)
        met = met.unionByName(inside).unionByName(core)
    return met.distinct()


def best_name(pairs: DataFrame, floor: float, organisations: bool = False) -> DataFrame:
    """(query, record, score, name): the best of a record's names, the first name in order on ties (SIM-05)."""
    s = N.scored(pairs, "qname", "name", floor, organisations)
    return s.groupBy("query", "record").agg(F.max("score").alias("score"), F.min_by("name", F.struct(-F.col("score"), F.col("name"))).alias("name"))


def best_record(matches: DataFrame) -> DataFrame:
    """The best record of each query; ties by record (JON-11)."""
    return matches.groupBy("query").agg(F.min_by(F.struct("record", "score", "name"), F.struct(-F.col("score"), F.col("record"))).alias("m")).select("query", "m.record", "m.score", "m.name")


def corroborates(country: Column, countries: Column, birth: Column, births: Column) -> Column:
    """Same country after folding, else same year of birth (FLT-10)."""
    fold = lambda c: F.lower(F.trim(c))
    same = F.exists(countries, lambda c: fold(c) == fold(country))
    year = F.exists(births, lambda b: F.substring(b, 1, 4) == F.substring(birth, 1, 4))
    return F.coalesce(same, F.lit(False)) | F.coalesce(year, F.lit(False))


def has_topic(topics: Column, *prefixes: str) -> Column:
    """Any topic that begins with one of the prefixes (FLT-09)."""
    out = F.lit(False)
    for p in prefixes:
        out = out | F.coalesce(F.exists(topics, lambda t: t.startswith(p)), F.lit(False))
    return out


def person_gate(score: Column, corroborated: Column, insider: Column, threshold: float = 0.85) -> Column:
    """Confirmed only when corroborated and over the threshold; insiders need 0.99 (FLT-12, FLT-14)."""
    return corroborated & (score >= threshold) & (~insider | (score >= 0.99))


def entity_gate(score: Column, active: Column, corroborated: Column, subsidiary: Column, floor: float = 0.97) -> Column:
    """Active and over the floor; subsidiaries corroborated as well (FLT-13)."""
    return active & (score >= floor) & (~subsidiary | corroborated)


def cascade(left: DataFrame, key: str, steps: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """The first method that resolves a row: (method, lookup(on, company), expression for on) in order (JON-14, JON-15).

    One left join for each method on unique lookup values; the first non-null company counts.
    """
    out = left
    for i, (method, table, on) in enumerate(steps):
        t = table.groupBy(F.col("on").alias(f"_on{i}")).agg(F.min("company").alias(f"_c{i}"))
        out = out.withColumn("_k", on).join(t, F.col("_k") == F.col(f"_on{i}"), "left").drop("_k", f"_on{i}")
    cols = [F.col(f"_c{i}") for i in range(len(steps))]
    method = F.coalesce(*(F.when(c.isNotNull(), m) for c, (m, _, _) in zip(cols, steps)), F.lit("unresolved"))
    return out.withColumn("company", F.coalesce(*cols)).withColumn("method", method).drop(*(f"_c{i}" for i in range(len(steps))))


def resolve_report(resolved: DataFrame) -> DataFrame:
    """(method, n, rate): counts for each method, shares to four digits (AGG-26)."""
    n = resolved.groupBy("method").agg(F.count("*").alias("n"))
    return n.withColumn("rate", F.bround(F.col("n") / F.sum("n").over(W.partitionBy()), 4))


def link_counts(linked: DataFrame, index: str) -> DataFrame:
    """(index, linked, unlinked): how many members of each index a cascade has found (JON-14)."""
    found = F.col("company").isNotNull()
    return linked.groupBy(index).agg(F.count_if(found).alias("linked"), F.count_if(~found).alias("unlinked"))


def insider_hint(source: Column, hints: list[str]) -> Column:
    """Whether a source's name contains any of the hints, in whatever case (FLT-14)."""
    out = F.lit(False)
    for h in hints:
        out = out | F.lower(F.coalesce(source, F.lit(""))).contains(h.lower())
    return out


def unify(left: DataFrame, right: DataFrame, key: str = "isin") -> DataFrame:
    """Two exchange lists by a shared number: both, left or right; the first row of each side counts (JON-13).

    Rows without the number stay alone.
    """
    one = lambda d, s: d.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by("name", "pos").alias(f"{s}_name"))
    both = one(left, "left").join(one(right, "right"), key, "full")
    bucket = F.when(F.col("left_name").isNotNull() & F.col("right_name").isNotNull(), "dual").when(F.col("left_name").isNotNull(), "left_only").otherwise("right_only")
    return both.withColumn("bucket", bucket)


def reconcile(issuers: DataFrame, existing: DataFrame, market: str) -> DataFrame:
    """(identity, key, created): feed issuers matched to nodes by identity, others get ``market-identity`` (JON-12, ERS-08)."""
    feed = issuers.where("identity is not null").groupBy("identity").agg(F.min_by("name", "pos").alias("name"))
    have = existing.where("identity is not null").groupBy("identity").agg(F.min_by("key", "seq").alias("have"))
    out = feed.join(have, "identity", "left")
    return out.select("identity", F.coalesce("have", F.concat_ws("-", F.lit(market), "identity")).alias("key"), "name", F.col("have").isNull().alias("created"))


#: Anchor schemes that may hold several values.
MANY_VALUED = ["ticker", "figi"]


def merge_anchors(anchors: DataFrame) -> DataFrame:
    """(key, anchors) from (key, scheme, value, seq): the first value of identity schemes, all of the others (SET-05)."""
    slot = F.when(F.col("scheme").isin(MANY_VALUED), F.concat_ws("=", "scheme", "value")).otherwise(F.col("scheme"))
    first = anchors.withColumn("slot", slot).groupBy("key", "slot").agg(F.min_by(F.struct("scheme", "value"), "seq").alias("a"))
    return first.groupBy("key").agg(F.array_sort(F.collect_list("a")).alias("anchors"))


def resolve_parties(parties: DataFrame, anchors: DataFrame, keys: DataFrame) -> DataFrame:
    """Owners by anchor, else by explicit key, else a surrogate; resolved says which (JON-17)."""
    a = anchors.groupBy("scheme", "value").agg(F.min_by("key", "seq").alias("by_anchor"))
    k = keys.select(F.col("key").alias("given_key"), F.lit(True).alias("known"))
    out = parties.join(a, ["scheme", "value"], "left").join(k, "given_key", "left")
    key = F.coalesce("by_anchor", F.when(F.col("known"), F.col("given_key")), F.concat(F.lit("x-"), N.slug(F.col("name"), "x")))
    return out.withColumn("key", key).withColumn("resolved", F.col("by_anchor").isNotNull() | F.coalesce("known", F.lit(False))).drop("by_anchor", "known")


def pair_key(left: Column, right: Column) -> Column:
    return F.array_sort(F.array(left, right))


def current_judgements(log: DataFrame) -> DataFrame:
    """The latest judgement of each unordered pair; later in the log on ties (WIN-01, ERS-03, ERS-04). Pairs of one with itself are refused."""
    rows = log.where("left_key <> right_key").withColumn("pair", pair_key(F.col("left_key"), F.col("right_key")))
    rest = [c for c in log.columns]
    return rows.groupBy("pair").agg(F.max_by(F.struct(*rest), F.struct("decided_at", "seq")).alias("j")).select("j.*")


def cluster(current: DataFrame, min_score: float = 0.0, fold_rows: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """((key, cluster, id), (left_key, right_key)): greedy clusters under "different" judgements, and refused unions (ERS-05, WIN-10).

    Unions go by falling score (none counts as 1), then by the pair's smaller and larger key; one is refused if a "different" pair lies between both
    clusters. Every key of a judgement that counts is in a cluster. The order matters only inside a connected component of "same" pairs, and there only if
    a "different" pair lies inside as well; all other components are clusters as they are.

    Contested components of up to ``fold_rows`` judgements are folded, each alone. Larger ones shrink by rounds of joins until what is left is
    that small: see ``_union_round``. The first rounds settle most unions; how many follow depends on how far the order of the scores is a chain.
    """
    score = F.coalesce("score", F.lit(1.0))
    pair = F.least("left_key", "right_key").alias("a"), F.greatest("left_key", "right_key").alias("b")
    same = stored(current.where(F.col("verdict") == "same").select(*pair, score.alias("score")).where(F.col("score") >= min_score), "same")
    apart = stored(current.where("verdict = 'different'").select(*pair), "apart")
    found = components(same)
    grouped = found.select(F.col("node").alias("key"), "root").unionByName(found.select(F.col("root").alias("key"), "root").distinct())
    # keys that are only told apart stand alone
    only = apart.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(grouped, "key", "left_anti").select("key", F.col("key").alias("root"))
    labels = stored(grouped.unionByName(only), "labels")
    first = labels.select(F.col("key").alias("a"), "root")
    enemies = apart.join(first, "a").join(labels.select(F.col("key").alias("b"), F.col("root").alias("other")), "b").where("root = other").select("root", F.col("a").alias("x"), F.col("b").alias("y"))
    enemies = stored(enemies, "enemies")
    contested = enemies.select("root").distinct()
    live = same.join(first, "a").join(contested, "root", "left_semi").select("root", F.col("a").alias("x"), F.col("b").alias("y"), F.struct((-F.col("score")).alias("score"), "a", "b").alias("e"))
    of = labels.join(contested, "root", "left_semi").select("key", F.col("key").alias("cluster"))
    done = labels.join(contested, "root", "left_anti").select("key", F.col("root").alias("cluster"))
    live, of, moves = stored(live, "live"), stored(of, "assigned"), []
    while not live.isEmpty():
        sizes = live.select("root").unionByName(enemies.select("root")).groupBy("root").agg(F.count("*").alias("n"))
        small = stored(sizes.select("root", (F.col("n") <= fold_rows).alias("small")), "sizes")
        own = small.where("small").select("root")
        rows = live.join(own, "root").select("root", "x", "y", "e").unionByName(enemies.join(own, "root").select("root", "x", "y", F.lit(None).cast(live.schema["e"].dataType).alias("e")))
        moves.append(stored(rows.groupBy("root").applyInPandas(_fold, "old string, cluster string"), "moves"))
        big = small.where("not small").select("root")
        live, enemies = stored(live.join(big, "root"), "live"), stored(enemies.join(big, "root"), "enemies")
        if not live.isEmpty():
            live, enemies, joined = _union_round(live, enemies)
            moves.append(joined)
    for move in moves:
        of = of.join(move.withColumnRenamed("cluster", "new"), F.col("cluster") == F.col("old"), "left").select("key", F.coalesce("new", "cluster").alias("cluster"))
        of = stored(of, "assigned")
    made = stored(of.unionByName(done), "clusters")
    out = made.select("key", "cluster", F.concat(F.lit("cid-"), N.hash_id(F.col("cluster"), length=12)).alias("id"))
    # a pair that ends in two clusters was refused when its turn came: clusters told apart never meet
    ends = same.join(made.select(F.col("key").alias("a"), F.col("cluster").alias("ca")), "a").join(made.select(F.col("key").alias("b"), F.col("cluster").alias("cb")), "b")
    return out, ends.where("ca <> cb").select(F.col("a").alias("left_key"), F.col("b").alias("right_key"))


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """One contested component: its unions in order. The cluster is its smallest member."""
    order = sorted((e["score"], e["a"], e["b"], x, y) for e, x, y in zip(pdf["e"], pdf["x"], pdf["y"]) if e is not None)
    parent = {k: k for k in {*pdf["x"], *pdf["y"]}}
    enemies: dict[str, set] = {k: set() for k in parent}
    for x, y in ((x, y) for e, x, y in zip(pdf["e"], pdf["x"], pdf["y"]) if e is None):
        enemies[x].add(y)
        enemies[y].add(x)

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for *_, x, y in order:
        x, y = sorted((find(x), find(y)))
        if x == y or y in enemies[x]:
            continue
        # enemies are named by their clusters of today
        parent[y] = x
        for k in enemies.pop(y):
            enemies[k].discard(y)
            enemies[k].add(x)
            enemies[x].add(k)
    return pd.DataFrame([(k, find(k)) for k in parent if find(k) != k], columns=["old", "cluster"])


def _union_round(live: DataFrame, enemies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(live, enemies, moves): a round of unions that can be made now as they will be made in their turn.

    ``live`` are the pairs that are open between clusters x and y, ``enemies`` the clusters told apart. A pair between enemies is refused for good
    and goes. The first pair of a cluster in order leads it to its ``target``. A cluster joins its target now

    * if it has no enemies: whatever the target is by then, nothing forbids the union; or
    * if, before its turn, the target can only meet clusters that it is the target of, and these only each other, and none of those that come before
      is its enemy. What the target will be by then, and that no enemy will be in it, is then certain. A pair that is the first one of both its clusters is the plain case.

    All of this follows from the first pairs around a cluster, so no component has to be in one place, and a large cluster takes many small ones in one round.
    """
    x, y = F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")
    enemies = stored(enemies.select("root", x, y).distinct(), "enemies")
    # of several pairs between two clusters the first one counts
    open_ = stored(live.select("root", x, y, "e").join(enemies, ["root", "x", "y"], "left_anti").groupBy("root", "x", "y").agg(F.min("e").alias("e")), "live")
    both = lambda t, *more: t.select("x", "y", *more).unionByName(t.select(F.col("y").alias("x"), F.col("x").alias("y"), *more))
    ways, told = both(open_, "e"), both(enemies)
    pick = ways.groupBy("x").agg(F.min(F.struct("e", "y")).alias("p")).select("x", F.col("p.e").alias("first"), F.col("p.y").alias("target"))
    pick = stored(pick.join(told.select("x").distinct().withColumn("hostile", F.lit(True)), "x", "left"), "picks")
    other = pick.select(F.col("x").alias("y"), F.col("target").alias("there"), F.col("first").alias("its_first"))
    seen = ways.join(pick.select("x", "target"), "x").join(other, "y")
    # the first pair by which a target, or a cluster on its way to it, can meet anything else
    loose = seen.where("there <> x").select(F.col("x").alias("target"), "e").unionByName(seen.where("y <> target and there <> target").select("target", "e"))
    until = loose.groupBy("target").agg(F.min("e").alias("until"))
    waits = told.join(pick.select("x", "first", "target"), "x").join(other, "y").where("target = there and its_first < first").select("x").distinct()
    sure = pick.where("hostile").join(until, "target", "left").where("until is null or first < until").join(waits, "x", "left_anti").select("x", "target")
    merged = pick.where("hostile is null").select("x", "target").unionByName(sure).select(F.col("x").alias("a"), F.col("target").alias("b"))
    moves = stored(components(merged).select(F.col("node").alias("old"), F.col("root").alias("cluster")), "moves")

    def moved(table: DataFrame) -> DataFrame:
        for side in ("x", "y"):
            new = moves.select(F.col("old").alias(side), F.col("cluster").alias("_new"))
            table = table.join(new, side, "left").withColumn(side, F.coalesce("_new", side)).drop("_new")
        return table

    return stored(moved(open_).where("x <> y").select("root", "x", "y", "e"), "live"), stored(moved(enemies).select("root", "x", "y"), "enemies"), moves


def canonical(clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical nodes and resolves_to edges of clusters with several members (ERS-07)."""
    big = clusters.groupBy("id").agg(F.count("*").alias("members"), F.min("key").alias("name")).where("members >= 2")
    edges = clusters.join(big.select("id"), "id").select(F.col("key").alias("source_key"), F.lit("resolves_to").alias("relation"), F.col("id").alias("target_key"))
    return big.select(F.lit("Canonical").alias("kind"), F.col("id").alias("key"), "name", "members"), edges


def priority_merge(rows: DataFrame, keys: list[str], rank: Column, order: str) -> DataFrame:
    """One row for each key: the best rank, then the first (JON-22)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(rank, F.col(order))).alias("r")).select(*keys, "r.*")


def mentions(texts: DataFrame, gazetteer: DataFrame, longest: int) -> DataFrame:
    """(doc, key, first): names found as whole runs of words, by n-grams and an equi-join (JON-18, JON-19)."""
    words = texts.select("doc", N.normal_ascii(F.col("text")).alias("t")).select("doc", F.split("t", " ").alias("w"))
    sizes = gazetteer.select(F.size(F.split("name", " ")).alias("n")).where(F.col("n") <= longest).distinct()
    counts = [r[0] for r in sizes.collect()]

    def runs(n: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
        return F.when(F.size("w") >= n, made).otherwise(F.array().cast("array<string>"))

    grams = F.array_distinct(F.flatten(F.array(*map(runs, counts)))) if counts else F.array().cast("array<string>")
    return words.select("doc", F.explode(grams).alias("name")).join(gazetteer, "name").select("doc", "key", "name").distinct()


def company_mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(doc, company, kind, key): entities of a document's own company whose name stands in it as whole words (JON-19).

    texts (doc, company, text); names (company, kind, key, name). Runs of words meet the company's names in an equi-join; what is found is then looked for in the text as it
    is, so that a name with signs in it matches only with them. One document's runs and one company's names bound both sides of a key.
    """
    known = names.withColumn("run", N.normal_ascii(F.col("name"))).where("run <> ''")
    sizes = [r[0] for r in known.select(F.size(F.split("run", " ")).alias("n")).distinct().collect()]
    words = texts.select("doc", "company", F.lower("text").alias("low"), F.split(N.normal_ascii(F.col("text")), " ").alias("w"))

    def runs(n: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
        return F.when(F.size("w") >= n, made).otherwise(F.array().cast("array<string>"))

    grams = F.array_distinct(F.flatten(F.array(*map(runs, sizes)))) if sizes else F.array().cast("array<string>")
    met = words.select("doc", "company", "low", F.explode(grams).alias("run")).join(known, ["company", "run"])
    whole = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.lower("name"), F.lit(r"\E(?!\w)"))
    return met.where(F.rlike(F.col("low"), whole)).select("doc", "company", "kind", "key").distinct()
