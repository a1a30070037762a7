"""Panels, briefings and end-to-end runs put together from the other operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import graph as G
from . import resolution as R


def panel(edges: DataFrame, confirmed: list[str], review: list[str], clearance: str, day: str | None = None) -> DataFrame:
    """(state, relation, n) of the edges that a clearance may see on a day (AGG-13, AGG-14, SET-06)."""
    seen = G.visible(G.as_of(edges, day), clearance)
    state = F.when(F.col("relation").isin(confirmed), "confirmed").when(F.col("relation").isin(review), "review")
    return seen.withColumn("state", state).where("state is not null").groupBy("state", "relation").agg(F.count("*").alias("n"))


def briefing(holdings: DataFrame, events: DataFrame, per_holding: int = 5, overall: int = 15) -> DataFrame:
    """The newest events of each holding, then the newest of all (JON-28). events (company, doc, seq, ...)."""
    x = events.join(holdings.select("company").distinct(), "company", "left_semi")
    k = F.row_number().over(W.partitionBy("company").orderBy(F.desc("seq"), F.desc("doc")))
    return x.withColumn("k", k).where(F.col("k") <= per_holding).drop("k").orderBy(F.desc("seq"), F.desc("doc")).limit(overall)


def dashboard(documents: DataFrame, events: DataFrame, latest: int = 40) -> dict[str, DataFrame]:
    """Counts, newest documents and events; risks and opportunities out of the newest 40 events only (AGG-21)."""
    newest = events.orderBy(F.desc("seq"), F.desc("doc")).limit(latest)
    pick = lambda cats: newest.where(F.col("category").isin(cats)).orderBy(F.desc("seq"), F.desc("doc")).limit(6)
    return {
        "counts": documents.agg(F.count("*").alias("documents"), F.countDistinct("company").alias("companies")),
        "documents": documents.orderBy(F.desc("doc")).limit(6),
        "events": newest.orderBy(F.desc("seq"), F.desc("doc")).limit(8),
        "risks": pick(["risk", "litigation", "regulatory", "supply_chain"]),
        "opportunities": pick(["opportunity", "product", "m&a"]),
    }


def run_report(documents: DataFrame, events: DataFrame, sets: DataFrame) -> DataFrame:
    """One row: documents, companies, sources, events, change sets, material ones (AGG-23, AGG-24)."""
    one = lambda d: d.withColumn("one", F.lit(1))
    d = one(documents.agg(F.count("*").alias("documents"), F.countDistinct("company").alias("companies"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")))
    e = one(events.agg(F.count("*").alias("events")))
    s = one(sets.agg(F.count("*").alias("change_sets"), F.count_if("material").alias("material")))
    return d.join(e, "one").join(s, "one").drop("one")


def commit_log(sets: DataFrame, events: DataFrame) -> DataFrame:
    """Material change sets and events in one list, newest first, undated last (WIN-07). Both (when, company, title, doc)."""
    a = sets.select("when", "company", "title", "doc", F.lit("change").alias("kind"))
    b = events.select("when", "company", "title", "doc", F.lit("event").alias("kind"))
    return a.unionByName(b).orderBy(F.col("when").desc_nulls_last(), "kind", "doc", "title")


def dominant_direction(rows: DataFrame) -> DataFrame:
    """(company, direction): risk before all, else the first seen (WIN-09)."""
    order = F.struct(F.when(F.col("direction") == "risk", 0).otherwise(1), F.col("seq"))
    return rows.groupBy("company").agg(F.min_by("direction", order).alias("direction"))


def first_labels(rows: DataFrame) -> DataFrame:
    """One row for each company, the first label (SET-07)."""
    return rows.groupBy("company").agg(F.min_by("label", "pos").alias("label"))


def connected(edges: DataFrame, limit: int = 6) -> DataFrame:
    """(company, k, key): the first distinct neighbours of each company (TOP-11)."""
    one = edges.groupBy(F.col("source_key").alias("company"), F.col("target_key").alias("key")).agg(F.min("seq").alias("seq"))
    k = F.row_number().over(W.partitionBy("company").orderBy("seq", "key"))
    return one.withColumn("k", k).where(F.col("k") <= limit).select("company", "k", "key")


def person_holdings(rows: DataFrame) -> DataFrame:
    """(company, person, shares, role) edges; a share count that is no whole number is dropped, the role falls back (JON-23)."""
    title = F.nullif(F.trim("title"), F.lit(""))
    role = F.coalesce(title, F.when(F.col("is_director"), "Director"), F.when(F.col("is_officer"), "Officer"), F.lit("Insider"))
    shares = F.when(F.col("shares") == F.floor("shares"), F.col("shares").cast("long"))
    return rows.select("company", "person", shares.alias("shares"), role.alias("role"))


def instrument_edges(commodities: DataFrame, debts: DataFrame) -> DataFrame:
    """affects_sector and issued_by edges of (slug, affects_sectors) and (slug, issuer_country) (JON-24)."""
    a = commodities.select(F.lit("Commodity").alias("source_kind"), F.col("slug").alias("source_key"), F.lit("affects_sector").alias("relation"), F.lit("Sector").alias("target_kind"), F.explode("affects_sectors").alias("target_key"))
    b = debts.where("issuer_country is not null").select(F.lit("DebtInstrument").alias("source_kind"), F.col("slug").alias("source_key"), F.lit("issued_by").alias("relation"), F.lit("Country").alias("target_kind"), F.col("issuer_country").alias("target_key"))
    return a.unionByName(b)


def classify(companies: DataFrame, paths: DataFrame, tiers: DataFrame) -> DataFrame:
    """(company, sector, tier): a company's classification, else its raw label; its country's tier (JON-20, FN-25)."""
    x = companies.join(paths, "company", "left").join(tiers, "country", "left")
    return x.select("company", F.coalesce("sector", "label").alias("sector"), F.col("sector").isNull().alias("from_label"), "tier")


def neighbourhood(edges: DataFrame, nodes: DataFrame, company: str, clearance: str = "public") -> DataFrame:
    """Visible edges out of and into one company with the far nodes (PRJ-05)."""
    out = G.neighbours(G.visible(edges, clearance).where(F.col("source_key") == company), nodes)
    back = G.neighbours(G.visible(edges, clearance).where(F.col("target_key") == company), nodes, incoming=True)
    cols = ["source_key", "relation", "target_key", F.col("far.name").alias("far_name")]
    return out.select(*cols, F.lit("out").alias("direction")).unionByName(back.select(*cols, F.lit("in").alias("direction")))


def with_provenance(documents: DataFrame, authority: DataFrame) -> DataFrame:
    """A uniform record of origin on every document (PRJ-06)."""
    x = documents.join(authority, "source", "left")
    return x.withColumn("provenance", F.struct("source", "uri", "retrieved_at", F.coalesce("authority", F.lit(0.5)).alias("authority"), "publisher"))


def visible_documents(documents: DataFrame, clearance: str = "public") -> DataFrame:
    """Documents by the tier in their metadata, before any limit is applied (FLT-05)."""
    return documents.where(G.can_see(F.col("metadata")["access_tier"], clearance))


Scorer = Callable[[DataFrame], DataFrame]


def screen(persons: DataFrame, records: DataFrame, floor: float = 0.85, scorer: Scorer | None = None) -> dict[str, DataFrame]:
    """Watchlist screening: block, score, corroborate, gate, edges, judgements, report (ERS-01, UDF-01).

    persons (key, name, country, birth, insider), names normalised; records (id, name, topics, countries, births), one row for each name.
    A confirmed match gives ``sanctioned`` and ``pep`` edges by its topics, others ``screening_candidate``.
    """
    pairs = R.blocked_pairs(persons.select("key", "name"), records.select(F.col("id").alias("key"), "name"), 0.0 if scorer else floor)
    best = (scorer or (lambda p: R.best_name(p, floor)))(pairs)
    facts = records.groupBy(F.col("id").alias("record")).agg(F.min(F.struct("topics", "countries", "births")).alias("f")).select("record", "f.*")
    x = best.join(persons.select(F.col("key").alias("query"), "country", "birth", "insider"), "query").join(facts, "record")
    x = x.withColumn("corroborated", R.corroborates(F.col("country"), F.col("countries"), F.col("birth"), F.col("births")))
    x = x.withColumn("confirmed", R.person_gate(F.col("score"), F.col("corroborated"), F.col("insider"), floor))
    kinds = F.array_compact(F.array(F.when(F.col("confirmed") & R.has_topic(F.col("topics"), "sanction"), "sanctioned"), F.when(F.col("confirmed") & R.has_topic(F.col("topics"), "role.pep"), "pep")))
    kinds = F.when(F.size(kinds) > 0, kinds).otherwise(F.array(F.lit("screening_candidate")))
    edges = x.select(F.col("query").alias("source_key"), F.explode(kinds).alias("relation"), F.col("record").alias("target_key"), "score", "corroborated", F.when(F.col("confirmed"), "confirmed").otherwise("review").alias("review_status"))
    judged = x.select(F.col("query").alias("left_key"), F.col("record").alias("right_key"), F.when(F.col("confirmed"), "same").otherwise("undecided").alias("verdict"), "score")
    report = x.agg(F.count("*").alias("matches"), F.count_if("confirmed").alias("confirmed"), F.count_if(~F.col("confirmed")).alias("pending"))
    return {"edges": edges, "judgements": judged, "report": report}


def anchor(nodes: DataFrame, records: DataFrame, floor: float = 0.97, review_floor: float = 0.85, scorer: Scorer | None = None) -> DataFrame:
    """(key, lei, score, status): resolved, review or unresolved, every node kept (ERS-02, UDF-02).

    nodes (key, name, country, subsidiary); records (id, name, country, active), one row for each name.
    """
    pairs = R.blocked_pairs(nodes.select("key", "name"), records.select(F.col("id").alias("key"), "name"), 0.0 if scorer else review_floor, organisations=True)
    best = R.best_record((scorer or (lambda p: R.best_name(p, review_floor, organisations=True)))(pairs))
    facts = records.groupBy(F.col("id").alias("record")).agg(F.max(F.struct("active", "country")).alias("f")).select("record", F.col("f.country").alias("rc"), F.col("f.active").alias("active"))
    x = nodes.join(best.join(facts, "record"), F.col("key") == F.col("query"), "left")
    ok = R.entity_gate(F.col("score"), F.col("active"), F.coalesce(F.col("country") == F.col("rc"), F.lit(False)), F.col("subsidiary"), floor)
    status = F.when(F.col("record").isNull(), "unresolved").when(ok, "resolved").otherwise("review")
    return x.select("key", F.col("record").alias("lei"), "score", status.alias("status"))


def anchor_report(anchored: DataFrame) -> DataFrame:
    """(nodes, resolved, review, unresolved, rate): counters of an anchoring run, the resolved share to four digits (AGG-27)."""
    n = lambda s: F.count_if(F.col("status") == s)
    rate = F.when(F.count("*") > 0, F.bround(n("resolved") / F.count("*"), 4)).otherwise(0.0)
    return anchored.agg(F.count("*").alias("nodes"), n("resolved").alias("resolved"), n("review").alias("review"), n("unresolved").alias("unresolved"), rate.alias("rate"))


def pending(current: DataFrame, method: str | None = None) -> DataFrame:
    """Judgements that nobody has decided yet, those without a score last (AGG-27)."""
    rows = current.where("verdict = 'undecided'")
    rows = rows if method is None else rows.where(F.col("method") == method)
    return rows.orderBy(F.desc_nulls_last("score"), "left_key", "right_key")


#: Default tier of each basis of ownership.
BASIS_TIER = {"owns": "public", "beneficial_owner_of": "legitimate-interest", "consolidates": "public"}


def ingest_ownership(records: DataFrame, anchors: DataFrame, keys: DataFrame) -> DataFrame:
    """Ownership edges with both parties resolved (JON-17 twice), a default tier unless the record has one, first write wins (ERS-09)."""
    side = lambda s: records.select("seq", *(F.col(f"{s}_{c}").alias(c) for c in ("scheme", "value", "given_key", "name")))
    h = R.resolve_parties(side("holder"), anchors, keys).select("seq", F.col("key").alias("source_key"), F.col("resolved").alias("holder_resolved"))
    s = R.resolve_parties(side("subject"), anchors, keys).select("seq", F.col("key").alias("target_key"), F.col("resolved").alias("subject_resolved"))
    table = F.create_map(*(F.lit(x) for p in BASIS_TIER.items() for x in p))
    e = records.select("seq", F.col("basis").alias("relation"), F.coalesce("access_tier", table[F.col("basis")], F.lit("aggregator-licensed")).alias("access_tier"), "percentage").join(h, "seq").join(s, "seq")
    e = e.withColumns({"source_kind": F.lit("Party"), "target_kind": F.lit("Company")})
    return G.upsert_edges(e)


def pinned(nodes: DataFrame) -> DataFrame:
    """(key, id) of nodes whose canonical id is fixed (ERS-06)."""
    return nodes.where("canonical_id is not null").select("key", F.col("canonical_id").alias("id"))


def with_pins(clusters: DataFrame, pins: DataFrame) -> DataFrame:
    """The lowest pinned id of a cluster instead of its own (WIN-10)."""
    p = clusters.join(pins.withColumnRenamed("id", "pin"), "key").groupBy("cluster").agg(F.min("pin").alias("pin"))
    return clusters.join(p, "cluster", "left").select("key", "cluster", F.coalesce("pin", "id").alias("id"))


def covered_numbers(companies: DataFrame, scheme: str) -> DataFrame:
    """Distinct anchor values of a scheme (FN-28)."""
    return companies.select(F.explode("anchors").alias("a")).where(F.col("a.scheme") == scheme).select(F.col("a.value").alias("value")).distinct()


def coarse_sector(label: Column, rules: list[tuple[str, str]], other: str = "Other") -> Column:
    """The first rule whose pattern fits a free label (FN-26)."""
    return F.coalesce(*(F.when(F.lower(label).rlike(p), name) for p, name in rules), F.lit(other))
