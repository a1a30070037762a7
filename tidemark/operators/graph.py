"""The property graph as two tables: upserts, filters, lookups and profiles.

An edge is (source_kind, source_key, relation, target_kind, target_key) with ``seq`` as its place of
insertion, the promoted columns ``source, access_tier, valid_from, valid_to`` and any facts.
Nodes: the last write wins, the first place stays. Edges: the first write wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE = ["source_kind", "source_key", "relation", "target_kind", "target_key"]
NODE = ["kind", "key"]

#: Access tiers from open to closed.
TIERS = ["public", "legitimate-interest", "restricted-authority", "aggregator-licensed"]


def _rest(df: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in df.columns if c not in keys]


def upsert_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each (kind, key): the last properties, the first ``seq`` (GRF-01). One hash aggregate."""
    rest = [c for c in _rest(nodes, NODE) if c != "seq"]
    out = nodes.groupBy(*NODE).agg(F.min("seq").alias("seq"), F.max_by(F.struct(*rest), "seq").alias("r"))
    return out.select(*NODE, "seq", *(F.col(f"r.{c}").alias(c) for c in rest))


def upsert_edges(edges: DataFrame) -> DataFrame:
    """The first row of each edge identity (GRF-02). One hash aggregate, no sort."""
    rest = _rest(edges, EDGE)
    out = edges.groupBy(*EDGE).agg(F.min_by(F.struct(*rest), "seq").alias("r"))
    return out.select(*EDGE, *(F.col(f"r.{c}").alias(c) for c in rest))


def first_by(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row of each key that is smallest in ``order`` (must be unique in a key)."""
    rest = _rest(df, keys)
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def create_absent(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """``nodes`` and those of ``new`` that aren't there yet (GRF-03)."""
    return nodes.unionByName(new.join(nodes, NODE, "left_anti"), allowMissingColumns=True)


def merge_properties(nodes: DataFrame, updates: DataFrame) -> DataFrame:
    """Non-null columns of ``updates`` over those of ``nodes`` (GRF-04)."""
    cols = [c for c in updates.columns if c not in NODE]
    u = updates.select(*NODE, *(F.col(c).alias(f"_{c}") for c in cols))
    out = nodes.join(u, NODE, "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c)) if c in nodes.columns else F.col(f"_{c}"))
    return out.drop(*(f"_{c}" for c in cols))


def by_relation(edges: DataFrame, *relations: str) -> DataFrame:
    """Edges of some relations; prunes partitions of a table partitioned by relation (GRF-05)."""
    return edges.where(F.col("relation").isin(list(relations)))


def neighbours(edges: DataFrame, nodes: DataFrame, incoming: bool = False) -> DataFrame:
    """Every edge with its far node, which may be missing (GRF-06)."""
    side = "source" if incoming else "target"
    far = nodes.select(F.col("kind").alias(f"{side}_kind"), F.col("key").alias(f"{side}_key"), F.struct(*nodes.columns).alias("far"))
    return edges.join(far, [f"{side}_kind", f"{side}_key"], "left")


def replace_layer(edges: DataFrame, relations: list[str], new: DataFrame) -> DataFrame:
    """Edges without some relations, and a new layer (GRF-08)."""
    return edges.where(~F.col("relation").isin(relations)).unionByName(new, allowMissingColumns=True)


def tier_rank(tier: Column) -> Column:
    """0 for public or missing; an unknown label is as closed as the most closed (FLT-01)."""
    at = F.array_position(F.array(*map(F.lit, TIERS)), tier)
    return F.when(tier.isNull(), 0).when(at > 0, at - 1).otherwise(len(TIERS) - 1).cast("int")


def can_see(tier: Column, clearance: str) -> Column:
    return tier_rank(tier) <= tier_rank(F.lit(clearance))


def visible(edges: DataFrame, clearance: str = "public") -> DataFrame:
    """Edges that a clearance may see (FLT-02)."""
    return edges.where(can_see(F.col("access_tier"), clearance))


def valid_on(day: str | Column) -> Column:
    """Both ends count; a missing end is open (FLT-03)."""
    d = F.lit(day).cast("date") if isinstance(day, str) else day
    return F.coalesce(F.col("valid_from") <= d, F.lit(True)) & F.coalesce(F.col("valid_to") >= d, F.lit(True))


def as_of(edges: DataFrame, day: str | None) -> DataFrame:
    return edges if day is None else edges.where(valid_on(day))


def stamp(edges: DataFrame, source: str, tier: str = "public", observed: str | None = None, valid_from: Column | None = None, valid_to: Column | None = None) -> DataFrame:
    """Provenance, tier and times on every edge (PRJ-04)."""
    none = F.lit(None).cast("date")
    return edges.withColumns({"source": F.lit(source), "access_tier": F.lit(tier), "observed_at": F.lit(observed).cast("date"), "valid_from": none if valid_from is None else valid_from, "valid_to": none if valid_to is None else valid_to})


def named(df: DataFrame, nodes: DataFrame, kind: str | None, key: str, into: str) -> DataFrame:
    """A display name beside a key column; the key itself where there is none (PRJ-02, JON-01)."""
    n = nodes if kind is None else nodes.where(F.col("kind") == kind)
    n = n.select(F.col("key").alias(key), F.col("name").alias("_name"))
    return df.join(n, key, "left").withColumn(into, F.coalesce("_name", key)).drop("_name")


def detail(shares: Column, role: Column, jurisdiction: Column, sector: Column) -> Column:
    """A readable fact: shares with separators and role, else the first of role, jurisdiction, sector (PRJ-01)."""
    text = [F.nullif(F.trim(c), F.lit("")) for c in (role, jurisdiction, sector)]
    amount = F.concat(F.format_number(shares, 0), F.lit(" shares"))
    return F.when(shares.isNotNull(), F.concat_ws(" · ", amount, text[0])).otherwise(F.coalesce(*text))


def profile(edges: DataFrame, clearance: str = "public") -> DataFrame:
    """(kind, key, direction, relation, other_kind, other_key) of all entities, mentions left out (PRJ-03)."""
    seen = visible(edges, clearance).where("relation <> 'mentions'")
    out = seen.select(F.col("source_kind").alias("kind"), F.col("source_key").alias("key"), F.lit("out").alias("direction"), "relation", F.col("target_kind").alias("other_kind"), F.col("target_key").alias("other_key"))
    back = seen.select(F.col("target_kind").alias("kind"), F.col("target_key").alias("key"), F.lit("in").alias("direction"), "relation", F.col("source_kind").alias("other_kind"), F.col("source_key").alias("other_key"))
    return out.unionByName(back)


def mentioned_in(edges: DataFrame, clearance: str = "public") -> DataFrame:
    """(kind, key, documents): sorted distinct documents that mention an entity (PRJ-03)."""
    m = visible(by_relation(edges, "mentions"), clearance)
    return m.groupBy(F.col("target_kind").alias("kind"), F.col("target_key").alias("key")).agg(F.array_sort(F.collect_set("source_key")).alias("documents"))


def bridges(edges: DataFrame, tracked: DataFrame) -> DataFrame:
    """(key, n): untracked nodes beside two tracked companies or more (AGG-25)."""
    t = tracked.select("key").distinct()
    ends = edges.select(F.col("source_key").alias("a"), F.col("target_key").alias("b")).union(edges.select("target_key", "source_key"))
    near = ends.join(t.withColumnRenamed("key", "a"), "a", "left_semi").join(t.withColumnRenamed("key", "b"), "b", "left_anti")
    return near.groupBy(F.col("b").alias("key")).agg(F.countDistinct("a").alias("n")).where("n >= 2")


def project_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of (canonical_id, document_type, title, entities, sections) (GRF-09).

    The last company named in a document files it; sections hang below the document.
    """
    company = F.element_at(F.filter("entities", lambda e: e["kind"] == "Company"), -1)
    own = docs.withColumn("company", F.when(F.size(F.filter("entities", lambda e: e["kind"] == "Company")) > 0, company))
    doc_kind = F.when(F.col("document_type") == "filing", "Filing").otherwise("Document")
    parts = own.select("canonical_id", doc_kind.alias("doc_kind"), F.explode("sections").alias("s"))
    nodes = (
        own.select(doc_kind.alias("kind"), F.col("canonical_id").alias("key"), F.col("title").alias("name"))
        .unionByName(own.where("company is not null").select(F.lit("Company").alias("kind"), F.col("company.key").alias("key"), F.col("company.name").alias("name")))
        .unionByName(parts.select(F.lit("Section").alias("kind"), F.col("s.id").alias("key"), F.col("s.title").alias("name")))
    )
    filed = own.where("company is not null").select(
        F.lit("Company").alias("source_kind"), F.col("company.key").alias("source_key"),
        F.when(F.col("document_type") == "filing", "filed").otherwise("published").alias("relation"),
        doc_kind.alias("target_kind"), F.col("canonical_id").alias("target_key"),
    )
    below = parts.select(F.col("doc_kind").alias("source_kind"), F.col("canonical_id").alias("source_key"), F.lit("contains_section").alias("relation"), F.lit("Section").alias("target_kind"), F.col("s.id").alias("target_key"))
    return nodes, filed.unionByName(below)


#: List column, relation and target kind of curated entities.
FAN_OUT = [
    ("executives", "employs", "Person"), ("suppliers", "relies_on_supplier", "Company"), ("customers", "supplies_to", "Company"),
    ("competitors", "competes_with", "Company"), ("partners", "partners_with", "Company"), ("products", "produces", "Product"),
    ("countries", "operates_in", "Country"), ("regulators", "engaged_with", "Regulator"), ("technologies", "uses_technology", "Technology"),
]


def project_entities(companies: DataFrame) -> DataFrame:
    """Typed edges from list columns, and every product with every technology of its company (GRF-10)."""
    kinds = F.explode(F.array(*(F.struct(F.lit(r).alias("relation"), F.lit(k).alias("target_kind"), F.col(c).alias("names")) for c, r, k in FAN_OUT if c in companies.columns and c != "technologies")))
    own = companies.select("key", kinds.alias("f")).select(F.lit("Company").alias("source_kind"), F.col("key").alias("source_key"), "f.relation", "f.target_kind", F.explode("f.names").alias("target_key"))
    if "products" not in companies.columns or "technologies" not in companies.columns:
        return own
    tech = companies.select(F.explode("products").alias("source_key"), "technologies").select(F.lit("Product").alias("source_kind"), "source_key", F.lit("uses_technology").alias("relation"), F.lit("Technology").alias("target_kind"), F.explode("technologies").alias("target_key"))
    return own.unionByName(tech)


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nodes, edges): one row (GRF-07)."""
    both = nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(edges.select(F.lit(0).alias("n"), F.lit(1).alias("e")))
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.coalesce(F.sum("e"), F.lit(0)).alias("edges"))


def company_nodes(companies: DataFrame, taxonomy: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Companies with the classification that ``taxonomy`` has for their ``on``; unknown ones keep nulls (GRF-11)."""
    return companies.join(taxonomy, on, "left").select("key", "name", *columns)


def entities(kinds: dict[str, DataFrame]) -> DataFrame:
    """(kind, key, name) of all tables of (key, name), by kind, name and key (FLT-16)."""
    out = None
    for kind, table in kinds.items():
        rows = table.select(F.lit(kind).alias("kind"), F.col("key").cast("string").alias("key"), "name")
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy("kind", "name", "key")


def siblings(members: DataFrame) -> DataFrame:
    """(key, sibling) of (key, canonical): each pair of one canonical entity's members in both directions; the members of one entity bound the rows (TRV-06)."""
    m = members.distinct()
    return m.join(m.select(F.col("key").alias("sibling"), "canonical"), "canonical").where("key <> sibling").select("key", "sibling")
