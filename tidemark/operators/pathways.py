"""Exposure pathways over typed edges, for all terms at once or for one.

Inputs are edge tables of one relation each. Joins are equi-joins on keys; Spark chooses how,
so nothing here is broadcast by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .graph import as_of, can_see, first_by, visible

LEVELS = ["sector", "industry_group", "industry", "sub_industry", "code"]


def country_exposure(operates: DataFrame, relies: DataFrame) -> DataFrame:
    """(country, operator, company): companies that rely on an operator in a country, one row for each path (JON-02, JON-03)."""
    op = operates.select(F.col("target_key").alias("country"), F.col("source_key").alias("operator"))
    return op.join(relies.select(F.col("target_key").alias("operator"), F.col("source_key").alias("company")), "operator").select("country", "operator", "company")


def footprint(subsidiaries: DataFrame) -> DataFrame:
    """(jurisdiction, company, subsidiaries, source): names in order, evidence of the first edge (JON-04)."""
    return subsidiaries.groupBy("jurisdiction", F.col("source_key").alias("company")).agg(F.array_sort(F.collect_list("target_key")).alias("subsidiaries"), F.min_by("source", "seq").alias("source"))


def network_peers(exposed: DataFrame, references: DataFrame, term: str = "term") -> DataFrame:
    """(term, company, via): companies that mention an exposed one without being exposed; the first evidence of each pair (JON-04, JON-05).

    The first evidence of a pair is the same for all terms, so pairs are made one first and meet each company's list of terms; rows by term are made last and not moved.
    """
    terms = exposed.groupBy("company").agg(F.collect_set(term).alias("own"), F.max(F.col(term).isNull()).alias("none"))
    terms = stored(terms.select("company", F.when(F.col("none"), F.concat("own", F.array(F.lit(None)))).otherwise(F.col("own")).alias("own")), "company-terms")
    pairs = references.groupBy(F.col("source_key").alias("company"), F.col("target_key").alias("via")).agg(F.min_by("source", "seq").alias("source"))
    met = pairs.join(terms.select(F.col("company").alias("via"), F.col("own").alias("theirs")), "via").join(terms, "company", "left")
    # a term that is null equals none
    fresh = F.when(F.col("own").isNull(), F.col("theirs")).otherwise(F.array_except("theirs", F.array_compact("own")))
    return met.select(F.explode(fresh).alias(term), "company", "via", "source")


def sector_matches(in_sector: DataFrame, term: Column) -> DataFrame:
    """(company, level): edges where any level, the code or the key equals the term; the level of the first such edge (JON-05)."""
    t = F.lower(F.trim(term))
    levels = [c for c in LEVELS if c in in_sector.columns]
    fits = F.array_compact(F.array(*(F.when(F.lower(F.trim(F.col(c))) == t, c) for c in levels), F.when(F.lower(F.trim("target_key")) == t, "name")))
    hit = in_sector.withColumn("level", F.get(fits, F.lit(0))).where("level is not null")
    return hit.groupBy(F.col("source_key").alias("company")).agg(F.min_by("level", "seq").alias("level"))


def sector_terms(in_sector: DataFrame) -> DataFrame:
    """(term, company): every level of every edge as a term, so that all terms are answered in one pass."""
    levels = [c for c in LEVELS if c in in_sector.columns]
    return in_sector.select(F.explode(F.array_compact(F.array(*(F.lower(F.trim(F.col(c))) for c in levels)))).alias("term"), F.col("source_key").alias("company")).distinct()


def tier_exposure(in_tier: DataFrame) -> DataFrame:
    """(tier, company), distinct (JON-06)."""
    return in_tier.select(F.col("target_key").alias("tier"), F.col("source_key").alias("company")).distinct()


def commodity_exposure(affects: DataFrame, in_sector: DataFrame) -> DataFrame:
    """(commodity, company) through the top sector only, distinct (JON-07, SET-03)."""
    a = affects.select(F.col("source_key").alias("commodity"), F.lower("target_key").alias("s")).distinct()
    return a.join(in_sector.select(F.lower("sector").alias("s"), F.col("source_key").alias("company")).distinct(), "s").select("commodity", "company").distinct()


def debt_by_country(issued: DataFrame, debt: DataFrame) -> DataFrame:
    """(country, key, name) of debt instruments (JON-08)."""
    return issued.select(F.col("target_key").alias("country"), F.col("source_key").alias("key")).join(debt.select("key", "name"), "key").select("country", "key", "name")


def holdings(holds: DataFrame, clearance: str = "public", day: str | None = None) -> DataFrame:
    """(fund, company, value, shares) as of a day at a clearance (AGG-07)."""
    return visible(as_of(holds, day), clearance).select(F.col("source_key").alias("fund"), F.col("target_key").alias("company"), "value", "shares")


def company_classes(links: DataFrame) -> DataFrame:
    """(company, class): companies with equal sets of terms, by distinct (term, company); the class is the smallest of them.

    Sets are compared by their size and two 64-bit hashes, each the exclusive or over its terms, so no set is ever gathered in one place.
    """
    size = links.groupBy("company").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("term")).alias("h1"), F.bit_xor(F.xxhash64("term", F.lit(1))).alias("h2"))
    least = size.groupBy("size", "h1", "h2").agg(F.min("company").alias("class"))
    return size.join(least, ["size", "h1", "h2"]).select("company", "class")


#: Terms numbered by one task, holdings whose exposure one task adds up, terms that are sent to all tasks at most.
NUMBERED, ADDED, SENT = 4096, 20_000, 100_000


def numbered_terms(links: DataFrame) -> DataFrame:
    """(term, word, bit): each distinct term as a bit of a 64-bit word; terms are dealt by hash and numbered within their part, so words are full."""
    terms = stored(links.select("term").distinct(), "exposed-terms")
    part = F.pmod(F.xxhash64("term"), F.lit(terms.count() // NUMBERED + 1))
    n = F.row_number().over(Window.partitionBy("part").orderBy("term")) - 1
    return stored(terms.withColumn("part", part).select("term", (F.shiftleft("part", 32) + F.floor(n / 64)).alias("word"), (n % 64).cast("int").alias("bit")), "exposed-bits")


def portfolio_exposure(held: DataFrame, exposed: DataFrame) -> DataFrame:
    """(fund, term, n_exposed, exposed_value, n_holdings, total_value) for all funds and terms (JON-09, SET-04).

    Holdings are summed by fund and class of companies first (``company_classes``). Each class has its terms as words of bits (``numbered_terms``), which meet
    these sums before they are dealt by fund; rows by fund and term are made after that and added up where they are, so what moves grows with holdings, not with holdings times terms.
    """
    links = stored(exposed.select("term", "company").distinct(), "exposed-links")
    classes = stored(company_classes(links), "exposed-classes")
    # a company without terms has no class, and counts in the totals only
    sums = stored(held.join(classes, "company", "left").groupBy("fund", "class").agg(F.count("*").alias("n"), F.sum("value").alias("v")), "exposed-sums")
    total = sums.groupBy("fund").agg(F.sum("n").alias("n_holdings"), F.sum("v").alias("total_value"))
    bits = numbered_terms(links)
    small = F.broadcast(bits) if bits.count() <= SENT else bits
    of_class = links.join(classes.select(F.col("class").alias("company")).distinct(), "company").join(small.withColumnRenamed("term", "t"), F.col("term").eqNullSafe(F.col("t")))
    words = of_class.groupBy(F.col("company").alias("class"), "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    words = stored(words.groupBy("class").agg(F.collect_list(F.struct("word", "bits")).alias("words")), "exposed-words")
    parts = max(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), sums.count() // ADDED)
    dealt = sums.join(words, "class").select("fund", "n", "v", "words").repartition(parts, "fund").join(total, "fund")
    each = dealt.select("fund", "n_holdings", "total_value", "n", "v", F.explode("words").alias("w")).select("*", F.explode(F.array(*map(F.lit, range(64)))).alias("bit"))
    part = each.where("shiftright(w.bits, bit) & 1 = 1").groupBy("fund", "n_holdings", "total_value", F.col("w.word").alias("word"), "bit").agg(F.sum("n").alias("n_exposed"), F.sum("v").alias("exposed_value"))
    return part.join(small, ["word", "bit"]).select("fund", "term", "n_exposed", "exposed_value", "n_holdings", "total_value")


def exposed_holdings(held: DataFrame, exposed: DataFrame) -> DataFrame:
    """The holdings of all funds that one set of companies touches (SET-04)."""
    return held.join(exposed.select("company"), "company", "left_semi")


def menu(edges: DataFrame, value: Column, company: str = "source_key") -> DataFrame:
    """(value, companies): distinct companies for each value, most first (AGG-01, AGG-02). Sorted by count, then name."""
    out = edges.select(value.alias("value"), F.col(company).alias("c")).where("value is not null and value <> ''")
    return out.groupBy("value").agg(F.countDistinct("c").alias("companies")).orderBy(F.desc("companies"), "value")


def classification_tree(in_sector: DataFrame) -> DataFrame:
    """(sector, sub_industry, industry, code, companies, n, sector_total): totals of a sector are distinct over its parts (AGG-03)."""
    e = in_sector.select("sector", "sub_industry", "industry", "code", F.col("source_key").alias("company"), "seq")
    sub = e.groupBy("sector", "sub_industry").agg(F.min_by(F.struct("industry", "code"), "seq").alias("f"), F.array_sort(F.collect_set("company")).alias("companies"))
    top = e.groupBy("sector").agg(F.countDistinct("company").alias("sector_total"))
    return sub.join(top, "sector").select("sector", "sub_industry", "f.industry", "f.code", "companies", F.size("companies").alias("n"), "sector_total")


def tier_menu(in_tier: DataFrame, order: list[str]) -> DataFrame:
    """(tier, companies, place): composition in a fixed order, other tiers after it (AGG-04)."""
    n = in_tier.groupBy(F.col("target_key").alias("tier")).agg(F.countDistinct("source_key").alias("companies"))
    at = F.array_position(F.array(*map(F.lit, order)), F.col("tier"))
    return n.withColumn("place", F.when(at > 0, at).otherwise(len(order) + 1).cast("int"))


def shared_people(employs: DataFrame, previously: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(company, people) with two people or more, and (person, companies) with two companies or more (AGG-05)."""
    pairs = employs.select(F.col("source_key").alias("company"), F.col("target_key").alias("person")).union(previously.select("target_key", "source_key")).distinct()
    by_company = pairs.groupBy("company").agg(F.array_sort(F.collect_set("person")).alias("people")).where(F.size("people") >= 2)
    by_person = pairs.groupBy("person").agg(F.array_sort(F.collect_set("company")).alias("companies")).where(F.size("companies") >= 2)
    return by_company, by_person


def portfolio_profile(held: DataFrame, in_sector: DataFrame, in_tier: DataFrame) -> DataFrame:
    """(fund, dimension, bucket, companies, value): value by sector and by tier; the first edge of a company counts (AGG-08)."""
    s = first_by(in_sector.select(F.col("source_key").alias("company"), "seq", F.col("sector").alias("bucket")), ["company"], F.col("seq")).select("company", F.col("bucket").alias("sector"))
    t = first_by(in_tier.select(F.col("source_key").alias("company"), "seq", F.col("target_key").alias("bucket")), ["company"], F.col("seq")).select("company", F.col("bucket").alias("tier"))
    wide = held.join(s, "company", "left").join(t, "company", "left")
    long = wide.select("fund", "company", "value", F.explode(F.array(F.struct(F.lit("sector").alias("d"), F.coalesce("sector", F.lit("unclassified")).alias("b")), F.struct(F.lit("tier").alias("d"), F.coalesce("tier", F.lit("unclassified")).alias("b")))).alias("x"))
    return long.groupBy("fund", F.col("x.d").alias("dimension"), F.col("x.b").alias("bucket")).agg(F.count("*").alias("companies"), F.sum("value").alias("value"))


def fold_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Line items to one row: sums of value and shares (0 is null), the first of the rest (AGG-09)."""
    return lines.groupBy(*keys).agg(F.sum("value").alias("value"), F.nullif(F.sum("shares"), F.lit(0)).alias("shares"), F.min_by("cusip", "pos").alias("cusip"), F.min_by("issuer", "pos").alias("issuer"))


def withheld(edges: DataFrame, keys: list[Column], clearance: str) -> DataFrame:
    """Visible and withheld edges by key, in one aggregate (FLT-04, AGG-11)."""
    see = can_see(F.col("access_tier"), clearance)
    return edges.groupBy(*keys).agg(F.count_if(see).alias("visible"), F.count_if(~see).alias("withheld"))


def owners(edges: DataFrame, clearance: str, day: str | None = None) -> DataFrame:
    """(company, owners, withheld): visible owners in order, and how many are withheld (AGG-12)."""
    see = can_see(F.col("access_tier"), clearance)
    own = as_of(edges, day).groupBy(F.col("target_key").alias("company"))
    return own.agg(F.array_sort(F.collect_set(F.when(see, F.col("source_key")))).alias("owners"), F.count_if(~see).alias("withheld"))


#: Companies of a hub that meet all others in one place; pairs in a task.
DEALT, PAIRS = 1000, 1 << 24


def proxy_links(edges: DataFrame) -> DataFrame:
    """(company, other, via): companies that share a leader or supplier (JON-29). Pairs of distinct companies, each once in both directions; their number is the square of a hub's companies, which ``proxy_groups`` avoids.

    A hub's companies are dealt into lists of about ``DEALT``, and each list meets all others as a key of its own, so that a hub is the work of many tasks. Their number follows the pairs, as few
    bytes make many rows here and Spark counts bytes.
    """
    e = stored(edges.select(F.col("source_key").alias("company"), F.col("target_key").alias("via")).distinct(), "proxy-edges")
    n = e.groupBy("via").agg(F.count("*").alias("n"))
    pairs = n.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0
    tasks = max(int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(10_000, int(pairs // PAIRS) + 1))
    sized = e.join(n.select("via", F.ceil(F.col("n") / DEALT).cast("int").alias("parts")), "via")
    own = sized.select("via", F.pmod(F.xxhash64("company"), "parts").cast("int").alias("part"), "company").repartition(tasks, "via", "part").groupBy("via", "part").agg(F.collect_list("company").alias("companies"))
    all_ = sized.select("via", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("company").alias("other")).repartition(tasks, "via", "part")
    return own.hint("shuffle_hash").join(all_, ["via", "part"]).select("via", F.explode("companies").alias("company"), "other").where("company <> other")


def proxy_groups(edges: DataFrame) -> DataFrame:
    """(via, company, companies): every leader or supplier of two companies or more with its companies and their number (JON-29).

    Two companies are linked if and only if they are rows of one ``via``, so this says all that ``proxy_links`` says with a row for each edge, however many companies
    a hub has. The counts are summed before their shuffle, and the join is one that Spark can split.
    """
    e = edges.select(F.col("target_key").alias("via"), F.col("source_key").alias("company")).distinct()
    return e.join(e.groupBy("via").agg(F.count("*").alias("companies")).where("companies > 1"), "via").select("via", "company", "companies")


def concentration(foot: DataFrame, regions: DataFrame, sectors: DataFrame) -> DataFrame:
    """(sector, region, companies) of (company, country) rows (JON-30)."""
    return foot.join(regions, "country").join(sectors, "company").groupBy("sector", "region").agg(F.countDistinct("company").alias("companies"))


def densest(cells: DataFrame) -> DataFrame:
    """The fullest cell; ties by name (JON-30)."""
    return cells.orderBy(F.desc("companies"), "sector", "region").limit(1)


def funds(holds: DataFrame) -> DataFrame:
    """(fund, n, value): holdings of each fund and their value, the largest number first (AGG-06)."""
    return holds.groupBy(F.col("source_key").alias("fund")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value")).orderBy(F.desc("n"), "fund")


def coverage(companies: DataFrame, inside: Column, parts: dict[str, Column]) -> DataFrame:
    """(market, total, in_universe, one count for each of ``parts``): how many companies of each market count, and by part (AGG-10)."""
    each = [F.count_if(inside & c).alias(name) for name, c in parts.items()]
    return companies.groupBy("market").agg(F.count("*").alias("total"), F.count_if(inside).alias("in_universe"), *each)


def ranked_cells(cells: DataFrame, k: int = 6) -> DataFrame:
    """The ``k`` cells (sector, region, companies) with the most companies (WIN-08)."""
    return cells.orderBy(F.desc("companies"), "sector", "region").limit(k)


def top_sectors(cells: DataFrame, k: int = 5) -> DataFrame:
    """(sector, total): the ``k`` sectors with the most companies over all regions (TOP-12)."""
    return cells.groupBy("sector").agg(F.sum("companies").alias("total")).orderBy(F.desc("total"), "sector").limit(k)


def commodities(links: DataFrame) -> DataFrame:
    """(commodity, sectors): each commodity with the sorted list of the sectors that it touches, from (commodity, sector) (FLT-17)."""
    return links.groupBy("commodity").agg(F.array_join(F.array_sort(F.collect_set("sector")), ",").alias("sectors")).orderBy("commodity")


def constituents(held: DataFrame, members: DataFrame) -> DataFrame:
    """(company, idx): the indices that held companies belong to, from (company) and (company, idx) (TRV-05)."""
    return held.select("company").distinct().join(members.select("company", "idx").distinct(), "company")
