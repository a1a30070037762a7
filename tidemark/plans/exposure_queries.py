"""Queries of graph upkeep, filters, pathways and panels, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import graph as G
from ..operators import pathways as P
from . import domain as D
from .domain import HOLDS, IN_SECTOR, IN_TIER, OWN, RANK, REFS, RELIES, SUBS

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

DAY, CLEARANCE = "1996-06-30", "legitimate-interest"
_SEEN = f"(select * from {HOLDS} where {RANK.format('access_tier')} <= 1 and (valid_from is null or valid_from <= date '{DAY}') and (valid_to is null or valid_to >= date '{DAY}'))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _held(spark: SparkSession, sf: str) -> DataFrame:
    return P.holdings(D.holds(spark, sf), CLEARANCE, DAY)


@query(f"""with t as (select distinct company, unnest([lower(sector), lower(industry), lower(sub_industry), lower(code)]) as term from {IN_SECTOR}),
h as {_SEEN}, x as (select h.fund, t.term, count(*) as n_exposed, sum(value) as v from h join (select distinct * from t) t using (company) group by 1, 2)
select x.fund, term, n_exposed, round(v, 2) as exposed_value, n as n_holdings, round(tv, 2) as total_value from x join (select fund, count(*) as n, sum(value) as tv from h group by 1) using (fund)""")
def jon09_portfolio_exposure(spark, sf):
    out = P.portfolio_exposure(_held(spark, sf), P.sector_terms(D.in_sector(spark, sf)))
    return out.select("fund", "term", "n_exposed", F.round("exposed_value", 2).alias("exposed_value"), "n_holdings", F.round("total_value", 2).alias("total_value"))


@query("""select 'Company' as kind, s_suppkey::varchar as key, min(s) as seq, max_by(nm, s) as name from
(select s_suppkey, s_suppkey as s, s_name as nm from supplier union all select s_suppkey, s_suppkey + 1000000, upper(s_name) from supplier where s_suppkey % 2 = 0) group by s_suppkey""")
def grf01_node_upsert(spark, sf):
    c = D.companies(spark, sf).drop("s_nationkey")
    later = c.where("seq % 2 = 0").select("kind", "key", (F.col("seq") + 1000000).alias("seq"), F.upper("name").alias("name"))
    return G.upsert_nodes(c.unionByName(later)).select("kind", "key", "seq", "name")


@query(f"select 'Company' as source_kind, a as source_key, 'references' as relation, 'Company' as target_kind, b as target_key, min(seq) as seq, min_by(source, seq) as source from {REFS} group by a, b")
def grf02_edge_upsert(spark, sf):
    return G.upsert_edges(D.references(spark, sf)).select(*G.EDGE, "seq", "source")


@query("select s_suppkey::varchar as key, case when s_suppkey % 3 = 0 then s_name else 'new' end as name from supplier")
def grf03_create_absent(spark, sf):
    c = D.companies(spark, sf).select("kind", "key", "name", "seq")
    have = c.where("seq % 3 = 0").drop("seq")
    return G.create_absent(have, c.select("kind", "key", F.lit("new").alias("name"))).select("key", "name")


@query("select s_suppkey::varchar as key, case when s_suppkey % 4 = 1 then 'renamed ' || s_suppkey else s_name end as name from supplier")
def grf04_merge_properties(spark, sf):
    c = D.companies(spark, sf).select("kind", "key", "name", "seq")
    upd = c.select("kind", "key", F.when(F.col("seq") % 4 == 1, F.concat(F.lit("renamed "), "key")).alias("name"))
    return G.merge_properties(c, upd).select("key", "name")


@query(f"select relation, count(*) as n from (select 'in_market_tier' as relation from {IN_TIER} union all select 'references' from {REFS}) group by 1")
def grf05_edges_by_relation(spark, sf):
    cols = [*G.EDGE, "seq"]
    e = D.in_tier(spark, sf).select(*cols).unionByName(D.references(spark, sf).select(*cols)).unionByName(D.operates_in(spark, sf).select(*cols))
    return G.by_relation(e, "in_market_tier", "references").groupBy("relation").agg(F.count("*").alias("n"))


@query(f"select a as source_key, b as target_key, seq, case when b::bigint % 2 = 0 then s_name end as name from {REFS} left join supplier on b = s_suppkey::varchar")
def grf06_neighbours(spark, sf):
    nodes = D.companies(spark, sf).where("seq % 2 = 0").select("kind", "key", "name")
    return G.neighbours(D.references(spark, sf), nodes).select("source_key", "target_key", "seq", F.col("far.name").alias("name"))


@query(f"select (select count(*) from supplier) as nodes, (select count(*) from {REFS}) as edges")
def grf07_counts(spark, sf):
    return G.counts(D.companies(spark, sf), D.references(spark, sf))


@query(f"select 'in_market_tier' as relation, company as source_key, lower(tier) as target_key from {IN_TIER} union all select 'operates_in', s_suppkey::varchar, n_name from supplier join nation on s_nationkey = n_nationkey")
def grf08_replace_layer(spark, sf):
    cols = [*G.EDGE, "seq"]
    tier = D.in_tier(spark, sf).select(*cols)
    e = tier.unionByName(D.operates_in(spark, sf).select(*cols))
    return G.replace_layer(e, ["in_market_tier"], tier.withColumn("target_key", F.lower("target_key"))).select("relation", "source_key", "target_key")


@query("""with d as (select doc_id::varchar as id, source, lang, doc_id % 2 = 0 as filing, len(string_split(text, chr(10))) as k from documents where text is not null)
select relation, count(*) as n, count(distinct source_key) as sources from (
 select case when filing then 'filed' else 'published' end as relation, source as source_key, id as target_key from d
 union all select 'contains_section', id, id || ':' || i from (select id, unnest(range(0, k)) as i from d)) group by 1""")
def grf09_project_documents(spark, sf):
    d = D.table(spark, sf, "documents").where("text is not null")
    lines = F.split("text", "\n", -1)
    docs = d.select(
        D.text("doc_id").alias("canonical_id"), F.when(F.col("doc_id") % 2 == 0, "filing").otherwise("news").alias("document_type"), F.substring("text", 1, 20).alias("title"),
        F.array(F.struct(F.lit("Country").alias("kind"), F.col("lang").alias("key"), F.col("lang").alias("name")), F.struct(F.lit("Company").alias("kind"), F.col("source").alias("key"), F.col("source").alias("name"))).alias("entities"),
        F.transform(lines, lambda x, i: F.struct(F.concat_ws(":", D.text("doc_id"), i.cast("string")).alias("id"), F.substring(x, 1, 20).alias("title"))).alias("sections"),
    )
    _, edges = G.project_documents(docs)
    return edges.groupBy("relation").agg(F.count("*").alias("n"), F.countDistinct("source_key").alias("sources"))


@query("""with c as (select s_suppkey::varchar as key, 'p' || (s_suppkey % 7) as pr, 'q' || (s_suppkey % 5) as pr2, 't' || (s_suppkey % 3) as te, n_name from supplier join nation on s_nationkey = n_nationkey)
select source_kind, relation, target_kind, count(*) as n from (
 select 'Company' as source_kind, 'produces' as relation, 'Product' as target_kind from c union all select 'Company', 'produces', 'Product' from c
 union all select 'Company', 'operates_in', 'Country' from c union all select 'Product', 'uses_technology', 'Technology' from c union all select 'Product', 'uses_technology', 'Technology' from c) group by 1, 2, 3""")
def grf10_project_entities(spark, sf):
    s = D.table(spark, sf, "supplier").join(D.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    c = s.select(D.text("s_suppkey").alias("key"), F.array(F.concat(F.lit("p"), D.text(k % 7)), F.concat(F.lit("q"), D.text(k % 5))).alias("products"), F.array(F.concat(F.lit("t"), D.text(k % 3))).alias("technologies"), F.array("n_name").alias("countries"))
    return G.project_entities(c).groupBy("source_kind", "relation", "target_kind").agg(F.count("*").alias("n"))


@query("select s_suppkey::varchar as key, s_name as name, n_name as country, r_name as tier, substr(s_name, 1, 3) as industry from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def grf11_company_nodes(spark, sf):
    n = D.table(spark, sf, "nation").join(D.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("country"), F.col("r_name").alias("tier"))
    named = G.company_nodes(D.companies(spark, sf), n, "s_nationkey", ["country", "tier"])
    return named.withColumn("industry", F.substring("name", 1, 3))


@query(f"select fund, company, {RANK.format('access_tier')}::int as rank, access_tier from {HOLDS} where {RANK.format('access_tier')} <= 1")
def flt02_visible(spark, sf):
    return G.visible(D.holds(spark, sf), CLEARANCE).select(F.col("source_key").alias("fund"), F.col("target_key").alias("company"), G.tier_rank(F.col("access_tier")).alias("rank"), "access_tier")


@query(f"select fund, company from {HOLDS} where valid_from <= date '{DAY}' and (valid_to is null or valid_to >= date '{DAY}')")
def flt03_as_of(spark, sf):
    return G.as_of(D.holds(spark, sf), DAY).select(F.col("source_key").alias("fund"), F.col("target_key").alias("company"))


@query(f"select fund, count_if({RANK.format('access_tier')} <= 1)::bigint as visible, count_if({RANK.format('access_tier')} > 1)::bigint as withheld from {HOLDS} group by 1")
def flt04_withheld(spark, sf):
    return P.withheld(D.holds(spark, sf), [F.col("source_key").alias("fund")], CLEARANCE)


@query("select o_orderpriority as exchange, count(*) as n from orders where trim(o_orderpriority) <> '' and not contains(lower(o_orderpriority), 'urg') group by 1")
def flt06_real_exchange(spark, sf):
    o = D.table(spark, sf, "orders")
    return o.where(N.real_exchange(F.regexp_replace("o_orderpriority", "(?i)urg", "OTC"))).groupBy(F.col("o_orderpriority").alias("exchange")).agg(F.count("*").alias("n"))


@query("select doc_id, source, lang from documents where source in ('src1', 'src2')")
def flt15_list_documents(spark, sf):
    return D.table(spark, sf, "documents").where(F.col("source").isin("src1", "src2")).select("doc_id", "source", "lang")


@query("select kind, key, name from (select 'Company' as kind, s_suppkey::varchar as key, s_name as name from supplier union all select 'Country', n_nationkey::varchar, n_name from nation)")
def flt16_list_entities(spark, sf):
    n = D.table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return G.entities({"Company": D.companies(spark, sf), "Country": n})


@query("select p_brand as commodity, array_to_string(list_sort(list(distinct p_type)), ',') as sectors from part group by 1")
def flt17_commodities(spark, sf):
    return P.commodities(D.table(spark, sf, "part").select(F.col("p_brand").alias("commodity"), F.col("p_type").alias("sector")))


@query(f"""select fund, company, case when shares is not null then concat_ws(' · ', format('{{:,}}', shares) || ' shares', case when company::bigint % 2 = 0 then 'Insider' end) end as detail from {HOLDS}""")
def prj01_detail(spark, sf):
    h = D.holds(spark, sf)
    role = F.when(F.col("target_key").cast("long") % 2 == 0, "Insider")
    none = F.lit(None).cast("string")
    return h.select(F.col("source_key").alias("fund"), F.col("target_key").alias("company"), G.detail(F.col("shares"), role, none, none).alias("detail"))


@query(f"select a as source_key, b as target_key, seq, case when b::bigint % 2 = 0 then s_name else b end as name from {REFS} left join supplier on b = s_suppkey::varchar")
def prj02_names(spark, sf):
    nodes = D.companies(spark, sf).where("seq % 2 = 0")
    return G.named(D.references(spark, sf), nodes, "Company", "target_key", "name").select("source_key", "target_key", "seq", "name")


@query(f"""with e as (select 'holds' as relation, 'Fund' as sk, fund as a, 'Company' as tk, company as b from {HOLDS} where {RANK.format('access_tier')} <= 0)
select kind, key, direction, count(*) as n from (select sk as kind, a as key, 'out' as direction from e union all select tk, b, 'in' from e) group by 1, 2, 3""")
def prj03_profile(spark, sf):
    return G.profile(D.holds(spark, sf)).groupBy("kind", "key", "direction").agg(F.count("*").alias("n"))


@query(f"select a as source_key, b as target_key, seq, 'stamped' as source, 'public' as access_tier, '2024-01-01' as observed_at, '1995-01-01' as valid_from from {REFS}")
def prj04_stamp(spark, sf):
    e = G.stamp(D.references(spark, sf), "stamped", observed="2024-01-01", valid_from=F.lit("1995-01-01").cast("date"))
    return e.select("source_key", "target_key", "seq", "source", "access_tier", D.text("observed_at").alias("observed_at"), D.text("valid_from").alias("valid_from"))


@query(f"select n_name as country, s_suppkey::varchar as operator, company from supplier join nation on s_nationkey = n_nationkey join {RELIES} on operator = s_suppkey::varchar")
def jon02_country_exposure(spark, sf):
    return P.country_exposure(D.operates_in(spark, sf), D.relies_on(spark, sf))


@query(f"select company, n_name as country, count(*) as suppliers from {RELIES} join supplier on operator = s_suppkey::varchar join nation on s_nationkey = n_nationkey group by 1, 2")
def jon03_company_countries(spark, sf):
    return P.country_exposure(D.operates_in(spark, sf), D.relies_on(spark, sf)).groupBy("company", "country").agg(F.count("*").alias("suppliers"))


@query(f"select jurisdiction, company, array_to_string(list_sort(list(sub)), ',') as subsidiaries, min_by(source, seq) as source from {SUBS} group by 1, 2")
def jon04_footprint(spark, sf):
    return P.footprint(D.subsidiaries(spark, sf)).withColumn("subsidiaries", F.array_join("subsidiaries", ","))


@query(f"""with f as (select distinct jurisdiction as term, company from {SUBS})
select f.term, r.a as company, r.b as via, min_by(r.source, r.seq) as source from {REFS} r join f on f.company = r.b
where not exists (select 1 from f g where g.term = f.term and g.company = r.a) group by 1, 2, 3""")
def jon04_network_peers(spark, sf):
    f = D.subsidiaries(spark, sf).select(F.col("jurisdiction").alias("term"), F.col("source_key").alias("company"))
    return P.network_peers(f, D.references(spark, sf))


@query(f"""select company, min_by(level, seq) as level from (select company, seq, case when lower(sector) = 'economy' then 'sector' when lower(industry) = 'economy' then 'industry' when lower(sub_industry) = 'economy' then 'sub_industry' when lower(code) = 'economy' then 'code' end as level from {IN_SECTOR}) where level is not null group by 1""")
def jon05_sector_exposure(spark, sf):
    return P.sector_matches(D.in_sector(spark, sf), F.lit(" Economy "))


@query(f"select distinct tier, company from {IN_TIER}")
def jon06_tier_exposure(spark, sf):
    return P.tier_exposure(D.in_tier(spark, sf))


@query(f"select distinct p_brand as commodity, company from (select distinct p_brand, lower(p_type) as s from part where p_partkey % 3 = 0) join (select distinct lower(sector) as s, company from {IN_SECTOR}) using (s)")
def jon07_commodity_exposure(spark, sf):
    a = D.table(spark, sf, "part").where("p_partkey % 3 = 0").select(F.col("p_brand").alias("source_key"), F.col("p_type").alias("target_key"))
    return P.commodity_exposure(a, D.in_sector(spark, sf))


@query("select n_name as country, 'debt-' || p_partkey as key, p_name as name from part join nation on p_partkey % 25 = n_nationkey where p_size > 25")
def jon08_debt(spark, sf):
    p = D.table(spark, sf, "part").where("p_size > 25")
    n = D.table(spark, sf, "nation")
    key = F.concat(F.lit("debt-"), D.text("p_partkey"))
    issued = p.join(n, (F.col("p_partkey") % 25) == F.col("n_nationkey")).select(key.alias("source_key"), F.col("n_name").alias("target_key"))
    return P.debt_by_country(issued, p.select(key.alias("key"), F.col("p_name").alias("name")))


@query(f"select fund, company, value from {_SEEN} where company in (select company from {IN_TIER} where tier = 'ASIA')")
def set04_exposed_holdings(spark, sf):
    asia = P.tier_exposure(D.in_tier(spark, sf)).where("tier = 'ASIA'")
    return P.exposed_holdings(_held(spark, sf), asia).select("fund", "company", "value")


@query(f"select jurisdiction as value, count(distinct company) as companies from {SUBS} group by 1")
def agg01_jurisdiction_menu(spark, sf):
    return P.menu(D.subsidiaries(spark, sf), N.normal_jurisdiction(F.col("jurisdiction")))


@query(f"select sector as value, count(distinct company) as companies from {IN_SECTOR} group by 1")
def agg02_sector_menu(spark, sf):
    return P.menu(D.in_sector(spark, sf), F.col("sector"))


@query(f"""with s as {IN_SECTOR} select a.sector, sub_industry, industry, code, companies, n, sector_total from
(select sector, sub_industry, min_by(industry, seq) as industry, min_by(code, seq) as code, array_to_string(list_sort(list(distinct company)), ',') as companies, count(distinct company)::int as n from s group by 1, 2) a
join (select sector, count(distinct company) as sector_total from s group by 1) b on a.sector = b.sector""")
def agg03_classification_tree(spark, sf):
    return P.classification_tree(D.in_sector(spark, sf)).withColumn("companies", F.array_join("companies", ","))


@query(f"select tier, count(distinct company) as companies, (case tier when 'AMERICA' then 1 when 'EUROPE' then 2 when 'ASIA' then 3 else 4 end)::int as place from {IN_TIER} group by 1")
def agg04_tier_menu(spark, sf):
    return P.tier_menu(D.in_tier(spark, sf), ["AMERICA", "EUROPE", "ASIA"])


_PEOPLE = "(select distinct s_suppkey::varchar as company, 'p' || (s_suppkey % 17) as person from supplier union select s_suppkey::varchar, 'p' || (s_suppkey % 13) from supplier)"


def _people(spark, sf):
    s = D.table(spark, sf, "supplier")
    now = s.select(D.text("s_suppkey").alias("source_key"), F.concat(F.lit("p"), D.text(F.col("s_suppkey") % 17)).alias("target_key"))
    then = s.select(F.concat(F.lit("p"), D.text(F.col("s_suppkey") % 13)).alias("source_key"), D.text("s_suppkey").alias("target_key"))
    return now, then


@query(f"select company, array_to_string(list_sort(list(person)), ',') as people from {_PEOPLE} group by 1 having count(*) >= 2")
def agg05_shared_people(spark, sf):
    return P.shared_people(*_people(spark, sf))[0].withColumn("people", F.array_join("people", ","))


@query(f"select person, array_to_string(list_sort(list(company)), ',') as companies from {_PEOPLE} group by 1 having count(*) >= 2")
def agg05_bridge_people(spark, sf):
    return P.shared_people(*_people(spark, sf))[1].withColumn("companies", F.array_join("companies", ","))


@query(f"select fund, count(*) as n, round(sum(value), 2) as value from {HOLDS} group by 1")
def agg06_funds(spark, sf):
    return P.funds(D.holds(spark, sf))


@query(f"select fund, company, value, shares from {_SEEN}")
def agg07_holdings(spark, sf):
    return _held(spark, sf).orderBy(F.desc("value"), "fund", "company")


@query(f"""with h as (select h.fund, value, s.sector, t.tier from {_SEEN} h left join (select company, min_by(sector, seq) as sector from {IN_SECTOR} group by 1) s using (company) left join {IN_TIER} t using (company))
select fund, 'sector' as dimension, coalesce(sector, 'unclassified') as bucket, count(*) as companies, round(sum(value), 2) as value from h group by 1, 2, 3
union all select fund, 'tier', coalesce(tier, 'unclassified'), count(*), round(sum(value), 2) from h group by 1, 2, 3""")
def agg08_portfolio_profile(spark, sf):
    out = P.portfolio_profile(_held(spark, sf), D.in_sector(spark, sf), D.in_tier(spark, sf))
    return out.withColumn("value", F.round("value", 2))


@query("""select o_custkey as fund, l_suppkey as company, round(sum(l_extendedprice), 2) as value, coalesce(nullif(sum(case when l_quantity > 25 then l_quantity::bigint else 0 end), 0), -1)::bigint as shares,
min_by('C' || l_partkey, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) as cusip, min_by('I' || l_linenumber, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) as issuer from lineitem join orders on l_orderkey = o_orderkey group by 1, 2""")
def agg09_fold_lines(spark, sf):
    li = D.lines(spark, sf).select(
        F.col("o_custkey").alias("fund"), F.col("l_suppkey").alias("company"), F.col("l_extendedprice").alias("value"), F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("long")).otherwise(0).alias("shares"),
        F.concat(F.lit("C"), D.text("l_partkey")).alias("cusip"), F.concat(F.lit("I"), D.text("l_linenumber")).alias("issuer"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("pos"),
    )
    return P.fold_lines(li, ["fund", "company"]).withColumns({"value": F.round("value", 2), "shares": F.coalesce("shares", F.lit(-1))})


@query("""select r_name as market, count(*) as total, count_if(s_acctbal > 0)::bigint as in_universe, count_if(s_acctbal > 0 and s_suppkey % 2 = 0)::bigint as main, count_if(s_acctbal > 0 and s_suppkey % 2 = 1)::bigint as second
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1""")
def agg10_coverage(spark, sf):
    t = D.in_tier(spark, sf).select(F.col("target_key").alias("market"), F.col("seq").alias("s_suppkey")).join(D.table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey")
    inside = F.col("s_acctbal") > 0
    return P.coverage(t, inside, {"main": F.col("s_suppkey") % 2 == 0, "second": F.col("s_suppkey") % 2 == 1})


@query(f"select relation, count_if({RANK.format('access_tier')} <= 0)::bigint as visible, count_if({RANK.format('access_tier')} > 0)::bigint as withheld from {OWN} group by 1")
def agg11_ownership(spark, sf):
    return P.withheld(D.ownership(spark, sf), [F.col("relation")], "public")


@query(f"select subject as company, array_to_string(list_sort(coalesce(list(distinct holder) filter ({RANK.format('access_tier')} <= 0), [])), ',') as owners, count_if({RANK.format('access_tier')} > 0)::bigint as withheld from {OWN} where valid_from <= date '{DAY}' group by 1")
def agg12_owners(spark, sf):
    return P.owners(D.ownership(spark, sf), "public", DAY).withColumn("owners", F.array_join("owners", ","))


@query(f"select e.company, f.company as other, person as via from {_PEOPLE.replace('(select distinct', '(select distinct')} e join {_PEOPLE} f using (person) where e.company <> f.company")
def jon29_control_by_proxy(spark, sf):
    now, then = _people(spark, sf)
    return P.proxy_links(now.union(then.select("target_key", "source_key")))


@query(f"select person as via, company, companies from (select person, company, count(*) over (partition by person) as companies from (select distinct person, company from {_PEOPLE})) where companies > 1")
def jon29_proxy_groups(spark, sf):
    now, then = _people(spark, sf)
    return P.proxy_groups(now.union(then.select("target_key", "source_key")))


_CELLS = f"(select s.sector, r_name as region, count(distinct f.company) as companies from (select distinct company, jurisdiction from {SUBS}) f join nation on jurisdiction = n_name join region on n_regionkey = r_regionkey join (select company, min_by(sector, seq) as sector from {IN_SECTOR} group by 1) s on s.company = f.company group by 1, 2)"


def _cells(spark, sf):
    foot = D.subsidiaries(spark, sf).select(F.col("source_key").alias("company"), F.col("jurisdiction").alias("country"))
    regions = D.table(spark, sf, "nation").join(D.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("country"), F.col("r_name").alias("region"))
    sectors = D.in_sector(spark, sf).groupBy(F.col("source_key").alias("company")).agg(F.min_by("sector", "seq").alias("sector"))
    return P.concentration(foot, regions, sectors)


@query(_CELLS[1:-1])
def jon30_concentration(spark, sf):
    return _cells(spark, sf)


@query(f"select * from {_CELLS} order by companies desc, sector, region limit 1")
def jon30_densest(spark, sf):
    return P.densest(_cells(spark, sf))


@query(f"select * from {_CELLS} order by companies desc, sector, region limit 6")
def win08_ranked_cells(spark, sf):
    return P.ranked_cells(_cells(spark, sf))


@query(f"select sector, sum(companies)::bigint as total from {_CELLS} group by 1 order by 2 desc, 1 limit 5")
def top12_sectors(spark, sf):
    return P.top_sectors(_cells(spark, sf))


@query(f"""with u as (select fund as a, company as b from {HOLDS} union select company, fund from {HOLDS})
select b as key, count(distinct a) as n from u where a in (select s_suppkey::varchar || 's' from supplier where s_suppkey % 2 = 0) or false group by 1 having count(distinct a) >= 2""".replace("fund as a, company as b", "'f' || fund as a, company || 's' as b").replace("select company, fund from", "select company || 's', 'f' || fund from"))
def agg25_bridges(spark, sf):
    e = D.holds(spark, sf).select(F.concat(F.lit("f"), "source_key").alias("source_key"), F.concat("target_key", F.lit("s")).alias("target_key"))
    tracked = D.companies(spark, sf).where("seq % 2 = 0").select(F.concat("key", F.lit("s")).alias("key"))
    return G.bridges(e, tracked)
