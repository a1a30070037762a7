"""The library's concepts derived from the order tables, once for Spark and once as SQL.

Companies are suppliers, funds are customers, tiers are regions, countries are nations. Every
edge has ``seq``, ``source``, ``access_tier``, ``valid_from`` and ``valid_to``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ensure
from ..operators.graph import TIERS


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ensure(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def tier_of(number: Column) -> Column:
    """A tier by number; every seventh has a label that no list knows."""
    return F.when(number % 7 == 6, "sealed").otherwise(F.element_at(F.array(*map(F.lit, TIERS)), (number % 4 + 1).cast("int")))


TIER_SQL = "case when ({0}) % 7 = 6 then 'sealed' else (['public','legitimate-interest','restricted-authority','aggregator-licensed'])[({0}) % 4 + 1] end"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))


def companies(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.select(F.lit("Company").alias("kind"), text("s_suppkey").alias("key"), F.col("s_suppkey").alias("seq"), F.col("s_name").alias("name"), F.col("s_nationkey"))


def holds(spark: SparkSession, sf: str) -> DataFrame:
    """Fund holds company: value, shares, valid from the first order, one in five closed after 400 days."""
    g = lines(spark, sf).groupBy("o_custkey", "l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("value"), F.sum("l_quantity").cast("long").alias("shares"), F.to_date(F.min("o_orderdate")).alias("valid_from"))
    return g.select(
        F.lit("Fund").alias("source_kind"), text("o_custkey").alias("source_key"), F.lit("holds").alias("relation"), F.lit("Company").alias("target_kind"), text("l_suppkey").alias("target_key"),
        (F.col("o_custkey") * 100000 + F.col("l_suppkey")).alias("seq"), F.lit("orders").alias("source"), tier_of(F.col("o_custkey") + F.col("l_suppkey")).alias("access_tier"),
        "valid_from", F.when(F.col("o_custkey") % 5 == 0, F.date_add("valid_from", 400)).alias("valid_to"), "value", "shares",
    )


HOLDS = f"""(select o_custkey::varchar as fund, l_suppkey::varchar as company, round(sum(l_extendedprice), 2) as value, sum(l_quantity)::bigint as shares,
  min(o_orderdate)::date as valid_from, case when o_custkey % 5 = 0 then (min(o_orderdate)::date + 400) end as valid_to,
  {TIER_SQL.format("o_custkey + l_suppkey")} as access_tier, o_custkey * 100000 + l_suppkey as seq
  from lineitem join orders on l_orderkey = o_orderkey group by o_custkey, l_suppkey)"""


def in_sector(spark: SparkSession, sf: str) -> DataFrame:
    """Company in a part's type (sector) and brand (sub-industry)."""
    p = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("seq"))
    g = li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_type", "p_brand").agg(F.min("seq").alias("seq"))
    return g.select(
        F.lit("Company").alias("source_kind"), text("l_suppkey").alias("source_key"), F.lit("in_sector").alias("relation"), F.lit("Industry").alias("target_kind"), F.col("p_brand").alias("target_key"),
        "seq", F.lit("parts").alias("source"), F.col("p_type").alias("sector"), F.col("p_brand").alias("sub_industry"), F.upper("p_type").alias("industry"), F.concat(F.substring("p_type", 1, 2), F.substring("p_brand", -2, 2)).alias("code"),
    )


IN_SECTOR = """(select l_suppkey::varchar as company, p_type as sector, p_brand as sub_industry, upper(p_type) as industry, left(p_type, 2) || right(p_brand, 2) as code, min((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) as seq
  from lineitem join part on l_partkey = p_partkey group by l_suppkey, p_type, p_brand)"""


def in_tier(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.lit("Company").alias("source_kind"), text("s_suppkey").alias("source_key"), F.lit("in_market_tier").alias("relation"), F.lit("MarketTier").alias("target_kind"), F.col("r_name").alias("target_key"), F.col("s_suppkey").alias("seq"), F.lit("registry").alias("source"))


IN_TIER = "(select s_suppkey::varchar as company, r_name as tier, s_suppkey as seq from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"


def operates_in(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.lit("Company").alias("source_kind"), text("s_suppkey").alias("source_key"), F.lit("operates_in").alias("relation"), F.lit("Country").alias("target_kind"), F.col("n_name").alias("target_key"), F.col("s_suppkey").alias("seq"))


def relies_on(spark: SparkSession, sf: str) -> DataFrame:
    d = lines(spark, sf).select("o_custkey", "l_suppkey").distinct()
    return d.select(F.lit("Company").alias("source_kind"), F.concat(F.lit("c"), text("o_custkey")).alias("source_key"), F.lit("relies_on_supplier").alias("relation"), F.lit("Company").alias("target_kind"), text("l_suppkey").alias("target_key"))


RELIES = "(select distinct 'c' || o_custkey as company, l_suppkey::varchar as operator from lineitem join orders on l_orderkey = o_orderkey)"


def subsidiaries(spark: SparkSession, sf: str) -> DataFrame:
    """Company has a subsidiary (a customer that bought over a value) in the customer's nation."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    d = lines(spark, sf).where("l_quantity >= 45").groupBy("l_suppkey", "o_custkey").agg(F.min("o_orderkey").alias("first"))
    e = d.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return e.select(F.lit("Company").alias("source_kind"), text("l_suppkey").alias("source_key"), F.lit("has_subsidiary").alias("relation"), F.lit("Subsidiary").alias("target_kind"), text("o_custkey").alias("target_key"), (F.col("first") * 100000 + F.col("o_custkey")).alias("seq"), F.concat(F.lit("order-"), text("first")).alias("source"), F.col("n_name").alias("jurisdiction"))


SUBS = """(select l_suppkey::varchar as company, o_custkey::varchar as sub, min(o_orderkey) * 100000 + o_custkey as seq, 'order-' || min(o_orderkey) as source, n_name as jurisdiction
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where l_quantity >= 45 group by l_suppkey, o_custkey, n_name)"""


def references(spark: SparkSession, sf: str) -> DataFrame:
    """Company mentions the next supplier of the same order."""
    from pyspark.sql import Window as W

    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").withColumn("next", F.lead("l_suppkey").over(w))
    e = li.where("next is not null and next <> l_suppkey")
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return e.select(F.lit("Company").alias("source_kind"), text("l_suppkey").alias("source_key"), F.lit("references").alias("relation"), F.lit("Company").alias("target_kind"), text("next").alias("target_key"), seq.alias("seq"), F.concat(F.lit("order-"), text("l_orderkey")).alias("source"))


REFS = """(select l_suppkey::varchar as a, nxt::varchar as b, l_orderkey * 10 + l_linenumber as seq, 'order-' || l_orderkey as source from
  (select l_orderkey, l_linenumber, l_suppkey, lead(l_suppkey) over (partition by l_orderkey order by l_linenumber, l_suppkey) as nxt from lineitem)
  where nxt is not null and nxt <> l_suppkey)"""


def ownership(spark: SparkSession, sf: str) -> DataFrame:
    """A tree of suppliers (the holder of n is n div 3), with one cycle in 20, tiers, and years of validity."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("n"))
    up = F.when((F.col("n") % 20 == 7) & (F.col("n") > 0), F.col("n") * 3).otherwise(F.floor(F.col("n") / 3))
    e = s.withColumn("h", up.cast("long")).where("h <> n")
    e = e.join(s.select(F.col("n").alias("h")), "h", "left_semi")
    return e.select(
        F.lit("Company").alias("source_kind"), text("h").alias("source_key"), F.when(F.col("n") % 3 == 0, "beneficial_owner_of").otherwise("owns").alias("relation"), F.lit("Company").alias("target_kind"), text("n").alias("target_key"),
        F.col("n").alias("seq"), F.lit("register").alias("source"), F.when(F.col("n") % 4 == 3, "restricted-authority").otherwise("public").alias("access_tier"),
        F.make_date(F.lit(1992) + (F.col("n") % 8).cast("int"), F.lit(1), F.lit(1)).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"),
    )


OWN = """(select h::varchar as holder, n::varchar as subject, case when n % 3 = 0 then 'beneficial_owner_of' else 'owns' end as relation, n as seq,
  case when n % 4 = 3 then 'restricted-authority' else 'public' end as access_tier, make_date(1992 + (n % 8)::int, 1, 1) as valid_from, null::date as valid_to
  from (select s_suppkey as n, case when s_suppkey % 20 = 7 and s_suppkey > 0 then s_suppkey * 3 else s_suppkey // 3 end as h from supplier)
  where h <> n and h in (select s_suppkey from supplier))"""

RANK = "(case when {0} is null or {0} = 'public' then 0 when {0} = 'legitimate-interest' then 1 when {0} = 'restricted-authority' then 2 else 3 end)"
