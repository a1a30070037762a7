"""Queries of scalar functions over whole tables, each with its SQL. Values of the tables stand for the forms that the functions read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from . import domain as D

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


@query("select c_custkey as k, case when c_custkey % 3 = 0 then null else c_custkey::varchar end as number from customer")
def fn10_numbers(spark, sf):
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, F.col("c_name")).when(k % 3 == 1, F.lpad(k.cast("string"), 12, "0")).otherwise(F.concat(F.lit(" "), k.cast("string"), F.lit(" ")))
    return D.table(spark, sf, "customer").select(k.alias("k"), N.registrant_number(raw).alias("number"))


@query("""select p_partkey as k, array_to_string(list_transform(list_concat(w[2:], w[:1]), lambda p: array_to_string(list_transform(string_split(p, chr(39)), lambda q: upper(q[1]) || lower(q[2:])), chr(39))), ' ') as name
from (select p_partkey, string_split('O' || chr(39) || upper(p_name) || ' ' || p_type, ' ') as w from part)""")
def fn13_insiders(spark, sf):
    raw = F.concat(F.lit("O'"), F.upper("p_name"), F.lit("  "), F.col("p_type"))
    return D.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), N.reorder_insider(raw).alias("name"))


@query("""select o_orderkey as k, case when a % 3 = 0 and a % 4 > 0 then 'shareholding' when b % 2 = 0 then 'voting-rights' else 'appoint-directors' end as interest,
case greatest(case when a % 3 = 0 then a % 4 else 0 end, case when b % 2 = 0 then 2 else 0 end) when 1 then '25%-50%' when 2 then '50%-75%' when 3 then '75%-100%' end as band
from (select o_orderkey, o_custkey as a, o_orderkey as b from orders)""")
def fn15_control(spark, sf):
    a, b = F.col("o_custkey"), F.col("o_orderkey")
    shares = [f"ownership-of-shares-{x}-percent" for x in ("25-to-50", "50-to-75", "75-to-100")]
    first = F.when(a % 3 == 0, F.when(a % 4 == 0, "ownership-of-shares-unknown").when(a % 4 == 1, shares[0]).when(a % 4 == 2, shares[1] + "-as-trust").otherwise(shares[2].upper()))
    second = F.when(b % 2 == 0, " voting-rights-50-to-75-percent-as-firm ")
    natures = F.array_compact(F.array(first, second, F.lit("right-to-appoint-and-remove-directors")))
    return D.table(spark, sf, "orders").select(b.alias("k"), N.control_band(natures).alias("g")).select("k", "g.interest", "g.band")


@query("""select l_orderkey as o, l_linenumber as l, case when l_linenumber % 4 = 0 then round(l_discount * 100)::int end as percentage,
case l_linenumber % 4 when 1 then q || '%-' || (q + 25) || '%' when 2 then '≥' || q || '%' when 3 then '≤' || q || '%' end as band from (select *, l_quantity::int as q from lineitem)""")
def fn16_shares(spark, sf):
    n, q = F.col("l_linenumber") % 4, F.col("l_quantity").cast("int")
    exact, low = F.when(n == 0, F.round(F.col("l_discount") * 100).cast("int")), F.when(n.isin(0, 1, 2), q)
    high = F.when(n == 1, q + 25).when(n == 3, q)
    x = D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), N.share_text(exact, low, high).alias("s"))
    return x.select("o", "l", F.col("s.percentage").alias("percentage"), F.col("s.percentage_band").alias("band"))


@query("""select p_partkey as k, case p_size % 4 when 0 then 'lei' when 1 then 'isin' when 2 then 'gb-coh' else lower(p_brand) end as scheme,
case when p_size % 4 = 0 then 'own' when p_partkey % 2 = 0 then 'other' else 'own' end as anchor from part""")
def fn17_schemes(spark, sf):
    z, k = F.col("p_size") % 4, F.col("p_partkey")
    raw = F.when(z == 0, "xi-lei ").when(z == 1, " ISIN code").when(z == 2, F.when(k % 2 == 0, "gb-coh").otherwise("Companies House")).otherwise(F.concat(F.lit(" "), "p_brand"))
    own, other = F.struct(N.scheme(raw).alias("scheme"), F.lit("own").alias("value")), F.struct(F.lit("duns").alias("scheme"), F.lit("other").alias("value"))
    ids = F.when(k % 2 == 0, F.array(other, own)).otherwise(F.array(own, other))
    return D.table(spark, sf, "part").select(k.alias("k"), N.scheme(raw).alias("scheme"), N.best_anchor(ids)["value"].alias("anchor"))


_CATEGORIES = [*T.CUES, "general", "none"]
_PLACES = ", ".join(f"({i}, '{c}', {min(T.CONFIDENCE.get(c, T.OTHER_CONFIDENCE), T.MAX_CONFIDENCE)}, {T.MATERIALITY.index(c) if c in T.MATERIALITY else len(T.MATERIALITY)})" for i, c in enumerate(_CATEGORIES))


@query(f"select event_id as k, category, confidence::double as confidence, place::int as place from events join (values {_PLACES}) r(i, category, confidence, place) on event_id % {len(_CATEGORIES)} = i")
def fn24_confidence(spark, sf):
    c = F.element_at(F.array(*map(F.lit, _CATEGORIES)), (F.col("event_id") % len(_CATEGORIES) + 1).cast("int"))
    return D.table(spark, sf, "events").select(F.col("event_id").alias("k"), c.alias("category"), T.confidence(c).alias("confidence"), T.materiality(c).alias("place"))


@query("select doc_id as doc, substr(text, 1, 280) as excerpt from documents")
def fn29_excerpts(spark, sf):
    return D.table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), N.excerpt(F.col("text")).alias("excerpt"))


@query(r"""select conv_id as conv, turn, case when conv_id % 5 in (0, 1) or regexp_matches(lower(coalesce(text, '')), '\b(opportunit\w*|upside|bullish|tailwind\w*|catalyst\w*)\b') then 'opportunity' else 'risk' end as focus from conversations""")
def fn30_focus(spark, sf):
    k = F.col("conv_id") % 5
    asked = F.concat(F.coalesce("text", F.lit("")), F.when(k == 0, " Any UPSIDE?").when(k == 1, " opportunities here").when(k == 2, " growing upsides, bulletin").otherwise(""))
    return D.table(spark, sf, "conversations").select(F.col("conv_id").alias("conv"), "turn", T.focus(asked).alias("focus"))
