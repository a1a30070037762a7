"""Queries of resolution, traversal, documents, retrieval and market operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import names as N
from ..functions import text as T
from ..operators import alerts as A
from ..operators import documents as Doc
from ..operators import graph as G
from ..operators import market as M
from ..operators import pathways as PW
from ..operators import resolution as R
from ..operators import retrieval as Ret
from ..operators import traverse as V
from ..operators import vectors as Vec
from ..sources.scratch import stored
from . import domain as D
from .domain import IN_SECTOR, OWN, RANK, REFS

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- traversal

_WALK = f"(select a, b from {REFS} union select b, a from {REFS})"
_REACH = """with recursive w as {walk}, r(s, k, h) as (select s_suppkey::varchar, s_suppkey::varchar, 0 from supplier where s_suppkey % 20 = 0
 union select s, b, h + 1 from r join w on k = a where h < {hops}) select s as start, k as key, min(h)::int as hops from r where k <> s group by 1, 2"""


def _starts(spark, sf):
    """The stated query set: every company whose number is divisible by 20, against all others."""
    return D.companies(spark, sf).where(F.col("seq") % 20 == 0).select("key")


@query(_REACH.format(walk=f"(select distinct a, b from {REFS})", hops=3))
def trv01_reachable(spark, sf):
    return V.reachable(_starts(spark, sf), D.references(spark, sf), 3, "out")


@query(_REACH.format(walk=f"(select distinct b as a, a as b from {REFS})", hops=2))
def trv01_reachable_in(spark, sf):
    return V.reachable(_starts(spark, sf), D.references(spark, sf), 2, "in")


#: A way along an edge (2 seq) or back (2 seq + 1), the smallest of parallel ones; then a level: the smallest sequence of ways to each node that is new.
_WAYS = "w as (select a, b, min(c) as c from (select {a} as a, {b} as b, {along} as c from {e} union all select {b}, {a}, {back} from {e}) group by 1, 2)"
_LEVEL = """l{h} as (select s, w.b as k, {h} as hops, min(o || lpad(c::varchar, 20, '0')) as o, arg_min(p || '|' || (c // 2)::varchar || case when c % 2 = 1 then '<' else '>' end || w.b, o || lpad(c::varchar, 20, '0')) as p,
  arg_min(u || case when c % 2 = 1 then 'u' else 'd' end, o || lpad(c::varchar, 20, '0')) as u, arg_min(case when c % 2 = 1 then w.b else t end, o || lpad(c::varchar, 20, '0')) as t
  from l{g} join w on w.a = k where not exists (select 1 from ({seen}) x where x.s = l{g}.s and x.k = w.b) group by 1, 2)"""


def _levels(start: str, hops: int) -> str:
    first = f"l0 as (select s_suppkey::varchar as s, s_suppkey::varchar as k, 0 as hops, '' as o, '' as p, '' as u, null::varchar as t from supplier {start})"
    seen = lambda h: " union all ".join(f"select s, k from l{i}" for i in range(h))
    return ", ".join([first, *(_LEVEL.format(h=h, g=h - 1, seen=seen(h)) for h in range(1, hops + 1))])


def _written(path: str):
    """A path as text: each step's edge number, its direction and where it arrives."""
    return F.concat(F.lit("|"), F.array_join(F.transform(path, lambda x: F.concat(x["seq"].cast("string"), F.when(x["up"], "<").otherwise(">"), x["to"])), "|"))


@query(f"with {_WAYS.format(a='a', b='b', along='2 * seq', back='2 * seq + 1', e=REFS)}, {_levels('where s_suppkey % 20 = 0', 2)} select s as start, k as key, hops, p as path from l1 union all select s, k, hops, p from l2")
def trv02_network(spark, sf):
    return V.network(_starts(spark, sf), D.references(spark, sf), 2).select("start", "key", "hops", _written("path").alias("path"))


_CHAINS = f"""with recursive e as (select * from {OWN} where valid_from <= date '1998-01-01'),
v as (select * from e where {RANK.format('access_tier')} = 0), c(s, k, path, last, stop) as (
 select s_suppkey::varchar, s_suppkey::varchar, [s_suppkey::varchar], null::varchar, null::varchar from supplier
 union all select s, holder, list_append(path, holder), relation, case when list_contains(path, holder) then 'cycle' when len(path) >= 6 then 'max_depth' end from c join v on subject = k where stop is null)
select s as start, array_to_string(path[2:], '>') as holders, coalesce(stop, case when exists (select 1 from e where subject = k) then 'restricted' when last = 'beneficial_owner_of' then 'beneficial_owner' else 'root' end) as terminal, (len(path) - 1)::int as depth,
 (stop is null and not exists (select 1 from e where subject = k)) as complete, false as truncated
from c where stop is not null or (len(path) > 1 and not exists (select 1 from v where subject = k))"""


@query(_CHAINS)
def trv03_ownership_chains(spark, sf):
    out = V.ownership_chains(D.companies(spark, sf).select("key"), D.ownership(spark, sf), "public", "1998-01-01", 6)
    return out.select("start", F.array_join("holders", ">").alias("holders"), "terminal", "depth", "complete", "truncated")


@query(f"""with recursive e as (select * from {OWN} where {RANK.format('access_tier')} = 0), w as (select holder as a, subject as b from e union select subject, holder from e),
r(s, k, h) as (select s_suppkey::varchar, s_suppkey::varchar, 0 from supplier union select s, b, h + 1 from r join w on k = a where h < 2)
select s as start, k as key, min(h)::int as hops from r where k <> s group by 1, 2""")
def trv04_contagion(spark, sf):
    return V.contagion(D.companies(spark, sf).select("key"), D.ownership(spark, sf), max_hops=2)[0].select("start", "key", "hops")


@query(f"""with {_WAYS.format(a="holder", b="subject", along="2 * (seq + 1099511627776)", back="2 * seq + 1", e="(select * from " + OWN + " where " + RANK.format("access_tier") + " = 0)")}, {_levels("", 3)},
r as (select s, k, hops, u, t from l1 union all select s, k, hops, u, t from l2 union all select s, k, hops, u, t from l3),
c as (select *, case when regexp_matches(u, '^u+$') then 'parent' when regexp_matches(u, '^d+$') then 'subsidiary' when regexp_matches(u, '^[ud]*u+d+$') then 'shares-owner' else 'group' end as link from r)
select s as start, k as key, hops, link, case when link = 'shares-owner' then t end as shared_owner from c""")
def trv04_link_classes(spark, sf):
    return V.contagion(D.companies(spark, sf).select("key"), D.ownership(spark, sf), max_hops=3)[0].select("start", "key", "hops", "link", "shared_owner")


@query(f"select h.company, r_name as idx from (select distinct l_suppkey as company from lineitem) h join supplier on s_suppkey = company join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def trv05_constituents(spark, sf):
    held = D.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("company"))
    return PW.constituents(held, D.in_tier(spark, sf).select(F.col("seq").alias("company"), F.col("target_key").alias("idx")))


@query("select a.s_suppkey as key, b.s_suppkey as sibling from supplier a join supplier b on a.s_suppkey // 4 = b.s_suppkey // 4 and a.s_suppkey <> b.s_suppkey")
def trv06_siblings(spark, sf):
    e = D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.floor(F.col("s_suppkey") / 4).alias("canonical"))
    return G.siblings(e)


# ---- resolution


def _names(spark, sf):
    """Every supplier's name with a designator, under two spellings."""
    s = D.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    base = F.regexp_replace("s_name", "#", " ")
    q = s.select(D.text("s_suppkey").alias("key"), N.normal_ascii(F.concat(base, F.lit(" Holdings"))).alias("name"))
    r = s.select(F.concat(F.lit("r"), D.text("s_suppkey")).alias("key"), N.normal_ascii(F.when(k % 2 == 0, F.concat(base, F.lit(" Inc"))).otherwise(F.concat(F.lit("The "), base))).alias("name"))
    return q, r


@query("select s_suppkey::varchar as query, 'r' || s_suppkey as record from supplier")
def jon16_best_organisation(spark, sf):
    q, r = _names(spark, sf)
    m = R.best_record(R.best_name(R.blocked_pairs(q, r, 0.97, organisations=True), 0.97, organisations=True))
    return m.select("query", "record")


@query()
def jon10_screening(spark, sf):
    s = D.table(spark, sf, "customer")
    q = s.where("c_custkey % 20 = 0").select(D.text("c_custkey").alias("key"), N.normal_ascii(F.col("c_name")).alias("name"))
    r = s.select(F.concat(F.lit("w"), D.text("c_custkey")).alias("key"), N.normal_ascii(F.concat(F.col("c_name"), F.lit(" ii"))).alias("name"))
    return R.best_name(R.blocked_pairs(q, r, 0.6), 0.6)


@query("""select s_suppkey as pos, case when s_suppkey % 4 = 0 then 'ticker' when s_suppkey % 4 = 1 then 'isin' when s_suppkey % 4 = 2 then 'name' else 'unresolved' end as method,
case when s_suppkey % 4 < 3 then s_suppkey::varchar end as company from supplier""")
def jon15_cascade(spark, sf):
    s = D.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    comp = s.select(D.text(k).alias("company"), F.concat(F.lit("T."), D.text(k)).alias("ticker"), F.concat(F.lit("IN"), D.text(k)).alias("isin"), F.lower("s_name").alias("name"))
    pos = s.select(k.alias("pos"), F.when(k % 4 == 0, F.concat(F.lit("t-"), D.text(k))).alias("ticker"), F.when(k % 4 == 1, F.concat(F.lit(" in"), D.text(k))).alias("isin"), F.when(k % 4 == 2, F.col("s_name")).alias("name"))
    steps = [
        ("ticker", comp.select(N.ticker_key(F.col("ticker")).alias("on"), "company"), N.ticker_key(F.col("ticker"))),
        ("isin", comp.select(N.clean_isin(F.col("isin")).alias("on"), "company"), N.clean_isin(F.col("isin"))),
        ("name", comp.select(F.col("name").alias("on"), "company"), F.lower("name")),
    ]
    return R.cascade(pos, "pos", steps).select("pos", "method", "company")


@query("""with m as (select case when s_suppkey % 4 = 0 then 'ticker' when s_suppkey % 4 = 1 then 'isin' when s_suppkey % 4 = 2 then 'name' else 'unresolved' end as method from supplier)
select method, count(*) as n, round_even(count(*) / (select count(*) from m), 4) as rate from m group by 1""")
def agg26_resolve_report(spark, sf):
    return R.resolve_report(jon15_cascade(spark, sf))


@query("""with l as (select 'I' || s_suppkey as isin, min_by(s_name, s_suppkey) as ln from supplier where s_suppkey % 3 <> 0 group by 1), r as (select 'I' || s_suppkey as isin, upper(s_name) as rn from supplier where s_suppkey % 2 = 0)
select coalesce(l.isin, r.isin) as isin, ln as left_name, rn as right_name, case when ln is not null and rn is not null then 'dual' when ln is not null then 'left_only' else 'right_only' end as bucket from l full join r on l.isin = r.isin""")
def jon13_unify_lists(spark, sf):
    s = D.table(spark, sf, "supplier").select(F.concat(F.lit("I"), D.text("s_suppkey")).alias("isin"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("pos"))
    return R.unify(s.where("pos % 3 <> 0"), s.where("pos % 2 = 0").withColumn("name", F.upper("name")))


@query("select c_custkey::varchar as identity, case when c_custkey % 3 = 0 then 'old-' || c_custkey else 'us-' || c_custkey end as key, c_name as name, c_custkey % 3 <> 0 as created from customer")
def jon12_reconcile(spark, sf):
    c = D.table(spark, sf, "customer").select(D.text("c_custkey").alias("identity"), F.col("c_name").alias("name"), F.col("c_custkey").alias("pos"))
    have = c.where("pos % 3 = 0").select("identity", F.concat(F.lit("old-"), "identity").alias("key"), F.col("pos").alias("seq"))
    return R.reconcile(c.unionByName(c.withColumn("pos", F.col("pos") + 1000000)), have, "us")


@query("""select p_partkey as pos, case when p_partkey % 2 = 0 then p_partkey % 50 when p_partkey % 3 = 0 then p_partkey % 40 else -1 end as company from part""")
def jon14_index_link(spark, sf):
    k = F.col("p_partkey")
    p = D.table(spark, sf, "part").select(k.alias("pos"), F.when(k % 2 == 0, F.concat(F.lit("I"), D.text(k % 50))).alias("isin"), F.when(k % 3 == 0, F.concat(F.lit("S"), D.text(k % 40))).alias("symbol"))
    ids = spark.range(50).select(F.col("id").alias("company"))
    steps = [("isin", ids.select(F.concat(F.lit("I"), D.text("company")).alias("on"), "company"), F.col("isin")), ("symbol", ids.select(F.concat(F.lit("S"), D.text("company")).alias("on"), "company"), F.col("symbol"))]
    return R.cascade(p, "pos", steps).select("pos", F.coalesce("company", F.lit(-1)).alias("company"))


@query("""select 'index' || (p_partkey % 5) as idx, count_if(p_partkey % 2 = 0 or p_partkey % 3 = 0)::bigint as linked, count_if(p_partkey % 2 <> 0 and p_partkey % 3 <> 0)::bigint as unlinked from part group by 1""")
def jon14_unlinked(spark, sf):
    found = jon14_index_link(spark, sf).select(F.concat(F.lit("index"), D.text(F.col("pos") % 5)).alias("idx"), F.when(F.col("company") >= 0, F.col("company")).alias("company"))
    return R.link_counts(found, "idx")


@query("""select s_suppkey as n, case when s_suppkey % 3 = 0 then 'k' || s_suppkey when s_suppkey % 3 = 1 then 'g' || s_suppkey else 'x-holder-' || s_suppkey end as key, s_suppkey % 3 < 2 as resolved from supplier""")
def jon17_parties(spark, sf):
    k = F.col("s_suppkey")
    s = D.table(spark, sf, "supplier")
    parties = s.select(k.alias("n"), F.when(k % 3 == 0, "lei").alias("scheme"), F.when(k % 3 == 0, D.text(k)).alias("value"), F.when(k % 3 == 1, F.concat(F.lit("g"), D.text(k))).alias("given_key"), F.concat(F.lit("Holder "), D.text(k)).alias("name"))
    anchors = s.where("s_suppkey % 3 = 0").select(F.lit("lei").alias("scheme"), D.text(k).alias("value"), F.concat(F.lit("k"), D.text(k)).alias("key"), k.alias("seq"))
    keys = s.where("s_suppkey % 3 = 1").select(F.concat(F.lit("g"), D.text(k)).alias("key"))
    return R.resolve_parties(parties, anchors, keys).select("n", "key", "resolved")


@query("""select l_suppkey::varchar as company, l_partkey::varchar as person, case when bool_or(l_returnflag = 'R') then 'officer' else 'director' end as role,
coalesce(min(l_orderkey * 10 + l_linenumber) filter (l_returnflag = 'R'), min(l_orderkey * 10 + l_linenumber)) as seq from lineitem group by 1, 2""")
def jon22_people_merge(spark, sf):
    li = D.table(spark, sf, "lineitem").select(D.text("l_suppkey").alias("company"), D.text("l_partkey").alias("person"), F.when(F.col("l_returnflag") == "R", "officer").otherwise("director").alias("role"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return R.priority_merge(li, ["company", "person"], F.when(F.col("role") == "officer", 0).otherwise(1), "seq")


@query("""select s_suppkey as key, array_to_string(list_sort(['isin=I' || s_suppkey, 'ticker=A' || s_suppkey, 'ticker=B' || s_suppkey]), ',') as anchors from supplier""")
def set05_merge_anchors(spark, sf):
    k = F.col("s_suppkey")
    a = D.table(spark, sf, "supplier").select(k.alias("key"), F.explode(F.array(*(F.struct(F.lit(s).alias("scheme"), F.concat(F.lit(p), D.text(k)).alias("value"), F.lit(i).alias("seq")) for i, (s, p) in enumerate([("isin", "I"), ("isin", "J"), ("ticker", "B"), ("ticker", "A"), ("ticker", "B")])))).alias("x"))
    out = R.merge_anchors(a.select("key", "x.*"))
    return out.select("key", F.array_join(F.transform("anchors", lambda x: F.concat_ws("=", x["scheme"], x["value"])), ",").alias("anchors"))


def _log(spark, sf):
    """Judgements of pairs of users within tens, so that the number of components grows with that of users."""
    e = D.table(spark, sf, "events")
    ten = F.col("user_id") - F.col("user_id") % 10
    a, b = F.concat(F.lit("u"), D.text("user_id")), F.concat(F.lit("u"), D.text(ten + (F.col("user_id") * 7 + F.col("event_id") % 3) % 10))
    verdict = F.when(F.col("event_id") % 10 == 0, "different").when(F.col("event_id") % 7 == 0, "undecided").otherwise("same")
    return e.select(a.alias("left_key"), b.alias("right_key"), verdict.alias("verdict"), F.round("value", 3).alias("score"), F.col("ts").alias("decided_at"), F.col("event_id").alias("seq"))


@query("""with l as (select 'u' || user_id as a, 'u' || (user_id - user_id % 10 + (user_id * 7 + event_id % 3) % 10) as b, case when event_id % 10 = 0 then 'different' when event_id % 7 = 0 then 'undecided' else 'same' end as v, ts, event_id from events)
select least(a, b) as low, greatest(a, b) as high, arg_max(v, (ts, event_id)) as verdict, arg_max(event_id, (ts, event_id)) as seq from l where a <> b group by 1, 2""")
def win01_current_judgements(spark, sf):
    return R.current_judgements(_log(spark, sf)).select(F.least("left_key", "right_key").alias("low"), F.greatest("left_key", "right_key").alias("high"), "verdict", "seq")


@query()
def ers05_clusters(spark, sf):
    return R.cluster(R.current_judgements(_log(spark, sf)))[0]


@query()
def ers07_canonical(spark, sf):
    return R.canonical(R.cluster(R.current_judgements(_log(spark, sf)))[0])[0]


# ---- documents

#: Words of the invented prose stand for cues and verbs.
_CUES = {"executive": ["hand"], "litigation": ["that"], "risk": ["with"], "product": ["thing"], "guidance": ["from"]}
_VERBS = ["is", "are", "was", "be"]


def _sections(spark, sf):
    d = D.table(spark, sf, "documents").where("text is not null")
    return d.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("s_order", "content")).withColumn("title", F.concat(F.lit("s"), D.text(F.col("s_order") % 3)))


def _sentences(spark, sf, cues=_CUES):
    return Doc.sentence_table(_sections(spark, sf), _VERBS, cues)


_SENT = r"""(select doc, s_order, 's' || (s_order % 3) as title, s_order * 1000000 + i as seq, sentence, lower(sentence) as low, regexp_replace(lower(sentence), '[^\x01-\x7F]', '0', 'g') as plain from (
  select doc, s_order, unnest(range(0, len(p))) as i, unnest(p) as sentence from (
   select doc, s_order, list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(content, '\s+', ' ', 'g')), '([.!?])\s+([A-Z("''$\d])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') as p from (
    select doc_id as doc, unnest(range(0, len(l))) as s_order, unnest(l) as content from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null)))))"""
#: Cues of the signals' queries, so that all rules have something to find; in the order of the operator's own table.
_SIGNAL_CUES = {"executive": ["hand"], "capital_allocation": ["this"], "litigation": ["that"], "supply_chain": [" by "], "guidance": ["from"], "product": ["thing"], "risk": ["with"]}
_SIGNAL_CAT = "case " + " ".join(f"when contains(low, '{w[0]}') then '{c}'" for c, w in _SIGNAL_CUES.items()) + " else 'general' end"
_CAT = "case when contains(low, 'hand') then 'executive' when contains(low, 'that') then 'litigation' when contains(low, 'with') then 'risk' when contains(low, 'thing') then 'product' when contains(low, 'from') then 'guidance' else 'general' end"
_READS = r"""(select *, {cat} as category, trim(regexp_replace(regexp_replace(low, '[^a-z0-9 ]+', '', 'g'), ' +', ' ', 'g')) as norm from {sent}
  where len(list_filter(regexp_split_to_array(sentence, '\s+'), lambda x: x <> '')) >= 6 and len(list_filter(regexp_split_to_array(sentence, '\s+'), lambda x: regexp_matches(x, '^\(?[$£€]?\d[\d,.–/%-]*\)?$'))) / len(list_filter(regexp_split_to_array(sentence, '\s+'), lambda x: x <> '')) <= 0.4
  and len(regexp_extract_all(plain, '\b[a-z][a-z'']+\b')) >= 4
  and (len(list_filter(regexp_extract_all(plain, '\b[a-z][a-z'']+\b'), lambda x: x in ('is', 'are', 'was', 'be'))) > 0 or regexp_matches(plain, '\b[a-z]{{3,}}(?:ed|ing)\b')))"""
_GOOD = _READS.format(cat=_CAT, sent=_SENT)


@query(rf"select doc, count(*) as sentences from {_SENT} group by 1")
def doc07_sentences(spark, sf):
    s = _sections(spark, sf)
    return s.select("doc", F.explode(T.sentences(F.col("content"))).alias("x")).groupBy("doc").agg(F.count("*").alias("sentences"))


@query(f"select doc, seq, category from {_GOOD}")
def doc08_categories(spark, sf):
    return _sentences(spark, sf).select("doc", "seq", "category")


@query(f"select doc, min(seq) as seq, arg_min(category, seq) as category, sentence from {_GOOD} where category in ('executive', 'litigation', 'product', 'guidance') group by doc, sentence")
def doc10_events(spark, sf):
    return Doc.events(_sentences(spark, sf)).select("doc", "seq", "category", "sentence")


@query(f"select doc, k, title, sentence from (select doc, title, sentence, row_number() over (partition by doc order by seq)::int as k from (select doc, title, min(seq) as seq, arg_min(sentence, seq) as sentence from {_GOOD} group by 1, 2)) where k <= 6")
def win03_key_points(spark, sf):
    return Doc.key_points(_sentences(spark, sf)).select("doc", "k", "title", "sentence")


@query(f"""with s as {_GOOD}, b as (select doc, 'risks' as bucket, seq, sentence from s where contains(low, 'that') or contains(low, 'with') union all select doc, 'opportunities', seq, sentence from s where contains(low, 'thing')
 union all select doc, 'financials', seq, sentence from s where contains(low, 'from') union all select doc, 'commentary', seq, sentence from s where contains(low, 'from') or contains(low, 'hand')
 union all select doc, 'events', seq, sentence from s where contains(low, 'thing') or contains(low, 'hand') or contains(low, 'that'))
select doc, bucket, k, sentence from (select *, row_number() over (partition by doc, bucket order by seq)::int as k from (select doc, bucket, sentence, min(seq) as seq from b group by 1, 2, 3)) where k <= 6""")
def top08_buckets(spark, sf):
    return Doc.buckets(_sentences(spark, sf)).select("doc", "bucket", "k", "sentence")


def _periods(spark, sf):
    d = D.table(spark, sf, "documents").where("text is not null")
    return d.select(F.col("doc_id").alias("doc"), F.col("source").alias("company"), F.col("lang").alias("source"), F.col("doc_id").alias("period"))


@query("select doc_id as doc, coalesce(lag(doc_id) over (partition by source, lang order by doc_id), -1) as previous from documents where text is not null")
def win02_previous(spark, sf):
    return Doc.previous(_periods(spark, sf)).select("doc", F.coalesce("previous", F.lit(-1)).alias("previous"))


_DIFF = """(with p as (select doc_id as doc, lag(doc_id) over (partition by source, lang order by doc_id) as previous from documents where text is not null), s as (select doc, norm, arg_min(sentence, seq) as sentence, arg_min(category, seq) as category from {good} where norm <> '' group by 1, 2)
select p.doc, previous, 'added' as kind, category, norm, sentence as statement from p join s using (doc) where previous is not null and not exists (select 1 from s t where t.doc = p.previous and t.norm = s.norm)
union all select p.doc, previous, 'removed', category, norm, sentence from p join s on s.doc = p.previous where not exists (select 1 from s t where t.doc = p.doc and t.norm = s.norm))"""
_CHANGES = _DIFF.replace("{good}", _GOOD)


def _changes(spark, sf, sent=None):
    return Doc.changes(_sentences(spark, sf) if sent is None else sent, Doc.previous(_periods(spark, sf)))


def _cut_once(spark, sf, cues=_CUES):
    """The sentences of all documents, for queries that read them several times."""
    return stored(_sentences(spark, sf, cues).select("doc", "seq", "title", "sentence", "category", "norm"), "sentences")


@query(_CHANGES[1:-1])
def doc11_changes(spark, sf):
    return _changes(spark, sf).select("doc", "previous", "kind", "category", "norm", "statement")


@query(f"select doc, count_if(kind = 'added')::bigint as added, count_if(kind = 'removed')::bigint as removed, bool_or(category not in ('general', 'financial')) as material from {_CHANGES} group by 1")
def agg22_change_sets(spark, sf):
    return Doc.change_sets(_changes(spark, sf))


# ---- signals: languages stand for kinds of documents and for countries

_SIGNAL_SQL = """c as materialized (select source as company, lang, ch.doc, ch.kind, category, statement, norm from {diff} ch join documents on doc = doc_id),
e as materialized (select source as company, lang, doc, category, norm, seq, sentence from (select doc, sentence, min(seq) as seq, arg_min(category, seq) as category, min(norm) as norm from {good} where category in ('executive', 'capital_allocation', 'litigation', 'supply_chain', 'guidance', 'product') group by 1, 2) join documents on doc = doc_id),
n as (select source as company, count_if(lang = 'es') as jobs, count_if(lang = 'fr') as patents, count(distinct lang) as lands, string_agg(distinct lang, ', ' order by lang) as land from documents where text is not null group by 1),
k as (select company, count_if(category in ('risk', 'litigation') and kind = 'added') as r, count_if(category = 'guidance') as g, bool_or(category = 'guidance' and contains(lower(statement), 'with')) as weak, count_if(category = 'supply_chain') as s, count_if(category = 'capital_allocation') as ca from c group by 1),
x as (select n.*, coalesce(k.r, 0) + coalesce(v.r, 0) as r, g, weak, s, ca from n left join k using (company) left join (select company, count(*) as r from e where category = 'litigation' group by 1) v using (company)),
sig as (select company, 'management_confidence' as type, 'Management confidence' as label, case when weak then 'down' else 'up' end as direction, (case when weak then 0.62 else 0.55 end)::double as strength, 'Guidance language ' || case when weak then 'weakened' else 'held/strengthened' end || ' in the latest disclosure.' as rationale from x where g > 0
 union all select company, 'emerging_risk', 'Emerging risk', 'elevated', round_even(least(0.8, 0.55 + 0.05 * least(3, r)), 2)::double, r || ' new risk/regulatory/legal signal(s) versus the prior period.' from x where r > 0
 union all select company, 'supply_chain_stress', 'Supply-chain stress', 'elevated', 0.6, 'Supplier-related changes versus the prior disclosure.' from x where s > 0
 union all select company, 'hiring', 'Hiring activity', 'up', 0.5, jobs || ' active job posting(s) signal investment in capacity.' from x where jobs > 0
 union all select company, 'patent_momentum', 'Patent momentum', 'up', 0.5, patents || ' patent record(s) indicate ongoing R&D output.' from x where patents > 0
 union all select company, 'capital_allocation', 'Capital allocation trend', 'elevated', 0.55, 'Capital-allocation language changed versus the prior disclosure.' from x where ca > 0
 union all select company, 'geopolitical', 'Geopolitical exposure', 'elevated', round_even(least(0.8, 0.5 + 0.05 * lands), 2)::double, 'Supply chain spans ' || land || '.' from x where lands > 0)"""
_SIGNAL_SQL = _SIGNAL_SQL.replace("{diff}", _DIFF).replace("{good}", _READS.format(cat=_SIGNAL_CAT, sent=_SENT))


def _signal_inputs(spark, sf):
    """(changes, events, documents, countries) of each company, from sentences that are cut once."""
    sent = _cut_once(spark, sf, _SIGNAL_CUES)
    p = _periods(spark, sf)
    whose = p.select("doc", "company", "source")
    ch, ev = _changes(spark, sf, sent).join(whose, "doc"), Doc.events(sent).join(whose, "doc")
    made = F.when(F.col("source") == "es", "job_posting").when(F.col("source") == "fr", "patent").otherwise("filing")
    docs = p.select("company", "doc", made.alias("document_type"), F.concat(F.lit("document "), D.text("doc")).alias("title"))
    return ch, ev, docs, p.select("company", F.col("source").alias("country"), F.concat(F.lit("s"), D.text(F.col("doc") % 7)).alias("supplier"))


@query(f"""with {_SIGNAL_SQL},
ev as (select company, case category when 'guidance' then 'management_confidence' when 'supply_chain' then 'supply_chain_stress' when 'capital_allocation' then 'capital_allocation' else 'emerging_risk' end as type, 0 as part, doc, (kind = 'removed')::int as nr, statement from c
  where category in ('guidance', 'supply_chain', 'capital_allocation') or (category in ('risk', 'litigation') and kind = 'added')
 union all select company, 'emerging_risk', 2, doc, seq, sentence from e where category = 'litigation'
 union all select source, case lang when 'es' then 'hiring' else 'patent_momentum' end, 0, doc_id, 0, 'document ' || doc_id from documents where text is not null and lang in ('es', 'fr')),
cites as (select company, type, part + k as place, statement from (select *, row_number() over (partition by company, type, part order by doc, nr, statement) as k from ev) where k <= case when type = 'supply_chain_stress' or (type = 'emerging_risk' and part = 0) then 2 else 1 end
 union all select company, 'geopolitical', 1, company || ' is exposed to ' || land || ' via its suppliers.' from n where lands > 0)
select sig.company, sig.type, label, direction, strength, rationale, string_agg(statement, ' | ' order by place) as evidence from sig join cites on sig.company = cites.company and sig.type = cites.type group by all""")
def doc12_signals(spark, sf):
    ch, ev, docs, land = _signal_inputs(spark, sf)
    found = Doc.signals(ch, ev, docs, land, soft=("with",))
    return Doc.cited(found, Doc.signal_evidence(ch, ev, docs, land)).withColumn("evidence", F.array_join("evidence", " | "))


_RULE_SQL = "(values " + ", ".join(f"('{c}', '{t}', '{s}', {Doc.SEVERITY.index(s)}, {v})" for c, t, s, v in Doc.RISKS) + ") r(category, title, severity, place, base)"


@query(f"""with {_SIGNAL_SQL},
a as (select company, category, norm, statement, case kind when 'added' then 0.05 else 0.0 end as bonus, 0 as late, case kind when 'added' then 'Added' else 'Removed' end || ' in ' || lang as how from c
 union all select company, category, norm, sentence, 0.0, 1, 'Event (' || lang || ')' from e),
one as (select company, category, norm, arg_min((statement, bonus, how), (late, -bonus, statement, how)) as b from a group by 1, 2, 3),
g as (select source as company, lang as country, string_agg(distinct 's' || (doc_id % 7), ', ' order by 's' || (doc_id % 7)) as suppliers from documents where text is not null group by 1, 2),
f as (select company, title, category, severity, place, round_even(least(0.8, base + b[2]), 2)::double as confidence, b[1] as statement, b[3] || ': ' || b[1] as rationale from one join {_RULE_SQL} using (category)
 union all select company, 'Geopolitical exposure to ' || country, 'supply_chain', 'medium', 1, 0.55, company || ' relies on ' || suppliers || ' in ' || country || '.', company || ' depends on ' || suppliers || ' operating in ' || country || ', creating concentration/geopolitical exposure.' from g)
select company, title, category, severity, confidence, statement, rationale, row_number() over (partition by company order by place, confidence desc, category, title, statement)::int as rank from f""")
def doc13_concerns(spark, sf):
    ch, ev, _, land = _signal_inputs(spark, sf)
    return Doc.concerns(ch, ev, land)


@query(f"with {_SIGNAL_SQL} select sig.company, upper(sig.company) as name, country, type, direction, strength from sig join (select source as company, min(lang) as country from documents where text is not null group by 1) l on sig.company = l.company")
def doc15_signal_feed(spark, sf):
    ch, ev, docs, land = _signal_inputs(spark, sf)
    found = Doc.signals(ch, ev, docs, land, soft=("with",))
    return Doc.signal_feed(found, docs.select("company", F.upper("company").alias("name")), land)


@query()
def doc01_html_text(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", T.html_lines(F.col("html")).alias("text"))


@query(r"""with d as (select source, l.quality, d.doc_id, len(string_split(text, chr(10))) >= 2 as s from documents d left join labels l on d.doc_id = l.doc_id), g as (select source, count(*) as n, avg(s::int) as st, avg((quality is not null)::int) as co from d group by 1)
select source, n, round_even(st, 3) as structure, round_even(co, 3) as completeness, round_even(100 * (0.5 * 0.8 + 0.2 * st + 0.15 * co + 0.15), 0)::int as score from g""")
def agg15_reliability(spark, sf):
    lab = D.table(spark, sf, "labels").select("doc_id", "quality")
    d = D.table(spark, sf, "documents").join(lab, "doc_id", "left")
    docs = d.select("source", F.lit(0.8).alias("authority"), (F.size(F.split("text", "\n", -1)) >= 2).alias("structured"), F.col("quality").isNotNull().alias("complete"), F.col("doc_id").alias("published"))
    none = docs.select("source").distinct().withColumn("errors", F.lit(0))
    return Doc.reliability(docs, none).select("source", "n", "structure", "completeness", "score")


@query("select case when event_id % 3 = 0 then event_type when event_id % 3 = 1 then 'src' || (event_id % 4) end as source, count(*) as n from events group by 1")
def agg16_errors(spark, sf):
    e = D.table(spark, sf, "events")
    k = F.col("event_id")
    m = F.when(k % 3 == 0, F.concat(F.lit("unknown source: "), "event_type")).when(k % 3 == 1, F.concat(F.lit("slug:src"), D.text(k % 4), F.lit(":label: broke"))).otherwise("free text")
    return e.select(Doc.error_source(m).alias("source")).groupBy("source").agg(F.count("*").alias("n"))


@query("""with g as (select item_id, unnest(range(1, len(w))) as i, w from (select item_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') as w from benchmark)),
names as (select distinct w[i] || ' ' || w[i + 1] as name from g where i < len(w)), d as (select doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') as w from documents),
x as (select doc_id, w, unnest(range(1, len(w))) as i from d) select distinct doc_id as doc, name from x join names on name = w[i] || ' ' || w[i + 1]""")
def jon18_mentions(spark, sf):
    b = D.table(spark, sf, "benchmark").select(F.split(N.normal_ascii(F.col("text")), " ").alias("w"))
    g = b.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.array_join(F.slice("w", i, 2), " "))).alias("name")).distinct().withColumn("key", F.col("name"))
    t = D.table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")
    return R.mentions(t, g, 2).select("doc", "name")


# ---- retrieval

_Q = "the that with idiot hand"


@query("select doc_id as doc, (contains(h, 'the')::int + contains(h, 'that')::int + contains(h, 'with')::int + contains(h, 'idiot')::int + contains(h, 'hand')::int) / 5 as lexical from (select doc_id, lower(source || ' ' || text) as h from documents where text is not null)")
def sim06_lexical(spark, sf):
    d = D.table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), F.col("source").alias("uri"), "text")
    return Ret.lexical(d, _Q)


_EMB = r"""(select doc, bucket, x / sqrt(sum(x * x) over (partition by doc)) as weight from (select doc, ('0x' || substr(sha256(w), 15, 2))::int as bucket, sum(case when ('0x' || substr(sha256('sign:' || w), 15, 2))::int % 2 = 0 then 1 else -1 end)::double as x
 from (select doc, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from {0}) group by 1, 2) where x <> 0)"""
_DOCS = "(select doc_id as doc, text from documents where text is not null)"


@query(f"select doc, bucket, round(weight, 6) as weight from {_EMB.format(_DOCS)}")
def sim07_embedding(spark, sf):
    d = D.table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), "text")
    return Ret.embed_sparse(d).select("doc", "bucket", F.round("weight", 6).alias("weight"))


@query(f"select q.doc as query, d.doc, round(sum(q.weight * d.weight), 6) + 0.0 as vector from {_EMB.format('(select item_id as doc, text from benchmark where item_id % 20 = 0)')} q join {_EMB.format(_DOCS)} d using (bucket) group by 1, 2")
def sim08_cosine(spark, sf):
    d = D.table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), "text")
    q = D.table(spark, sf, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("doc"), "text")
    return Ret.cosine_sparse(Ret.embed_sparse(q), Ret.embed_sparse(d)).select("query", "doc", (F.round("vector", 6) + F.lit(0.0)).alias("vector"))


@query("select a.vec_id as query, b.vec_id as doc, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine from embeddings a join embeddings b on a.label = b.label and a.vec_id % 20 = 0")
def sim08_dense_cosine(spark, sf):
    e = D.table(spark, sf, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"), "label")
    return Vec.cosines(q, e.select(F.col("vec_id").alias("key"), F.col("embedding").alias("v"), "label"), "label").select("query", F.col("key").alias("doc"), "cosine")


@query("""with e as (select vec_id, embedding::double[] as v from embeddings), s as (select a.vec_id as query, b.vec_id as doc, round(list_cosine_similarity(a.v, b.v), 6) as cosine from e a, e b where a.vec_id % 20 = 0)
select query, doc, cosine, rank::int as rank from (select *, row_number() over (partition by query order by cosine desc, doc) as rank from s) where rank <= 10""")
def top02_vector_search(spark, sf):
    """The stated query set: every vector whose number is divisible by 20, against all rows."""
    e = D.table(spark, sf, "embeddings")
    found = Vec.nearest(e.where("vec_id % 20 = 0"), Vec.build(e, "vec_id", "embedding", cells=64), 10, "vec_id", "embedding")
    return found.select("query", F.col("key").alias("doc"), F.col("score").alias("cosine"), "rank")


@query("""with i as (select distinct lower(w[1] || ' ' || w[2]) as v from (select string_split(text, ' ') as w from benchmark) where len(w) > 1 union select distinct lower(left(p_type, 4)) from part union select distinct lower(left(r_name, 2)) from region)
select doc_id as doc, v as value from documents join i on contains(lower(text), v)""")
def jon25_keyword_alerts(spark, sf):
    """Whole texts that contain a watched value anywhere: the first two words of each benchmark text, part types, short ones."""
    w = F.split("text", " ")
    b = D.table(spark, sf, "benchmark").where(F.size(w) > 1).select(F.lower(F.concat_ws(" ", w[0], w[1])).alias("v"))
    more = D.table(spark, sf, "part").select(F.lower(F.substring("p_type", 1, 4)).alias("v")).unionByName(D.table(spark, sf, "region").select(F.lower(F.substring("r_name", 1, 2)).alias("v")))
    docs = D.table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")
    return A.containing(docs, F.lower("text"), b.unionByName(more).distinct()).select("doc", F.col("v").alias("value"))


@query(f"""with v as (select d.doc, sum(q.weight * d.weight) as vector from {_EMB.format("(select 1 as doc, 'the that with idiot hand' as text)")} q join {_EMB.format(_DOCS)} d using (bucket) group by 1),
l as (select doc_id as doc, (contains(h, 'the')::int + contains(h, 'that')::int + contains(h, 'with')::int + contains(h, 'idiot')::int + contains(h, 'hand')::int) / 5 as lexical from (select doc_id, lower(source || ' ' || text) as h from documents where text is not null))
select doc, round(0.5 * coalesce(lexical, 0) + 0.5 * greatest(coalesce(vector, 0), 0), 6) as score from l full join v using (doc) order by 2 desc, 1 limit 20""")
def top03_hybrid(spark, sf):
    d = D.table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), F.col("source").alias("uri"), "text")
    q = spark.createDataFrame([(1, _Q)], "doc int, text string")
    vec = Ret.cosine_sparse(Ret.embed_sparse(q), Ret.embed_sparse(d)).select("doc", "vector")
    scored = Ret.blend(Ret.lexical(d, _Q), vec).withColumn("score", F.round("score", 6))
    return Ret.top_k(scored, 20)


@query("""with s as (select doc_id as doc, unnest(range(0, len(l))) as s_order, unnest(l) as content from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null)), h as (select doc, s_order, content[:280] as excerpt from s where contains(lower(content), 'idiot'))
select * from h union all select doc, s_order, content from s where s_order = 0 and doc not in (select doc from h)""")
def sim10_evidence(spark, sf):
    return Ret.evidence(_sections(spark, sf), ["idiot"]).select("doc", "s_order", "excerpt")


# ---- market and operations


def _prices(spark, sf):
    li = D.lines(spark, sf).select(D.text("l_partkey").alias("symbol"), F.to_date("o_orderdate").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    return li.groupBy("symbol", "ts").agg(F.avg("p").alias("price"))


_PRICES = "(select l_partkey::varchar as symbol, o_orderdate::date as ts, avg(l_extendedprice / l_quantity) as price from lineitem join orders on l_orderkey = o_orderkey group by 1, 2)"
_QUOTES = f"(select symbol, arg_max(ts, ts) as ts, arg_max(price, ts) as price, arg_max(coalesce(prev, -1), ts) as prev from (select *, lag(price) over (partition by symbol order by ts) as prev from {_PRICES}) group by 1)"


@query(f"select symbol, ts::varchar as ts, round(price, 8) as price, case when prev > 0 then round(100 * (price - prev) / prev, 4) end as change_pct from {_QUOTES}")
def win06_latest_quotes(spark, sf):
    q = M.latest_quotes(_prices(spark, sf))
    return q.select("symbol", D.text("ts").alias("ts"), F.round("price", 8).alias("price"), F.round("change_pct", 4).alias("change_pct"))


@query(f"select symbol from {_QUOTES} where epoch(timestamp '1998-06-30') - epoch(ts::timestamp) <= 86400 * 90")
def str04_fresh_quotes(spark, sf):
    return M.fresh(M.latest_quotes(_prices(spark, sf)), "1998-06-30 00:00:00", 86400 * 90).select("symbol")


_PARTS_HELD = "(select distinct o_custkey as fund, l_partkey::varchar as symbol, p_type as sector from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey)"


def _parts_held(spark, sf):
    p = D.table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("sector"))
    return D.lines(spark, sf).join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("o_custkey").alias("fund"), D.text("l_partkey").alias("symbol"), "sector").distinct()


@query(f"""with q as (select symbol, ts, case when prev > 0 then 100 * (price - prev) / prev end as c from {_QUOTES}) select fund, count(*) as total, count(c) as priced, round(avg(c), 4) as avg_change_pct, count_if(c > 0)::bigint as gainers, count_if(c < 0)::bigint as losers from {_PARTS_HELD} left join q using (symbol) group by 1""")
def agg17_portfolio_day(spark, sf):
    out = M.portfolio_day(_parts_held(spark, sf), M.latest_quotes(_prices(spark, sf)))
    return out.select("fund", "total", "priced", F.round("avg_change_pct", 4).alias("avg_change_pct"), "gainers", "losers")


@query(f"""with q as (select symbol, case when prev > 0 then 100 * (price - prev) / prev end as c from {_QUOTES}), h as (select fund, sector, count(*) as holdings, avg(c) as portfolio from {_PARTS_HELD} left join q using (symbol) group by 1, 2),
b as (select p_type as sector, min(p_partkey)::varchar as symbol from part group by 1)
select fund, h.sector, holdings, round(100 * holdings / sum(holdings) over (partition by fund), 4) as weight_pct, round(portfolio, 4) as portfolio, round(q.c, 4) as benchmark, round(portfolio - q.c, 4) as delta from h left join b on b.sector = h.sector left join q on q.symbol = b.symbol""")
def jon26_sector_benchmarks(spark, sf):
    proxies = D.table(spark, sf, "part").groupBy(F.col("p_type").alias("sector")).agg(F.min("p_partkey").cast("string").alias("symbol"))
    out = M.sector_benchmarks(_parts_held(spark, sf), M.latest_quotes(_prices(spark, sf)), proxies)
    return out.select("fund", "sector", "holdings", *(F.round(c, 4).alias(c) for c in ("weight_pct", "portfolio", "benchmark", "delta")))


@query("""select n_name as country, round(max(case when c_mktsegment = 'AUTOMOBILE' then s end), 2) as "AUTOMOBILE", round(max(case when c_mktsegment = 'BUILDING' then s end), 2) as "BUILDING" from nation left join (select c_nationkey, c_mktsegment, sum(c_acctbal) as s from customer group by 1, 2) on c_nationkey = n_nationkey group by 1""")
def jon27_country_macro(spark, sf):
    n = D.table(spark, sf, "nation").select(F.col("n_name").alias("country"), "n_nationkey")
    c = D.table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("country", F.col("c_mktsegment").alias("indicator")).agg(F.sum("c_acctbal").alias("value"))
    idx = n.select("country", F.col("n_nationkey").alias("index_quote"))
    out = M.country_macro(n.select("country"), c, idx, ["AUTOMOBILE", "BUILDING"])
    return out.select("country", F.round("AUTOMOBILE", 2).alias("AUTOMOBILE"), F.round("BUILDING", 2).alias("BUILDING"))


@query("select user_id as user, event_type as action, count(*) as n from events where ts >= timestamp '2024-01-15' group by 1, 2")
def agg18_usage(spark, sf):
    e = D.table(spark, sf, "events").select(F.col("user_id").alias("user"), F.col("event_type").alias("action"), "ts")
    return M.usage(e, "2024-01-15 00:00:00")


@query("""with p as (select user_id as user, max(10 * (1 + event_id % 3)) as lim from events group by 1), u as (select user_id as user, count(*) as used from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-11' group by 1)
select user, lim as "limit", coalesce(used, 0) as used, greatest(0, lim - coalesce(used, 0)) as remaining, coalesce(used, 0) < lim as within from p left join u using (user)""")
def agg19_quota(spark, sf):
    e = D.table(spark, sf, "events")
    members = e.select(F.col("user_id").alias("user"), F.concat(F.lit("plan"), D.text(F.col("event_id") % 3)).alias("plan"), (10 * (1 + F.col("event_id") % 3)).alias("limit"))
    calls = e.where("ts >= timestamp '2024-01-10 00:00:00' and ts < timestamp '2024-01-11 00:00:00'").select(F.col("user_id").alias("user"))
    return M.quota(members, calls).select("user", "limit", "used", "remaining", "within")


@query("select user_id as user, count(*) as total, count_if(event_id % 3 <> 0)::bigint as unread from events group by 1")
def agg20_notifications(spark, sf):
    return A.totals(D.table(spark, sf, "events").select(F.col("user_id").alias("user"), (F.col("event_id") % 3 == 0).alias("read")))


@query("select count_if(event_id % 3 <> 0 and user_id = 7)::bigint as changed, count_if(event_id % 3 = 0 or user_id = 7)::bigint as read_now from events")
def snk07_mark_read(spark, sf):
    e = D.table(spark, sf, "events").select("user_id", (F.col("event_id") % 3 == 0).alias("read"))
    return A.mark_read(e, F.col("user_id") == 7).agg(F.count_if("changed").alias("changed"), F.count_if("read").alias("read_now"))


@query("select user_id as user, event_type as kind, arg_max(event_id, (ts, event_id)) as event_id, round(arg_max(value, (ts, event_id)), 4) as value from events group by 1, 2")
def snk03_upsert(spark, sf):
    e = D.table(spark, sf, "events").select(F.col("user_id").alias("user"), F.col("event_type").alias("kind"), "event_id", "ts", "value")
    return M.latest_rows(e, ["user", "kind"], ["ts", "event_id"]).select("user", "kind", "event_id", F.round("value", 4).alias("value"))


@query("select event_id, event_type from events order by ts desc, event_id desc limit 50")
def top07_timeline(spark, sf):
    return M.newest(D.table(spark, sf, "events"), "ts", "event_id", 50).select("event_id", "event_type")


@query("select user_id as user, max(ts) is null or epoch(timestamp '2024-01-31') - epoch(max(ts)) >= 3 * 86400 as due from events group by 1")
def fn27_due(spark, sf):
    e = D.table(spark, sf, "events").groupBy(F.col("user_id").alias("user")).agg(F.max("ts").alias("last"))
    return e.select("user", N.is_due(F.col("last"), F.lit(3), F.lit("2024-01-31 00:00:00").cast("timestamp")).alias("due"))


@query("select user_id as user, strftime(ts, '%Y-%m-%d') as day, count(*) as n, count(*) > 3 as over from events group by 1, 2")
def str03_daily_usage(spark, sf):
    from ..streaming import jobs

    e = D.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), "ts")
    return jobs.usage_windows(e, "1 day", 3).select(F.col("key").cast("long").alias("user"), F.date_format("start", "yyyy-MM-dd").alias("day"), "n", "over")


# ---- scalar functions over table columns


@query(r"""select p_partkey as k, coalesce(nullif(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'entity') as slug,
substr(sha256(p_partkey || ':' || p_name), 1, 16) as id, regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') as ticker, upper(trim(p_brand)) as isin from part""")
def fn01_keys(spark, sf):
    p = D.table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("k"), N.slug(F.col("p_name")).alias("slug"), N.hash_id(D.text("p_partkey"), F.col("p_name")).alias("id"), N.ticker_key(F.col("p_brand")).alias("ticker"), N.clean_isin(F.col("p_brand")).alias("isin"))


@query(r"""select s_suppkey as k, array_to_string(list_filter(string_split(n, ' '), lambda x: x not in ('holdings', 'inc', 'the', 'co', 'group')), ' ') as core, trim(regexp_replace(regexp_replace(n, '(( |^)(corp|corporation|inc|incorporated|co|com|plc|ltd|lp|sa|ag|nv))+$', ''), '^the( |$)', '')) as company
from (select s_suppkey, 'the ' || trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) || ' group co inc' as n from supplier)""")
def fn05_cores(spark, sf):
    raw = F.concat(F.lit("The "), F.col("s_name"), F.lit(" Group, Co. INC"))
    return D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), N.org_core(N.normal_ascii(raw)).alias("core"), N.company_core(raw).alias("company"))


@query("select doc_id as doc, trim(regexp_replace(lower(strip_accents(replace(text, 'ß', 'ss'))), '[^a-z0-9]+', ' ', 'g')) as name from documents where text is not null")
def fn03_normal_name(spark, sf):
    d = D.table(spark, sf, "documents").where("text is not null")
    return d.select(F.col("doc_id").alias("doc"), N.normal_name(F.col("text")).alias("name"))


@query("""select n_nationkey as k, case n_nationkey % 4 when 0 then 'US' when 1 then 'GB' when 2 then 'DE' end as country from nation""")
def fn09_country(spark, sf):
    k = F.col("n_nationkey") % 4
    j = F.when(k == 0, "Delaware").when(k == 1, " England and Wales ").when(k == 2, "GERMANY").otherwise("Atlantis")
    return D.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), N.jurisdiction_country(j).alias("country"))


@query("select o_orderkey as k, o_orderdate::date::varchar as d, round(o_totalprice)::bigint is not null as ok, trunc(o_totalprice)::bigint as n from orders")
def fn19_dates_numbers(spark, sf):
    o = D.table(spark, sf, "orders")
    fmt = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select(F.col("o_orderkey").alias("k"), D.text(N.parse_date(fmt)).alias("d"), F.col("o_totalprice").isNotNull().alias("ok"), N.to_int(F.format_number("o_totalprice", 4)).alias("n"))


@query(r"""select doc_id as doc, regexp_replace(array_to_string(w[1:9], ' '), '[.,;:]+$', '') || case when len(w) > 9 then '…' else '' end as headline from (select doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0b]+'), lambda x: x <> '') as w from documents where text is not null)""")
def fn22_headline(spark, sf):
    return D.table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), N.headline(F.col("text")).alias("headline"))


@query(f"select a.company, b.company as other, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) as j from (select company, list(distinct sub_industry) as s from {IN_SECTOR} group by 1) a join (select company, list(distinct sub_industry) as s from {IN_SECTOR} group by 1) b on a.company::bigint + 1 = b.company::bigint")
def sim01_jaccard(spark, sf):
    s = D.in_sector(spark, sf).groupBy(F.col("source_key").alias("company")).agg(F.collect_set("sub_industry").alias("s"))
    o = s.select(F.col("company").alias("other"), F.col("s").alias("t"), (F.col("company").cast("long") - 1).alias("k"))
    return s.withColumn("k", F.col("company").cast("long")).join(o, "k").select("company", "other", F.round(N.jaccard(F.col("s"), F.col("t")), 6).alias("j"))
