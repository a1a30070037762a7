"""Queries of panels, briefings and end-to-end runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import documents as Doc
from ..operators import market as M
from ..operators import panels as P
from ..operators import retrieval as Ret
from . import domain as D
from .analytics_queries import _CHANGES, _CUES, _GOOD, _VERBS, _changes, _cut_once, _periods, _sections, _sentences
from .domain import HOLDS, IN_SECTOR, OWN, RANK, REFS

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"select case relation when 'owns' then 'confirmed' else 'review' end as state, relation, count(*) as n from {OWN} where {RANK.format('access_tier')} <= 1 and valid_from <= date '1996-06-30' group by 1, 2")
def agg13_panel(spark, sf):
    return P.panel(D.ownership(spark, sf), ["owns"], ["beneficial_owner_of"], "legitimate-interest", "1996-06-30")


@query("""with h as (select source as company, doc_id as doc, doc_id * 7 % 1000 as seq from documents), k as (select *, row_number() over (partition by company order by seq desc, doc desc) as k from h)
select company, doc, seq from k where k <= 5 order by seq desc, doc desc limit 15""")
def jon28_briefing(spark, sf):
    d = D.table(spark, sf, "documents")
    ev = d.select(F.col("source").alias("company"), F.col("doc_id").alias("doc"), (F.col("doc_id") * 7 % 1000).alias("seq"))
    held = d.select(F.col("source").alias("company"))
    return P.briefing(held, ev)


@query(f"""with e as (select doc, min(seq) as seq, arg_min(category, seq) as category, sentence from {_GOOD} where category in ('executive', 'litigation', 'product', 'guidance') group by doc, sentence),
n as (select * from e order by seq desc, doc desc, sentence limit 40) select doc, seq, category from n where category in ('litigation') order by seq desc, doc desc limit 6""")
def agg21_dashboard_risks(spark, sf):
    docs = _periods(spark, sf)
    ev = Doc.events(_sentences(spark, sf))
    return P.dashboard(docs, ev)["risks"].select("doc", "seq", "category")


@query(f"""select (select count(*) from documents where text is not null) as documents, (select count(distinct source) from documents where text is not null) as companies, (select string_agg(s, ',' order by s) from (select distinct lang as s from documents where text is not null)) as sources,
(select count(*) from (select distinct doc, sentence from {_GOOD} where category in ('executive', 'litigation', 'product', 'guidance'))) as events, (select count(distinct doc) from {_CHANGES}) as change_sets, (select count(*) from (select doc from {_CHANGES} group by 1 having bool_or(category not in ('general', 'financial')))) as material""")
def agg23_run_report(spark, sf):
    sent = _cut_once(spark, sf)
    return P.run_report(_periods(spark, sf), Doc.events(sent), Doc.change_sets(_changes(spark, sf, sent)))


@query("select event_id % 50 as company, arg_min(d, (case when d = 'risk' then 0 else 1 end, event_id)) as direction from (select event_id, case when value > 90 then 'risk' when value > 50 then 'event' else 'opportunity' end as d from events) group by 1")
def win09_dominant_direction(spark, sf):
    v = F.col("value")
    e = D.table(spark, sf, "events").select((F.col("event_id") % 50).alias("company"), F.when(v > 90, "risk").when(v > 50, "event").otherwise("opportunity").alias("direction"), F.col("event_id").alias("seq"))
    return P.dominant_direction(e)


@query("""select strftime(ts, '%Y-%m-%d %H:%M:%S') as "when", kind, doc from (select ts, 'change' as kind, event_id as doc from events where event_id % 2 = 0 union all select case when event_id % 9 = 0 then null else ts end, 'event', event_id from events where event_id % 2 = 1)""")
def win07_commit_log(spark, sf):
    e = D.table(spark, sf, "events").select(F.col("ts").alias("when"), D.text("user_id").alias("company"), F.col("event_type").alias("title"), F.col("event_id").alias("doc"))
    ev = e.where("doc % 2 = 1").withColumn("when", F.when(F.col("doc") % 9 != 0, F.col("when")))
    return P.commit_log(e.where("doc % 2 = 0"), ev).select(F.date_format("when", "yyyy-MM-dd HH:mm:ss").alias("when"), "kind", "doc")


@query(f"select company, min_by(l, seq) as label from (select a as company, 'to ' || b as l, seq from {REFS}) group by 1")
def set07_first_labels(spark, sf):
    r = D.references(spark, sf).select(F.col("source_key").alias("company"), F.concat(F.lit("to "), "target_key").alias("label"), F.col("seq").alias("pos"))
    return P.first_labels(r)


@query(f"select company, k, key from (select a as company, b as key, row_number() over (partition by a order by min(seq), b)::int as k from {REFS} group by a, b) where k <= 6")
def top11_connected(spark, sf):
    return P.connected(D.references(spark, sf))


@query("""select l_suppkey as company, l_orderkey as person, case when l_quantity % 2 = 0 then (l_quantity / 2)::bigint else -1 end as shares, case when l_returnflag = 'A' then 'A' when l_linestatus = 'O' then 'Director' when l_linenumber = 1 then 'Officer' else 'Insider' end as role from lineitem""")
def jon23_person_holdings(spark, sf):
    li = D.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("company"), F.col("l_orderkey").alias("person"), (F.col("l_quantity") / 2).alias("shares"), F.when(F.col("l_returnflag") == "A", " A ").otherwise(" ").alias("title"), (F.col("l_linestatus") == "O").alias("is_director"), (F.col("l_linenumber") == 1).alias("is_officer"))
    return P.person_holdings(li).withColumn("shares", F.coalesce("shares", F.lit(-1)))


@query("select relation, count(*) as n, count(distinct target_key) as targets from (select 'affects_sector' as relation, unnest([p_type, p_brand]) as target_key from part where p_size <= 25 union all select 'issued_by', n_name from part join nation on p_partkey % 25 = n_nationkey where p_size > 25) group by 1")
def jon24_instruments(spark, sf):
    p = D.table(spark, sf, "part")
    c = p.where("p_size <= 25").select(D.text("p_partkey").alias("slug"), F.array("p_type", "p_brand").alias("affects_sectors"))
    d = p.where("p_size > 25").join(D.table(spark, sf, "nation"), F.col("p_partkey") % 25 == F.col("n_nationkey")).select(D.text("p_partkey").alias("slug"), F.col("n_name").alias("issuer_country"))
    return P.instrument_edges(c, d).groupBy("relation").agg(F.count("*").alias("n"), F.countDistinct("target_key").alias("targets"))


@query(f"""select s_suppkey::varchar as company, coalesce(x.sector, 'label ' || n_name) as sector, x.sector is null as from_label, r_name as tier from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
left join (select company, min_by(sector, seq) as sector from {IN_SECTOR} where company::bigint % 3 <> 0 group by 1) x on x.company = s_suppkey::varchar""")
def jon20_classify(spark, sf):
    n = D.table(spark, sf, "nation")
    c = D.companies(spark, sf).join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("key").alias("company"), F.col("n_name").alias("country"), F.concat(F.lit("label "), "n_name").alias("label"))
    paths = D.in_sector(spark, sf).where("cast(source_key as bigint) % 3 <> 0").groupBy(F.col("source_key").alias("company")).agg(F.min_by("sector", "seq").alias("sector"))
    tiers = n.join(D.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("country"), F.col("r_name").alias("tier"))
    return P.classify(c, paths, tiers)


@query(f"""select 'Fund ' || fund as source_key, 'holds' as relation, company as target_key, c_name as far_name, 'in' as direction from {HOLDS} join customer on c_custkey = fund::bigint where company = '3' and {RANK.format('access_tier')} <= 0
union all select b, 'references', a, s_name, 'out' from (select distinct a as b, b as a from {REFS} where a = '3') join supplier on s_suppkey = a::bigint""")
def prj05_neighbourhood(spark, sf):
    cols = ["source_kind", "source_key", "relation", "target_kind", "target_key", "access_tier"]
    e = D.holds(spark, sf).withColumn("source_key", F.concat(F.lit("Fund "), "source_key")).select(*cols)
    r = D.references(spark, sf).where("source_key = '3'").withColumn("access_tier", F.lit("public")).select(*cols).distinct()
    funds = D.table(spark, sf, "customer").select(F.lit("Fund").alias("kind"), F.concat(F.lit("Fund "), D.text("c_custkey")).alias("key"), F.col("c_name").alias("name"))
    return P.neighbourhood(e.unionByName(r), D.companies(spark, sf).select("kind", "key", "name").unionByName(funds), "3")


@query("select doc_id as doc, source as p_source, (case when source = 'src1' then 0.9 else 0.5 end)::double as authority from documents")
def prj06_provenance(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", "source", F.lit("u").alias("uri"), F.lit("2024-01-01").alias("retrieved_at"), F.lit("p").alias("publisher"))
    a = d.where("source = 'src1'").select("source", F.lit(0.9).alias("authority")).distinct()
    return P.with_provenance(d, a).select(F.col("doc_id").alias("doc"), F.col("provenance.source").alias("p_source"), F.col("provenance.authority").alias("authority"))


@query("select doc_id as doc from documents where doc_id % 4 <= 1")
def flt05_visible_documents(spark, sf):
    d = D.table(spark, sf, "documents")
    tier = F.when(F.col("doc_id") % 4 == 0, F.lit(None)).otherwise(F.element_at(F.array(*map(F.lit, ["public", "legitimate-interest", "odd"])), (F.col("doc_id") % 4).cast("int")))
    return P.visible_documents(d.withColumn("metadata", F.create_map(F.lit("access_tier"), tier))).select(F.col("doc_id").alias("doc"))


@query("""select c_custkey as k, case when c_custkey % 2 = 0 then 'sanctioned' else 'screening_candidate' end as relation, case when c_custkey % 2 = 0 then 'confirmed' else 'review' end as review_status from customer where c_custkey % 20 = 0""")
def ers01_screening(spark, sf):
    c = D.table(spark, sf, "customer")
    k = F.col("c_custkey")
    name = N.normal_ascii(F.col("c_name"))
    people = c.where("c_custkey % 20 = 0").select(D.text(k).alias("key"), name.alias("name"), F.lit("US").alias("country"), F.lit(None).cast("string").alias("birth"), F.lit(False).alias("insider"))
    recs = c.select(F.concat(F.lit("w"), D.text(k)).alias("id"), name.alias("name"), F.array(F.lit("sanction.linked")).alias("topics"), F.array(F.when(k % 2 == 0, " us ").otherwise("FR")).alias("countries"), F.array().cast("array<string>").alias("births"))
    e = P.screen(people, recs, floor=0.99)["edges"]
    return e.select(F.col("source_key").cast("long").alias("k"), "relation", "review_status")


@query("""select s_suppkey as k, case when s_suppkey % 5 = 4 then 'unresolved' when s_suppkey % 3 = 0 or s_suppkey % 2 = 0 then 'resolved' else 'review' end as status from supplier""")
def ers02_anchoring(spark, sf):
    s = D.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    name = N.normal_ascii(F.concat(F.lit("n"), D.text(k), F.lit(" works")))
    nodes = s.select(D.text(k).alias("key"), name.alias("name"), F.lit("US").alias("country"), (k % 3 != 0).alias("subsidiary"))
    recs = s.where("s_suppkey % 5 <> 4").select(F.concat(F.lit("L"), D.text(k)).alias("id"), N.normal_ascii(F.concat(name, F.lit(" inc"))).alias("name"), F.when(k % 2 == 0, "US").otherwise("FR").alias("country"), F.lit(True).alias("active"))
    recs = recs.withColumn("name", F.regexp_replace("name", "^n", "n"))
    return P.anchor(nodes, recs, review_floor=0.97).select(F.col("key").cast("long").alias("k"), "status")


@query("""select s_suppkey::bigint as seq, case when s_suppkey % 2 = 0 then 'k' || s_suppkey else 'x-h-' || s_suppkey end as source_key, s_suppkey % 2 = 0 as holder_resolved, case when s_suppkey % 3 = 0 then 'restricted-authority' when s_suppkey % 2 = 0 then 'public' else 'legitimate-interest' end as access_tier from supplier""")
def ers09_ownership_ingest(spark, sf):
    k = F.col("s_suppkey")
    s = D.table(spark, sf, "supplier")
    none = F.lit(None).cast("string")
    recs = s.select(
        k.alias("seq"), F.when(k % 2 == 0, "owns").otherwise("beneficial_owner_of").alias("basis"), F.when(k % 3 == 0, "restricted-authority").alias("access_tier"), F.lit(25.0).alias("percentage"),
        F.when(k % 2 == 0, "lei").alias("holder_scheme"), F.when(k % 2 == 0, D.text(k)).alias("holder_value"), none.alias("holder_given_key"), F.concat(F.lit("H "), D.text(k)).alias("holder_name"),
        none.alias("subject_scheme"), none.alias("subject_value"), none.alias("subject_given_key"), F.concat(F.lit("S "), D.text(k)).alias("subject_name"),
    )
    anchors = s.select(F.lit("lei").alias("scheme"), D.text(k).alias("value"), F.concat(F.lit("k"), D.text(k)).alias("key"), k.alias("seq"))
    keys = s.select(F.concat(F.lit("k"), D.text(k)).alias("key"))
    return P.ingest_ownership(recs, anchors, keys).select("seq", "source_key", "holder_resolved", "access_tier")


@query("select l_suppkey as company, l_partkey as owner, arg_max(l_quantity, (l_orderkey, l_linenumber, l_quantity)) as shares from lineitem group by 1, 2")
def agg28_latest_filing(spark, sf):
    li = D.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("company"), F.col("l_partkey").alias("owner"), F.col("l_quantity").alias("shares"), "l_orderkey", "l_linenumber")
    return M.latest_rows(li, ["company", "owner"], ["l_orderkey", "l_linenumber", "shares"]).select("company", "owner", "shares")


@query("select 'lei' || (s_suppkey % 30) as value from supplier group by 1")
def fn28_covered_numbers(spark, sf):
    k = F.col("s_suppkey")
    c = D.table(spark, sf, "supplier").select(F.array(F.struct(F.lit("lei").alias("scheme"), F.concat(F.lit("lei"), D.text(k % 30)).alias("value")), F.struct(F.lit("isin").alias("scheme"), D.text(k).alias("value"))).alias("anchors"))
    return P.covered_numbers(c, "lei")


@query("select p_partkey as k, case when lower(p_type) like 'e%' then 'Essentials' when contains(lower(p_type), 'm') then 'Middle' else 'Other' end as sector from part")
def fn26_coarse_sector(spark, sf):
    return D.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), P.coarse_sector(F.col("p_type"), [("^e", "Essentials"), ("m", "Middle")]).alias("sector"))


@query(f"select a.doc, norm, 'added' as kind from (select distinct doc, norm from {_GOOD} where doc = 8 and norm <> '') a where norm not in (select norm from {_GOOD} where doc = 5) union all select 8, norm, 'removed' from (select distinct norm from {_GOOD} where doc = 5 and norm <> '') where norm not in (select norm from {_GOOD} where doc = 8)")
def set02_compare(spark, sf):
    d = D.table(spark, sf, "documents").where("doc_id = 8").select(F.col("doc_id").alias("doc"), F.lit(5).cast("long").alias("previous"))
    # only the two documents are cut into sentences
    s = Doc.sentence_table(_sections(spark, sf).where("doc in (5, 8)"), _VERBS, _CUES)
    return Doc.changes(s, d).select("doc", "norm", "kind")


@query("""select doc_id as doc, source || ' note ' || array_to_string(list_transform(string_split(text, chr(10)), lambda x: coalesce(lang, '') || ' ' || x), ' ') || ' ' || source as whole from documents where text is not null""")
def sim12_document_text(spark, sf):
    """Whole texts: each line is a section whose title is the language; the source is an entity."""
    sections = F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.coalesce("lang", F.lit("")).alias("title"), x.alias("content")))
    d = D.table(spark, sf, "documents").where("text is not null")
    return d.select(F.col("doc_id").alias("doc"), Ret.document_text(F.col("source"), F.lit("note"), sections, F.array(F.struct(F.col("source").alias("name")))).alias("whole"))


@query("""with h as (select doc_id, (contains(h, 'idiot')::int + contains(h, 'pathetic')::int) / 2 as score, source, left(text, 280) as excerpt from (select doc_id, source, text, lower(source || ' ' || text) as h from documents where text is not null)), t as (select * from h where score > 0 order by score desc, doc_id limit 3)
select string_agg('- ' || excerpt || ' [' || source || ']', chr(10) order by score desc, doc_id) as answer from t""")
def sim11_answer(spark, sf):
    d = D.table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), F.col("source").alias("uri"), "text")
    hits = Ret.lexical(d, "idiot pathetic").withColumnRenamed("lexical", "score").where("score > 0").join(d, "doc").withColumn("excerpt", F.substring("text", 1, 280))
    return Ret.answer(hits)
