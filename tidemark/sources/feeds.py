"""Readers of feeds. Each gives rows, or rows and what was left out with its reason.

Files are read by Spark with declared schemas; nothing is parsed on the driver but a header line.
"""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import names as N

#: Headers that name a column, first match wins.
ALIASES = {
    "symbol": ["symbol", "ticker", "security id", "tidm", "epic"],
    "name": ["name of company", "security name", "company name", "company", "issuer name", "name"],
    "isin": ["isin number", "isin no", "isin code", "isin"],
    "sedol": ["sedol"],
    "series": ["series"],
    "code": ["security code"],
    "status": ["status"],
    "instrument": ["instrument"],
    "market": ["market"],
    "company_number": ["company number"],
    "industry": ["icb industry", "industry"],
    "country": ["country of incorporation"],
}


def fold_header(name: str) -> str:
    return re.sub(r"\s+", " ", name).strip().lower()


def with_aliases(df: DataFrame, wanted: list[str], aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """Columns under their plain names; one that no header names is null (SRC-15). Work on the schema only."""
    have: dict[str, str] = {}
    for c in df.columns:
        have.setdefault(fold_header(c), c)
    out = []
    for w in wanted:
        found = next((have[a] for a in aliases[w] if a in have), None)
        out.append((F.lit(None).cast("string") if found is None else N.blank_to_null(F.col(f"`{found}`"))).alias(w))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("mode", "PERMISSIVE").csv(path)


def _files(spark: SparkSession, path: str, rule: Column) -> tuple[list[str], list[str]]:
    """Files with a line that meets ``rule``, and the others; only their names come to the driver, as in listing a folder."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.coalesce(rule, F.lit(False)).alias("hit"))
    found = lines.groupBy("file").agg(F.bool_or("hit").alias("hit")).collect()
    return [unquote(r["file"]) for r in found if r["hit"]], [unquote(r["file"]) for r in found if not r["hit"]]


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """Objects of JSON files, each an array, an envelope or lines; the form is found for every file by itself."""
    value = F.trim("value")
    whole, lines = _files(spark, path, value.startswith("[") | (value == "{"))
    parts = [spark.read.schema(schema).option("multiLine", multi).json(files) for multi, files in ((True, whole), (False, lines)) if files]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def split_by(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, counts): rows without a reason, and how many had each; kept and counted add up to the rows read."""
    x = rows.withColumn("_why", reason)
    return x.where("_why is null").drop("_why"), x.where("_why is not null").groupBy(F.col("_why").alias("reason")).agg(F.count("*").alias("n"))


def graph_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a snapshot; places are insertion order, doubles go by the graph's rules (SRC-01)."""
    from ..operators.graph import upsert_edges, upsert_nodes

    props = "map<string,string>"
    schema = f"nodes array<struct<kind:string,key:string,properties:{props}>>, edges array<struct<source_kind:string,source_key:string,relation:string,target_kind:string,target_key:string,properties:{props}>>"
    j = spark.read.schema(schema).option("multiLine", True).json(path)
    n = j.select(F.posexplode("nodes").alias("seq", "x")).select("x.kind", "x.key", F.col("seq").cast("long"), F.col("x.properties")["name"].alias("name"), F.col("x.properties").alias("props"))
    e = j.select(F.posexplode("edges").alias("seq", "x")).select("x.source_kind", "x.source_key", "x.relation", "x.target_kind", "x.target_key", F.col("seq").cast("long"), F.col("x.properties")["source"].alias("source"), F.col("x.properties")["access_tier"].alias("access_tier"), F.col("x.properties").alias("props"))
    return upsert_nodes(n), upsert_edges(e)


DOCUMENT = "document_type string, source_uri string, canonical_id string, title string, published_at string, language string, sections array<struct<title:string,content:string,`order`:int>>, entities array<struct<kind:string,key:string,name:string>>, metadata map<string,string>, _corrupt string"


def normalized_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents of all JSON files below a folder, and the unreadable ones (SRC-02)."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    x = raw.select(F.col("value"), F.from_json("value", DOCUMENT, {"columnNameOfCorruptRecord": "_corrupt"}).alias("d"))
    good = x.where("d._corrupt is null and d.canonical_id is not null").select("d.*").drop("_corrupt")
    return good, x.where("d._corrupt is not null or d.canonical_id is null").select(F.col("value").alias("raw"), F.lit("unreadable").alias("error"))


def us_issuers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Issuers of a positional envelope (SRC-03)."""
    j = spark.read.schema("fields array<string>, data array<array<string>>").option("multiLine", True).json(path)
    row = j.select("fields", F.posexplode("data").alias("pos", "r"))
    at = lambda f: F.get(F.col("r"), (F.array_position("fields", f) - 1).cast("int"))
    x = row.select("pos", N.registrant_number(at("cik")).alias("cik"), N.blank_to_null(at("name")).alias("name"), N.blank_to_null(at("ticker")).alias("ticker"), at("exchange").alias("exchange"), F.size("r").alias("n"), F.size("fields").alias("m"))
    why = F.when(F.col("n") != F.col("m"), "malformed").when(F.col("cik").isNull(), "no_cik").when(~N.real_exchange(F.coalesce("exchange", F.lit(""))), "otc_or_blank_exchange").when(F.col("name").isNull(), "malformed")
    kept, gone = split_by(x, why)
    return kept.select("pos", "cik", "name", "ticker", "exchange"), gone


def nse_equities(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Equity series of the first Indian list (SRC-04)."""
    x = with_aliases(read_csv(spark, path), ["symbol", "name", "series", "isin"]).withColumn("isin", N.clean_isin(F.col("isin")))
    why = F.when(F.col("symbol").isNull() | F.col("name").isNull(), "malformed").when(~F.upper(F.coalesce("series", F.lit(""))).isin("EQ", "BE"), "non_equity_series").when(F.col("isin").isNull(), "no_isin")
    return split_by(x, why)


def bse_scrips(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Active equity of the second Indian list, files of CSV or JSON side by side (SRC-05)."""
    wanted = ["code", "symbol", "name", "status", "isin", "instrument"]
    value = F.trim("value")
    lists, tables = _files(spark, path, value.startswith("[") | value.startswith("{"))
    parts = []
    if lists:
        raw = spark.read.text(lists, wholetext=True).select(F.col("value").alias("v"))
        rows = F.coalesce(F.try_variant_get(F.try_parse_json("v"), "$.Table", "array<map<string,string>>"), F.try_variant_get(F.try_parse_json("v"), "$", "array<map<string,string>>"))
        m = raw.select(F.explode(rows).alias("m"))
        parts.append(m.select(*(N.blank_to_null(_first(F.col("m"), ALIASES[w])).alias(w) for w in wanted)))
    # every table has its own header
    parts += [with_aliases(read_csv(spark, t), wanted) for t in tables]
    x = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], ", ".join(f"{w} string" for w in wanted))
    x = x.withColumn("isin", N.clean_isin(F.col("isin")))
    why = F.when(F.col("code").isNull() | F.col("name").isNull(), "malformed").when(F.lower(F.coalesce("status", F.lit(""))) != "active", "not_active").when(~F.lower(F.coalesce("instrument", F.lit("equity"))).contains("equity"), "non_equity").when(F.col("isin").isNull(), "no_isin")
    return split_by(x, why)


def _first(values: Column, keys: list[str]) -> Column:
    """The value of the first key that a map has, whatever the case of its letters."""
    folded = F.transform_keys(values, lambda k, v: F.lower(F.regexp_replace(k, r"[\s_]+", " ")))
    return F.coalesce(*(folded[k] for k in keys))


def lse_companies(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """London companies with up to four anchors; AIM by the segment's name (SRC-06)."""
    x = with_aliases(read_csv(spark, path), ["name", "symbol", "isin", "sedol", "company_number", "market", "industry", "country"]).withColumn("isin", N.clean_isin(F.col("isin")))
    pairs = F.array(*(F.struct(F.lit(s).alias("scheme"), F.col(c).alias("value")) for s, c in (("isin", "isin"), ("sedol", "sedol"), ("gb-coh", "company_number"), ("ticker", "symbol"))))
    x = x.withColumn("segment", F.when(F.upper("market").contains("AIM"), "AIM").otherwise("Main Market")).withColumn("anchors", F.filter(pairs, lambda a: a["value"].isNotNull()))
    return split_by(x, F.when(F.col("name").isNull() | F.col("symbol").isNull(), "malformed"))


def index_constituents(spark: SparkSession, path: str, index_key: str, index_name: str, source: str) -> DataFrame:
    """Rows with an ISIN or a symbol (SRC-07)."""
    x = with_aliases(read_csv(spark, path), ["name", "symbol", "isin"]).withColumn("isin", N.clean_isin(F.col("isin")))
    return x.where("isin is not null or symbol is not null").withColumns({"index_key": F.lit(index_key), "index_name": F.lit(index_name), "source": F.lit(source)})


def watchlist(spark: SparkSession, path: str) -> DataFrame:
    """Listed persons and entities with their names, topics, countries and births (SRC-08). Arrays and lines alike."""
    p = "name array<string>, alias array<string>, topics array<string>, country array<string>, birthDate array<string>"
    schema = f"id string, caption string, schema string, datasets array<string>, first_seen string, last_seen string, properties struct<{', '.join(x.replace(' ', ':', 1) for x in p.split(', '))}>"
    j = read_json(spark, path, schema).where("id is not null")
    none = F.array().cast("array<string>")
    get = lambda c: F.coalesce(F.col(f"properties.{c}"), none)
    names = F.array_distinct(F.concat(F.array_compact(F.array("caption")), get("name"), get("alias")))
    return j.select("id", F.col("schema").alias("kind"), names.alias("names"), get("topics").alias("topics"), get("country").alias("countries"), get("birthDate").alias("births"), F.coalesce("datasets", none).alias("datasets"), "first_seen", "last_seen")


def lei_records(spark: SparkSession, path: str) -> DataFrame:
    """LEI records of an envelope, a list or lines (SRC-09)."""
    ent = "struct<legalName:struct<name:string>,otherNames:array<struct<name:string>>,legalAddress:struct<country:string>,jurisdiction:string,status:string>"
    item = f"attributes:struct<lei:string,entity:{ent}>,lei:string,name:string,country:string,status:string"
    schema = T.StructType.fromDDL(f"data array<struct<{item}>>, " + item.replace("attributes:", "attributes ", 1).replace(",lei:string,name:string,country:string,status:string", ", lei string, name string, country string, status string"))
    j = read_json(spark, path, schema)
    one = j.select(F.explode(F.coalesce("data", F.array(F.struct("attributes", "lei", "name", "country", "status")))).alias("r"))
    a = F.col("r.attributes")
    others = F.coalesce(F.transform(a["entity"]["otherNames"], lambda n: n["name"]), F.array().cast("array<string>"))
    name = F.coalesce(a["entity"]["legalName"]["name"], F.col("r.name"))
    out = one.select(F.coalesce(a["lei"], F.col("r.lei")).alias("lei"), F.array_distinct(F.concat(F.array_compact(F.array(name)), others)).alias("names"), F.coalesce(a["entity"]["legalAddress"]["country"], F.col("r.country")).alias("country"), (F.upper(F.coalesce(a["entity"]["status"], F.col("r.status"), F.lit("ACTIVE"))) == "ACTIVE").alias("active"))
    return out.where("lei is not null")


#: The two consolidation types of LEI relationships, and the statuses in force.
CONSOLIDATION = ["IS_DIRECTLY_CONSOLIDATED_BY", "IS_ULTIMATELY_CONSOLIDATED_BY"]
IN_FORCE = ["ACTIVE", "PUBLISHED"]


def lei_relationships(spark: SparkSession, path: str) -> DataFrame:
    """(parent, child, valid_from, valid_to): consolidations in force, each pair once (SRC-10)."""
    rel = "relationship:struct<startNode:struct<id:string>,endNode:struct<id:string>,relationshipType:string,relationshipStatus:string,relationshipPeriods:array<struct<startDate:string,endDate:string,periodType:string>>>"
    j = spark.read.schema(T.StructType.fromDDL(f"data array<struct<attributes:struct<{rel}>>>")).option("multiLine", True).json(path)
    x = j.select(F.posexplode("data").alias("pos", "d")).select("pos", "d.attributes.relationship.*")
    x = x.where(F.col("relationshipType").isin(CONSOLIDATION) & F.upper(F.coalesce("relationshipStatus", F.lit(""))).isin(IN_FORCE))
    period = F.coalesce(F.get(F.filter("relationshipPeriods", lambda p: p["periodType"] == "ACCOUNTING_PERIOD"), F.lit(0)), F.get("relationshipPeriods", F.lit(0)))
    x = x.select(F.col("endNode.id").alias("parent"), F.col("startNode.id").alias("child"), N.parse_date(F.substring(period["startDate"], 1, 10)).alias("valid_from"), N.parse_date(F.substring(period["endDate"], 1, 10)).alias("valid_to"), "pos")
    x = x.where("parent is not null and child is not null")
    return x.groupBy("parent", "child").agg(F.min_by(F.struct("valid_from", "valid_to"), "pos").alias("r")).select("parent", "child", "r.*")


def ownership_statements(spark: SparkSession, path: str) -> DataFrame:
    """(holder, holder_kind, holder_name, subject, subject_name, interest, percentage, percentage_band, start): statements joined by id; unresolved ones are left out (SRC-11)."""
    share = "struct<exact:double,minimum:double,maximum:double>"
    schema = f"statementID string, statementType string, name string, names array<struct<fullName:string>>, subject struct<describedByEntityStatement:string>, interestedParty struct<describedByPersonStatement:string,describedByEntityStatement:string>, interests array<struct<type:string,share:{share},startDate:string>>"
    j = spark.read.schema(T.StructType.fromDDL(schema)).option("multiLine", True).json(path)
    ent = j.where("statementType = 'entityStatement'").select(F.col("statementID").alias("id"), N.blank_to_null(F.col("name")).alias("ename"))
    per = j.where("statementType = 'personStatement'").select(F.col("statementID").alias("id"), F.coalesce(N.blank_to_null(F.get("names", F.lit(0))["fullName"]), N.blank_to_null(F.col("name")), F.lit("Unnamed person")).alias("pname"))
    own = j.where("statementType = 'ownershipOrControlStatement'").select("subject", "interestedParty", F.explode_outer("interests").alias("i"))
    band = N.share_text(F.col("i.share.exact"), F.col("i.share.minimum"), F.col("i.share.maximum"))
    x = own.select(F.col("subject.describedByEntityStatement").alias("subject"), F.coalesce(F.col("interestedParty.describedByPersonStatement"), F.col("interestedParty.describedByEntityStatement")).alias("holder"), F.col("i.type").alias("interest"), band.alias("s"), N.parse_date(F.col("i.startDate")).alias("start"))
    y = x.join(ent.select(F.col("id").alias("subject"), F.col("ename").alias("subject_name")), "subject").join(per.withColumnRenamed("id", "holder"), "holder", "left").join(ent.withColumnRenamed("id", "holder"), "holder", "left")
    y = y.where("pname is not null or ename is not null")
    return y.select("holder", F.when(F.col("pname").isNotNull(), "Person").otherwise("Company").alias("holder_kind"), F.coalesce("pname", "ename").alias("holder_name"), "subject", "subject_name", "interest", "s.percentage", "s.percentage_band", "start")


def control_register(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(company_number, name, kind, interest, band, notified, ceased) of a control register, lines or envelopes, and counts of what is no person (SRC-12)."""
    item = "struct<kind:string,name:string,name_elements:struct<forename:string,surname:string>,natures_of_control:array<string>,notified_on:string,ceased_on:string>"
    schema = T.StructType.fromDDL(f"company_number string, company_name string, data {item}, links struct<self:string>, items array<{item}>")
    j = read_json(spark, path, schema)
    number = F.coalesce("company_number", F.regexp_extract("links.self", "/company/([^/]+)", 1))
    x = j.select(number.alias("company_number"), F.explode(F.coalesce("items", F.array("data"))).alias("d")).where("d is not null")
    named = F.coalesce(N.blank_to_null(F.col("d.name")), N.blank_to_null(F.concat_ws(" ", "d.name_elements.forename", "d.name_elements.surname")))
    band = N.control_band(F.coalesce("d.natures_of_control", F.array().cast("array<string>")))
    why = F.when(F.col("d.kind") == "persons-with-significant-control-statement", "statement").when(F.col("d.kind").contains("super-secure"), "protected").when(~F.coalesce(F.col("d.kind"), F.lit("")).contains("person-with-significant-control"), "unknown_kind").when(named.isNull(), "no_name")
    kept, gone = split_by(x.withColumns({"name": named, "b": band}), why)
    kind = F.when(F.col("d.kind").startswith("individual"), "Person").otherwise("Company")
    return kept.select("company_number", "name", kind.alias("kind"), "b.interest", "b.band", N.parse_date(F.col("d.notified_on")).alias("notified"), N.parse_date(F.col("d.ceased_on")).alias("ceased")), gone


def fund_table(spark: SparkSession, path: str) -> DataFrame:
    """Positions of a fund's XML table, whatever its namespace (SRC-13)."""
    schema = "nameOfIssuer string, titleOfClass string, cusip string, value string, shrsOrPrnAmt struct<sshPrnamt:string,sshPrnamtType:string>"
    x = spark.read.format("xml").schema(schema).option("rowTag", "infoTable").option("ignoreNamespace", True).load(path)
    out = x.select(N.blank_to_null(F.col("nameOfIssuer")).alias("issuer"), F.trim("titleOfClass").alias("title"), F.upper(F.trim("cusip")).alias("cusip"), N.to_int(F.col("value")).alias("value"), N.to_int(F.col("shrsOrPrnAmt.sshPrnamt")).alias("shares"), F.col("shrsOrPrnAmt.sshPrnamtType").alias("share_type"))
    return out.where("issuer is not null")


def insider_form(spark: SparkSession, path: str) -> DataFrame:
    """One row for each insider form: names in reading order, the last balance, flags (SRC-14)."""
    own = "reportingOwnerId:struct<rptOwnerName:string>,reportingOwnerRelationship:struct<isDirector:string,isOfficer:string,officerTitle:string>"
    hold = "postTransactionAmounts:struct<sharesOwnedFollowingTransaction:struct<value:string>>"
    schema = T.StructType.fromDDL(f"issuer struct<issuerCik:string,issuerTradingSymbol:string>, reportingOwner struct<{own}>, nonDerivativeTable struct<nonDerivativeTransaction:array<struct<{hold}>>,nonDerivativeHolding:array<struct<{hold}>>>")
    x = spark.read.format("xml").schema(schema).option("rowTag", "ownershipDocument").load(path)
    none = F.array().cast("array<string>")
    amounts = lambda c: F.coalesce(F.transform(F.col(f"nonDerivativeTable.{c}"), lambda t: t["postTransactionAmounts"]["sharesOwnedFollowingTransaction"]["value"]), none)
    all_ = F.filter(F.concat(amounts("nonDerivativeTransaction"), amounts("nonDerivativeHolding")), lambda v: v.isNotNull())
    rel = F.col("reportingOwner.reportingOwnerRelationship")
    flag = lambda c: F.lower(F.trim(c)).isin("1", "true")
    return x.select(N.registrant_number(F.col("issuer.issuerCik")).alias("cik"), F.upper(F.trim("issuer.issuerTradingSymbol")).alias("ticker"), N.reorder_insider(F.col("reportingOwner.reportingOwnerId.rptOwnerName")).alias("owner"), N.to_int(F.when(F.size(all_) > 0, F.element_at(all_, -1))).alias("shares"), F.coalesce(flag(rel["isDirector"]), F.lit(False)).alias("is_director"), F.coalesce(flag(rel["isOfficer"]), F.lit(False)).alias("is_officer"), N.blank_to_null(rel["officerTitle"]).alias("title"))


def brokerage(spark: SparkSession, path: str) -> DataFrame:
    """Holdings with any of four keys; lines with none are no holdings (SRC-16)."""
    x = with_aliases(read_csv(spark, path), ["symbol", "name", "isin", "sedol"])
    return x.where("symbol is not null or name is not null or isin is not null or sedol is not null")


def quotes(spark: SparkSession, path: str) -> DataFrame:
    """Quotes of chart JSON lines; without a price or a prior close there is none (SRC-17)."""
    meta = "struct<symbol:string,regularMarketPrice:double,chartPreviousClose:double,previousClose:double,currency:string,marketState:string,regularMarketTime:bigint>"
    j = spark.read.schema(T.StructType.fromDDL(f"chart struct<result:array<struct<meta:{meta}>>>")).json(path)
    m = j.select(F.get("chart.result", F.lit(0))["meta"].alias("m")).select("m.*")
    prior = F.coalesce("chartPreviousClose", "previousClose")
    x = m.select("symbol", F.timestamp_seconds("regularMarketTime").alias("ts"), F.col("regularMarketPrice").alias("price"), prior.alias("previous_close"), "currency", F.col("marketState").alias("market_state"))
    return x.where("price is not null and previous_close is not null and previous_close <> 0").withColumns({"change": F.col("price") - F.col("previous_close"), "change_pct": 100 * (F.col("price") - F.col("previous_close")) / F.col("previous_close")})


def indicator(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The most recent value of a country indicator (SRC-18)."""
    raw = spark.read.text(path, wholetext=True).select(F.try_variant_get(F.try_parse_json("value"), "$[1]", "array<struct<date:string,value:double>>").alias("rows"))
    return raw.select(F.lit(name).alias("indicator"), F.get(F.filter("rows", lambda r: r["value"].isNotNull()), F.lit(0)).alias("r")).where("r is not null").select("indicator", "r.date", "r.value")


def articles(spark: SparkSession, path: str, limit: int = 50) -> DataFrame:
    """News, each address once, blank titles out, in the feed's order (SRC-19)."""
    j = spark.read.schema("articles array<struct<title:string,url:string,domain:string,seendate:string,sourcecountry:string,language:string>>").option("multiLine", True).json(path)
    x = j.select(F.posexplode("articles").alias("pos", "a")).select("pos", "a.*").where("trim(title) <> '' and url is not null")
    one = x.groupBy("url").agg(F.min_by(F.struct("pos", "title", "domain", "seendate", "sourcecountry", "language"), "pos").alias("r")).select("url", "r.*")
    seen = F.try_to_timestamp(F.col("seendate"), F.lit("yyyyMMdd'T'HHmmss'Z'"))
    return one.withColumn("seen_at", seen).drop("seendate").orderBy("pos").limit(limit).drop("pos")


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """A judgement log with its order (SRC-21)."""
    item = "struct<left_kind:string,left_key:string,right_kind:string,right_key:string,verdict:string,score:double,method:string,decided_by:string,decided_at:string,note:string>"
    j = spark.read.schema(T.StructType.fromDDL(f"judgements array<{item}>")).option("multiLine", True).json(path)
    return j.select(F.posexplode("judgements").alias("seq", "x")).select("x.*", F.col("seq").cast("long").alias("seq"))


def filing_index(spark: SparkSession, path: str) -> DataFrame:
    """(name, is_subsidiary_list) of a filing's index (DOC-14)."""
    j = spark.read.schema("directory struct<item:array<struct<name:string,type:string>>>").option("multiLine", True).json(path)
    x = j.select(F.explode("directory.item").alias("i")).select("i.name", "i.type")
    return x.withColumn("is_subsidiary_list", F.lower("name").rlike(r"ex[-_]?(hibit)?[-_]?21.*\.html?$"))
