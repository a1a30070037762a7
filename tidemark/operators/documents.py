"""Document analytics: sections, sentences, summaries, events, changes, signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import names as N
from ..functions import text as T

#: Categories that make an event.
EVENTS = ["product", "m&a", "executive", "regulatory", "litigation", "guidance", "capital_allocation", "supply_chain"]

#: Buckets of a summary and the section titles of commentary.
BUCKETS = {
    "risks": ["risk", "supply_chain", "litigation", "regulatory"],
    "opportunities": ["opportunity", "product"],
    "financials": ["financial", "capital_allocation", "guidance"],
    "commentary": ["guidance", "executive"],
    "events": ["product", "m&a", "executive", "regulatory", "capital_allocation", "litigation"],
}
COMMENTARY_TITLES = ["management", "discussion", "outlook", "remarks", "guidance"]

#: Categories that are not material.
IMMATERIAL = ["general", "financial"]

#: Headings of filings by form, as patterns on lower-case text.
HEADINGS = {
    "10-K": r"(?m)^\s*(item\s+\d+[a-z]?\.[^\n]{0,120})$",
    "10-Q": r"(?m)^\s*((?:part\s+[iv]+|item\s+\d+[a-z]?)[.,\s][^\n]{0,120})$",
    "8-K": r"(?m)^\s*(item\s+\d+\.\d+[^\n]{0,120})$",
    "": r"(?m)^\s*(item\s+\d+[a-z]?[^\n]{0,120})$",
}


def split_sections(text: Column, heading: str, fallback: str) -> Column:
    """Sections between headings as (order, title, content); text before the first is dropped, empty ones too; else one section of the whole text (DOC-02, DOC-03)."""
    whole = F.coalesce(text, F.lit(""))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    titles = F.transform(F.regexp_extract_all(whole, F.lit(heading), F.lit(1)), strip)
    bodies = F.transform(F.split(whole, heading), strip)
    pairs = F.filter(F.zip_with(titles, F.slice(bodies, F.lit(2), F.greatest(F.size(bodies) - 1, F.lit(0))), lambda t, b: F.struct(t.alias("title"), b.alias("content"))), lambda s: F.coalesce(s["content"], F.lit("")) != "")
    pairs = F.when(F.size(pairs) > 0, pairs).otherwise(F.array(F.struct(F.lit(fallback).alias("title"), whole.alias("content"))))
    return F.transform(pairs, lambda s, i: F.struct((i + 1).alias("order"), s["title"].alias("title"), s["content"].alias("content")))


def markdown_sections(text: Column) -> Column:
    """Sections under ``## Title`` lines, else one named Document (DOC-03)."""
    return split_sections(text, r"(?m)^## +([^\n]+)$", "Document")


def filing_sections(form: Column, text: Column) -> Column:
    """Sections by the headings of the form, else by general ones, else one Raw Filing (DOC-02)."""
    out = split_sections(text, HEADINGS[""], "Raw Filing")
    for name, pattern in HEADINGS.items():
        if name:
            own = split_sections(text, "(?i)" + pattern, "")
            out = F.when((form == name) & (own[0]["title"] != ""), own).otherwise(out)
    return out


def sentence_table(sections: DataFrame, verbs: list[str] = T.VERBS, cues: dict = T.CUES) -> DataFrame:
    """One row for each disclosure sentence of (doc, s_order, title, content): place, sentence, category (FLT-07, DOC-07, DOC-08).

    Summary, events and changes all read this table; store it once.
    """
    x = sections.select("doc", "s_order", "title", F.posexplode(T.sentences(F.col("content"))).alias("i", "sentence"))
    x = x.where(T.is_disclosure(F.col("sentence"), verbs))
    return x.withColumns({"seq": F.col("s_order").cast("long") * 1_000_000 + F.col("i"), "category": T.primary_category(F.col("sentence"), cues), "categories": T.categories(F.col("sentence"), cues), "norm": T.normal_statement(F.col("sentence"))})


def events(sent: DataFrame) -> DataFrame:
    """Action sentences, each text once per document (DOC-10, WIN-04)."""
    one = sent.where(F.col("category").isin(EVENTS)).groupBy("doc", "sentence").agg(F.min_by(F.struct("seq", "title", "category"), "seq").alias("r"))
    return one.select("doc", "r.seq", "r.category", "r.title", "sentence", N.headline(F.col("sentence")).alias("headline"), T.confidence(F.col("r.category")).alias("confidence"))


def key_points(sent: DataFrame, limit: int = 6) -> DataFrame:
    """The first sentence of each section title, the first six of a document (WIN-03, DOC-09)."""
    first = sent.groupBy("doc", "title").agg(F.min_by(F.struct("seq", "sentence", "category"), "seq").alias("r"))
    k = F.row_number().over(W.partitionBy("doc").orderBy("r.seq"))
    return first.withColumn("k", k).where(F.col("k") <= limit).select("doc", "k", "title", "r.sentence", "r.category")


def buckets(sent: DataFrame, limit: int = 6) -> DataFrame:
    """(doc, bucket, k, sentence, category): up to six claims for each bucket, each text once (TOP-08, DOC-09)."""
    parts = []
    for name, wanted in BUCKETS.items():
        has = F.size(F.array_intersect("categories", F.array(*map(F.lit, wanted)))) > 0
        if name == "commentary":
            for cue in COMMENTARY_TITLES:
                has = has | F.lower("title").contains(cue)
        # categories come in the table's order, so the first wanted one is the most specific
        cat = F.coalesce(F.get(F.array_intersect("categories", F.array(*map(F.lit, wanted))), F.lit(0)), F.col("category"))
        parts.append(F.when(has, F.struct(F.lit(name).alias("bucket"), cat.alias("category"))))
    x = sent.select("doc", "seq", "sentence", F.explode(F.array_compact(F.array(*parts))).alias("b"))
    one = x.groupBy("doc", "b.bucket", "sentence").agg(F.min_by(F.struct("seq", "b.category"), "seq").alias("r"))
    k = F.row_number().over(W.partitionBy("doc", "bucket").orderBy("r.seq"))
    return one.withColumn("k", k).where(F.col("k") <= limit).select("doc", "bucket", "k", "sentence", "r.category")


def previous(docs: DataFrame, latest_only: bool = False) -> DataFrame:
    """(doc, previous) of the same company and source, by period and place (WIN-02)."""
    w = W.partitionBy("company", "source").orderBy("period", "doc")
    out = docs.withColumn("previous", F.lag("doc").over(w)).withColumn("last", F.lead("doc").over(w).isNull())
    return (out.where("last") if latest_only else out).select("doc", "company", "source", "previous")


def changes(sent: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc, previous, kind, category, statement, norm, confidence, rank): added and removed statements of consecutive documents (DOC-11, SET-01).

    One aggregate finds the first original of each statement; both sides then meet in one aggregate over (pair, statement), not in two anti joins.
    """
    first = sent.where("norm <> ''").groupBy("doc", "norm").agg(F.min_by(F.struct("sentence", "category"), "seq").alias("r"))
    p = pairs.where("previous is not null").select("doc", "previous")
    now = p.join(first, "doc").select("doc", "previous", "norm", "r", F.lit(1).alias("side"))
    then = p.join(first.withColumnRenamed("doc", "previous"), "previous").select("doc", "previous", "norm", "r", F.lit(2).alias("side"))
    both = now.unionByName(then).groupBy("doc", "previous", "norm").agg(F.sum("side").alias("side"), F.min("r").alias("r"))
    out = both.where("side < 3").select("doc", "previous", F.when(F.col("side") == 1, "added").otherwise("removed").alias("kind"), F.col("r.category").alias("category"), F.col("r.sentence").alias("statement"), "norm")
    return out.withColumns({"confidence": T.confidence(F.col("category")), "rank": T.materiality(F.col("category"))})


def change_sets(ch: DataFrame) -> DataFrame:
    """(doc, added, removed, material) (AGG-22, FLT-08)."""
    return ch.groupBy("doc").agg(F.count_if(F.col("kind") == "added").alias("added"), F.count_if(F.col("kind") == "removed").alias("removed"), F.bool_or(~F.col("category").isin(IMMATERIAL)).alias("material"))


#: Signals and their labels.
SIGNALS = {
    "management_confidence": "Management confidence", "emerging_risk": "Emerging risk", "supply_chain_stress": "Supply-chain stress", "hiring": "Hiring activity",
    "patent_momentum": "Patent momentum", "capital_allocation": "Capital allocation trend", "geopolitical": "Geopolitical exposure",
}
#: Words of weakened guidance.
SOFT = ("lower", "soft")
#: Categories that make a risk.
RISKY = ["risk", "regulatory", "litigation"]


def signals(ch: DataFrame, ev: DataFrame, docs: DataFrame, countries: DataFrame, soft: tuple = SOFT) -> DataFrame:
    """(company, type, label, direction, strength, rationale) by seven rules over material changes (company, kind, category, statement),
    events (company, category), documents (company, document_type) and countries (company, country) (DOC-12, TOP-06). ``signal_evidence`` tells what each rests on."""
    risk = F.col("category").isin(RISKY)
    low = F.lower("statement")
    weak = reduce(lambda a, b: a | b, (low.contains(w) for w in soft))
    c = ch.groupBy("company").agg(
        F.count_if(F.col("category") == "guidance").alias("guidance"), F.count_if((F.col("category") == "guidance") & weak).alias("lowered"),
        F.count_if(risk & (F.col("kind") == "added")).alias("risk_changes"), F.count_if(F.col("category") == "supply_chain").alias("supply"), F.count_if(F.col("category") == "capital_allocation").alias("capital"),
    )
    e = ev.groupBy("company").agg(F.count_if(risk).alias("risk_events"))
    d = docs.groupBy("company").agg(F.count_if(F.col("document_type") == "job_posting").alias("jobs"), F.count_if(F.col("document_type") == "patent").alias("patents"))
    g = countries.groupBy("company").agg(F.array_sort(F.collect_set("country")).alias("lands"))
    x = d.join(c, "company", "full").join(e, "company", "full").join(g, "company", "full").na.fill(0).withColumn("countries", F.greatest(F.size("lands"), F.lit(0)))
    total = F.col("risk_changes") + F.col("risk_events")

    def rule(when: Column, name: str, direction: Column, strength: Column, *said: Column | str) -> Column:
        rationale = F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in said))
        return F.when(when, F.struct(F.lit(name).alias("type"), F.lit(SIGNALS[name]).alias("label"), direction.alias("direction"), F.bround(F.least(F.lit(0.8), strength), 2).alias("strength"), rationale.alias("rationale")))

    up, elevated, lowered = F.lit("up"), F.lit("elevated"), F.col("lowered") > 0
    # fixed values: strengths, directions and rationales
    rules = F.array_compact(F.array(
        rule(F.col("guidance") > 0, "management_confidence", F.when(lowered, "down").otherwise("up"), F.when(lowered, 0.62).otherwise(0.55), "Guidance language ", F.when(lowered, "weakened").otherwise("held/strengthened"), " in the latest disclosure."),
        rule(total > 0, "emerging_risk", elevated, 0.55 + 0.05 * F.least(F.lit(3), total), total, " new risk/regulatory/legal signal(s) versus the prior period."),
        rule(F.col("supply") > 0, "supply_chain_stress", elevated, F.lit(0.6), "Supplier-related changes versus the prior disclosure."),
        rule(F.col("jobs") > 0, "hiring", up, F.lit(0.5), F.col("jobs"), " active job posting(s) signal investment in capacity."),
        rule(F.col("patents") > 0, "patent_momentum", up, F.lit(0.5), F.col("patents"), " patent record(s) indicate ongoing R&D output."),
        rule(F.col("capital") > 0, "capital_allocation", elevated, F.lit(0.55), "Capital-allocation language changed versus the prior disclosure."),
        rule(F.col("countries") > 0, "geopolitical", elevated, 0.5 + 0.05 * F.col("countries"), "Supply chain spans ", F.array_join("lands", ", "), "."),
    ))
    return x.select("company", F.explode(rules).alias("s")).select("company", "s.*")


def signal_evidence(ch: DataFrame, ev: DataFrame, docs: DataFrame, countries: DataFrame) -> DataFrame:
    """(company, type, place, statement): the first statements that each signal rests on (DOC-12).

    From changes (company, doc, kind, category, statement), events (company, doc, seq, category, sentence), documents (company, doc, document_type, title) and
    countries (company, country). Guidance and capital allocation cite one change, supply chain two, risk two added changes and one event, hiring and
    patents one document. First is by document, added before removed, then by sequence or text; Spark keeps so many rows of a company before its shuffle.
    """
    category, kind = F.col("category"), F.col("kind")
    of = F.when(category == "guidance", "management_confidence").when(category.isin(RISKY) & (kind == "added"), "emerging_risk").when(category == "supply_chain", "supply_chain_stress").when(category == "capital_allocation", "capital_allocation")
    a = ch.select("company", of.alias("type"), F.lit(0).alias("part"), "doc", F.when(kind == "added", 0).otherwise(1).cast("long").alias("at"), "statement")
    b = ev.where(category.isin(RISKY)).select("company", F.lit("emerging_risk").alias("type"), F.lit(2).alias("part"), "doc", F.col("seq").cast("long").alias("at"), F.col("sentence").alias("statement"))
    made = F.when(F.col("document_type") == "job_posting", "hiring").when(F.col("document_type") == "patent", "patent_momentum")
    d = docs.select("company", made.alias("type"), F.lit(0).alias("part"), "doc", F.lit(0).cast("long").alias("at"), F.coalesce("title", "document_type").alias("statement"))
    order = W.partitionBy("company", "type", "part").orderBy("doc", "at", "statement")
    first = a.unionByName(b).unionByName(d).where("type is not null").withColumn("k", F.row_number().over(order)).where("k <= 2")
    two = (F.col("type") == "supply_chain_stress") | ((F.col("type") == "emerging_risk") & (F.col("part") == 0))
    first = first.where(two | (F.col("k") == 1)).select("company", "type", (F.col("part") + F.col("k")).alias("place"), "statement")
    g = countries.where("country is not null").groupBy("company").agg(F.array_join(F.array_sort(F.collect_set("country")), ", ").alias("lands"))
    said = F.concat("company", F.lit(" is exposed to "), "lands", F.lit(" via its suppliers."))
    return first.unionByName(g.select("company", F.lit("geopolitical").alias("type"), F.lit(1).alias("place"), said.alias("statement")))


def cited(found: DataFrame, evidence: DataFrame) -> DataFrame:
    """``signals`` with ``evidence``, an array of at most three statements in order (DOC-12)."""
    own = evidence.groupBy("company", "type").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "statement"))), lambda x: x["statement"]).alias("evidence"))
    return found.join(own, ["company", "type"], "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))


#: Category, title, severity, confidence of the risk lens and of the opportunity lens.
RISKS = [
    ("guidance", "Forward guidance changed", "high", 0.72), ("executive", "Leadership change", "medium", 0.6), ("regulatory", "Regulatory exposure", "high", 0.72),
    ("litigation", "Legal / litigation exposure", "high", 0.7), ("supply_chain", "Supply-chain risk", "high", 0.7), ("capital_allocation", "Capital allocation shift", "medium", 0.58),
    ("risk", "New or heightened risk", "medium", 0.6), ("m&a", "M&A activity", "medium", 0.58), ("product", "Product / roadmap shift", "low", 0.5),
]
OPPORTUNITIES = [
    ("opportunity", "Growth opportunity", "medium", 0.55), ("product", "Product / roadmap momentum", "medium", 0.55), ("m&a", "Strategic M&A", "medium", 0.55), ("capital_allocation", "Capital returns", "low", 0.5),
]


#: Order of severity.
SEVERITY = ["high", "medium", "low"]


def concerns(ch: DataFrame, ev: DataFrame, countries: DataFrame | None = None, rules: list = RISKS) -> DataFrame:
    """(company, title, category, severity, confidence, statement, rationale, rank): one for each category and statement, changes before events (DOC-13).

    Changes are (company, kind, category, statement), events (company, category, sentence); a column ``source`` of either names the kind of document in the rationale.
    ``rules`` are those of a lens, ``RISKS`` or ``OPPORTUNITIES``. With ``countries`` (company, country, supplier), for the risk lens, each country that a company's suppliers
    work in is one more. ``rank`` orders a company's concerns by severity, then confidence (TOP-05).
    """
    source = lambda t: F.col("source") if "source" in t.columns else F.lit("filing")
    a = ch.select("company", "category", "statement", F.when(F.col("kind") == "added", 0.05).otherwise(0.0).alias("bonus"), F.lit(0).alias("first"), F.concat(F.initcap("kind"), F.lit(" in "), source(ch)).alias("how"))
    b = ev.select("company", "category", F.col("sentence").alias("statement"), F.lit(0.0).alias("bonus"), F.lit(1).alias("first"), F.concat(F.lit("Event ("), source(ev), F.lit(")")).alias("how"))
    x = a.unionByName(b).withColumn("norm", T.normal_statement(F.col("statement")))
    one = x.groupBy("company", "category", "norm").agg(F.min_by(F.struct("statement", "bonus", "how"), F.struct("first", -F.col("bonus"), "statement", "how")).alias("r"))
    table = F.create_map(*(y for c, t, s, v in rules for y in (F.lit(c), F.struct(F.lit(t).alias("title"), F.lit(s).alias("severity"), F.lit(v).alias("base")))))
    out = one.withColumn("rule", table[F.col("category")]).where("rule is not null")
    conf = F.bround(F.least(F.lit(0.8), F.col("rule.base") + F.col("r.bonus")), 2)
    out = out.select("company", "rule.title", "category", "rule.severity", conf.alias("confidence"), F.col("r.statement").alias("statement"), F.concat("r.how", F.lit(": "), "r.statement").alias("rationale"))
    if countries is not None:
        # the suppliers of one company in one country, which its own list bounds
        g = countries.where("country is not null").groupBy("company", "country").agg(F.array_join(F.array_sort(F.collect_set("supplier")), ", ").alias("suppliers"))
        said = F.concat(F.col("company"), F.lit(" relies on "), F.col("suppliers"), F.lit(" in "), F.col("country"), F.lit("."))
        why = F.concat(F.col("company"), F.lit(" depends on "), F.col("suppliers"), F.lit(" operating in "), F.col("country"), F.lit(", creating concentration/geopolitical exposure."))
        out = out.unionByName(g.select("company", F.concat(F.lit("Geopolitical exposure to "), F.col("country")).alias("title"), F.lit("supply_chain").alias("category"), F.lit("medium").alias("severity"), F.lit(0.55).alias("confidence"), said.alias("statement"), why.alias("rationale")))
    place = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("severity"))
    order = W.partitionBy("company").orderBy(place, F.col("confidence").desc(), "category", "title", "statement")
    return out.withColumn("rank", F.row_number().over(order))


def reliability(docs: DataFrame, errors: DataFrame) -> DataFrame:
    """Score and tier of every source from (source, authority, structured, complete, published) and (source, errors) (AGG-15)."""
    d = docs.groupBy("source").agg(F.max("authority").alias("authority"), F.count("*").alias("n"), F.avg(F.col("structured").cast("double")).alias("structure"), F.avg(F.col("complete").cast("double")).alias("completeness"), F.max("published").alias("latest"))
    x = d.join(errors, "source", "full").na.fill(0, ["n", "errors"]).na.fill(0.0, ["authority", "structure", "completeness"])
    tried = F.col("n") + F.col("errors")
    success = F.when(tried > 0, F.col("n") / tried).otherwise(0.0)
    raw = 0.5 * F.col("authority") + 0.2 * F.col("structure") + 0.15 * F.col("completeness") + 0.15 * success
    score = F.bround(100 * raw, 0).cast("int")
    out = x.select("source", "n", F.bround("structure", 3).alias("structure"), F.bround("completeness", 3).alias("completeness"), F.bround(success, 3).alias("success"), score.alias("score"), "latest")
    return out.withColumn("tier", F.when(F.col("score") >= 85, "high").when(F.col("score") >= 70, "medium").otherwise("low"))


def error_source(message: Column) -> Column:
    """The source that an error line names (AGG-16)."""
    parts = F.split(message, ":")
    return F.when(message.startswith("unknown source:"), F.trim(F.regexp_replace(message, "^unknown source:", ""))).when(F.size(parts) >= 2, parts[1])


def subsidiary_pairs(lines: Column, places: list[str], self_core: Column, limit: int = 30) -> Column:
    """(name, place): a line that is a known place, with the line before it (DOC-04, JON-21)."""
    low = F.transform(lines, lambda x: F.lower(N.normal_jurisdiction(x)))
    at = F.filter(F.transform(low, lambda x, i: F.when((i > 0) & x.isin(places), i)), lambda i: i.isNotNull())
    found = F.transform(at, lambda i: F.struct(F.trim(F.get(lines, i - 1)).alias("name"), F.trim(F.get(lines, i)).alias("place")))
    # the parent's own entry and headers go
    good = F.filter(found, lambda p: F.length(p["name"]).between(3, 90) & ~N.normal_ascii(p["name"]).contains(self_core) & ~F.lower(p["name"]).rlike("^(name|subsidiary|jurisdiction)"))
    return F.slice(good, 1, limit)


def officers(lines: Column, limit: int = 20) -> Column:
    """(name, age, role): a two-digit age from 35 to 95 between a name and a role; two or more, or none (DOC-05)."""
    at = F.filter(F.transform(lines, lambda x, i: F.when((i > 0) & F.trim(x).rlike(r"^\d{2}$") & F.trim(x).try_cast("int").between(35, 95), i)), lambda i: i.isNotNull())
    found = F.transform(at, lambda i: F.struct(F.trim(F.get(lines, i - 1)).alias("name"), F.trim(F.get(lines, i)).cast("int").alias("age"), F.trim(F.get(lines, i + 1)).alias("role")))
    named = F.filter(found, lambda p: p["name"].rlike(r"^[A-Z][^\d]{2,60}$") & p["role"].isNotNull())
    return F.when(F.size(named) >= 2, F.slice(named, 1, limit)).otherwise(F.slice(named, 1, 0))


def signers(text: Column, anchor: str = "pursuant to the requirements", limit: int = 20) -> Column:
    """(name, role) of ``/s/`` lines within 4000 characters after the anchor; the role within three lines (DOC-06)."""
    at = F.locate(anchor, F.lower(text))
    tail = F.when(at > 0, F.substring(text, at, F.lit(4000))).otherwise("")
    lines = F.filter(F.transform(F.split(tail, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    place = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"(?i)^/s/\s*\S"), i)), lambda i: i.isNotNull())
    role = lambda i: F.coalesce(*(F.when(F.get(lines, i + k).rlike("(?i)officer|director|president|chair|treasurer|secretary"), F.get(lines, i + k)) for k in (1, 2, 3)))
    found = F.transform(place, lambda i: F.struct(F.trim(F.regexp_replace(F.get(lines, i), r"(?i)^/s/\s*", "")).alias("name"), role(i).alias("role")))
    return F.slice(F.filter(found, lambda p: p["role"].isNotNull() & ~p["name"].rlike("(?i)llp|llc|inc")), 1, limit)


def signal_feed(found: DataFrame, roster: DataFrame, countries: DataFrame) -> DataFrame:
    """(company, name, country, type, direction, strength), the strongest first: signals of all companies with their names (company, name) and countries (company, country) (DOC-15, TOP-06)."""
    names = roster.groupBy("company").agg(F.min("name").alias("name"))
    lands = countries.groupBy("company").agg(F.min("country").alias("country"))
    out = found.join(names, "company", "left").join(lands, "company", "left").select("company", F.coalesce("name", "company").alias("name"), "country", "type", "direction", "strength")
    return out.orderBy(F.desc("strength"), "company", "type")


def attached(metadata: Column) -> Column:
    """The entities that a document's metadata names: its company and its filing, (kind, key, name) each (DOC-17)."""
    one = lambda kind, key, name: F.when(F.coalesce(metadata[key], F.lit("")) != "", F.struct(F.lit(kind).alias("kind"), metadata[key].alias("key"), F.coalesce(metadata[name], metadata[key]).alias("name")))
    return F.array_compact(F.array(one("Company", "company_slug", "company_name"), one("Filing", "accession_number", "title")))


#: Exhibit numbers that are looked for, in order.
EXHIBITS = ["21", "23", "31", "32"]


def exhibit_reference(text: Column, url: Column) -> Column:
    """(title, number, url) of the exhibit that a text mentions, null where it mentions none (DOC-18)."""
    low = F.lower(text)
    number = F.coalesce(*(F.when(low.contains(f"exhibit {n}"), n) for n in EXHIBITS))
    return F.when(low.contains("exhibit"), F.struct(F.lit("Exhibit Reference").alias("title"), number.alias("number"), url.alias("url")))


def labelled_cell(html: Column, label: str) -> Column:
    """The value beside a label in a page's table: within 300 signs, up to the cell's end, after the last tag, references decoded (DOC-18)."""
    at = F.instr(F.lower(html), label.lower())
    cell = F.element_at(F.split(F.substring_index(html.substr(at, F.lit(300)), "</td>", 1), ">"), -1)
    return F.when(at > 0, N.blank_to_null(F.regexp_replace(T.decoded(cell), r"^[ :\n\t\r]+|[ :\n\t\r]+$", "")))


def labelled_value(text: Column, label: str) -> Column:
    """The rest of a line after ``label:`` (DOC-18)."""
    return N.blank_to_null(F.regexp_extract(text, rf"(?im)^\s*{label}\s*:\s*([^\n]+)$", 1))


def split_bad(rows: DataFrame, parsed: Column, raw: str) -> tuple[DataFrame, DataFrame]:
    """(good, dead letters): rows that a ``try_`` expression could read, and those with the raw text and an error (DOC-16)."""
    x = rows.withColumn("_v", parsed)
    good = x.where("_v is not null").withColumnRenamed("_v", "value")
    return good, x.where("_v is null").select(F.col(raw).alias("raw"), F.lit("unreadable").alias("error"))
