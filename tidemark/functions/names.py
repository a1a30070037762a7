"""Column functions over names, keys and identifiers.

Two suffix rules live here on purpose: ``org_core`` drops designators anywhere
(screening and holdings), ``company_core`` pops legal forms at the end only (co-mentions, subsidiaries).
"""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Designators dropped anywhere in an organisation's name.
DESIGNATORS = [
    "inc", "incorporated", "corp", "corporation", "co", "company", "companies",
    "llc", "lp", "llp", "ltd", "limited", "plc", "sa", "ag", "nv", "bv", "gmbh",
    "ulc", "pjsc", "sarl", "spa", "srl", "oyj", "ab", "as", "kk", "pte",
    "holdings", "holding", "group", "the",
]

#: Legal forms dropped at the end of a company's name.
LEGAL_FORMS = ["corp", "corporation", "inc", "incorporated", "co", "com", "plc", "ltd", "lp", "sa", "ag", "nv"]

#: Parts of the United States that a filing may name.
US_PARTS = [
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida",
    "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine",
    "maryland", "massachusetts", "michigan", "minnesota", "mississippi", "missouri", "montana", "nebraska",
    "nevada", "new hampshire", "new jersey", "new mexico", "new york", "north carolina", "north dakota", "ohio",
    "oklahoma", "oregon", "pennsylvania", "rhode island", "south carolina", "south dakota", "tennessee", "texas",
    "utah", "vermont", "virginia", "washington", "west virginia", "wisconsin", "wyoming", "district of columbia",
    "puerto rico",
]

#: Other jurisdictions and their countries.
COUNTRIES = {
    "united states": "US", "usa": "US", "u s a": "US", "united kingdom": "GB", "england and wales": "GB",
    "england": "GB", "scotland": "GB", "wales": "GB", "great britain": "GB", "uk": "GB", "canada": "CA",
    "netherlands": "NL", "the netherlands": "NL", "germany": "DE", "france": "FR", "china": "CN", "hong kong": "HK",
    "japan": "JP", "india": "IN", "ireland": "IE", "switzerland": "CH", "luxembourg": "LU", "singapore": "SG",
    "australia": "AU", "brazil": "BR", "italy": "IT", "spain": "ES", "sweden": "SE", "belgium": "BE",
    "mexico": "MX", "bermuda": "BM", "cayman islands": "KY",
}


def _sql(text: str) -> str:
    return text.replace("'", "''")


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of a small fixed map, or null."""
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def blank_to_null(value: Column) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(F.trim(value), F.lit(""))


def slug(value: Column, fallback: str = "entity") -> Column:
    """Lower-case letters and digits joined by hyphens (FN-01)."""
    made = F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(made, F.lit("")), F.lit(fallback))


def normal_jurisdiction(value: Column) -> Column:
    """No-break spaces as spaces, trimmed (FN-02)."""
    return F.trim(F.translate(value, "\u00a0", " "))


def normal_name(name: Column) -> Column:
    """NFKD without marks, case-folded, runs of a-z0-9 joined by spaces (FN-03). No built-in function decomposes."""

    @F.pandas_udf("string")
    def of(names: pd.Series) -> pd.Series:
        def one(text):
            bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()
            return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in bare).split())

        return names.map(one, na_action="ignore")

    return of(name)


def normal_ascii(value: Column) -> Column:
    """Like ``normal_name`` for names of ASCII letters, without Python (FN-07)."""
    return F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "))


def tokens(normal: Column) -> Column:
    """The distinct words of a normalised name (FN-04)."""
    return F.array_distinct(F.filter(F.split(normal, " "), lambda t: t != ""))


def org_core(normal: Column) -> Column:
    """A normalised name without designators (FN-05)."""
    return F.array_join(F.filter(F.split(normal, " "), lambda t: ~t.isin(DESIGNATORS) & (t != "")), " ")


def company_core(name: Column) -> Column:
    """A name without legal forms at its end and a leading "the" (FN-06)."""
    forms = "|".join(LEGAL_FORMS)
    return F.trim(F.regexp_replace(F.regexp_replace(normal_ascii(name), f"((^| )({forms}))+$", ""), "^the( |$)", ""))


def jurisdiction_country(value: Column) -> Column:
    """Two-letter country of a jurisdiction, or null (FN-09)."""
    key = F.lower(normal_jurisdiction(value))
    return F.when(key.isin(US_PARTS), "US").otherwise(lookup(COUNTRIES, key))


def registrant_number(value: Column) -> Column:
    """A number as plain digits, or null (FN-10)."""
    return F.trim(value.cast("string")).try_cast("bigint").cast("string")


def clean_isin(value: Column) -> Column:
    return blank_to_null(F.upper(value))


def ticker_key(value: Column) -> Column:
    """Capitals and digits only, so that BRK.B equals BRK-B (FN-12)."""
    return F.regexp_replace(F.upper(value), "[^A-Z0-9]", "")


def reorder_insider(name: Column) -> Column:
    """LAST FIRST MIDDLE as First Middle Last, capitals after ' and - too (FN-13)."""
    parts = F.filter(F.split(F.trim(name), r"\s+"), lambda p: p != "")
    turned = F.when(F.size(parts) >= 2, F.concat(F.slice(parts, F.lit(2), F.size(parts) - 1), F.slice(parts, 1, 1))).otherwise(parts)
    cased = F.transform(turned, lambda p: F.array_join(F.transform(F.split(p, "(?<=['-])"), lambda q: F.initcap(q)), ""))
    return F.array_join(cased, " ")


def to_int(value: Column) -> Column:
    """A number with thousands separators, cut to its whole part (FN-14)."""
    return F.regexp_replace(F.trim(value), ",", "").try_cast("double").cast("bigint")


def real_exchange(value: Column) -> Column:
    """A named exchange that is not over the counter (FLT-06)."""
    return F.coalesce((F.trim(value) != "") & ~F.lower(value).contains("otc"), F.lit(False))


#: Holding-vehicle endings, bands and interests of control statements.
VEHICLES = ["-as-firm", "-as-trust", "-as-control-over-trust", "-as-control-over-firm"]
BANDS = ["25%-50%", "50%-75%", "75%-100%"]
NATURES = {
    "ownership-of-shares-25-to-50-percent": "25%-50%", "ownership-of-shares-50-to-75-percent": "50%-75%", "ownership-of-shares-75-to-100-percent": "75%-100%",
    "voting-rights-25-to-50-percent": "25%-50%", "voting-rights-50-to-75-percent": "50%-75%", "voting-rights-75-to-100-percent": "75%-100%",
}


def control_band(natures: Column) -> Column:
    """A struct of the first interest named and the widest band disclosed (FN-15)."""
    folded = F.transform(natures, lambda n: F.regexp_replace(F.lower(F.trim(n)), f"({'|'.join(VEHICLES)})$", ""))
    bands = F.filter(F.transform(folded, lambda n: lookup(NATURES, n)), lambda b: b.isNotNull())
    interests = F.transform(
        folded,
        lambda n: F.when(n.startswith("ownership-of-shares-") & lookup(NATURES, n).isNotNull(), "shareholding")
        .when(n.startswith("voting-rights-") & lookup(NATURES, n).isNotNull(), "voting-rights")
        .when(n.contains("right-to-appoint-and-remove"), "appoint-directors")
        .when(n.contains("significant-influence-or-control"), "significant-influence"),
    )
    # the bands' text order is also their order of width
    return F.struct(F.get(F.filter(interests, lambda i: i.isNotNull()), F.lit(0)).alias("interest"), F.array_max(bands).alias("band"))


def share_text(exact: Column, low: Column, high: Column) -> Column:
    """A struct of the exact percentage and the disclosed range, never both (FN-16)."""

    def shown(x: Column) -> Column:
        return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))

    band = (
        F.when(exact.isNotNull(), F.lit(None))
        .when(low.isNotNull() & high.isNotNull(), F.concat(shown(low), F.lit("%-"), shown(high), F.lit("%")))
        .when(low.isNotNull(), F.concat(F.lit("≥"), shown(low), F.lit("%")))
        .when(high.isNotNull(), F.concat(F.lit("≤"), shown(high), F.lit("%")))
    )
    return F.struct(exact.alias("percentage"), band.alias("percentage_band"))


def scheme(value: Column) -> Column:
    """An identifier scheme folded to a short name (FN-17)."""
    v = F.upper(F.trim(value))
    return F.when(v.contains("LEI"), "lei").when(v.contains("ISIN"), "isin").when(v.contains("GB-COH") | v.contains("COMPANIES HOUSE"), "gb-coh").otherwise(F.lower(v))


def best_anchor(ids: Column) -> Column:
    """The LEI among (scheme, value) structs, else the first (FN-17)."""
    return F.coalesce(F.get(F.filter(ids, lambda i: i["scheme"] == "lei"), F.lit(0)), F.get(ids, F.lit(0)))


def parse_date(value: Column) -> Column:
    """Dates of the two plain forms and of one with a time, else null (FN-19)."""
    text = F.trim(value)
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "yyyyMMdd"), F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss"))))


def headline(sentence: Column, words: int = 9) -> Column:
    """The first words without closing signs, with an ellipsis when cut (FN-22)."""
    parts = F.filter(F.split(sentence, r"\s+"), lambda p: p != "")
    start = F.regexp_replace(F.array_join(F.slice(parts, 1, words), " "), "[.,;:]+$", "")
    return F.concat(start, F.when(F.size(parts) > words, "…").otherwise(""))


def hash_id(*parts: Column, length: int = 16, sep: str = ":") -> Column:
    """The first digits of the SHA-256 of joined parts (FN-23)."""
    return F.substring(F.sha2(F.concat_ws(sep, *parts), 256), 1, length)


def excerpt(value: Column) -> Column:
    return F.substring(value, 1, 280)


def is_due(last: Column, cadence_days: Column, now: Column) -> Column:
    """Whether the time since ``last`` reaches the cadence; never run is due (FN-27)."""
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(last) >= cadence_days * 86400, F.lit(True))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token arrays (SIM-01)."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def blocks_ratio(a: Column, b: Column) -> Column:
    """Matching-blocks ratio (SIM-02); only for pairs that a bound lets through."""

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)], dtype="float64")

    return of(a, b)


def ratio_bound(a: Column, b: Column) -> Column:
    """The most that ``blocks_ratio`` can be for texts of these lengths: all of the shorter one matches."""
    return F.when(a + b > 0, 2 * F.least(a, b) / (a + b)).otherwise(1.0)


def certain_person_score(a: Column, b: Column) -> Column:
    """The cases of the person score that need no ratio, else null (SIM-03)."""
    ta, tb = tokens(a), tokens(b)
    same = (F.size(ta) == F.size(tb)) & (F.size(F.array_intersect(ta, tb)) == F.size(ta))
    return F.when((a == "") | (b == "") | a.isNull() | b.isNull(), 0.0).when(a == b, 1.0).when(same, 0.98)


def certain_org_score(a: Column, b: Column) -> Column:
    """The cases of the organisation score that need no ratio, else null (SIM-04)."""
    ta, tb = tokens(a), tokens(b)
    return (
        F.when((a == "") | (b == "") | a.isNull() | b.isNull(), 0.0)
        .when(a == b, 1.0)
        .when((org_core(a) != "") & (org_core(a) == org_core(b)), 0.97)
        .when((F.size(ta) > 0) & (F.size(F.array_except(ta, tb)) == 0), 0.90)
    )


def scored(pairs, a: str, b: str, floor: float, organisations: bool = False, into: str = "score"):
    """Pairs of normalised names with a score of at least ``floor``.

    A score of 0.5 J + 0.5 R can't reach the floor unless J >= 2 floor - R, and R is bounded by the lengths (``ratio_bound``); only
    such pairs reach Python. (0.0001 of slack, as scores are rounded before the test.)
    """
    sure = (certain_org_score if organisations else certain_person_score)(F.col(a), F.col(b))
    j = jaccard(tokens(F.col(a)), tokens(F.col(b)))
    marked = pairs.withColumns({"_sure": sure, "_j": j})
    known = marked.where(F.col("_sure").isNotNull() & (F.col("_sure") >= floor)).withColumn(into, F.col("_sure"))
    open_ = marked.where(F.col("_sure").isNull() & (F.col("_j") >= 2 * floor - 0.0001 - ratio_bound(F.length(a), F.length(b)) - 1e-9))
    open_ = open_.withColumn(into, F.bround(0.5 * F.col("_j") + 0.5 * blocks_ratio(F.col(a), F.col(b)), 4)).where(F.col(into) >= floor)
    return known.unionByName(open_).drop("_sure", "_j")
