"""Column functions over sentences and documents. Cue tables are parameters."""

from __future__ import annotations

import re
from functools import reduce
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Categories in order, most specific first, and the terms that show them.
CUES = {
    "executive": ["appointed", "named ceo", "named cfo", "chief executive", "chief financial", "resigned", "stepped down", "board of directors", "leadership change"],
    "m&a": ["acquire", "acquisition", "merger", "merge with", "divest", "takeover"],
    "capital_allocation": ["dividend", "buyback", "repurchase", "share repurchase", "capital allocation", "capital return"],
    "litigation": ["litigation", "lawsuit", "legal proceeding", "settlement", "court"],
    "regulatory": ["regulatory", "regulation", "antitrust", "investigation", "compliance", "sanction"],
    "supply_chain": ["supply chain", "supplier", "logistics", "inventory", "manufacturing capacity", "shortage"],
    "guidance": ["guidance", "outlook", "we expect", "forecast", "anticipate", "reaffirm", "full-year", "full year", "raised guidance", "lowered guidance"],
    "product": ["launch", "launched", "unveiled", "new product", "introduced", "released", "product initiative"],
    "financial": ["revenue", "margin", "operating income", "earnings", "cash flow", "expenditure", "profit", "financial performance"],
    "opportunity": ["growth", "opportunity", "expand", "expansion", "demand", "investment", "record", "momentum"],
    "risk": ["risk", "adverse", "uncertain", "decline", "headwind", "competition", "competitive", "disrupt", "challenge", "pressure"],
}

#: Verbs that make a fragment a sentence.
VERBS = (
    "is are was were be been being am will would shall should may might can could must "
    "has have had do does did expect expects expected anticipate anticipates believe believes "
    "intend intends plan plans seek seeks include includes included provide provides provided "
    "operate operates result results resulted affect affects affected require requires required "
    "continue continues remain remains face faces depend depends increase increased decrease "
    "decreased grow grew reduce reduced incur incurred recognize recognized estimate estimated "
    "assume rely relies maintain generate generated invest report reported issue issued offer "
    "represent represents drive driven impact impacts experience experienced use uses used "
    "contributed declined rose fell expanded launched acquired entered agreed announced reflect "
    "reflects exceed exceeds arise arises subject relates related cause causes caused"
).split()

#: Confidence by category, the value for others, and the ceiling.
CONFIDENCE = {
    "guidance": 0.78, "regulatory": 0.78, "litigation": 0.76, "supply_chain": 0.74, "executive": 0.7, "m&a": 0.7,
    "capital_allocation": 0.66, "risk": 0.66, "financial": 0.6, "opportunity": 0.6, "product": 0.58,
}
OTHER_CONFIDENCE, MAX_CONFIDENCE = 0.5, 0.8

#: Order of materiality.
MATERIALITY = ["guidance", "executive", "m&a", "litigation", "regulatory", "supply_chain", "capital_allocation", "risk", "product", "opportunity", "financial", "general"]

SENTENCE_END = r"""(?<=[.!?])\s+(?=[A-Z("'$\d])"""


def sentences(text: Column) -> Column:
    """Trimmed sentences; white space is one space first (DOC-07)."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.filter(F.transform(F.split(clean, SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")


def is_disclosure(sentence: Column, verbs: list[str] = VERBS) -> Column:
    """Reads as a sentence: six words, few numbers, four lower-case words, a verb (FLT-07).

    Parts and words are found once for each sentence, and only where what comes before lets it through; signs outside ASCII ask for slower patterns.
    """
    plain = F.length(sentence) == F.octet_length(sentence)
    parts = F.filter(F.split(sentence, r"\s+"), lambda p: p != "")
    numbers = lambda ps: F.when(sentence.rlike(r"\d"), F.size(F.filter(ps, lambda p: p.rlike(r"^\(?[$£€]?\d[\d,.–/%-]*\)?$")))).otherwise(0)
    found = lambda flag: F.regexp_extract_all(F.lower(sentence), F.lit(flag + r"\b([a-z][a-z']+)\b"), F.lit(1))
    ends = lambda flag: F.lower(sentence).rlike(flag + r"\b[a-z]{3,}(?:ed|ing)\b")
    verb = lambda ws: F.exists(ws, lambda w: w.isin(verbs)) | F.when(plain, ends("")).otherwise(ends("(?U)"))
    # a list of one, so that its value is made once and read several times
    once = lambda value, test: F.exists(F.array(value), test)
    filled = once(parts, lambda ps: (F.size(ps) >= 6) & (numbers(ps) / F.size(ps) <= 0.4))
    return filled & once(F.when(plain, found("")).otherwise(found("(?U)")), lambda ws: (F.size(ws) >= 4) & verb(ws))


def _shows(text: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(t) for t in terms))


def categories(sentence: Column, cues: dict[str, list[str]] = CUES) -> Column:
    """All categories whose terms appear, in the table's order (DOC-08)."""
    low = F.lower(sentence)
    return F.array_compact(F.array(*(F.when(_shows(low, terms), c) for c, terms in cues.items())))


def primary_category(sentence: Column, cues: dict[str, list[str]] = CUES) -> Column:
    """The first category that appears, else general (DOC-08)."""
    low = F.lower(sentence)
    return F.coalesce(*(F.when(_shows(low, terms), c) for c, terms in cues.items()), F.lit("general"))


def confidence(category: Column) -> Column:
    """Confidence by category, never over the ceiling (FN-24)."""
    table = F.create_map(*(F.lit(x) for pair in CONFIDENCE.items() for x in pair))
    return F.least(F.lit(MAX_CONFIDENCE), F.coalesce(table[category], F.lit(OTHER_CONFIDENCE)))


def materiality(category: Column) -> Column:
    """Place in the order of materiality; unknown ones last (TOP-04)."""
    at = F.array_position(F.array(*map(F.lit, MATERIALITY)), category)
    return F.when(at > 0, at - 1).otherwise(len(MATERIALITY)).cast("int")


def normal_statement(sentence: Column) -> Column:
    """Lower-case letters, digits and single spaces (FN-08)."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(sentence), "[^a-z0-9 ]+", ""), " +", " "))


def focus(question: Column) -> Column:
    """opportunity or risk (FN-30)."""
    return F.when(F.lower(question).rlike(r"\b(opportunit\w*|upside|bullish|tailwind\w*|catalyst\w*)\b"), "opportunity").otherwise("risk")


#: Tags without quotation marks inside values, end tags and document types: what all parsers read alike.
_PLAIN_TAG = re.compile(r"""<(?:/[A-Za-z][A-Za-z0-9]*\s*|[A-Za-z][A-Za-z0-9]*(?:\s+[A-Za-z][A-Za-z0-9-]*="[^"]*")*\s*/?|![Dd][Oo][Cc][Tt][Yy][Pp][Ee][^<>]*)>""")
_RAW_TEXT = re.compile("<(?:script|style)", re.IGNORECASE)


class _Texts(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found: list[str] = []

    def handle_data(self, data: str) -> None:
        self.found.append(data)


def page_text(html: str) -> str:
    """The texts of a page between its tags, character references decoded, one line each, without blank ones.

    Plain pages are cut by one pattern. Comments, scripts, unquoted values and anything else that is left over are for the standard library's parser, which is
    some ten times slower; so is a reference in the last text, as it could go on.
    """
    parts = _PLAIN_TAG.split(html)
    if "&" in parts[-1] or any("<" in x for x in parts) or _RAW_TEXT.search(html):
        parser = _Texts()
        parser.feed(html)
        parts = parser.found
    else:
        parts = [unescape(x) if "&" in x else x for x in parts]
    return "\n".join(t for x in parts if (t := x.strip()))


def html_lines(html: Column) -> Column:
    """Text between tags, one line each, blank lines dropped, character references decoded (DOC-01). Script text stays, as in plain tag stripping."""

    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else page_text(x) for x in pages], dtype=object)

    return of(html)


def decoded(text: Column) -> Column:
    """Character references as signs."""

    @F.pandas_udf("string")
    def of(values: pd.Series) -> pd.Series:
        return pd.Series([x if x is None or "&" not in x else unescape(x) for x in values], dtype=object)

    return of(text)
