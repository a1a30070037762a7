"""Feeds on small files of our own."""

import json

import pytest

from tidemark.sources import feeds as S


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text if isinstance(text, str) else json.dumps(text))
    return str(p)


def counts(df):
    return {r["reason"]: r["n"] for r in df.collect()}


def test_us_issuers(spark, tmp_path):
    p = put(tmp_path, "us.json", {"fields": ["cik", "name", "ticker", "exchange"], "data": [[12, "Alpha Inc", "ALF", "Nasdaq"], [13, "Beta", "", "OTC"], [14, "Gamma", "G", None], [None, "Delta", "D", "NYSE"], [15, "Eps", "E"]]})
    kept, gone = S.us_issuers(spark, p)
    assert [(r.cik, r.ticker) for r in kept.collect()] == [("12", "ALF")]
    assert counts(gone) == {"otc_or_blank_exchange": 2, "no_cik": 1, "malformed": 1}


def test_nse(spark, tmp_path):
    p = put(tmp_path, "nse.csv", "SYMBOL, NAME OF COMPANY, SERIES, ISIN NUMBER\n AAA , Alpha Ltd , EQ , ine001 \nBBB,Beta,GB,INE2\nCCC,Gamma,BE,\n")
    kept, gone = S.nse_equities(spark, p)
    assert [(r.symbol, r.isin) for r in kept.collect()] == [("AAA", "INE001")]
    assert counts(gone) == {"non_equity_series": 1, "no_isin": 1}


def test_bse_both_forms(spark, tmp_path):
    csv = put(tmp_path, "bse.csv", "Security Code,Security Id,Security Name,Status,ISIN No,Instrument\n500,AAA,Alpha,Active,INE1,Equity\n501,BBB,Beta,Suspended,INE2,Equity\n")
    kept, gone = S.bse_scrips(spark, csv)
    assert [r.code for r in kept.collect()] == ["500"] and counts(gone) == {"not_active": 1}
    js = put(tmp_path, "bse.json", [{"Security Code": "500", "Security Id": "AAA", "Security Name": "Alpha", "Status": "Active", "ISIN No": "INE1", "Instrument": "Equity"}])
    assert [r.isin for r in S.bse_scrips(spark, js)[0].collect()] == ["INE1"]


def test_lse_and_index(spark, tmp_path):
    p = put(tmp_path, "lse.csv", "Company,TIDM,ISIN,SEDOL,Company Number,Market\nAlpha plc,ALF,GB1,B01,0012,MAIN MARKET\nBeta,BET,,,,AIM\n")
    rows = {r.symbol: r for r in S.lse_companies(spark, p)[0].collect()}
    assert rows["BET"].segment == "AIM" and len(rows["ALF"].anchors) == 4 and len(rows["BET"].anchors) == 1
    q = put(tmp_path, "ix.csv", "Company,EPIC,ISIN\nAlpha,ALF,GB1\nNone,,\n")
    assert S.index_constituents(spark, q, "k", "K", "s").count() == 1


@pytest.mark.parametrize("lines", [True, False])
def test_watchlist(spark, tmp_path, lines):
    row = {"id": "w1", "caption": "Ann Doe", "schema": "Person", "datasets": ["d"], "properties": {"name": ["Ann Doe"], "alias": ["A. Doe"], "topics": ["sanction"], "country": ["us"], "birthDate": ["1970-01-01"]}}
    p = put(tmp_path, "w.json", json.dumps(row) if lines else json.dumps([row]))
    (r,) = S.watchlist(spark, p).collect()
    assert r.names == ["Ann Doe", "A. Doe"] and r.topics == ["sanction"] and r.births == ["1970-01-01"]


def test_lei_records_and_relations(spark, tmp_path):
    rec = {"attributes": {"lei": "L1", "entity": {"legalName": {"name": "Alpha AG"}, "otherNames": [{"name": "Alpha"}], "legalAddress": {"country": "DE"}, "status": "ACTIVE"}}}
    (r,) = S.lei_records(spark, put(tmp_path, "l.json", {"data": [rec]})).collect()
    assert (r.lei, r.names, r.country, r.active) == ("L1", ["Alpha AG", "Alpha"], "DE", True)
    rel = lambda t, s: {"attributes": {"relationship": {"startNode": {"id": "C"}, "endNode": {"id": "P"}, "relationshipType": t, "relationshipStatus": s, "relationshipPeriods": [{"startDate": "2019-01-01T00:00:00Z", "periodType": "RELATIONSHIP_PERIOD"}, {"startDate": "2020-01-01T00:00:00Z", "endDate": None, "periodType": "ACCOUNTING_PERIOD"}]}}}
    out = S.lei_relationships(spark, put(tmp_path, "r.json", {"data": [rel("IS_DIRECTLY_CONSOLIDATED_BY", "ACTIVE"), rel("IS_ULTIMATELY_CONSOLIDATED_BY", "ACTIVE"), rel("IS_FUND-MANAGED_BY", "ACTIVE")]})).collect()
    assert [(x.parent, x.child, str(x.valid_from)) for x in out] == [("P", "C", "2020-01-01")]


def test_ownership_statements(spark, tmp_path):
    rows = [
        {"statementID": "e1", "statementType": "entityStatement", "name": "Alpha"},
        {"statementID": "p1", "statementType": "personStatement", "names": [{"fullName": "Ann Doe"}]},
        {"statementID": "o1", "statementType": "ownershipOrControlStatement", "subject": {"describedByEntityStatement": "e1"}, "interestedParty": {"describedByPersonStatement": "p1"}, "interests": [{"type": "shareholding", "share": {"minimum": 25, "maximum": 50}, "startDate": "2020-02-01"}]},
        {"statementID": "o2", "statementType": "ownershipOrControlStatement", "subject": {"describedByEntityStatement": "missing"}, "interestedParty": {"describedByPersonStatement": "p1"}},
    ]
    (r,) = S.ownership_statements(spark, put(tmp_path, "b.json", rows)).collect()
    assert (r.holder_name, r.subject_name, r.percentage, r.percentage_band, str(r.start)) == ("Ann Doe", "Alpha", None, "25%-50%", "2020-02-01")


def test_control_register(spark, tmp_path):
    item = lambda k, n, c: {"company_number": "001", "data": {"kind": k, "name": n, "natures_of_control": c, "notified_on": "2021-01-01"}}
    lines = [item("individual-person-with-significant-control", "Ann Doe", ["voting-rights-25-to-50-percent", "ownership-of-shares-75-to-100-percent-as-trust"]), item("persons-with-significant-control-statement", None, []), item("super-secure-person-with-significant-control", None, [])]
    kept, gone = S.control_register(spark, put(tmp_path, "p.json", "\n".join(map(json.dumps, lines))))
    (r,) = kept.collect()
    assert (r.kind, r.interest, r.band) == ("Person", "voting-rights", "75%-100%")
    assert counts(gone) == {"statement": 1, "protected": 1}


def test_xml(spark, tmp_path):
    t = "<n:informationTable xmlns:n='urn:x'><n:infoTable><n:nameOfIssuer>ALPHA INC</n:nameOfIssuer><n:titleOfClass>COM</n:titleOfClass><n:cusip>01a</n:cusip><n:value>1,234</n:value><n:shrsOrPrnAmt><n:sshPrnamt>56</n:sshPrnamt><n:sshPrnamtType>SH</n:sshPrnamtType></n:shrsOrPrnAmt></n:infoTable></n:informationTable>"
    (r,) = S.fund_table(spark, put(tmp_path, "t.xml", t)).collect()
    assert (r.issuer, r.cusip, r.value, r.shares) == ("ALPHA INC", "01A", 1234, 56)
    amount = "<postTransactionAmounts><sharesOwnedFollowingTransaction><value>{}</value></sharesOwnedFollowingTransaction></postTransactionAmounts>"
    f = "<ownershipDocument><issuer><issuerCik>0000012</issuerCik><issuerTradingSymbol>alf</issuerTradingSymbol></issuer><reportingOwner><reportingOwnerId><rptOwnerName>O'NEIL ANNE-MARIE</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>1</isDirector><isOfficer>false</isOfficer></reportingOwnerRelationship></reportingOwner><nonDerivativeTable>" + "".join(f"<nonDerivativeTransaction>{amount.format(n)}</nonDerivativeTransaction>" for n in (10, 25)) + "</nonDerivativeTable></ownershipDocument>"
    (r,) = S.insider_form(spark, put(tmp_path, "f.xml", f)).collect()
    assert (r.cik, r.ticker, r.owner, r.shares, r.is_director, r.is_officer) == ("12", "ALF", "Anne-Marie O'Neil", 25, True, False)


def test_small_json_feeds(spark, tmp_path):
    q = put(tmp_path, "q.json", "\n".join(json.dumps({"chart": {"result": [{"meta": {"symbol": s, "regularMarketPrice": p, "chartPreviousClose": 100.0}}]}}) for s, p in (("A", 110.0), ("B", None))))
    assert [(r.symbol, round(r.change_pct, 6)) for r in S.quotes(spark, q).collect()] == [("A", 10.0)]
    i = put(tmp_path, "i.json", [{"page": 1}, [{"date": "2023", "value": None}, {"date": "2022", "value": 1.5}]])
    assert [(r.date, r.value) for r in S.indicator(spark, i, "x").collect()] == [("2022", 1.5)]
    a = put(tmp_path, "a.json", {"articles": [{"title": "One", "url": "u1", "seendate": "20240102T030405Z"}, {"title": "Twice", "url": "u1"}, {"title": " ", "url": "u2"}]})
    assert [(r.url, r.title, str(r.seen_at)) for r in S.articles(spark, a).collect()] == [("u1", "One", "2024-01-02 03:04:05")]
    j = put(tmp_path, "j.json", {"judgements": [{"left_key": "a", "right_key": "b", "verdict": "same", "score": 0.9}]})
    assert [(r.seq, r.verdict) for r in S.judgements(spark, j).collect()] == [(0, "same")]
    b = put(tmp_path, "b.csv", "Ticker,Company,ISIN\nA,Alpha,\n,,\n")
    assert S.brokerage(spark, b).count() == 1
    g = put(tmp_path, "g.json", {"nodes": [{"kind": "K", "key": "1", "properties": {"name": "a"}}, {"kind": "K", "key": "1", "properties": {"name": "b"}}], "edges": [{"source_kind": "K", "source_key": "1", "relation": "r", "target_kind": "K", "target_key": "2", "properties": {"source": "x"}}, {"source_kind": "K", "source_key": "1", "relation": "r", "target_kind": "K", "target_key": "2", "properties": {"source": "y"}}]})
    n, e = S.graph_snapshot(spark, g)
    assert [(r.name, r.seq) for r in n.collect()] == [("b", 0)] and [r.source for r in e.collect()] == ["x"]


def test_documents_skip_bad(spark, tmp_path):
    put(tmp_path, "ok.json", {"canonical_id": "d1", "title": "t", "sections": [{"title": "s", "content": "c", "order": 1}]})
    put(tmp_path, "bad.json", "{broken")
    good, bad = S.normalized_documents(spark, str(tmp_path))
    assert [r.canonical_id for r in good.collect()] == ["d1"] and bad.count() == 1


def test_filing_index(spark, tmp_path):
    p = put(tmp_path, "ix.json", {"directory": {"item": [{"name": "ex21.htm"}, {"name": "main.htm"}]}})
    assert {r.name: r.is_subsidiary_list for r in S.filing_index(spark, p).collect()} == {"ex21.htm": True, "main.htm": False}


def test_folders_of_both_forms(spark, tmp_path):
    """The form is found for each file: lines beside arrays, tables beside lists."""
    w = tmp_path / "watch"
    w.mkdir()
    one = lambda i: {"id": i, "caption": i, "schema": "Person"}
    put(w, "a.json", "\n".join(json.dumps(one(f"l{i}")) for i in range(3)))
    put(w, "b.json", [one("x")])
    assert sorted(r.id for r in S.watchlist(spark, str(w)).collect()) == ["l0", "l1", "l2", "x"]
    b = tmp_path / "scrips"
    b.mkdir()
    put(b, "a.csv", "Security Code,Security Id,Security Name,Status,ISIN No,Instrument\n500,AAA,Alpha,Active,INE1,Equity\n")
    put(b, "b.json", [{"Security Code": "501", "Security Id": "BBB", "Security Name": "Beta", "Status": "Active", "ISIN No": "INE2", "Instrument": "Equity"}])
    assert sorted(r.code for r in S.bse_scrips(spark, str(b))[0].collect()) == ["500", "501"]
