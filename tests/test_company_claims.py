"""Claims of companies, observations and crawl events on a few rows."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import functions as F

from skarv.functions import dates, text, url
from skarv.operators import aggregates, crawl, documents, observations
from skarv.operators import company_claims as cc

RECORD = "organisation_number string, module string, status string, note string, value string, source_url string, content_sha256 string"


def records(spark, *rows):
    return spark.createDataFrame([(o, m, s, n, v if v is None or isinstance(v, str) else json.dumps(v), "https://a.example", "h") for o, m, s, n, v in rows], RECORD)


def told(frame):
    return sorted((r.organisation_number, r.field, r.availability, r.value, r.reason) for r in frame.collect())


def test_modules_that_are_unavailable_or_broken(spark):
    rows = records(spark, ("1", "roles", "blocked", "robots", None), ("2", "roles", "available", None, "not json"), ("3", "roles", "available", None, None), ("4", "roles", "not_fetched", "", "{}"))
    assert told(cc.role_claims(rows)) == [("1", "roles", "blocked", None, "robots"), ("2", "role_count", "available", "0", None), ("3", "role_count", "available", "0", None), ("4", "roles", "failed", None, "Role source unavailable")]
    assert told(cc.role_claims(rows.limit(0))) == [] and told(cc.group_claims(rows)) == []


def test_role_claims(spark):
    value = {"roles": [{"type": "DAGL", "name": "A", "last_changed": "2024-01-01"}, {"role_code": "XYZ", "organisation_number": "9"}, {"type": "LEDE", "name": "B", "inactive": True, "last_changed": "2025-01-01"}, {"type": "MEDL"}]}
    got = told(cc.role_claims(records(spark, ("1", "roles", "available", None, value))))
    assert [(f, a) for _, f, a, _, _ in got] == [("ceo", "available"), ("registered_role", "available"), ("role_count", "available"), ("roles_last_changed", "available")]
    assert dict((f, v) for _, f, _, v, _ in got)["roles_last_changed"] == "2024-01-01" and dict((f, v) for _, f, _, v, _ in got)["role_count"] == "3"


def test_financial_claims(spark):
    value = {"records": [{"record_id": "1", "currency": "NOK", "period": {"fraDato": "2023-01-01", "tilDato": "2023-12-31"}, "revenue": 5, "assets": True, "equity": "x", "debt": -2.5}]}
    got = told(cc.financial_claims(records(spark, ("1", "financials", "available", None, value), ("2", "financials", "available", None, {"records": []}), ("3", "financials", "source_error", "HTTP 500", None))))
    assert [(o, f, a, v) for o, f, a, v, _ in got] == [("1", "revenue", "available", "5"), ("1", "total_debt", "available", "-2.5"), ("2", "annual_accounts", "not_available", None), ("3", "annual_accounts", "failed", None)]


def test_identity_from_live_and_bulk(spark):
    bulk = spark.createDataFrame([("1", "Bulk 1"), ("2", "Bulk 2"), ("3", None)], "organisation_number string, name string")
    live = spark.createDataFrame([("1", "available", "1", "Live 1"), ("2", "available", "9", "Other"), ("3", "source_error", None, None), ("4", "available", "4", "Live 4")], "organisation_number string, status string, live_number string, name string")
    assert sorted(map(tuple, cc.identity_view(bulk, live, ["name"]).collect())) == [("1", "live", "Live 1"), ("2", "bulk", "Bulk 2"), ("3", "bulk", None), ("4", "live", "Live 4")]
    assert sorted(map(tuple, cc.overlaid(bulk, live, ["name"]).collect())) == [("1", "Live 1", False), ("2", "Bulk 2", True), ("3", None, False)]


def test_claims_composed_and_covered(spark):
    view = spark.createDataFrame([("1", "A AS", None), ("2", None, None)], "organisation_number string, name string, employees string")
    site = {"site_url": "https://a.example", "identity_reasons": ["organisation number"], "jobs": [{"title": "J"}]}
    facts = spark.createDataFrame([("1", "business_description", "makes things", "makes things", 0.8), ("1", "unknown", "x", "x", 0.8)], "organisation_number string, fact_type string, value string, evidence_span string, confidence double")
    claims = cc.compose(view, records(spark, ("1", "roles", "available", None, {"roles": []}), ("1", "site_research", "available", None, site)), facts)
    states = {(r.organisation_number, r.category): r.state for r in cc.category_coverage(claims).collect()}
    assert states["1", "leadership"] == "not_available" and states["1", "hiring"] == "available" and states["1", "relationships"] == "not_checked" and states["2", "identity"] == "failed"
    areas = {r.organisation_number: r for r in cc.area_coverage(claims).collect()}
    assert areas["1"].hiring and areas["1"].websites and not areas["1"].leadership and not areas["2"].hiring
    assert ("1", "website_business_description", "available", "makes things", None) in told(claims)
    assert [r.fact_id for r in cc.ranked_facts(claims, limit=2).where("organisation_number = '1'").orderBy("fact_id").collect()] == ["f1", "f2"]
    assert sum(len(r.value) for r in cc.ranked_facts(claims, width=3).collect()) <= 3 * claims.count()


def test_findings_of_claims(spark):
    evidence = spark.createDataFrame([("e1", "https://a.example", "2024-01-01T00:00:00Z", "0" * 64, "x"), ("e2", "https://u:p@a.example", "2024-01-01", "zz", None)], "evidence_id string, source_url string, retrieved_at string, content_sha256 string, content string")
    claims = spark.createDataFrame([(1, "available", "v", ["e1", "e1"]), (2, "available", "v", ["e2", "e3"]), (3, "available", "v", None), (4, "blocked", "v", []), (5, "odd", "v", None), (6, "failed", None, None)], "claim_id long, availability string, value string, evidence_ids array<string>")
    got = sorted((r.claim_id, r.code) for r in cc.claim_findings(claims, evidence, url.web_address, content="content").collect())
    assert got == [
        (1, "snapshot_hash_mismatch"), (2, "invalid_content_sha256"), (2, "invalid_retrieved_at"), (2, "invalid_source_url"), (2, "missing_evidence_record"),
        (3, "available_claim_without_evidence"), (4, "value_on_non_available_claim"), (5, "invalid_availability"),
    ]
    inputs = spark.createDataFrame([(0, "1" * 9), (1, "2" * 9)], "position long, organisation_number string")
    fine = inputs.withColumn("terminal_status", F.lit("completed"))
    none = claims.limit(0)
    assert tuple(cc.batch_checks(inputs, fine, none).collect()[0]) == (True, True, True, True)
    assert tuple(cc.batch_checks(inputs, fine.where("position = 0"), claims).collect()[0]) == (False, False, False, False)
    assert {r.code for r in cc.envelope_findings(fine.withColumn("organisation_number", F.lit("x")).withColumn("terminal_status", F.lit("running"))).collect()} == {"invalid_organisation_number", "non_terminal_status"}


def test_observations(spark):
    base = {"id": "1", "organisation_number": "1", "platform": "news", "signal_type": "review", "source_url": "https://a.example/1", "retrieved_at": datetime.datetime(2024, 1, 1), "content_sha256": "0" * 64, "exact_entity": True, "identity_proof": "p", "acquisition_mode": "official_api", "rights_status": "approved", "evidence_span": "s", "sentiment_label": "positive", "source_class": "customer_review", "sentiment_model_version": "m", "reviewer_id": "r", "text": None}
    schema = ", ".join(f"{k} {'boolean' if k == 'exact_entity' else 'timestamp_ntz' if k == 'retrieved_at' else 'string'}" for k in base)
    rows = [tuple((base | {"id": str(i), "source_url": f"https://h{i % 2}.example/{i}", "sentiment_label": label}).values()) for i, label in enumerate(["positive"] * 7 + ["negative"] * 3 + ["mixed"])]
    rows.append(tuple((base | {"id": None, "platform": "fax", "sentiment_label": "fine", "source_class": None, "evidence_span": " "}).values()))
    frame = spark.createDataFrame(rows, schema)
    got = observations.footprint(frame, F.lit("2024-01-20 00:00:00").cast("timestamp")).collect()[0]
    assert (got.accepted, got.rejected, got.fresh, got.opinions, got.opinion) == (11, 1, 11, 11, 70.0)
    bad = observations.judged(frame).where("size(reasons) > 0").collect()[0].reasons
    assert bad == ["missing observation id", "unsupported platform", "missing evidence span", "unsupported sentiment label", "sentiment source is not independent"]
    assert {tuple(r[0]) for r in frame.select(observations.opinion_reasons()).collect()} == {(), ("source is not an allowed independent class",)}
    assert observations.footprint(frame.limit(0), F.current_timestamp()).collect() == []


def test_crawl_events(spark):
    at = lambda d: datetime.datetime(2024, 1, d)
    rows = [("1", 1, "home", "u", "https://a/", at(1), None), ("1", 2, "home", "u", "https://a/new", at(2), None), ("1", 3, "about", "u", "https://a/about", at(1), None), ("1", 4, "about", "u", "https://a/about", at(3), None), ("1", 5, "x", "u", None, at(1), "HTTP 500"), ("1", 6, "x", "u", None, at(2), "HTTP 500")]
    events = spark.createDataFrame(rows, "organisation_number string, event_id long, page_kind string, requested_url string, final_url string, retrieved_at timestamp, error string")
    got = [(r.final_url, r.event_id, r.is_homepage) for r in crawl.merged_pages(events).orderBy("place").collect()]
    assert got == [("https://a/new", 2, True), ("https://a/", 1, False), ("https://a/about", 4, False)]
    assert crawl.errors(events).count() == 1
    seeds = spark.createDataFrame([("1", "a.example"), ("2", "B.example/x"), ("3", None), ("4", "no site")], "organisation_number string, website string")
    assert [tuple(r)[:2] for r in crawl.missing_seeds(seeds, events, F.lit(True)).collect()] == [("2", "https://b.example/x")]
    assert crawl.missing_seeds(seeds, events, F.lit(False)).count() == 0
    assert tuple(crawl.run_report(seeds, events).collect()[0]) == (4, 6, 4, 2, 6.0, 0.25)


def test_small_functions(spark):
    one = lambda column: spark.range(1).select(column).collect()[0][0]
    as_of = F.lit("2025-01-01 00:00:00").cast("timestamp")
    for given, want in {"Tue, 02 Jan 2024 10:00:00 +0100": "2024-01-02T09:00:00Z", "2 Jan 2024 10:00 EST": "2024-01-02T15:00:00Z", "2024-01-02": "2024-01-02", "2024-01-02T10:00:00": "2024-01-02T10:00:00Z", "1994-12-31": None, "2026-01-01": None, "31 Feb 2024 10:00:00 GMT": None, "soon": None, "": None}.items():
        assert one(dates.published(F.lit(given), as_of)) == want, given
    assert one(text.office(F.lit("Adm. dir."), F.lit(None).cast("string"))).office == "ceo" and one(text.office(F.lit("Kokk"), F.lit("OWNER "))).method == "proposed" and one(text.office(F.lit("Kokk"), F.lit("cook"))).office is None
    assert one(text.plain(F.lit("ﬁn — „Ord“  ’s"))) == "fin - \"ord\" 's"
    assert one(url.company_page(F.lit("https://no.linkedin.com/Company/Nord%20Bygg/about"))) == "https://linkedin.com/company/nord%20bygg" and one(url.company_page(F.lit("https://linkedin.com/in/x"))) is None
    assert one(url.page_of_name(F.lit("Ærlig Øl & Åk AS"))) == "https://www.linkedin.com/company/aerlig-ol-ak-as"
    for name, public in {"a.no": True, "localhost": False, "10.0.0.1": False, "172.20.1.1": False, "8.8.8.8": True, "999.1.1.1": False, "::1": False, "x.local": False}.items():
        assert one(url.public_address(F.lit(name))) is public, name
    rows = spark.createDataFrame([("a", v) for v in (3, 1, 1, 2, None)], "k string, v int")
    assert [aggregates.value_at_rank(rows, ["k"], "v", f).collect()[0].v for f in (lambda n: n * 0, lambda n: F.floor((n - 1) / 2), lambda n: F.floor(n / 2))] == [1, 1, 2]
    body = json.dumps({"_embedded": {"oppdaterteEnheter": [{"oppdateringsid": 1, "endringer": {"b": 1, "a": 2}}, {"oppdateringsid": 2, "endringer": [{"felt": "x"}, {"path": "a"}, {"path": "a"}]}, {"oppdateringsid": 3}]}})
    got = documents.updates(spark.createDataFrame([(body,), (None,), ("x",)], "body string"), "body").orderBy("update_id").collect()
    assert [r.changed_fields for r in got] == [["a", "b"], ["a", "x"], []]
