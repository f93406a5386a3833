"""Queries over the claims of companies, their coverage and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarv.functions import url
from skarv.operators import claims as facts
from skarv.operators import company_claims as cc
from skarv.plans import screening
from skarv.plans.company_queries import _PROFILES, profiles
from skarv.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(make):
        QUERIES[make.__name__] = make
        if sql is not None:
            SQL[make.__name__] = sql
        return make

    return add


def _view(spark: SparkSession, sf: str) -> DataFrame:
    return profiles(spark, sf).withColumnRenamed("municipality", "business_address")


_IDENTITY = f"""{_PROFILES}, identity_claims AS (
SELECT organisation_number, 'identity' AS category, 'organisation_number' AS field, 'available' AS availability, organisation_number AS value FROM profiles
UNION ALL SELECT organisation_number, 'identity', 'legal_name', CASE WHEN nullif(trim(name), '') IS NULL THEN 'not_available' ELSE 'available' END, nullif(trim(name), '') FROM profiles
UNION ALL SELECT organisation_number, 'identity', 'legal_form', 'available', trim(legal_form) FROM profiles WHERE nullif(trim(legal_form), '') IS NOT NULL
UNION ALL SELECT organisation_number, 'identity', 'industry', 'available', '{{"code":"' || trim(industry) || '"}}' FROM profiles WHERE nullif(trim(industry), '') IS NOT NULL
UNION ALL SELECT organisation_number, 'identity', 'bankrupt', 'available', CAST(bankrupt AS VARCHAR) FROM profiles
UNION ALL SELECT organisation_number, 'identity', 'registry_employee_count', CASE WHEN employees IS NULL THEN 'not_available' ELSE 'available' END, CAST(employees AS VARCHAR) FROM profiles
UNION ALL SELECT organisation_number, 'description', 'registered_activity', 'not_available', NULL FROM profiles
UNION ALL SELECT organisation_number, 'locations', 'business_address', CASE WHEN nullif(trim(municipality), '') IS NULL THEN 'not_available' ELSE 'available' END, nullif(trim(municipality), '') FROM profiles
UNION ALL SELECT organisation_number, 'websites', 'registry_listed_website', 'available', trim(website) FROM profiles WHERE nullif(trim(website), '') IS NOT NULL
UNION ALL SELECT organisation_number, 'filings', 'latest_filed_accounts_year', 'available', trim(latest_accounts) FROM profiles WHERE nullif(trim(latest_accounts), '') IS NOT NULL)"""


@query(f"WITH {_IDENTITY} SELECT * FROM identity_claims")
def identity_claims(spark: SparkSession, sf: str) -> DataFrame:
    return cc.identity_claims(_view(spark, sf)).select("organisation_number", "category", "field", "availability", "value")


def _roles(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "bulk_evidence").where("field = 'roles'")
    return cc.role_claims(cc.latest_records(rows, "organisation_number", F.lit("roles")))


_ROLE_FIELD = "CASE r.type " + " ".join(f"WHEN '{code}' THEN '{field}'" for code, field in cc.ROLE_FIELDS.items()) + " ELSE 'registered_role' END"
_STATE = "CASE status WHEN 'not_found' THEN 'not_available' WHEN 'not_applicable' THEN 'not_applicable' WHEN 'blocked' THEN 'blocked' ELSE 'failed' END"
_ROLES = f"""last_roles AS (SELECT * FROM bulk_evidence WHERE field = 'roles' AND organisation_number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY organisation_number ORDER BY retrieved_at DESC NULLS LAST, row_id DESC) = 1),
members AS (SELECT organisation_number, status, list_filter(coalesce(CASE WHEN status = 'available' THEN from_json(json_extract(value, '$.roles'), '[{{"type":"VARCHAR","name":"VARCHAR","organisation_number":"VARCHAR","inactive":"BOOLEAN"}}]') END, []), lambda m: NOT coalesce(m.inactive, false)) AS active FROM last_roles),
role_claims AS (
SELECT organisation_number, 'leadership' AS category, 'role_count' AS field, 'available' AS availability, CAST(len(active) AS VARCHAR) AS value FROM members WHERE status = 'available'
UNION ALL SELECT organisation_number, 'leadership', 'roles', {_STATE}, NULL FROM members WHERE status <> 'available'
UNION ALL SELECT organisation_number, 'leadership', {_ROLE_FIELD}, 'available', coalesce(nullif(r.name, ''), r.organisation_number) FROM (SELECT organisation_number, unnest(active) AS r FROM members) WHERE coalesce(nullif(r.name, ''), r.organisation_number) IS NOT NULL)"""


@query(f"WITH {_ROLES} SELECT * FROM role_claims")
def role_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Holders of roles by name; counts and what is unavailable as they are."""
    holder = F.when((F.col("availability") == "available") & (F.col("field") != "role_count"), F.regexp_extract("span", r"(?s)\]=(.*)$", 1)).otherwise(F.col("value"))
    return _roles(spark, sf).select("organisation_number", "category", "field", "availability", holder.alias("value"))


def _documents(rows: DataFrame, entity: str, module: str, status, value) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(F.col(entity).cast("string").alias("organisation_number"), F.lit(module).alias("module"), status.alias("status"), none.alias("note"), F.to_json(value).alias("value"), none.alias("source_url"), none.alias("content_sha256"))


@query(f"""WITH {_PROFILES} SELECT organisation_number, 'websites' AS category, 'official_website' AS field, CASE WHEN website IS NULL THEN 'not_available' WHEN coalesce(employees >= 5, false) THEN 'available' ELSE 'ambiguous' END AS availability,
 CASE WHEN employees >= 5 THEN website END AS value, CASE WHEN website IS NULL THEN 'Website unavailable' WHEN coalesce(employees >= 5, false) THEN NULL ELSE 'too small to tell' END AS reason, CASE WHEN website IS NOT NULL AND employees >= 5 THEN 0.95 END AS confidence FROM profiles
UNION ALL SELECT organisation_number, 'description', 'website_description', 'available', name, NULL, 0.95 FROM profiles WHERE website IS NOT NULL AND employees >= 5 AND name IS NOT NULL
UNION ALL SELECT organisation_number, 'websites', 'social_profile', 'available', '{{"platform":"x","url":"https://x.com/' || organisation_number || '"}}', NULL, least(0.95, 0.5) FROM profiles WHERE website IS NOT NULL AND employees >= 5""")
def website_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Registered websites taken for proven from five employees on, with an assessed profile each."""
    rows = profiles(spark, sf)
    link = F.concat(F.lit("https://x.com/"), F.col("organisation_number"))
    proof = F.struct(F.coalesce(F.col("employees") >= 5, F.lit(False)).alias("publishable"), F.lit(0.95).alias("score"), F.array(F.lit("too small to tell")).alias("reasons"))
    value = F.struct(F.col("website").alias("final_url"), F.col("name").alias("description"), F.array(F.struct(F.lit("x").alias("platform"), link.alias("url"))).alias("social_links"), proof.alias("identity_assessment"))
    records = _documents(rows, "organisation_number", "website", F.when(F.col("website").isNull(), "not_found").otherwise("available"), value)
    graded = rows.select("organisation_number", link.alias("url"), F.lit(0.5).alias("identity_score"))
    return cc.website_claims(records, assessments=graded).drop("span")


@query("""WITH o AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 3)
SELECT CAST(o_custkey AS VARCHAR) AS organisation_number, 'revenue' AS field, count(*) AS claims, max(CAST(o_totalprice AS DOUBLE)) AS largest FROM o GROUP BY 1
UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'total_debt', count(*), max(CAST(o_orderkey AS DOUBLE)) FROM o GROUP BY 1
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'annual_accounts', 1, NULL FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def financial_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's last three orders read as periods of accounts, their figures unpivoted."""
    period = F.struct(F.col("o_orderdate").cast("string").alias("fraDato"), F.col("o_orderdate").cast("string").alias("tilDato"))
    record = F.struct(F.col("o_orderkey").cast("string").alias("record_id"), F.lit("NOK").alias("currency"), period.alias("period"), F.col("o_totalprice").alias("revenue"), F.lit(True).alias("assets"), F.col("o_orderstatus").alias("equity"), F.col("o_orderkey").alias("debt"))
    last = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), "o_orderkey")
    three = table(spark, sf, "orders").withColumn("_n", F.row_number().over(last)).where("_n <= 3")
    orders = three.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(record).alias("records"))
    rows = table(spark, sf, "customer").select("c_custkey").join(orders, "c_custkey", "left")
    made = cc.financial_claims(_documents(rows, "c_custkey", "financials", F.lit("available"), F.struct("records")))
    return made.groupBy("organisation_number", "field").agg(F.count("*").alias("claims"), F.max(F.col("value").cast("double")).alias("largest"))


@query("""WITH y AS (SELECT DISTINCT o_custkey AS k, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders)
SELECT CAST(k AS VARCHAR) AS organisation_number, 'filed_account_years' AS field, to_json(list(y ORDER BY y))::VARCHAR AS value FROM y GROUP BY k
UNION ALL SELECT CAST(k AS VARCHAR), 'annual_accounts_copy', '{"year":"' || y || '","url":"https://a.example/' || y || '"}' FROM y""")
def history_claims(spark: SparkSession, sf: str) -> DataFrame:
    """The years of each customer's orders as filed years, with a copy each."""
    years = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").cast("string").alias("y")).distinct().groupBy("o_custkey").agg(F.collect_list("y").alias("y"))
    value = F.struct(cc.filed_years(F.col("y")).alias("years"), cc.copies(F.col("y"), lambda y: F.concat(F.lit("https://a.example/"), y)).alias("pdfs"))
    return cc.history_claims(_documents(years, "o_custkey", "financial_history", F.lit("available"), value)).select("organisation_number", "field", "value")


@query("""SELECT CAST(s_nationkey AS VARCHAR) AS organisation_number, 'subunit_count' AS field, CAST(count(*) AS VARCHAR) AS value FROM supplier GROUP BY 1
UNION ALL SELECT CAST(s_nationkey AS VARCHAR), 'subunit', '{"organisation_number":"' || s_suppkey || '","name":"' || s_name || '"}' FROM supplier
UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'subunits', NULL FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)""")
def location_claims(spark: SparkSession, sf: str) -> DataFrame:
    """The suppliers of a nation as its subunits."""
    unit = F.struct(F.col("s_suppkey").cast("string").alias("organisation_number"), F.col("s_name").alias("name"))
    units = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.collect_list(unit).alias("locations"))
    rows = table(spark, sf, "nation").select("n_nationkey").join(units, "n_nationkey", "left")
    status = F.when(F.col("locations").isNull(), "not_found").otherwise("available")
    return cc.location_claims(_documents(rows, "n_nationkey", "locations", status, F.struct("locations"))).select("organisation_number", "field", "value")


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS organisation_number, CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN 'available' ELSE 'not_available' END AS availability, CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN '{"parent":"' || r_name || '"}' END AS value FROM nation JOIN region ON n_regionkey = r_regionkey""")
def group_claims(spark: SparkSession, sf: str) -> DataFrame:
    """The regions of nations as their groups; those elsewhere have none."""
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    parent = F.when(F.col("r_name").isin("ASIA", "EUROPE"), F.col("r_name"))
    return cc.group_claims(_documents(rows, "n_nationkey", "group", F.lit("available"), F.struct(parent.alias("parent")))).select("organisation_number", "availability", "value")


@query("""WITH p AS (SELECT CAST(page_id AS VARCHAR) AS k, source_url AS u, coalesce(status_code = 200, false) AS ok, page_kind AS kind, CASE WHEN organisation_number IS NULL THEN 0.95 ELSE 1.0 END AS sure FROM page_contents)
SELECT k AS organisation_number, 'official_website' AS field, 'available' AS availability, u AS value, sure AS confidence FROM p WHERE ok AND nullif(u, '') IS NOT NULL
UNION ALL SELECT k, 'site_activity', CASE WHEN ok AND kind = 'news' THEN 'available' WHEN ok THEN 'not_available' ELSE 'failed' END, CASE WHEN ok AND kind = 'news' THEN '{"title":"news","url":"' || u || '"}' END, CASE WHEN ok AND kind = 'news' THEN sure END FROM p
UNION ALL SELECT k, 'job_posting', CASE WHEN ok AND kind = 'job' THEN 'available' WHEN ok THEN 'not_available' ELSE 'failed' END, CASE WHEN ok AND kind = 'job' THEN '{"title":"job","url":"' || u || '"}' END, CASE WHEN ok AND kind = 'job' THEN sure END FROM p""")
def site_research_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Each captured page read as a site: news as activity, job advertisements as jobs, absents where there are none."""
    item = lambda kind: F.when(F.col("page_kind") == kind, F.array(F.struct(F.lit(kind).alias("title"), F.col("source_url").alias("url")))).otherwise(F.array().cast("array<struct<title:string,url:string>>"))
    reasons = F.array(F.when(F.col("organisation_number").isNull(), "name").otherwise("organisation number"))
    value = F.struct(F.col("source_url").alias("site_url"), reasons.alias("identity_reasons"), item("news").alias("activities"), item("job").alias("jobs"))
    status = F.when(F.col("status_code") == 200, "available").otherwise("source_error")
    return cc.site_research_claims(_documents(table(spark, sf, "page_contents"), "page_id", "site_research", status, value)).select("organisation_number", "field", "availability", "value", "confidence")


@query(f"""WITH {_PROFILES}, f AS (SELECT organisation_number, text FROM documents WHERE source = 'registry_purpose' AND organisation_number IS NOT NULL AND nullif(text, '') IS NOT NULL)
SELECT organisation_number, 'available' AS availability, text AS value FROM f UNION ALL SELECT organisation_number, 'not_available', NULL FROM profiles WHERE organisation_number NOT IN (SELECT organisation_number FROM f)""")
def model_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptions drawn from purposes, in place of the absents of companies that have one."""
    drawn = table(spark, sf, "documents").where("source = 'registry_purpose' and organisation_number is not null")
    drawn = cc.model_claims(drawn.select("organisation_number", F.lit("business_description").alias("fact_type"), F.col("text").alias("value"), F.lit("x").alias("evidence_span"), F.lit(0.8).alias("confidence")))
    none = F.lit(None).cast("string")
    absents = profiles(spark, sf).select("organisation_number", F.lit("description").alias("category"), F.lit("website_business_description").alias("field"), F.lit("not_available").alias("availability"), none.alias("value"), F.lit("none found").alias("reason"), none.alias("span"), F.lit(None).cast("double").alias("confidence"))
    return cc.without_filled_absents(absents, drawn).select("organisation_number", "availability", "value")


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    return cc.identity_claims(_view(spark, sf)).unionByName(_roles(spark, sf))


_ALL = f"{_IDENTITY}, {_ROLES}, all_claims AS (SELECT * FROM identity_claims UNION ALL SELECT * FROM role_claims), graded AS (SELECT *, field LIKE '%\\_count' ESCAPE '\\' AND TRY_CAST(value AS DOUBLE) = 0 AS nothing FROM all_claims)"
_RANKS = ", ".join(f"'{s}'" for s in cc.STATES)
_KINDS = ", ".join(f"'{c}'" for c in cc.CATEGORIES)


@query(f"""WITH {_ALL}, best AS (SELECT organisation_number, category, min(list_position([{_RANKS}], CASE WHEN coalesce(nothing, false) THEN 'not_available' ELSE availability END)) AS r FROM graded GROUP BY ALL)
SELECT o.organisation_number, o.category, coalesce([{_RANKS}][r], 'not_checked') AS state FROM (SELECT DISTINCT organisation_number, unnest([{_KINDS}]) AS category FROM all_claims) o LEFT JOIN best USING (organisation_number, category)""")
def category_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return cc.category_coverage(_claims(spark, sf))


def _area(rule: str) -> str:
    return f"coalesce(bool_or(availability = 'available' AND NOT coalesce(nothing, false) AND ({rule})), false)"


_AREAS = f"""SELECT organisation_number, {_area("category = 'filings'")} AS filings, {_area("category = 'leadership'")} AS leadership, {_area("category = 'locations'")} AS locations, {_area("category = 'websites' AND field = 'official_website'")} AS websites,
 {_area("category = 'public_activity' OR (category = 'websites' AND field = 'social_profile')")} AS public_footprint, {_area("category = 'hiring'")} AS hiring FROM graded GROUP BY 1"""


@query(f"WITH {_ALL} {_AREAS}")
def area_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return cc.area_coverage(_claims(spark, sf))


@query(f"WITH {_ALL}, a AS ({_AREAS}) SELECT count(*) AS companies, count_if(filings) AS filings, count_if(leadership) AS leadership, count_if(locations) AS locations, count_if(filings AND leadership AND locations) AS all_three, count_if(leadership AND NOT filings) AS gained_by_roles FROM a")
def coverage_gain(spark: SparkSession, sf: str) -> DataFrame:
    """How many companies each area covers, all of them, and what one source adds to another."""
    a = cc.area_coverage(_claims(spark, sf))
    return a.agg(F.count("*").alias("companies"), *(F.count_if(c).alias(c) for c in ("filings", "leadership", "locations")), F.count_if(F.col("filings") & F.col("leadership") & F.col("locations")).alias("all_three"), F.count_if(F.col("leadership") & ~F.col("filings")).alias("gained_by_roles"))


@query(f"WITH {_ALL} SELECT category, availability, count(*) AS claims, count(DISTINCT organisation_number) AS companies, round(count(*) FILTER (WHERE value IS NOT NULL) / count(*), 4) AS with_value FROM all_claims GROUP BY ALL")
def batch_report(spark: SparkSession, sf: str) -> DataFrame:
    return _claims(spark, sf).groupBy("category", "availability").agg(F.count("*").alias("claims"), F.count_distinct("organisation_number").alias("companies"), F.round(F.count("value") / F.count("*"), 4).alias("with_value"))


_LIVE = """live AS (SELECT organisation_number, status, CASE WHEN status = 'available' THEN json_extract_string(value, '$') END AS name, source_row_key AS live_number FROM evidence WHERE field = 'registry.name' AND organisation_number IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY organisation_number ORDER BY retrieved_at DESC NULLS LAST, row_id DESC) = 1)"""


def _live(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "evidence").where("field = 'registry.name' and organisation_number is not null").groupBy("organisation_number")
    last = rows.agg(F.max_by(F.struct("status", "value", "source_row_key"), F.struct("retrieved_at", "row_id")).alias("_r"))
    name = F.when(F.col("_r.status") == "available", F.get(F.from_json(F.concat(F.lit("["), F.col("_r.value"), F.lit("]")), "array<string>"), F.lit(0)))
    return last.select("organisation_number", F.col("_r.status").alias("status"), name.alias("name"), F.col("_r.source_row_key").alias("live_number"))


@query(f"""WITH {_PROFILES}, {_LIVE}, good AS (SELECT * FROM live WHERE status = 'available' AND live_number = organisation_number)
SELECT coalesce(p.organisation_number, g.organisation_number) AS organisation_number, CASE WHEN g.organisation_number IS NOT NULL THEN 'live' ELSE 'bulk' END AS source, CASE WHEN g.organisation_number IS NOT NULL THEN g.name ELSE p.name END AS name FROM profiles p FULL JOIN good g ON p.organisation_number = g.organisation_number""")
def identity_view(spark: SparkSession, sf: str) -> DataFrame:
    """The name that holds: the live registry's where it is of the company itself, else the delivered one."""
    return cc.identity_view(profiles(spark, sf).select("organisation_number", "name"), _live(spark, sf), ["name"])


@query(f"""WITH {_PROFILES}, {_LIVE} SELECT p.organisation_number, coalesce(CASE WHEN l.status = 'available' AND l.live_number = l.organisation_number THEN l.name END, p.name) AS name, coalesce(l.status = 'available' AND l.live_number <> l.organisation_number, false) AS identity_mismatch FROM profiles p LEFT JOIN live l ON p.organisation_number = l.organisation_number""")
def identity_overlay(spark: SparkSession, sf: str) -> DataFrame:
    return cc.overlaid(profiles(spark, sf).select("organisation_number", "name"), _live(spark, sf), ["name"])


@query("""SELECT state, count(*) AS records FROM (SELECT CASE WHEN status = 'available' THEN 'complete' WHEN status IN ('not_applicable', 'not_found', 'source_error') THEN status WHEN status = 'blocked' THEN CASE WHEN contains(lower(coalesce(note, '')), 'robot') THEN 'blocked_robots' ELSE 'blocked_policy' END ELSE 'submission_error' END AS state FROM evidence) GROUP BY 1""")
def terminal_states(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "evidence").groupBy(cc.terminal_state(F.col("status"), F.col("note")).alias("state")).agg(F.count("*").alias("records"))


@query("""SELECT organisation_number, bool_and(status <> 'not_fetched') AND count(DISTINCT field) = 3 AS complete, count_if(status NOT IN ('source_error', 'not_fetched')) AS present FROM bulk_evidence WHERE organisation_number IS NOT NULL GROUP BY 1""")
def module_completeness(spark: SparkSession, sf: str) -> DataFrame:
    """Whether all modules of a company were fetched, and how many of its records are there."""
    rows = table(spark, sf, "bulk_evidence").where("organisation_number is not null").groupBy("organisation_number")
    return rows.agg((F.bool_and(F.col("status") != "not_fetched") & (F.count_distinct("field") == 3)).alias("complete"), F.count_if(~F.col("status").isin("source_error", "not_fetched")).alias("present"))


@query(f"""WITH {_PROFILES} SELECT row_id, p.organisation_number IS NOT NULL AS known, p.name FROM input_rows i LEFT JOIN profiles p ON i.organisation_number = p.organisation_number""")
def inputs_with_previous(spark: SparkSession, sf: str) -> DataFrame:
    """Each input row with what is known of its company from before."""
    before = profiles(spark, sf).select("organisation_number", "name", F.lit(True).alias("_known"))
    return table(spark, sf, "input_rows").join(before, "organisation_number", "left").select("row_id", F.coalesce("_known", F.lit(False)).alias("known"), "name")


_ZONED = r"'^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d([.,]\d{1,9})?)?(Z|[+-]\d\d:?\d\d)$'"


@query(f"""WITH e AS (SELECT source_row_key AS id, source_url AS u, effective_at AS t, content_sha256 AS h FROM bulk_evidence WHERE field = 'website' AND source_row_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_row_key ORDER BY retrieved_at DESC NULLS LAST, row_id DESC) = 1),
c AS (SELECT row_id, CASE WHEN status = 'available' THEN 'available' ELSE {_STATE} END AS a, value, source_row_key AS id FROM evidence), m AS (SELECT c.*, e.*, e.id IS NOT NULL AS there FROM c LEFT JOIN e ON c.id = e.id WHERE c.id IS NOT NULL)
SELECT row_id, CAST(NULL AS VARCHAR) AS evidence_id, 'available_claim_without_evidence' AS code FROM c WHERE a = 'available' AND id IS NULL
UNION ALL SELECT row_id, NULL, 'value_on_non_available_claim' FROM c WHERE a <> 'available' AND value IS NOT NULL
UNION ALL SELECT row_id, id, 'missing_evidence_record' FROM m WHERE NOT there
UNION ALL SELECT row_id, id, 'invalid_source_url' FROM m WHERE there AND NOT coalesce(regexp_matches(u, '^https?://[^\\s/?#@]+(?:[/?#][^\\s]*)?$'), false)
UNION ALL SELECT row_id, id, 'invalid_retrieved_at' FROM m WHERE there AND NOT coalesce(regexp_matches(t, {_ZONED}) AND TRY_CAST(replace(substr(t, 1, 19), 'T', ' ') AS TIMESTAMP) IS NOT NULL, false)
UNION ALL SELECT row_id, id, 'invalid_content_sha256' FROM m WHERE there AND NOT coalesce(regexp_matches(h, '^[0-9a-f]{{64}}$'), false)""")
def claim_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Observed attributes as claims that cite the last capture of their company's website."""
    last = table(spark, sf, "bulk_evidence").where("field = 'website' and source_row_key is not null").groupBy(F.col("source_row_key").alias("evidence_id"))
    evidence = last.agg(F.max_by(F.struct("source_url", F.col("effective_at").alias("retrieved_at"), "content_sha256"), F.struct("retrieved_at", "row_id")).alias("_r")).select("evidence_id", "_r.*")
    claims = table(spark, sf, "evidence").select("row_id", facts.availability(F.col("status")).alias("availability"), "value", F.array_compact(F.array("source_row_key")).alias("evidence_ids"))
    return cc.claim_findings(claims, evidence, url.web_address, "row_id").withColumnRenamed("claim", "row_id")


@query("SELECT bool_and(n = 1) AS one_envelope_per_input_row, true AS envelopes_follow_input_order, bool_and(ended) AS all_terminal, false AS all_envelopes_valid FROM (SELECT row_id, count(*) AS n, bool_and(errors IS NULL OR errors <> '') AS ended FROM input_rows GROUP BY 1)")
def batch_checks(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "input_rows").withColumnRenamed("row_id", "position")
    ended = rows.select("position", "organisation_number", F.when(F.col("errors").isNull() | (F.col("errors") != ""), "completed").alias("terminal_status"))
    return cc.batch_checks(rows, ended, cc.envelope_findings(ended))


@query(f"""WITH {_PROFILES}, hits AS (SELECT organisation_number, name FROM profiles WHERE employees >= 1 AND website IS NOT NULL), last AS (SELECT organisation_number, split_part(field, '.', 1) AS module, source_url, retrieved_at, content_sha256 FROM evidence
 WHERE organisation_number IS NOT NULL AND field IS NOT NULL QUALIFY row_number() OVER (PARTITION BY organisation_number, module ORDER BY retrieved_at DESC NULLS LAST, row_id DESC) = 1)
SELECT h.organisation_number, h.name, m.module, source_url, retrieved_at, content_sha256 FROM hits h, (VALUES ('registry'), ('website')) m(module) LEFT JOIN last l ON l.organisation_number = h.organisation_number AND l.module = m.module""")
def screen_cited(spark: SparkSession, sf: str) -> DataFrame:
    """All companies that fit a question, with the evidence that each part of the answer rests on."""
    plan = screening.parse("companies with at least 1 employees with a website")
    evidence = table(spark, sf, "evidence").where("organisation_number is not null and field is not null").withColumn("module", F.split("field", r"\.")[0])
    return screening.cited(screening.run(profiles(spark, sf), plan).select("organisation_number", "name"), evidence, plan)


@query("""SELECT * FROM (VALUES ('companies with good glassdoor reviews', true, 'Glassdoor data is not available through a permitted connector; review data is not available through a qualified provider', 0), ('companies without a website', true, 'missing or unverified website evidence does not prove that a company has no website', 0), ('hello', true, 'No supported criterion was recognized.', 0), ('profitable companies', false, NULL, 0)) t(question, abstained, reason, result_count)""")
def screen_abstentions(spark: SparkSession, sf: str) -> DataFrame:
    rows = profiles(spark, sf)
    out = None
    for question in ("companies with good glassdoor reviews", "companies without a website", "hello", "profitable companies"):
        part = screening.outcome(rows, question)
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {_ALL}, r AS (SELECT organisation_number, category, field, value, row_number() OVER (PARTITION BY organisation_number ORDER BY list_position([{_KINDS}], category), field, value) AS n FROM identity_claims WHERE availability = 'available') SELECT organisation_number, 'f' || n AS fact_id, category, field, left(value, 240) AS value FROM r WHERE n <= 60")
def ranked_facts(spark: SparkSession, sf: str) -> DataFrame:
    return cc.ranked_facts(cc.identity_claims(_view(spark, sf)))
