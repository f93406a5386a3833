"""Queries over registry rows, claims, evidence, places and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarv.functions import extract, html, text, url
from skarv.functions.ids import mod11_valid, only_digits
from skarv.operators import aggregates, claims, documents, identity, malformed, relational
from skarv.plans import screening
from skarv.plans.evidence_queries import malformed_sql
from skarv.plans.relational_queries import MONEY
from skarv.sources import readers
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


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    """The latest registry row of each organisation, normalised."""
    last = relational.latest_per_key(table(spark, sf, "registry"), ["organisasjonsnummer"], ["retrieved_at", "row_id"])
    flat = {"organisasjonsform.kode": "organisasjonsform.kode", "antallAnsatte": "antallansatte", "forretningsadresse.kommune": "forretningsadresse.kommune", "naeringskode1.kode": "naeringskode1.kode", "sisteInnsendteAarsregnskap": "sisteinnsendteaarsregnskap"}
    return readers.normalised_registry(last.select("organisasjonsnummer", "navn", "hjemmeside", "konkurs", *(F.col(path).alias(name) for name, path in flat.items())))


_PROFILES = """profiles AS (SELECT organisasjonsnummer AS organisation_number, nullif(navn, '') AS name, nullif(organisasjonsform.kode, '') AS legal_form, nullif(hjemmeside, '') AS website, nullif(forretningsadresse.kommune, '') AS municipality,
 nullif(naeringskode1.kode, '') AS industry, nullif(sisteinnsendteaarsregnskap, '') AS latest_accounts, TRY_CAST(antallansatte AS INT) AS employees, coalesce(lower(konkurs) = 'true', false) AS bankrupt
 FROM registry WHERE length(organisasjonsnummer) = 9 QUALIFY row_number() OVER (PARTITION BY organisasjonsnummer ORDER BY retrieved_at DESC NULLS LAST, row_id DESC) = 1)"""


@query(f"WITH {_PROFILES} SELECT * FROM profiles")
def registry_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return profiles(spark, sf)


@query(f"WITH {_PROFILES} SELECT organisation_number, name FROM profiles WHERE organisation_number IN (SELECT organisation_number FROM claims)")
def registry_semi_scan(spark: SparkSession, sf: str) -> DataFrame:
    return readers.wanted_from_delivery(profiles(spark, sf), table(spark, sf, "claims")).select("organisation_number", "name")


@query(f"WITH {_PROFILES} SELECT DISTINCT organisation_number FROM claims WHERE organisation_number NOT IN (SELECT organisation_number FROM profiles)")
def registry_missing(spark: SparkSession, sf: str) -> DataFrame:
    return readers.missing_from_delivery(profiles(spark, sf), table(spark, sf, "claims").where("organisation_number is not null"))


@query(f"""WITH {_PROFILES} SELECT stratum, count(*) AS companies FROM (SELECT concat_ws('|', CASE WHEN legal_form IN ('AS', 'ASA', 'ENK') THEN legal_form ELSE 'OTHER' END, CASE WHEN employees IS NULL THEN 'missing' WHEN employees = 0 THEN '0' WHEN employees < 5 THEN '1-4' WHEN employees < 20 THEN '5-19' WHEN employees < 100 THEN '20-99' ELSE '100+' END,
 CASE WHEN bankrupt THEN 'adverse' ELSE 'active' END, CASE WHEN website IS NULL THEN 'no-web' ELSE 'web' END) AS stratum FROM profiles) GROUP BY 1""")
def stratum_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("employees")
    band = F.when(n.isNull(), "missing").when(n == 0, "0").when(n < 5, "1-4").when(n < 20, "5-19").when(n < 100, "20-99").otherwise("100+")
    form = F.when(F.col("legal_form").isin("AS", "ASA", "ENK"), F.col("legal_form")).otherwise("OTHER")
    stratum = F.concat_ws("|", form, band, F.when(F.col("bankrupt"), "adverse").otherwise("active"), F.when(F.col("website").isNull(), "no-web").otherwise("web"))
    return profiles(spark, sf).groupBy(stratum.alias("stratum")).agg(F.count("*").alias("companies"))


_DIGITS = "regexp_replace(coalesce(raw, ''), '[^0-9]', '', 'g')"


@query(f"""WITH d AS (SELECT row_id, {_DIGITS} AS n FROM input_rows), s AS (SELECT *, CASE WHEN length(n) = 9 THEN ({" + ".join(f"{w} * TRY_CAST(n[{i + 1}] AS INT)" for i, w in enumerate((3, 2, 7, 6, 5, 4, 3, 2)))}) % 11 END AS r FROM d)
SELECT row_id, n AS digits, coalesce(length(n) = 9 AND (CASE WHEN r = 0 THEN 0 ELSE 11 - r END) = TRY_CAST(n[9] AS INT), false) AS valid FROM s""")
def mod11_check(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "input_rows").select("row_id", only_digits(F.coalesce("raw", F.lit(""))).alias("digits"))
    return rows.withColumn("valid", mod11_valid(F.col("digits")))


@query(f"""WITH j AS (SELECT row_id, raw, CASE WHEN json_valid(raw) AND NOT regexp_matches(raw, ',\\s*[}}\\]]\\s*$') THEN CAST(raw AS JSON) END AS j FROM input_rows),
d AS (SELECT row_id, regexp_replace(coalesce(json_extract_string(j, '$.organisation_number'), json_extract_string(j, '$.organisasjonsnummer'), raw, ''), '[^0-9]', '', 'g') AS n FROM j), g AS (SELECT row_id, CASE WHEN length(n) = 9 THEN n END AS n FROM d),
f AS (SELECT *, min(row_id) OVER (PARTITION BY n) AS first, CASE WHEN n IS NOT NULL THEN ({" + ".join(f"{w} * CAST(n[{i + 1}] AS INT)" for i, w in enumerate((3, 2, 7, 6, 5, 4, 3, 2)))}) % 11 END AS r FROM g)
SELECT row_id AS position, n AS organisation_number, array_to_string(list_filter([CASE WHEN n IS NULL THEN 'invalid_organisation_number' END, CASE WHEN (CASE WHEN r = 0 THEN 0 ELSE 11 - r END) <> CAST(n[9] AS INT) THEN 'checksum_mismatch' END, CASE WHEN n IS NOT NULL AND first < row_id THEN 'duplicate_input ' || first END], lambda x: x IS NOT NULL), '; ') AS errors FROM f""")
def tolerant_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Every raw record as an input line, with its errors."""
    lines = table(spark, sf, "input_rows").select(F.col("row_id").alias("position"), "raw")
    return readers.tolerant_inputs(lines).select("position", "organisation_number", F.array_join(F.transform("errors", lambda e: F.concat_ws(" ", e["code"], e["detail"])), "; ").alias("errors"))


_HOST = r"nullif(regexp_extract(lower(CASE WHEN regexp_matches(trim({0}), '^[a-zA-Z]+://') THEN trim({0}) ELSE 'https://' || trim({0}) END), '^https?://(?:[^/?#@\s]*@)?(?:www\.)?([^/?#:\s]+)', 1), '')"


@query(f"SELECT organisasjonsnummer, hjemmeside, {_HOST.format('hjemmeside')} AS host FROM registry WHERE hjemmeside LIKE '%.%'")
def website_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "registry").where("hjemmeside like '%.%'").select("organisasjonsnummer", "hjemmeside", url.host(F.col("hjemmeside")).alias("host"))


@query(f"""WITH p AS (SELECT DISTINCT {_HOST.format('web_site')} AS h FROM map_places WHERE web_site LIKE '%.%'), d AS (SELECT DISTINCT {_HOST.format('hjemmeside')} AS d FROM registry WHERE hjemmeside LIKE '%.%')
SELECT h AS host FROM p WHERE h IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d WHERE h = d OR ends_with(h, '.' || d))""")
def hosts_not_listed(spark: SparkSession, sf: str) -> DataFrame:
    places = table(spark, sf, "map_places").where("web_site like '%.%'").select(url.host(F.col("web_site")).alias("host")).where("host is not null").distinct()
    listed = table(spark, sf, "registry").where("hjemmeside like '%.%'").select(url.host(F.col("hjemmeside")).alias("domain")).where("domain is not null")
    return relational.suffix_join(places, "host", listed, "domain", "left_anti")


_PAGE_HOST = r"regexp_replace(regexp_extract(lower(source_url), '^https?://([^/?#:\s]+)', 1), '^www\.', '')"


@query(f"""WITH p AS (SELECT * FROM (SELECT page_id, {_HOST.format('source_url')} AS host, sha256('20260823:' || page_id) AS r FROM page_contents) WHERE host IS NOT NULL)
SELECT page_id, host FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY host ORDER BY r, page_id) = 1) ORDER BY r, page_id LIMIT 50""")
def first_page_per_host(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "page_contents").select("page_id", url.host(F.col("source_url")).alias("host")).where("host is not null")
    return relational.first_per_host(pages, "host", "page_id", 50, "20260823").select("page_id", "host")


def _fold_sql(column: str) -> str:
    return f"translate(replace(replace(replace(replace(replace(lower({column}), 'æ', 'ae'), 'œ', 'oe'), 'ß', 'ss'), 'þ', 'th'), 'ð', 'd'), '{text.ACCENTED}', '{text.PLAIN}')"


def _key_sql(column: str) -> str:
    stop = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
    return f"array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all({_fold_sql(column)}, '[a-z0-9]+'), lambda w: length(w) >= 2 AND w NOT IN ({stop})))), ' ')"


@query(f"""SELECT DISTINCT p.place_id, r.organisasjonsnummer AS organisation_number FROM (SELECT place_id, {_key_sql('title')} AS k FROM map_places WHERE title IS NOT NULL) p JOIN (SELECT organisasjonsnummer, {_key_sql('navn')} AS k FROM registry WHERE navn IS NOT NULL) r ON p.k = r.k AND p.k <> ''""")
def name_key_join(spark: SparkSession, sf: str) -> DataFrame:
    places = table(spark, sf, "map_places").where("title is not null").select("place_id", text.name_key(F.col("title")).alias("k")).where("k <> ''").distinct()
    companies = table(spark, sf, "registry").where("navn is not null").select(F.col("organisasjonsnummer").alias("organisation_number"), text.name_key(F.col("navn")).alias("k")).distinct()
    return places.join(companies, "k").select("place_id", "organisation_number").distinct()


@query(r"""SELECT domain, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(lower(text), '[a-z0-9._%+-]+@([a-z0-9-]+(?:\.[a-z0-9-]+)+)', 1)) AS domain FROM page_contents) GROUP BY 1""")
def email_domains(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "page_contents").select("page_id", F.explode(text.email_domains(F.col("text"))).alias("domain"))
    return pages.groupBy("domain").agg(F.count_distinct("page_id").alias("pages"))


@query(f"""WITH n AS (SELECT page_id, organisation_number, unnest(list_distinct(list_transform(regexp_extract_all(' ' || replace(coalesce(text, ''), chr(160), ' ') || ' ', '[^0-9][0-9]{{3}}[ .]?[0-9]{{3}}[ .]?[0-9]{{3}}[^0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')))) AS number FROM page_contents),
s AS (SELECT *, ({" + ".join(f"{w} * CAST(number[{i + 1}] AS INT)" for i, w in enumerate((3, 2, 7, 6, 5, 4, 3, 2)))}) % 11 AS r FROM n WHERE length(number) = 9)
SELECT page_id, organisation_number, number, coalesce(number = organisation_number, false) AS own, (CASE WHEN r = 0 THEN 0 ELSE 11 - r END) = CAST(number[9] AS INT) AS valid FROM s""")
def numbers_on_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Organisation numbers that pages show, and whether they are the site's own."""
    pages = table(spark, sf, "page_contents").select("page_id", "organisation_number", F.explode(text.organisation_numbers(F.col("text"))).alias("number"))
    return pages.withColumn("own", F.col("number").eqNullSafe(F.col("organisation_number"))).withColumn("valid", mod11_valid(F.col("number")))


@query("""WITH t AS (SELECT row_id, ' ' || lower(concat_ws(' | ', as_of, effective_at, note)) || ' ' AS t FROM evidence), f AS (SELECT row_id, unnest(list_transform(regexp_extract_all(t, '[^0-9][0-9]{4}-[0-9]{2}-[0-9]{2}[^0-9]'), lambda x: TRY_CAST(substr(x, 2, 10) AS DATE))) AS day FROM t
UNION ALL SELECT row_id, unnest(list_transform(regexp_extract_all(t, '[^0-9.]([0-9]{1,2}\\.[0-9]{1,2}\\.[0-9]{4})[^0-9]', 1), lambda x: TRY_CAST(concat_ws('-', string_split(x, '.')[3], lpad(string_split(x, '.')[2], 2, '0'), lpad(string_split(x, '.')[1], 2, '0')) AS DATE))) FROM t)
SELECT day, count(DISTINCT row_id) AS evidence FROM f WHERE year(day) >= 1995 GROUP BY 1""")
def dates_in_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """How many pieces of evidence name each day, in whatever notation."""
    days = table(spark, sf, "evidence").select("row_id", F.explode(text.explicit_dates(F.concat_ws(" | ", "as_of", "effective_at", "note"))).alias("day"))
    return days.groupBy("day").agg(F.count_distinct("row_id").alias("evidence"))


@query()
def page_signals(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "page_contents").select("page_id", html.page_signals("html").alias("_s"))
    return pages.select("page_id", "_s.title", "_s.heading", "_s.footer", F.size("_s.emails").alias("emails"), F.length("_s.text").alias("characters"))


#: Parts of addresses and labels of the pages that tell most of a company, the best first.
PRIORITY_TERMS = ("om-oss", "om_oss", "about", "kontakt", "contact", "ledelse", "management", "team", "people", "locations", "lokasjoner", "avdelinger", "butikker", "news", "press", "aktuelt", "nyheter")


@query()
def priority_links(spark: SparkSession, sf: str) -> DataFrame:
    """At most four links of a page to its own host, those whose address or label names the best term first."""
    links = table(spark, sf, "page_contents").select("page_id", "source_url", F.explode(html.page_links("html", "source_url")).alias("_l")).select("page_id", "source_url", "_l.url", "_l.label")
    rank = F.array_min(F.array_compact(F.array(*(F.when(F.contains(F.lower(F.concat_ws(" ", "url", "label")), F.lit(t)), F.lit(i)) for i, t in enumerate(PRIORITY_TERMS)))))
    own = links.where(url.host(F.col("url")) == url.host(F.col("source_url"))).withColumn("rank", rank).where("rank is not null")
    best = own.groupBy("page_id", "url").agg(F.min("rank").alias("rank"))
    return best.groupBy("page_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", "url"))), 1, 4).alias("_links")).select("page_id", F.inline("_links"))


_STATES = ("available", "blocked", "source_error", "not_found", "not_fetched")


@query(f"""SELECT source_row_key, field, CASE min(CASE status {' '.join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(_STATES))} ELSE 9 END) {' '.join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_STATES))} END AS status FROM evidence GROUP BY ALL""")
def best_state_per_field(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.best_state(table(spark, sf, "evidence"), ["source_row_key", "field"], "status", list(_STATES))


@query("""SELECT source_row_key, bool_or(field = 'registry.name' AND status = 'available') AS "registry.name", bool_or(field = 'roles.roles' AND status = 'available') AS "roles.roles", bool_or(field = 'website.social_links' AND status = 'available') AS "website.social_links",
 "registry.name" AND "roles.roles" AND "website.social_links" AS all_areas FROM evidence GROUP BY 1""")
def area_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.coverage(table(spark, sf, "evidence"), "source_row_key", "field", F.col("status") == "available", ["registry.name", "roles.roles", "website.social_links"])


@query("SELECT source_row_key, field, row_id FROM (SELECT * FROM evidence QUALIFY row_number() OVER (PARTITION BY source_row_key, field ORDER BY retrieved_at DESC, row_id DESC) = 1) WHERE status = 'available'")
def latest_active_state(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "evidence").select(F.concat_ws("/", "source_row_key", "field").alias("_k"), "source_row_key", "field", "row_id", "retrieved_at", "status")
    return relational.changelog(rows, "_k", ["retrieved_at", "row_id"], "status", "available").select("source_row_key", "field", "row_id")


@query("""SELECT type, inactive, count(*) AS roles FROM (SELECT unnest(CAST(value AS STRUCT("type" VARCHAR, "name" VARCHAR, inactive BOOLEAN)[]), recursive := true) FROM (SELECT CAST(value AS JSON) AS value FROM evidence WHERE field = 'roles.roles' AND status = 'available' AND value IS NOT NULL)) GROUP BY ALL""")
def role_members(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "evidence").where("field = 'roles.roles' and status = 'available'").select("row_id", F.concat(F.lit('{"roles":'), "value", F.lit("}")).alias("doc"))
    members = claims.nested_members(rows, ["row_id"], "doc", "roles array<struct<type: string, name: string, inactive: boolean>>", ("roles",))
    return members.groupBy("type", "inactive").agg(F.count("*").alias("roles"))


def _told(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "evidence").select(F.col("source_row_key").alias("organisation_number"), F.split("field", r"\.")[0].alias("category"), "field", "value", "status", "source_url", "content_sha256", "retrieved_at")


_CITED = """cited AS (SELECT source_row_key AS organisation_number, substr(sha256(concat_ws(chr(31), split_part(field, '.', 1), field, value)), 1, 24) AS claim_key, min('ev-' || substr(sha256(concat_ws(chr(31), source_url, content_sha256, field)), 1, 20)) AS evidence_id
 FROM evidence WHERE status = 'available' AND source_url IS NOT NULL AND content_sha256 IS NOT NULL AND retrieved_at IS NOT NULL AND value IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {_CITED} SELECT * FROM cited")
def cited_claims(spark: SparkSession, sf: str) -> DataFrame:
    return claims.cited(_told(spark, sf)).select("organisation_number", "claim_key", "evidence_id")


@query(
    malformed_sql()
    + """, cited AS (SELECT source_row_key AS organisation_number, field, value FROM evidence WHERE status = 'available' AND source_url IS NOT NULL AND content_sha256 IS NOT NULL AND retrieved_at IS NOT NULL AND value IS NOT NULL GROUP BY ALL)
SELECT row_id AS position, n AS organisation_number, coalesce(n_claims, 0) AS n_claims, coalesce(n_fields, 0) AS n_fields, n_claims IS NOT NULL AS found FROM told LEFT JOIN (SELECT organisation_number, count(*) AS n_claims, count(DISTINCT field) AS n_fields FROM cited GROUP BY 1) c ON n = organisation_number WHERE reason IS NULL"""
)
def envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """Each input line that loads, with what is claimed of its company."""
    inputs = malformed.loaded(table(spark, sf, "input_rows")).select(F.col("row_id").alias("position"), "organisation_number")
    return claims.envelopes(inputs, claims.cited(_told(spark, sf)))


@query(r"""SELECT row_id, unnest(list_filter([CASE WHEN NOT coalesce(regexp_full_match(source_url, 'https?://[^\s/?#@]+(?:[/?#][^\s]*)?'), false) THEN 'invalid_url' END, CASE WHEN NOT coalesce(regexp_full_match(content_sha256, '[0-9a-f]{64}'), false) THEN 'invalid_hash' END, CASE WHEN retrieved_at IS NULL THEN 'invalid_time' END], lambda c: c IS NOT NULL)) AS code FROM bulk_evidence""")
def evidence_findings(spark: SparkSession, sf: str) -> DataFrame:
    return claims.findings(table(spark, sf, "bulk_evidence"), "row_id")


@query("SELECT page_id FROM page_contents WHERE content_sha256 IS NULL OR content_sha256 <> sha256(coalesce(html, ''))")
def contents_changed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "page_contents").where(~F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).eqNullSafe(F.col("content_sha256"))).select("page_id")


@query("""SELECT organisasjonsnummer AS organisation_number, task, substr(sha256(concat_ws(chr(31), organisasjonsnummer, task)), 1, 24) AS task_id FROM (SELECT organisasjonsnummer, max(hjemmeside) AS web FROM registry WHERE length(organisasjonsnummer) = 9 GROUP BY 1), unnest(['registry', 'roles', 'accounts', CASE WHEN web IS NULL THEN 'search' ELSE 'website' END]) AS t(task)""")
def task_plan(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "registry").where("length(organisasjonsnummer) = 9").groupBy(F.col("organisasjonsnummer").alias("organisation_number")).agg(F.max("hjemmeside").alias("web"))
    tasks = F.array(F.lit("registry"), F.lit("roles"), F.lit("accounts"), F.when(F.col("web").isNull(), "search").otherwise("website"))
    return rows.select("organisation_number", F.explode(tasks).alias("task")).withColumn("task_id", claims.digest(F.col("organisation_number"), F.col("task"), length=24))


@query(f"WITH {_PROFILES} SELECT organisation_number, name, employees FROM profiles WHERE lower(legal_form) = 'as' AND employees >= 2 AND website IS NOT NULL ORDER BY employees DESC NULLS LAST, organisation_number LIMIT 25")
def screen_top_n(spark: SparkSession, sf: str) -> DataFrame:
    return screening.screen(profiles(spark, sf), "AS companies with at least 2 employees with a website top 25 by employees").select("organisation_number", "name", "employees")


@query("SELECT c_custkey, revenue, municipality FROM (SELECT c_custkey, n_name AS municipality, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) WHERE lower(municipality) = 'nation_7' AND revenue > 1000000 ORDER BY revenue DESC, c_custkey LIMIT 10")
def screen_by_revenue(spark: SparkSession, sf: str) -> DataFrame:
    totals = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.col("o_totalprice").cast(MONEY)).cast("double").alias("revenue"))
    rows = totals.join(table(spark, sf, "customer"), "c_custkey").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "revenue", F.col("n_name").alias("municipality"))
    return screening.screen(rows, "companies in NATION_7 with revenue over 1 million top 10 by revenue", "c_custkey")


@query(f"WITH {_PROFILES} SELECT organisation_number, 'employees' AS topic, CAST(employees AS VARCHAR) AS value FROM profiles WHERE employees IS NOT NULL UNION ALL SELECT organisation_number, 'website', website FROM profiles WHERE website IS NOT NULL")
def qa_facts(spark: SparkSession, sf: str) -> DataFrame:
    return screening.answer(profiles(spark, sf), "How many employees do they have, and what is their website?")


@query()
def site_identity(spark: SparkSession, sf: str) -> DataFrame:
    """How surely each page is its company's own."""
    names = profiles(spark, sf).select("organisation_number", "name")
    pages = table(spark, sf, "page_contents").select("page_id", "organisation_number", "text").join(names, "organisation_number", "left")
    return pages.select("page_id", identity.site_confidence(F.col("name"), F.col("organisation_number"), F.col("text")).alias("_s")).select("page_id", "_s.confidence", "_s.reason")


@query("""SELECT regexp_replace(regexp_replace(fullkey, '\\[(\\d+)\\]', '.\\1', 'g'), '^\\$\\.?', '') AS path, count(*) AS leaves FROM (SELECT TRY_CAST(value AS JSON) AS v FROM bulk_evidence WHERE value IS NOT NULL), json_tree(v) AS t WHERE t.atom IS NOT NULL GROUP BY 1""")
def document_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """How often each field of the delivered documents is given."""
    rows = table(spark, sf, "bulk_evidence").where("value is not null").select(F.explode(extract.json_leaves("value")).alias("_l")).where("_l.kind <> 'null'")
    return rows.groupBy(F.regexp_replace(F.substr("_l.path", F.lit(2)), "/", ".").alias("path")).agg(F.count("*").alias("leaves"))


@query("""SELECT row_id, unnest(list_filter([CASE WHEN NOT coalesce(place_id <> '', false) THEN 'no_id' END, CASE WHEN NOT coalesce(title <> '', false) THEN 'no_title' END, CASE WHEN NOT coalesce(web_site LIKE 'http%', false) THEN 'no_url' END, CASE WHEN NOT coalesce(review_rating BETWEEN 1 AND 5 OR review_count = 0, false) THEN 'bad_rating' END], lambda x: x IS NOT NULL)) AS reason FROM map_places""")
def place_rejections(spark: SparkSession, sf: str) -> DataFrame:
    """Why captured places can't be published as they are, a row a reason."""
    rules = {"no_id": F.col("place_id") != "", "no_title": F.col("title") != "", "no_url": F.col("web_site").like("http%"), "bad_rating": F.col("review_rating").between(1, 5) | (F.col("review_count") == 0)}
    return documents.with_reasons(table(spark, sf, "map_places"), rules).select("row_id", F.explode("reasons").alias("reason"))


_GUESSED = f"list_filter(regexp_extract_all({{0}}, '[a-z0-9]+'), lambda t: t NOT IN ({', '.join(repr(w) for w in text.STOP_WORDS)}))"


@query(f"""WITH {_PROFILES}, w AS (SELECT organisation_number, {_HOST.format("website")} AS given, {_GUESSED.format(_fold_sql("name"))} AS w FROM profiles),
g AS (SELECT organisation_number, given, unnest(list_filter([CASE WHEN length(array_to_string(w, '')) >= 5 THEN array_to_string(w, '') || '.example' END, CASE WHEN len(w) > 1 AND length(array_to_string(w, '')) >= 5 THEN array_to_string(w, '-') || '.example' END], lambda x: x IS NOT NULL)) AS guess FROM w)
SELECT organisation_number, guess, coalesce(guess = given, false) AS "right" FROM g""")
def domain_guesses(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts each company may have by its name, and whether one is the website it gives."""
    rows = profiles(spark, sf).select("organisation_number", url.host(F.col("website")).alias("given"), F.explode(url.domain_guesses(text.name_tokens(F.col("name")), "example")).alias("guess"))
    return rows.withColumn("right", F.col("guess").eqNullSafe(F.col("given"))).select("organisation_number", "guess", "right")


_PADDED = "contains(' ' || lower(text) || ' ', ' {0} ')"


@query(f"""WITH g AS (SELECT lang, CASE WHEN {_PADDED.format('the')} THEN 'en' WHEN {_PADDED.format('ikkje')} OR {_PADDED.format('ei')} THEN 'nn' WHEN {_PADDED.format('och')} THEN 'sv' ELSE 'nb' END AS guess FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL),
s AS (SELECT label, sum(support)::BIGINT AS support, sum(given) AS given, sum(r) AS r FROM (SELECT lang AS label, 1 AS support, 0 AS given, (lang = guess)::INT AS r FROM g UNION ALL SELECT guess, 0, 1, 0 FROM g) GROUP BY 1), q AS (SELECT label, support, coalesce(r / nullif(given, 0), 0.0) AS precision, coalesce(r / nullif(support, 0), 0.0) AS recall FROM s)
SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM q""")
def language_quality(spark: SparkSession, sf: str) -> DataFrame:
    """How well two frequent words tell a document's language: precision, recall and F1 a label."""
    padded = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    guess = F.when(F.contains(padded, F.lit(" the ")), "en").when(F.contains(padded, F.lit(" ikkje ")) | F.contains(padded, F.lit(" ei ")), "nn").when(F.contains(padded, F.lit(" och ")), "sv").otherwise("nb")
    return aggregates.label_quality(table(spark, sf, "documents").where("lang is not null and text is not null").select("lang", guess.alias("guess")), "lang", "guess")
