"""Queries over observations, crawl events and the functions on dates, titles and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarv.functions import dates, extract, url
from skarv.operators import aggregates, claims, crawl, documents, identity, observations
from skarv.plans.company_queries import _PROFILES, profiles
from skarv.sources import sinks
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


def _observed(spark: SparkSession, sf: str) -> DataFrame:
    """Documents read as observations of their companies."""
    source = F.col("source")
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), "organisation_number", F.when(source == "reviews", "google_places").when(source == "job_ads", "job_board").otherwise(source).alias("platform"),
        F.when(source == "reviews", "review").when(source == "job_ads", "job_posting").when(source == "news", "public_mention").otherwise("company_profile").alias("signal_type"),
        "source_url", "retrieved_at", "content_sha256", F.col("organisation_number").isNotNull().alias("exact_entity"), F.col("lang").alias("identity_proof"), F.lit("permitted_public_page").alias("acquisition_mode"),
        F.when(source != "press_kit", "approved").alias("rights_status"), F.col("text").alias("evidence_span"), F.when(source == "reviews", F.when(F.contains("text", F.lit("anbefal")), "positive").otherwise("neutral")).when((source == "news") & F.contains("text", F.lit("!")), "loud").alias("sentiment_label"),
        F.when(source == "reviews", "customer_review").alias("source_class"), F.lit("m1").alias("sentiment_model_version"), F.col("source_url").alias("reviewer_id"),
    )


_HOST = "nullif(regexp_extract(lower(trim(source_url)), '^https?://(?:[^/?#@\\s]*@)?(?:www\\.)?([^/?#:\\s]+)', 1), '')"
_OBSERVED = f"""observed AS (SELECT doc_id AS id, organisation_number AS o, source, text, source_url, retrieved_at, CASE source WHEN 'reviews' THEN 'google_places' WHEN 'job_ads' THEN 'job_board' ELSE source END AS platform, {_HOST} AS host,
 CASE WHEN source = 'reviews' THEN CASE WHEN contains(text, 'anbefal') THEN 'positive' ELSE 'neutral' END WHEN source = 'news' AND contains(text, '!') THEN 'loud' END AS label, content_sha256 AS h, lang FROM documents),
reasons AS (SELECT *, list_filter([CASE WHEN NOT coalesce(regexp_matches(o, '^[0-9]+$'), false) THEN 'missing or invalid organisation number' END, CASE WHEN platform NOT IN ({", ".join(f"'{p}'" for p in observations.PLATFORMS)}) THEN 'unsupported platform' END,
 CASE WHEN host IS NULL THEN 'missing or invalid source URL' END, CASE WHEN retrieved_at IS NULL THEN 'missing retrieval time' END, CASE WHEN length(coalesce(h, '')) <> 64 THEN 'missing content hash' END, CASE WHEN o IS NULL THEN 'exact legal entity is not verified' END,
 CASE WHEN coalesce(trim(lang), '') = '' THEN 'missing exact-entity proof' END, CASE WHEN source = 'press_kit' THEN 'source rights are not approved' END, CASE WHEN source IN ('reviews', 'news') AND coalesce(trim(text), '') = '' THEN 'missing evidence span' END,
 CASE WHEN label = 'loud' THEN 'unsupported sentiment label' END, CASE WHEN label IS NOT NULL AND source <> 'reviews' THEN 'sentiment source is not independent' END], lambda x: x IS NOT NULL) AS reasons FROM observed)"""


@query(f"WITH {_OBSERVED} SELECT id, array_to_string(reasons, '; ') AS reasons FROM reasons")
def observation_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Why each observation may not be published; empty where it may."""
    return observations.judged(_observed(spark, sf)).select("id", F.array_join("reasons", "; ").alias("reasons"))


@query(f"WITH {_OBSERVED} SELECT platform, reason, count(*) AS n FROM (SELECT platform, unnest(reasons) AS reason FROM reasons) GROUP BY ALL")
def rejections_by_platform(spark: SparkSession, sf: str) -> DataFrame:
    return observations.reasons_counted(_observed(spark, sf))


@query(f"""WITH {_OBSERVED}, j AS (SELECT *, len(reasons) = 0 AS ok FROM reasons), g AS (SELECT o AS organisation_number, count_if(ok) AS accepted, count_if(NOT ok) AS rejected, (count(*) FILTER (WHERE ok AND epoch(TIMESTAMP '2025-07-01') - epoch(retrieved_at) BETWEEN 0 AND 45 * 86400)) AS fresh, count_if(ok AND source = 'reviews') AS reviews,
 count(DISTINCT CASE WHEN ok AND source = 'job_ads' THEN source_url END) AS jobs, count(DISTINCT CASE WHEN ok AND source = 'news' THEN source_url END) AS public_items, count_if(ok AND label IS NOT NULL) AS opinions,
 count(DISTINCT CASE WHEN ok AND label IS NOT NULL THEN host END) AS hosts, count(DISTINCT CASE WHEN ok AND label IS NOT NULL THEN source_url END) AS people, avg(CASE WHEN ok THEN CASE label WHEN 'positive' THEN 1 WHEN 'neutral' THEN 0 END END) AS m FROM j GROUP BY 1)
SELECT organisation_number, accepted, rejected, fresh, reviews, jobs, public_items, opinions, CASE WHEN opinions >= 10 AND (hosts >= 2 OR people >= 10) THEN round(50 + 50 * m, 1) END AS opinion FROM g""")
def observed_footprint(spark: SparkSession, sf: str) -> DataFrame:
    return observations.footprint(_observed(spark, sf), F.lit("2025-07-01 00:00:00").cast("timestamp"))


@query(f"""WITH {_OBSERVED} SELECT id, array_to_string(list_filter([CASE WHEN o IS NULL THEN 'exact company identity is not verified' END, CASE WHEN source <> 'reviews' THEN 'source is not an allowed independent class' END, CASE WHEN coalesce(source_url, '') = '' THEN 'missing source_url' END,
 CASE WHEN retrieved_at IS NULL THEN 'missing retrieved_at' END, CASE WHEN coalesce(text, '') = '' THEN 'missing evidence_span' END, CASE WHEN coalesce(h, '') = '' THEN 'missing content_sha256' END, CASE WHEN coalesce(text, '') = '' THEN 'missing text' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM observed""")
def opinion_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return _observed(spark, sf).withColumn("text", F.lit(None).cast("string")).select("id", F.array_join(observations.opinion_reasons(), "; ").alias("reasons"))


@query("SELECT row_id, CASE WHEN review_rating <= 2 THEN 'negative' WHEN review_rating >= 4 THEN 'positive' WHEN review_rating IS NOT NULL THEN 'neutral' END AS label FROM map_places")
def review_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "map_places").select("row_id", observations.review_label(F.col("review_rating")).alias("label"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "page_contents")
    error = crawl.page_event(F.col("html"), F.col("text"), F.col("status_code"), F.length(F.coalesce("html", F.lit(""))))
    return pages.select("organisation_number", F.col("page_id").alias("event_id"), "page_kind", F.col("source_url").alias("requested_url"), F.col("source_url").alias("final_url"), "retrieved_at", error.alias("error"))


_EVENTS = """events AS (SELECT organisation_number AS o, page_id AS event_id, page_kind, source_url AS u, retrieved_at AS t, CASE WHEN coalesce(status_code, 0) <> 200 THEN 'HTTP ' || coalesce(status_code, 0) WHEN length(coalesce(html, '')) > 5000000 THEN 'too large' WHEN coalesce(html, '') = '' AND coalesce(text, '') = '' THEN 'empty' END AS error FROM page_contents)"""


@query(f"""WITH {_EVENTS}, good AS (SELECT * FROM events WHERE error IS NULL AND u IS NOT NULL), last AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY o, u ORDER BY t DESC NULLS LAST, event_id DESC) = 1),
home AS (SELECT o, u AS h FROM good WHERE page_kind = 'home' QUALIFY row_number() OVER (PARTITION BY o ORDER BY t DESC NULLS LAST, event_id DESC) = 1)
SELECT last.o AS organisation_number, u AS final_url, event_id, page_kind, t AS retrieved_at, coalesce(u = h, false) AS is_homepage, CASE WHEN coalesce(u = h, false) THEN '0 ' ELSE '1 ' END || u AS place FROM last LEFT JOIN home ON last.o = home.o""")
def merged_pages(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.merged_pages(_events(spark, sf))


@query(f"WITH {_EVENTS} SELECT DISTINCT o AS organisation_number, u AS requested_url, error FROM events WHERE error IS NOT NULL")
def crawl_errors(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.errors(_events(spark, sf))


@query(f"""WITH {_PROFILES} SELECT DISTINCT organisation_number, regexp_replace(regexp_extract(lower(trim(website)), '^(?:https?://)?([^/?#]+)', 1), '^', CASE WHEN lower(trim(website)) LIKE 'http://%' THEN 'http://' ELSE 'https://' END) || coalesce(nullif(regexp_replace(regexp_extract(regexp_replace(trim(website), '^[a-zA-Z]+://', ''), '^[^/?#]+(/[^?#]*)?', 1), ';.*$', ''), ''), '/') AS requested_url, '{crawl.NO_EVENT}' AS error
FROM profiles WHERE website IS NOT NULL AND organisation_number NOT IN (SELECT organisation_number FROM page_contents WHERE organisation_number IS NOT NULL) AND regexp_matches(trim(website), '^(?:[hH][tT][tT][pP][sS]?://)?[^\\s/:]+\\.[^\\s/:]+')""")
def missing_seed_events(spark: SparkSession, sf: str) -> DataFrame:
    """An error for each company with a website of which no page was captured."""
    return crawl.missing_seeds(profiles(spark, sf), _events(spark, sf).where("organisation_number is not null"), F.lit(True)).drop("page_kind")


@query(f"""WITH {_PROFILES}, {_EVENTS}, per AS (SELECT o, count(*) AS e, count_if(error IS NULL) AS p FROM events GROUP BY 1), t AS (SELECT count(*) AS seeds, count(e) AS ended, coalesce(sum(e), 0)::BIGINT AS events, coalesce(sum(p), 0)::BIGINT AS pages FROM profiles LEFT JOIN per ON o = organisation_number)
SELECT seeds, events, pages, events - pages AS errors, round(events / ended, 4) AS events_per_seed, round(ended / seeds, 4) AS terminal_coverage FROM t""")
def crawl_report(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.run_report(profiles(spark, sf), _events(spark, sf))


@query("""SELECT o_orderpriority, CAST(a AS DOUBLE) AS lower_tenth, CAST(b AS DOUBLE) AS lower_median, CAST(c AS DOUBLE) AS upper_median FROM (SELECT o_orderpriority, l[1 + CAST(floor((len(l) - 1) * 0.1) AS INT)] AS a, l[1 + (len(l) - 1) // 2] AS b, l[1 + len(l) // 2] AS c FROM (SELECT o_orderpriority, list_sort(list(o_totalprice)) AS l FROM orders GROUP BY 1))""")
def values_at_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles by three definitions of their place."""
    rows, keys = table(spark, sf, "orders"), ["o_orderpriority"]
    at = lambda name, index: aggregates.value_at_rank(rows, keys, "o_totalprice", index).select(*keys, F.col("o_totalprice").cast("double").alias(name))
    return at("lower_tenth", lambda n: F.floor((n - 1) * F.lit(0.1))).join(at("lower_median", lambda n: F.floor((n - 1) / 2)), keys).join(at("upper_median", lambda n: F.floor(n / 2)), keys)


_SAID = "CASE WHEN contains(text, ' ikkje ') THEN 'nn' WHEN contains(text, ' the ') THEN 'en' WHEN contains(text, ' og ') THEN 'nb' END"


@query(f"""WITH r AS (SELECT lang AS g, {_SAID} AS p FROM documents WHERE lang IS NOT NULL), f AS (SELECT g, 2 * (count(*) FILTER (WHERE g = p)) / (count(*) + coalesce((SELECT count(*) FROM r s WHERE s.p = r.g), 0)) AS f1 FROM r GROUP BY g)
SELECT count(*) AS items, count(p) AS predicted, round((count(*) FILTER (WHERE g = p)) / count(*), 6) AS accuracy, round(count(p) / count(*), 6) AS coverage, round((SELECT avg(f1) FROM f), 6) AS macro_f1 FROM r""")
def prediction_quality(spark: SparkSession, sf: str) -> DataFrame:
    """How well three words tell the language: accuracy, coverage, mean F1."""
    said = F.when(F.contains("text", F.lit(" ikkje ")), "nn").when(F.contains("text", F.lit(" the ")), "en").when(F.contains("text", F.lit(" og ")), "nb")
    return aggregates.quality_summary(table(spark, sf, "documents").select("lang", said.alias("said")), "lang", "said")


@query("""SELECT row_id, CASE WHEN regexp_matches(trim(effective_at), '^\\d{4}-\\d{2}-\\d{2}$') THEN CASE WHEN TRY_CAST(trim(effective_at) AS DATE) BETWEEN DATE '1995-01-01' AND DATE '2026-01-02' THEN trim(effective_at) END
 WHEN regexp_matches(trim(effective_at), '^\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}') THEN CASE WHEN year(u) >= 1995 AND u <= TIMESTAMP '2026-01-02' THEN strftime(u, '%Y-%m-%dT%H:%M:%SZ') END END AS published
FROM (SELECT row_id, effective_at, (CASE WHEN regexp_matches(trim(effective_at), '(Z|[+-][0-9]{2}:?[0-9]{2})$') THEN TRY_CAST(trim(effective_at) AS TIMESTAMPTZ) ELSE TRY_CAST(trim(effective_at) || '+00:00' AS TIMESTAMPTZ) END) AT TIME ZONE 'UTC' AS u FROM evidence)""")
def published_times(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "evidence").select("row_id", dates.published(F.col("effective_at"), F.lit("2026-01-01 00:00:00").cast("timestamp")).alias("published"))


@query(f"""WITH {_PROFILES}, a AS (SELECT organisation_number AS owner, organisation_number AS number, 0 AS scope FROM profiles UNION ALL SELECT organisation_number, source_row_key, 1 FROM evidence WHERE source_row_key <> organisation_number), m AS (SELECT number, arg_min(owner, (scope, owner)) AS owner, min(scope) AS scope FROM a GROUP BY 1)
SELECT e.row_id, m.owner, m.scope FROM bulk_evidence e JOIN m ON e.source_row_key = m.number""")
def rows_by_owner(spark: SparkSession, sf: str) -> DataFrame:
    """Delivered rows with the company that their number is of, itself or by a subunit; the company itself goes before."""
    own = profiles(spark, sf).select(F.col("organisation_number").alias("owner"), F.col("organisation_number").alias("number"), F.lit(0).alias("scope"))
    units = table(spark, sf, "evidence").where("source_row_key <> organisation_number").select(F.col("organisation_number").alias("owner"), F.col("source_row_key").alias("number"), F.lit(1).alias("scope"))
    owners = own.unionByName(units).groupBy("number").agg(F.min(F.struct("scope", "owner")).alias("_o"))
    return table(spark, sf, "bulk_evidence").join(owners, F.col("source_row_key") == F.col("number")).select("row_id", "_o.owner", "_o.scope")


@query("""WITH h AS (SELECT organisation_number AS o, page_id, nullif(regexp_extract(lower(trim(source_url)), '^https?://(?:www\\.)?([^/?#:\\s]+)', 1), '') AS host FROM page_contents WHERE organisation_number IS NOT NULL), d AS (SELECT o, page_id, array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - 1, 1), len(string_split(host, '.'))), '.') AS domain FROM h WHERE host IS NOT NULL)
SELECT organisation_number, domain, rank FROM (SELECT o AS organisation_number, domain, row_number() OVER (PARTITION BY o ORDER BY min(page_id), domain) AS rank FROM d GROUP BY o, domain) WHERE rank <= 3""")
def candidate_domains(spark: SparkSession, sf: str) -> DataFrame:
    """The first three domains of each company's captures; the limit is the feature."""
    pages = table(spark, sf, "page_contents").where("organisation_number is not null")
    rows = pages.select("organisation_number", "page_id", url.registered_domain(url.host(F.col("source_url"))).alias("domain")).where("domain is not null")
    first = rows.groupBy("organisation_number", "domain").agg(F.min("page_id").alias("_first"))
    # A limit on a rank is taken before the shuffle, so no company's domains meet in one task.
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("organisation_number").orderBy("_first", "domain")))
    return ranked.where("rank <= 3").select("organisation_number", "domain", "rank")


@query("SELECT row_id, array_to_string(list_filter(['email:' || nullif(trim(hjemmeside), ''), 'mobile:' || nullif(trim(mobil), ''), 'phone:' || nullif(trim(telefon), '')], lambda x: x IS NOT NULL), '|') AS fields FROM registry")
def contact_fields(spark: SparkSession, sf: str) -> DataFrame:
    given = documents.contact_fields({"email": "hjemmeside", "mobile": "mobil", "phone": "telefon"})
    return table(spark, sf, "registry").select("row_id", F.array_join(F.transform(F.array_sort(F.map_entries(given)), lambda e: F.concat(e["key"], F.lit(":"), F.trim(e["value"]))), "|").alias("fields"))


@query("SELECT row_id AS update_id, as_of AS date, coalesce(organisation_number, '') AS organisation_number, status AS change_type, array_to_string(list_sort(list_distinct([field, 'a'])), ',') AS changed_fields FROM (SELECT CAST(row_id AS VARCHAR) AS row_id, as_of, organisation_number, status, field FROM evidence)")
def update_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence rows as an update feed of one entry each, read back."""
    change = F.array(F.struct(F.col("field").alias("path")), F.struct(F.lit("a").alias("path")), F.struct(F.col("field").alias("path")))
    entry = F.struct(F.col("row_id").cast("string").alias("oppdateringsid"), F.col("as_of").alias("dato"), F.col("organisation_number").alias("organisasjonsnummer"), F.col("status").alias("endringstype"), change.alias("endringer"))
    feed = table(spark, sf, "evidence").select(F.to_json(F.struct(F.struct(F.array(entry).alias("oppdaterteEnheter")).alias("_embedded"))).alias("body"))
    return documents.updates(feed, "body").withColumn("changed_fields", F.array_join("changed_fields", ","))


@query("""SELECT row_id, 'https://www.linkedin.com/company/' || array_to_string(regexp_extract_all(replace(replace(replace(lower(navn), 'æ', 'ae'), 'ø', 'o'), 'å', 'a'), '[a-z0-9]+'), '-') AS page FROM registry WHERE len(regexp_extract_all(replace(replace(replace(lower(navn), 'æ', 'ae'), 'ø', 'o'), 'å', 'a'), '[a-z0-9]+')) > 0""")
def guessed_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "registry").select("row_id", url.page_of_name(F.col("navn")).alias("page")).where("page is not null")


@query("SELECT page_id, regexp_matches(host, '^[^:]*\\.[^:]*$') AND NOT regexp_matches(host, '^[0-9.]+$') AS public FROM (SELECT page_id, nullif(regexp_extract(lower(trim(source_url)), '^https?://(?:www\\.)?([^/?#:\\s]+)', 1), '') AS host FROM page_contents) WHERE host IS NOT NULL")
def public_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "page_contents").select("page_id", url.host(F.col("source_url")).alias("h")).where("h is not null").select("page_id", url.public_address(F.col("h")).alias("public"))


@query("SELECT DISTINCT content_sha256, substr(content_sha256, 1, 2) || '/' || content_sha256 || '.bin' AS path FROM page_contents WHERE content_sha256 IS NOT NULL")
def content_paths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "page_contents").where("content_sha256 is not null").select("content_sha256", sinks.content_path(F.col("content_sha256")).alias("path")).distinct()


@query("SELECT evidence_id, claim_id FROM claims WHERE evidence_id NOT IN (SELECT coalesce(evidence_id, '') FROM claims WHERE confidence IS NOT NULL)")
def dangling_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Claims whose evidence no graded claim cites."""
    rows = table(spark, sf, "claims").where("evidence_id is not null")
    return claims.dangling(rows, rows.where("confidence is not null")).select("evidence_id", "claim_id")


@query("SELECT row_id, CASE WHEN regexp_matches(trim(antallansatte), '^[+-]?\\d+([.,]\\d+)?$') THEN TRY_CAST(replace(trim(antallansatte), ',', '.') AS DOUBLE) END AS number FROM registry")
def plain_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "registry").select("row_id", extract.plain_number(F.col("antallansatte")).cast("double").alias("number"))


@query("SELECT source, arg_min(doc_id, (-n_chars, doc_id)) AS doc_id, max(n_chars) AS n_chars FROM documents WHERE n_chars >= 200 GROUP BY 1")
def longest_of_source(spark: SparkSession, sf: str) -> DataFrame:
    """The best candidate of each key by score and order."""
    return identity.choose(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), "source", "n_chars", ["doc_id"], 200)


