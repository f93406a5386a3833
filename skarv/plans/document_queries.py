"""Queries over registry documents, texts, addresses and files written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarv.functions import extract, text, url
from skarv.operators import claims, company_claims, documents, identity, refresh
from skarv.plans.company_queries import _HOST, _PROFILES, _fold_sql, profiles
from skarv.session import shared_dir, table
from skarv.sources import readers, sinks
from skarv.streaming import events

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(make):
        QUERIES[make.__name__] = make
        if sql is not None:
            SQL[make.__name__] = sql
        return make

    return add


def _folder(spark: SparkSession) -> str:
    """A new place in the shared folder that goes with the application."""
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


@query("""SELECT row_id, organisasjonsnummer AS organisation_number, navn AS name, organisasjonsform.kode AS legal_form, TRY_CAST(antallansatte AS BIGINT) AS employees, TRY_CAST(konkurs AS BOOLEAN) AS bankrupt, nullif(forretningsadresse.adresse, '') AS line, nullif(forretningsadresse.poststed, '') AS town FROM registry""")
def entity_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Registry rows as entity documents, read back by their schema."""
    a = F.col("forretningsadresse")
    place = F.struct(F.array_compact(F.array(a["adresse"])).alias("adresse"), a["postnummer"].alias("postnummer"), a["poststed"].alias("poststed"))
    body = F.struct("organisasjonsnummer", "navn", "organisasjonsform", F.col("antallansatte").try_cast("long").alias("antallAnsatte"), F.col("konkurs").try_cast("boolean").alias("konkurs"), place.alias("forretningsadresse"))
    rows = documents.entities(table(spark, sf, "registry").select("row_id", F.to_json(body).alias("body")), "row_id", "body")
    return rows.select("row_id", "organisation_number", "name", "legal_form", "employees", "bankrupt", F.col("business_address.line").alias("line"), F.col("business_address.poststed").alias("town"))


@query("""SELECT o_custkey, position, period_from, revenue, net_result FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS position, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS period_from, CAST(o_totalprice AS DOUBLE) AS revenue, CAST(-o_totalprice AS DOUBLE) AS net_result FROM orders) WHERE position <= 3""")
def account_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The last three orders of each customer as its accounts, read back from documents."""
    day = F.col("o_orderdate").cast("date").cast("string")
    total = F.col("o_totalprice").cast("double")
    result = F.struct((-total).alias("aarsresultat"), F.struct(F.struct(total.alias("sumDriftsinntekter")).alias("driftsinntekter")).alias("driftsresultat"))
    account = F.struct(F.col("o_orderkey").alias("id"), F.lit("NOK").alias("valuta"), F.struct(day.alias("fraDato"), day.alias("tilDato")).alias("regnskapsperiode"), result.alias("resultatregnskapResultat"))
    entry = F.struct((-F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))).alias("_t"), F.col("o_orderkey").alias("_k"), account.alias("_a"))
    last = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), "o_orderkey")
    three = table(spark, sf, "orders").withColumn("_n", F.row_number().over(last)).where("_n <= 3")
    orders = three.groupBy("o_custkey").agg(F.to_json(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["_a"])).alias("body"))
    return documents.accounts(orders, "o_custkey", "body").select("o_custkey", "position", "period_from", "revenue", "net_result")


@query("SELECT s_nationkey AS nation, 'LEDE' AS role, s_name AS holder, CAST(s_suppkey AS VARCHAR) AS holder_number, s_acctbal < 0 AS left_office FROM supplier")
def role_documents(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.struct(F.lit("LEDE").alias("kode"))
    role = F.struct(kind.alias("type"), (F.col("s_acctbal") < 0).alias("fratraadt"), F.struct(F.col("s_suppkey").cast("string").alias("organisasjonsnummer"), F.array("s_name").alias("navn")).alias("enhet"))
    bodies = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.to_json(F.struct(F.array(F.struct(kind.alias("type"), F.lit("2024-01-01").alias("sistEndret"), F.array(role).alias("roller"))).alias("rollegrupper"))).alias("body"))
    return documents.roles(bodies, "nation", "body").select("nation", "role", "holder", "holder_number", "left_office")


@query("SELECT s_nationkey AS nation, CAST(s_suppkey AS VARCHAR) AS unit_number, s_name AS name, CASE WHEN s_acctbal > 0 THEN 'Gate 1' ELSE 'Boks 1' END AS line FROM supplier")
def unit_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as subunits with a location or else a postal address."""
    place = F.struct(F.array_compact(F.array(F.when(F.col("s_acctbal") > 0, "Gate 1"))).alias("adresse"))
    unit = F.struct(F.col("s_suppkey").cast("string").alias("organisasjonsnummer"), F.col("s_name").alias("navn"), place.alias("beliggenhetsadresse"), F.struct(F.array(F.lit("Boks 1")).alias("adresse")).alias("postadresse"))
    bodies = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.to_json(F.struct(F.struct(F.array(unit).alias("underenheter")).alias("_embedded"))).alias("body"))
    return documents.locations(bodies, "nation", "body").select("nation", "unit_number", "name", F.col("address.line").alias("line"))


@query("SELECT o_orderkey, year(o_orderdate) = 1995 AS fits FROM orders")
def periods_in_year(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date").cast("string")
    return table(spark, sf, "orders").select("o_orderkey", documents.in_period(day, day, F.lit("1995")).alias("fits"))


@query("SELECT (SELECT count(DISTINCT organisasjonsnummer) FROM registry WHERE organisasjonsnummer NOT IN (SELECT organisation_number FROM claims WHERE organisation_number IS NOT NULL)) AS only_previous, (SELECT count(DISTINCT organisation_number) FROM claims WHERE organisation_number NOT IN (SELECT organisasjonsnummer FROM registry)) AS only_current")
def keys_of_either_side(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "registry").select(F.col("organisasjonsnummer").alias("k"))
    return refresh.same_keys(a, table(spark, sf, "claims").where("organisation_number is not null").select(F.col("organisation_number").alias("k")), "k")


@query(f"""SELECT row_id, CASE WHEN {_HOST.format("hjemmeside")} IS NOT NULL AND contains(hjemmeside, '.') THEN 'https://www.' || {_HOST.format("hjemmeside")} || '/' END AS page FROM registry WHERE hjemmeside IS NOT NULL""")
def homepages(spark: SparkSession, sf: str) -> DataFrame:
    """The homepage of each registered website, under ``www``."""
    rows = table(spark, sf, "registry").where("hjemmeside is not null")
    page = F.regexp_replace(url.homepage(F.col("hjemmeside")), r"^https?://(?:www\.)?([^/]+)/.*$", "https://www.$1/")
    return rows.select("row_id", page.alias("page"))


@query(f"SELECT row_id, array_to_string(regexp_extract_all({_fold_sql('navn')}, '[a-z0-9]+'), '-') AS slug, regexp_replace(array_to_string(regexp_extract_all({_fold_sql('navn')}, '[a-z0-9]+'), ' '), '( ({'|'.join(text.LEGAL_FORMS)}))+$', '') AS plain FROM registry")
def name_slugs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "registry").select("row_id", text.slug(F.col("navn")).alias("slug"), text.without_legal_form(F.col("navn")).alias("plain"))


@query(f"""SELECT claim_id, len(list_filter(regexp_extract_all({_fold_sql("coalesce(name, '')")}, '[a-z0-9]+'), lambda t: NOT list_contains(regexp_extract_all({_fold_sql("coalesce(purpose, '')")}, '[a-z0-9]+'), t))) = 0 AS supported FROM claims WHERE name IS NOT NULL AND purpose IS NOT NULL""")
def names_in_purposes(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each claim's purpose has all words of its name."""
    return table(spark, sf, "claims").where("name is not null and purpose is not null").select("claim_id", text.supported_by(F.col("name"), F.col("purpose")).alias("supported"))


@query("""SELECT p.page_id, contains(lower(regexp_replace(p.text, '\\s+', ' ', 'g')), lower(trim(regexp_replace(c.name, '\\s+', ' ', 'g')))) AS named FROM page_contents p JOIN (SELECT organisation_number, max(name) AS name FROM claims WHERE organisation_number IS NOT NULL AND regexp_matches(name, '^[A-Za-zæøåÆØÅ ]+$') GROUP BY 1) c USING (organisation_number) WHERE p.text IS NOT NULL""")
def names_on_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a page quotes its company's name, layout and typography aside; one name a company."""
    names = table(spark, sf, "claims").where("organisation_number is not null").where(F.col("name").rlike("^[A-Za-zæøåÆØÅ ]+$")).groupBy("organisation_number").agg(F.max("name").alias("name"))
    pages = table(spark, sf, "page_contents").where("text is not null").join(names, "organisation_number")
    return pages.select("page_id", text.contains_span(F.col("text"), F.col("name")).alias("named"))


@query("SELECT status, count(*) AS pages FROM (SELECT CASE WHEN status_code = 200 THEN 'available' WHEN status_code IN (404, 410) THEN 'not_found' ELSE 'source_error' END AS status FROM page_contents) GROUP BY 1")
def page_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "page_contents").groupBy(readers.outcome(F.col("status_code")).alias("status")).agg(F.count("*").alias("pages"))


@query("""WITH c AS (SELECT source_url AS url, arg_max(status_code, (retrieved_at, page_id)) AS status, arg_max(coalesce(html, ''), (retrieved_at, page_id)) AS body FROM page_contents WHERE source_url IS NOT NULL GROUP BY 1)
SELECT r.url, coalesce(status, 0) AS status, CASE WHEN c.url IS NOT NULL THEN sha256(body) END AS content_sha256, CASE WHEN c.url IS NULL THEN 'not captured' END AS error FROM (SELECT DISTINCT source_url AS url FROM claims WHERE source_url IS NOT NULL UNION SELECT url FROM c) r LEFT JOIN c ON r.url = c.url""")
def replayed(spark: SparkSession, sf: str) -> DataFrame:
    """The addresses of claims and pages answered out of the last captures."""
    pages = table(spark, sf, "page_contents").where("source_url is not null")
    captured = pages.groupBy(F.col("source_url").alias("url")).agg(F.max_by(F.struct(F.col("status_code").alias("status"), F.coalesce("html", F.lit("")).alias("body")), F.struct("retrieved_at", "page_id")).alias("_p")).select("url", "_p.status", "_p.body")
    asked = table(spark, sf, "claims").where("source_url is not null").select(F.col("source_url").alias("url")).union(captured.select("url")).distinct()
    return readers.replay(asked, captured).drop("body")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def last_order_wins(spark: SparkSession, sf: str) -> DataFrame:
    return readers.last_wins(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def lines_written_and_read(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered JSON lines, written and read back under their schema."""
    path = _folder(spark)
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    sinks.write_json_lines(rows, path, ["n_nationkey"])
    return readers.read_json_lines(spark, path, "n_nationkey long, n_name string, n_regionkey long").select(*(F.col(c).cast(t) for c, t in rows.dtypes))


@query("SELECT sha256(text) AS sha256, max(length(text)) AS characters FROM documents WHERE text IS NOT NULL GROUP BY 1")
def contents_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Texts in a store by their hash, each once although they are added twice."""
    path, rows = _folder(spark), table(spark, sf, "documents").select("text")
    sinks.store_contents(rows, path, "text")
    sinks.store_contents(rows, path, "text")
    return sinks.stored_contents(spark, path).select("sha256", F.length(F.col("content").cast("string")).alias("characters"))


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS report FROM nation""")
def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.report(table(spark, sf, "nation").select("n_nationkey", "n_name"))


@query("SELECT row_id FROM evidence ORDER BY row_id DESC LIMIT 100")
def history_kept(spark: SparkSession, sf: str) -> DataFrame:
    """A history keeps its last 100 entries; the limit is the feature."""
    rows = table(spark, sf, "evidence").select("row_id")
    return sinks.append_history(rows.where("row_id <= 1000"), rows.where("row_id > 1000"), "row_id")


@query("SELECT event_id FROM events WHERE CAST(ts AS TIMESTAMP) <= TIMESTAMP '2024-01-20' AND CAST(ts AS TIMESTAMP) >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY")
def fresh_events(spark: SparkSession, sf: str) -> DataFrame:
    return events.freshness(table(spark, sf, "events"), "ts", "2024-01-20 00:00:00", 7).select("event_id")


@query(f"""WITH {_PROFILES} SELECT organisation_number, name = 'Nytt om ' || name AS same, true AS at_start, true AS after_word, false AS inside FROM (SELECT organisation_number, name FROM profiles WHERE regexp_matches(lower(name), '[a-z0-9æøå]'))""")
def names_in_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Each company's name in a title of its own, behind a word that may stand there, and within another name."""
    rows = profiles(spark, sf).where(F.lower("name").rlike("[a-z0-9æøå]"))
    name = F.col("name")
    return rows.select("organisation_number", (name == F.concat(F.lit("Nytt om "), name)).alias("same"), identity.in_title(name, F.concat(name, F.lit(" vokser - Avisen"))).alias("at_start"), identity.in_title(name, F.concat(F.lit("Nytt om "), name)).alias("after_word"), identity.in_title(name, F.concat(F.lit("Zzz "), name)).alias("inside"))


@query("SELECT claim_id, 'ev-' || substr(sha256(concat_ws(chr(31), coalesce(source_url, ''), coalesce(evidence_id, ''), coalesce(name, ''))), 1, 20) AS id FROM claims")
def evidence_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "claims").select("claim_id", claims.evidence_id(F.col("source_url"), F.col("evidence_id"), F.col("name")).alias("id"))


@query("""SELECT eval.item_id, CAST(json_extract_string(j, '$.n') AS BIGINT) AS n FROM (SELECT item_id, '{"n": ' || length(text) || '}' AS j FROM eval_items) eval""")
def fenced_answers(spark: SparkSession, sf: str) -> DataFrame:
    """JSON between code fences, as models answer."""
    rows = table(spark, sf, "eval_items")
    said = F.concat(F.lit("Here it is:\n```json\n"), F.to_json(F.struct(F.length("text").alias("n"))), F.lit("\n```\n"))
    return rows.select("item_id", F.get_json_object(extract.fenced_json(said), "$.n").cast("long").alias("n"))


@query("SELECT organisation_number, coalesce(bool_or(field = 'registry' AND status = 'available'), false) AS anchored FROM bulk_evidence WHERE organisation_number IS NOT NULL GROUP BY 1")
def anchored_companies(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "bulk_evidence").where("organisation_number is not null").withColumnRenamed("field", "module")
    return company_claims.anchored(rows)


@query(f"WITH {_PROFILES} SELECT organisation_number, name FROM profiles WHERE latest_accounts = '2024' AND NOT bankrupt")
def filers(spark: SparkSession, sf: str) -> DataFrame:
    return company_claims.filer(profiles(spark, sf), "2024").select("organisation_number", "name")


@query(f"SELECT row_id, array_to_string(list_filter(regexp_extract_all({_fold_sql('title')}, '[a-z0-9]+'), lambda t: length(t) >= 3 OR regexp_matches(t, '[0-9]')), ' ') AS words FROM map_places")
def place_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "map_places").select("row_id", F.array_join(text.place_tokens(F.col("title")), " ").alias("words"))


@query(f"""WITH h AS (SELECT DISTINCT {_HOST.format("source_url")} AS host FROM claims WHERE contains(source_url, '.')), l AS (SELECT host, string_split(host, '.') AS p FROM h WHERE host IS NOT NULL),
s AS (SELECT *, CASE WHEN regexp_matches(host, '^(.*[.])?example$') THEN len(p) - 1 ELSE greatest(len(p) - 1, 1) END AS b FROM l) SELECT host, CASE WHEN b > 0 THEN array_to_string(list_slice(p, b, len(p)), '.') END AS domain FROM s""")
def domains_under_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    """Registered domains of the hosts that claims cite, under a given list of suffixes."""
    hosts = table(spark, sf, "claims").select(url.host(F.col("source_url")).alias("host")).where("host is not null").distinct()
    return url.registered_domains(hosts, "host", spark.createDataFrame([("example",), ("co.uk",)], "suffix string"))


@query(f"""WITH {_PROFILES} SELECT count(*) AS rows, count_if(c.organisation_number = p.organisation_number) AS verified, count(*) - count_if(c.organisation_number = p.organisation_number) AS mismatched FROM claims c JOIN profiles p ON lower(c.name) = lower(p.name) WHERE c.name IS NOT NULL""")
def owners_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Claims joined to companies by name alone, verified by number; what isn't is counted, not told."""
    rows = table(spark, sf, "claims").where("name is not null").select(F.lower("name").alias("name_key"), F.col("organisation_number").alias("number"))
    owners = profiles(spark, sf).select(F.lower("name").alias("name_key"), F.col("organisation_number").alias("owner_number"), F.array("organisation_number").alias("allowed"))
    return company_claims.verified_by_name(rows, owners).agg(F.count("*").alias("rows"), F.count("owner_number").alias("verified"), F.count_if("mismatched").alias("mismatched"))


@query(f"WITH {_PROFILES} SELECT p.organisation_number AS o, p.name AS n, p.legal_form AS f, coalesce(p.employees, -1) AS e, coalesce(c.k, 0) AS c FROM profiles p LEFT JOIN (SELECT organisation_number, count(*) AS k FROM claims GROUP BY 1) c ON c.organisation_number = p.organisation_number")
def compact_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """The few fields of each profile that a page shows, under short names."""
    counted = table(spark, sf, "claims").groupBy("organisation_number").agg(F.count("*").alias("k"))
    rows = profiles(spark, sf).join(counted, "organisation_number", "left")
    return rows.select(F.col("organisation_number").alias("o"), F.col("name").alias("n"), F.col("legal_form").alias("f"), F.coalesce("employees", F.lit(-1)).alias("e"), F.coalesce("k", F.lit(0)).alias("c"))
