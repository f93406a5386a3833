"""Claims of companies: what each part of a profile states, and what is explicitly absent.

A profile's parts are records, one row an entity and module, with the status
of their source and a JSON document as value. Each producer below reads one
module and gives rows of ``CLAIM``; a module that wasn't asked for gives none,
since not checked isn't the same as not available. ``compose`` puts them
together. Every producer is a projection and explosions, without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarv.operators.claims import availability

#: The columns of claims behind their entity.
CLAIM = ("category", "field", "availability", "value", "reason", "span", "confidence")
#: The categories in their order, and of availability the more telling first.
CATEGORIES = ("identity", "description", "filings", "leadership", "locations", "websites", "public_activity", "hiring", "relationships", "registry_activity")
STATES = ("available", "ambiguous", "blocked", "failed", "not_available", "not_applicable")
#: Codes of roles and the fields they make.
ROLE_FIELDS = {
    "DAGL": "ceo", "LEDE": "board_chair", "NEST": "board_deputy_chair", "MEDL": "board_member", "VARA": "board_deputy_member", "OBS": "board_observer", "REVI": "auditor", "REGN": "accountant",
    "KONT": "contact_person", "DTPR": "partner", "DTSO": "partner", "INNH": "owner", "FFØR": "business_manager", "KOMP": "general_partner", "PROK": "procuration", "SIGN": "signatory",
}
#: Figures of accounts and the fields they make.
FIGURES = {"revenue": "revenue", "operating_result": "operating_result", "profit_before_tax": "profit_before_tax", "annual_result": "net_result", "assets": "total_assets", "equity": "equity", "debt": "total_debt"}
#: Facts a model may draw from a page, with category and field.
MODEL_FACTS = {
    "business_description": ("description", "website_business_description"), "product_or_service": ("description", "website_product_or_service"), "certification": ("description", "website_certification"),
    "person_role": ("leadership", "website_named_role"), "office_location": ("locations", "website_office_location"), "contact_email": ("identity", "website_contact_email"),
    "contact_phone": ("identity", "website_contact_phone"), "founded_year": ("identity", "website_founded_year_statement"), "employee_count_statement": ("identity", "website_employee_count_statement"),
}


def _claim(category: str | Column, field: str | Column, value: Column, span: Column | None = None, confidence: Column | None = None) -> Column:
    """A claim, or nothing where the value is null or empty."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    text = value.cast("string")
    made = F.struct(
        lit(category).alias("category"), lit(field).alias("field"), F.lit("available").alias("availability"), text.alias("value"), F.lit(None).cast("string").alias("reason"),
        (span if span is not None else text).cast("string").alias("span"), (confidence if confidence is not None else F.lit(1.0)).cast("double").alias("confidence"),
    )
    return F.when(text.isNotNull() & (text != ""), made)


def _absent(category: str, field: str, state: str | Column, reason: str | Column, when: Column) -> Column:
    none = F.lit(None).cast("string")
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    made = F.struct(F.lit(category).alias("category"), F.lit(field).alias("field"), lit(state).alias("availability"), none.alias("value"), lit(reason).alias("reason"), none.alias("span"), F.lit(None).cast("double").alias("confidence"))
    return F.when(when, made)


def _claims(rows: DataFrame, entity: str, *claims: Column) -> DataFrame:
    return rows.select(entity, F.inline(F.array_compact(F.array(*claims)))).select(entity, *CLAIM)


def _module(records: DataFrame, name: str, schema: str) -> DataFrame:
    """The records of one module with their document as ``_v``; null unless the source was available."""
    document = F.from_json("value", schema)
    return records.where(F.col("module") == name).withColumn("_ok", F.col("status") == "available").withColumn("_v", F.when(F.col("_ok"), document))


def _unavailable(category: str, field: str, otherwise: str, when: Column) -> Column:
    """That a module has nothing: as its source says, with its note or else ``otherwise`` as the reason."""
    state = availability(F.col("status"))
    return _absent(category, field, F.when(state == "available", "not_available").otherwise(state), F.coalesce(F.nullif("note", F.lit("")), F.lit(otherwise)), when)


def _json(**parts: Column) -> Column:
    """A JSON object of the parts that aren't null."""
    return F.to_json(F.struct(*(value.alias(name) for name, value in parts.items())))


def latest_records(evidence: DataFrame, entity: str, module: Column) -> DataFrame:
    """The record of each entity and module retrieved last."""
    columns = ("status", "note", "value", "source_url", "retrieved_at", "content_sha256")
    rows = evidence.withColumn("module", module).where(F.col(entity).isNotNull() & F.col("module").isNotNull())
    last = rows.groupBy(entity, "module").agg(F.max_by(F.struct(*columns), F.struct("retrieved_at", "row_id")).alias("_r"))
    return last.select(entity, "module", "_r.*")


def identity_view(bulk: DataFrame, live: DataFrame, fields: list[str], entity: str = "organisation_number") -> DataFrame:
    """``entity, source`` and ``fields``: the live record where it is available and of the entity itself, else the bulk one.

    ``live`` has ``status`` and ``live_number`` beside the fields. An entity
    that only one side has keeps it; an unavailable live record, or one of
    another entity, counts as none.
    """
    good = live.where((F.col("status") == "available") & (F.col("live_number") == F.col(entity))).select(entity, F.lit(True).alias("_live"), *(F.col(f).alias(f"_{f}") for f in fields))
    both = bulk.select(entity, F.lit(True).alias("_bulk"), *fields).join(good, entity, "full")
    chosen = [F.when(F.col("_live"), F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in fields]
    return both.select(entity, F.when(F.col("_live"), "live").otherwise("bulk").alias("source"), *chosen)


def overlaid(base: DataFrame, live: DataFrame, fields: list[str], entity: str = "organisation_number") -> DataFrame:
    """``base`` with each field's live value where it isn't null, and ``identity_mismatch`` where the live record is of another entity and so isn't used."""
    other = live.select(entity, (F.col("live_number") != F.col(entity)).alias("_other"), "status", *(F.col(f).alias(f"_{f}") for f in fields))
    rows = base.join(other, entity, "left")
    use = F.coalesce((F.col("status") == "available") & ~F.col("_other"), F.lit(False))
    return rows.select(entity, *(F.coalesce(F.when(use, F.col(f"_{f}")), F.col(f)).alias(f) for f in fields), F.coalesce((F.col("status") == "available") & F.col("_other"), F.lit(False)).alias("identity_mismatch"))


def anchored(records: DataFrame, entity: str = "organisation_number") -> DataFrame:
    """``entity, anchored``: whether a registry, live or delivered, has answered for it."""
    registry = F.col("module").isin("registry", "registry_live") & (F.col("status") == "available")
    return records.groupBy(entity).agg(F.coalesce(F.bool_or(registry), F.lit(False)).alias("anchored"))


def filer(profiles: DataFrame, year: str) -> DataFrame:
    """The profiles that have filed accounts for the year and are neither bankrupt nor in liquidation."""
    closing = F.coalesce(F.col("bankrupt"), F.lit(False))
    if "liquidating" in profiles.columns:
        closing = closing | F.coalesce(F.col("liquidating"), F.lit(False))
    return profiles.where((F.col("latest_accounts") == year) & ~closing)


def verified_by_name(rows: DataFrame, owners: DataFrame, key: str = "name_key") -> DataFrame:
    """Rows joined to their owners by name: ``owner_number`` where one of the owner's numbers is the row's own, and ``mismatched`` where the name alone agrees.

    ``rows`` have ``key`` and ``number``, ``owners`` ``key``, ``owner_number``
    and ``allowed``, the numbers of the company and its subunits.
    """
    met = rows.join(owners, key)
    fits = F.array_contains("allowed", F.col("number"))
    return met.select(*rows.columns, F.when(fits, F.col("owner_number")).alias("owner_number"), (~F.coalesce(fits, F.lit(False))).alias("mismatched"))


def terminal_state(status: Column, note: Column) -> Column:
    """How a module ended: ``blocked`` splits by whether its note speaks of robots; no status is a submission error."""
    blocked = F.when(F.contains(F.lower(F.coalesce(note, F.lit(""))), F.lit("robot")), "blocked_robots").otherwise("blocked_policy")
    told = F.when(status == "available", "complete").when(status.isin("not_applicable", "not_found", "source_error"), status).when(status == "blocked", blocked)
    return told.otherwise("submission_error")


def identity_claims(view: DataFrame, entity: str = "organisation_number") -> DataFrame:
    """Who a company is: a row of ``view`` an entity, with what columns it has; all absent where ``name`` and all others are null."""
    has = lambda name: F.col(name) if name in view.columns else F.lit(None)
    text = lambda name: F.nullif(F.trim(has(name).cast("string")), F.lit(""))
    known = reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in view.columns if c not in (entity, "source")), F.lit(False))
    number = F.expr("try_cast(employees as long)") if "employees" in view.columns else F.lit(None).cast("long")
    flag = lambda name: F.when(F.lower(text(name)).isin("true", "false"), F.lower(text(name)))
    industry = F.when(text("industry").isNotNull(), _json(code=text("industry"), description=text("industry_label")))
    nothing = "No registry identity source was available to this run"
    return _claims(
        view, entity,
        *(_absent(category, field, "failed", nothing, ~known) for category, field in (("identity", "legal_name"), ("locations", "business_address"), ("description", "registered_activity"))),
        F.when(known, _claim("identity", "organisation_number", F.col(entity))),
        _claim("identity", "legal_name", text("name")),
        _absent("identity", "legal_name", "not_available", "Registry record has no name", known & text("name").isNull()),
        _claim("identity", "legal_form", text("legal_form")),
        _claim("identity", "industry", industry),
        _claim("identity", "bankrupt", flag("bankrupt")),
        _claim("identity", "under_liquidation", flag("liquidating")),
        _claim("identity", "registry_employee_count", number),
        _absent("identity", "registry_employee_count", "not_available", "The registry record carries no employee count", known & number.isNull()),
        _claim("identity", "founded_date", text("founded_date")),
        _claim("identity", "registry_registration_date", text("registered_date")),
        _claim("description", "registered_activity", text("activity")),
        _claim("description", "statutory_purpose", text("purpose")),
        _absent("description", "registered_activity", "not_available", "The registry record carries no activity or purpose text", known & text("activity").isNull() & text("purpose").isNull()),
        _claim("locations", "business_address", text("business_address")),
        _claim("locations", "postal_address", text("postal_address")),
        _absent("locations", "business_address", "not_available", "The registry record carries no business address", known & text("business_address").isNull()),
        _claim("websites", "registry_listed_website", text("website")),
        _claim("filings", "latest_filed_accounts_year", text("latest_accounts")),
    )


def financial_claims(records: DataFrame, entity: str = "organisation_number") -> DataFrame:
    """The figures of all periods; booleans and what isn't a number are no figures, and none at all is said so."""
    row = f"record_id:string,currency:string,account_type:string,period:struct<fraDato:string,tilDato:string>,{','.join(f'{f}:string' for f in FIGURES)}"
    rows = _module(records, "financials", f"struct<records:array<struct<{row}>>>")
    span = lambda r, name: F.concat_ws(" ", F.concat(F.lit(f"{name}="), r[name]), F.concat(r["period"]["fraDato"], F.lit(".."), r["period"]["tilDato"]), r["currency"])
    figures = F.flatten(F.transform(F.coalesce("_v.records", F.array()), lambda r: F.array_compact(F.array(*(F.when(r[name].try_cast("double").isNotNull(), _claim("filings", field, r[name], span(r, name))) for name, field in FIGURES.items())))))
    made = rows.withColumn("_made", figures)
    told = made.select(entity, F.inline("_made")).select(entity, *CLAIM)
    return told.unionByName(_claims(made, entity, _unavailable("filings", "annual_accounts", "No normalised annual-account record was returned; missing values are not zero", F.size("_made") == 0)))


def filed_years(years: Column) -> Column:
    """The distinct years of digits alone, ascending."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(years, lambda y: y.cast("string")), lambda y: y.rlike(r"^[0-9]+$"))))


def copies(years: Column, address) -> Column:
    """``struct(year, url)`` of each filed year's copy, the last year first; ``address`` makes a year's url."""
    return F.transform(F.reverse(filed_years(years)), lambda y: F.struct(y.alias("year"), address(y).alias("url")))


def history_claims(records: DataFrame, entity: str = "organisation_number") -> DataFrame:
    """The years with filed accounts, and a claim for each copy."""
    rows = _module(records, "financial_history", "struct<years:array<string>,pdfs:array<struct<year:string,url:string>>>")
    given = F.col("_v.years").isNotNull()
    copy = F.transform(F.when(given, F.coalesce("_v.pdfs", F.array())).otherwise(F.array()), lambda p: _claim("filings", "annual_accounts_copy", _json(year=p["year"], url=p["url"]), F.concat(F.lit("aarsregnskap/kopi/"), p["year"])))
    one = _claims(rows, entity, F.when(given, _claim("filings", "filed_account_years", F.to_json(F.coalesce("_v.years", F.array())))), _unavailable("filings", "filed_account_years", "Filing-year list unavailable", ~given))
    return one.unionByName(rows.select(entity, F.inline(F.array_compact(copy))).select(entity, *CLAIM))


def role_claims(records: DataFrame, entity: str = "organisation_number") -> DataFrame:
    """How many hold a role, each holder under the field of the role's code, and the last change of any."""
    member = "type:string,role_code:string,name:string,organisation_number:string,role:string,group:string,last_changed:string,inactive:boolean"
    rows = _module(records, "roles", f"struct<roles:array<struct<{member}>>>")
    active = rows.withColumn("_active", F.filter(F.coalesce("_v.roles", F.array()), lambda r: ~F.coalesce(r["inactive"], F.lit(False))))
    fields = F.create_map(*(F.lit(x) for pair in ROLE_FIELDS.items() for x in pair))
    code = lambda r: F.coalesce(r["role_code"], r["type"], F.lit(""))
    holder = lambda r: F.coalesce(F.nullif(r["name"], F.lit("")), r["organisation_number"])
    value = lambda r: _json(name=r["name"], organisation_number=r["organisation_number"], role_code=F.coalesce(r["role_code"], r["type"]), role=r["role"], group=r["group"], group_last_changed=r["last_changed"])
    held = F.transform("_active", lambda r: F.when(holder(r).isNotNull(), _claim("leadership", F.coalesce(F.try_element_at(fields, code(r)), F.lit("registered_role")), value(r), F.concat(F.lit("roller["), code(r), F.lit("]="), holder(r)))))
    changed = F.array_max(F.transform(F.filter("_active", lambda r: holder(r).isNotNull()), lambda r: r["last_changed"]))
    one = _claims(active, entity, F.when(F.col("_ok"), _claim("leadership", "role_count", F.size("_active"))), _unavailable("leadership", "roles", "Role source unavailable", ~F.col("_ok")), _claim("registry_activity", "roles_last_changed", F.when(F.col("_ok"), changed)))
    return one.unionByName(active.select(entity, F.inline(F.array_compact(held))).select(entity, *CLAIM))


def location_claims(records: DataFrame, entity: str = "organisation_number") -> DataFrame:
    """How many subunits there are, and each of them."""
    rows = _module(records, "locations", "struct<locations:array<struct<organisation_number:string,name:string,address:string,industry:string,employees:long>>>")
    units = F.when(F.col("_ok"), F.coalesce("_v.locations", F.array())).otherwise(F.array())
    unit = F.transform(units, lambda u: _claim("locations", "subunit", _json(organisation_number=u["organisation_number"], name=u["name"], address=u["address"], industry=u["industry"], employees=u["employees"]), F.concat(F.lit("underenheter["), u["organisation_number"], F.lit("]"))))
    one = _claims(rows, entity, F.when(F.col("_ok"), _claim("locations", "subunit_count", F.size(units))), _unavailable("locations", "subunits", "Subunit source unavailable", ~F.col("_ok")))
    return one.unionByName(rows.select(entity, F.inline(F.array_compact(unit))).select(entity, *CLAIM))


def group_claims(records: DataFrame, entity: str = "organisation_number") -> DataFrame:
    """The group's structure as it was given, or that there is none."""
    rows = records.where("module = 'group'")
    given = (F.col("status") == "available") & ~F.coalesce(F.trim("value"), F.lit("")).isin("", "null", "{}", "[]")
    return _claims(rows, entity, F.when(given, _claim("relationships", "group_structure", F.col("value"), F.lit("konsernstruktur"))), _unavailable("relationships", "group_structure", "No official group structure was returned", ~given))


def website_claims(records: DataFrame, entity: str = "organisation_number", assessments: DataFrame | None = None) -> DataFrame:
    """The official site, its description and profiles where the site is proven the company's own; else why not.

    ``assessments`` (``entity, url, identity_score``) grade the profiles; one
    is as sure as the less sure of itself and its site.
    """
    assessment = "identity_assessment:struct<publishable:boolean,score:double,reasons:array<string>>"
    rows = _module(records, "website", f"struct<final_url:string,title:string,description:string,social_links:array<struct<platform:string,url:string>>,{assessment}>")
    proven = F.col("_ok") & F.coalesce("_v.identity_assessment.publishable", F.lit(False))
    score = F.coalesce("_v.identity_assessment.score", F.lit(0.9))
    why = F.coalesce(F.nullif(F.array_join("_v.identity_assessment.reasons", "; "), F.lit("")), F.lit("Exact legal-entity identity not established"))
    one = _claims(
        rows, entity,
        F.when(proven, _claim("websites", "official_website", F.coalesce("_v.final_url", "source_url"), F.concat(F.lit("identity: "), F.coalesce(F.array_join("_v.identity_assessment.reasons", "; "), F.lit(""))), score)),
        F.when(proven, _claim("description", "website_description", F.col("_v.description"), F.concat(F.lit("meta description: "), F.left("_v.description", F.lit(200))), score)),
        _absent("websites", "official_website", "ambiguous", why, F.col("_ok") & ~proven),
        _unavailable("websites", "official_website", "Website unavailable", ~F.col("_ok")),
    )
    links = rows.where(proven).select(entity, score.alias("_site"), F.inline("_v.social_links"))
    graded = links.withColumn("_own", F.lit(None).cast("double")) if assessments is None else links.join(assessments.select(entity, "url", F.col("identity_score").alias("_own")), [entity, "url"], "left")
    profile = _claim("websites", "social_profile", _json(platform=F.col("platform"), url=F.col("url")), F.concat(F.lit("outbound link on company site: "), F.col("url")), F.least("_site", F.coalesce("_own", "_site")))
    return one.unionByName(_claims(graded, entity, profile))


def site_research_claims(records: DataFrame, entity: str = "organisation_number") -> DataFrame:
    """What a proven site shows: profiles, careers page, dated activity and jobs, or that it was looked for in vain."""
    item = "title:string,url:string,page_url:string,date:string,date_kind:string,summary:string,method:string"
    job = "title:string,url:string,page_url:string,date_posted:string,valid_through:string"
    rows = _module(records, "site_research", f"struct<site_url:string,identity_class:string,identity_reasons:array<string>,careers_page:string,profiles:array<struct<platform:string,url:string,found_on:string>>,activities:array<struct<{item}>>,jobs:array<struct<{job}>>>")
    reasons = F.coalesce(F.array_join("_v.identity_reasons", "; "), F.lit(""))
    rows = rows.withColumn("_sure", F.when(F.contains(reasons, F.lit("organisation number")), 1.0).otherwise(0.95))
    sure, lists = F.col("_sure"), lambda name: F.coalesce(f"_v.{name}", F.array())
    one = _claims(
        rows, entity,
        F.when(F.col("_ok"), _claim("websites", "official_website", F.col("_v.site_url"), F.concat(F.coalesce("_v.identity_class", F.lit("")), F.lit(": "), reasons), sure)),
        F.when(F.col("_ok"), _claim("websites", "careers_page", F.col("_v.careers_page"), None, sure)),
        _absent("public_activity", "site_activity", "not_available", "Verified website checked; no source-dated activity found", F.col("_ok") & (F.size(lists("activities")) == 0)),
        _absent("hiring", "job_posting", "not_available", "Verified website checked; no schema.org JobPosting found", F.col("_ok") & (F.size(lists("jobs")) == 0)),
        _unavailable("public_activity", "site_activity", "No verified company website", ~F.col("_ok")),
        _unavailable("hiring", "job_posting", "No verified company website", ~F.col("_ok")),
    )
    profile = F.transform(lists("profiles"), lambda p: _claim("websites", "social_profile", _json(platform=p["platform"], url=p["url"]), F.concat(F.lit("outbound link on verified site page "), p["found_on"]), sure))
    activity = F.transform(lists("activities"), lambda a: _claim("public_activity", "site_activity", _json(title=a["title"], url=a["url"], publication_date=a["date"], date_kind=a["date_kind"], summary=a["summary"]), F.concat_ws(" ", F.concat(a["method"], F.lit(":")), a["date"], a["title"]), sure))
    posting = F.transform(lists("jobs"), lambda j: _claim("hiring", "job_posting", _json(title=j["title"], url=j["url"], date_posted=j["date_posted"], valid_through=j["valid_through"]), F.concat(F.lit("schema.org JobPosting: "), j["title"]), sure))
    return one.unionByName(rows.select(entity, F.inline(F.array_compact(F.concat(profile, activity, posting)))).select(entity, *CLAIM))


def model_claims(facts: DataFrame, entity: str = "organisation_number") -> DataFrame:
    """Facts a model drew from pages and a check accepted (``fact_type, value, evidence_span, confidence``); unknown types are none."""
    kinds = F.create_map(*(x for kind, (category, field) in MODEL_FACTS.items() for x in (F.lit(kind), F.struct(F.lit(category).alias("category"), F.lit(field).alias("field")))))
    named = facts.withColumn("_kind", F.try_element_at(kinds, F.col("fact_type"))).where("_kind is not null")
    return _claims(named, entity, _claim(F.col("_kind.category"), F.col("_kind.field"), F.col("value"), F.col("evidence_span"), F.col("confidence")))


def without_filled_absents(claims: DataFrame, filling: DataFrame, entity: str = "organisation_number") -> DataFrame:
    """``claims`` and ``filling``, less what is absent in a category and field that ``filling`` has a claim for."""
    filled = filling.select(entity, "category", "field").distinct().withColumn("_filled", F.lit(True))
    kept = claims.join(filled, [entity, "category", "field"], "left").where("availability = 'available' or _filled is null").drop("_filled")
    return kept.unionByName(filling)


def compose(view: DataFrame, records: DataFrame, facts: DataFrame | None = None, entity: str = "organisation_number") -> DataFrame:
    """All claims of all companies; see the producers."""
    parts = [identity_claims(view, entity), *(make(records, entity) for make in (financial_claims, history_claims, role_claims, location_claims, group_claims, website_claims, site_research_claims))]
    claims = reduce(DataFrame.unionByName, parts)
    return claims if facts is None else without_filled_absents(claims, model_claims(facts, entity), entity)


def _counts_nothing() -> Column:
    return F.endswith(F.col("field"), F.lit("_count")) & (F.col("value").try_cast("double") == 0)


def _named(rank: str) -> Column:
    told = F.lit(None).cast("string")
    for n, state in enumerate(STATES, 1):
        told = F.when(F.col(rank) == n, state).otherwise(told)
    return told


def category_coverage(claims: DataFrame, entity: str = "organisation_number") -> DataFrame:
    """``entity, category, state``: of each category the most telling state, a count of zero being not available; ``not_checked`` without a claim."""
    state = F.when(F.coalesce(_counts_nothing(), F.lit(False)), "not_available").otherwise(F.col("availability"))
    rank = F.array_position(F.array(*map(F.lit, STATES)), state)
    best = claims.where(rank > 0).groupBy(entity, "category").agg(F.min(rank).alias("_rank"))
    every = claims.select(entity).distinct().withColumn("category", F.explode(F.array(*map(F.lit, CATEGORIES))))
    return every.join(best, [entity, "category"], "left").select(entity, "category", F.when(F.col("_rank").isNull(), "not_checked").otherwise(_named("_rank")).alias("state"))


def area_coverage(claims: DataFrame, entity: str = "organisation_number") -> DataFrame:
    """``entity`` and six areas: whether each has an available claim other than a count of zero."""
    good = (F.col("availability") == "available") & ~F.coalesce(_counts_nothing(), F.lit(False))
    has = lambda rule: F.coalesce(F.bool_or(good & rule), F.lit(False))
    category, field = F.col("category"), F.col("field")
    return claims.groupBy(entity).agg(
        has(category == "filings").alias("filings"), has(category == "leadership").alias("leadership"), has(category == "locations").alias("locations"), has((category == "websites") & (field == "official_website")).alias("websites"),
        has(((category == "websites") & (field == "social_profile")) | (category == "public_activity")).alias("public_footprint"), has(category == "hiring").alias("hiring"),
    )


def ranked_facts(claims: DataFrame, entity: str = "organisation_number", limit: int = 60, width: int = 240) -> DataFrame:
    """``entity, fact_id, category, field, value``: the first ``limit`` available claims of an entity by category, values cut to ``width``: what a prompt is given."""
    from pyspark.sql import Window

    rank = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    order = Window.partitionBy(entity).orderBy(rank, "field", "value")
    told = claims.where("availability = 'available'").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit)
    return told.select(entity, F.concat(F.lit("f"), F.col("_n")).alias("fact_id"), "category", "field", F.left("value", F.lit(width)).alias("value"))


#: Codes of what may be wrong with a claim and its evidence.
CODES = ("invalid_availability", "available_claim_without_evidence", "value_on_non_available_claim", "missing_evidence_record", "invalid_source_url", "invalid_retrieved_at", "invalid_content_sha256", "snapshot_hash_mismatch")
TERMINAL = ("completed", "failed")


def zoned_time(text: Column) -> Column:
    """Whether a text is an ISO date and time with its zone."""
    zoned = text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d(?::\d\d(?:[.,]\d{1,9})?)?(?:Z|[+-]\d\d:?\d\d)$")
    return F.coalesce(zoned & F.try_to_timestamp(F.regexp_replace(F.substring(text, 1, 19), "T", " ")).isNotNull(), F.lit(False))


def claim_findings(claims: DataFrame, evidence: DataFrame, web_address, claim: str = "claim_id", content: str | None = None) -> DataFrame:
    """``claim, evidence_id, code``: what is wrong with claims and the evidence they cite.

    ``claims`` has ``availability``, ``value`` and ``evidence_ids`` (a list),
    ``evidence`` ``evidence_id, source_url, retrieved_at`` (text) and
    ``content_sha256``, and the captured ``content`` where it is at hand. A
    claim of unknown availability isn't looked into further.
    """
    known = F.coalesce(F.col("availability").isin(*STATES), F.lit(False))
    given = F.size(F.coalesce("evidence_ids", F.array().cast("array<string>"))) > 0
    own = F.array_compact(
        F.array(
            F.when(~known, "invalid_availability"),
            F.when(known & (F.col("availability") == "available") & ~given, "available_claim_without_evidence"),
            F.when(known & (F.col("availability") != "available") & F.col("value").isNotNull(), "value_on_non_available_claim"),
        )
    )
    first = claims.select(claim, F.lit(None).cast("string").alias("evidence_id"), F.explode(own).alias("code"))
    cited = claims.where(known).select(claim, F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
    met = cited.join(evidence.withColumn("_there", F.lit(True)), "evidence_id", "left")
    wrong = [
        F.when(F.col("_there").isNull(), "missing_evidence_record"),
        F.when(F.col("_there") & ~web_address(F.col("source_url")), "invalid_source_url"),
        F.when(F.col("_there") & ~zoned_time(F.col("retrieved_at")), "invalid_retrieved_at"),
        F.when(F.col("_there") & ~F.coalesce(F.col("content_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "invalid_content_sha256"),
    ]
    if content:
        wrong.append(F.when(F.col(content).isNotNull() & ~F.sha2(F.col(content).cast("binary"), 256).eqNullSafe(F.col("content_sha256")), "snapshot_hash_mismatch"))
    return first.unionByName(met.select(claim, "evidence_id", F.explode(F.array_compact(F.array(*wrong))).alias("code")))


def envelope_findings(envelopes: DataFrame, number: str = "organisation_number", status: str = "terminal_status") -> DataFrame:
    """``position, code``: inputs whose number is none although the run didn't fail, and runs that never ended."""
    bad = ~F.coalesce(F.col(number).rlike("^[0-9]{9}$"), F.lit(False)) & ~F.coalesce(F.col(status) == "failed", F.lit(False))
    codes = F.array_compact(F.array(F.when(bad, "invalid_organisation_number"), F.when(~F.coalesce(F.col(status).isin(*TERMINAL), F.lit(False)), "non_terminal_status")))
    return envelopes.select("position", F.explode(codes).alias("code"))


def duplicate_evidence(evidence: DataFrame, owner: str) -> DataFrame:
    """``owner, evidence_id`` of evidence that an owner lists more than once."""
    return evidence.groupBy(owner, "evidence_id").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")


def batch_checks(inputs: DataFrame, envelopes: DataFrame, found: DataFrame) -> DataFrame:
    """One row: whether each input line has one envelope, in its place, ended, and without a finding."""
    both = inputs.select("position", F.col("organisation_number").alias("_asked")).join(envelopes.select("position", "terminal_status", F.col("organisation_number").alias("_got"), F.lit(1).alias("_there")), "position", "full")
    counts = both.groupBy("position").agg(F.count("_there").alias("_n"), F.bool_and(F.col("_asked").eqNullSafe(F.col("_got"))).alias("_same"), F.bool_and(F.col("terminal_status").isin(*TERMINAL)).alias("_ended"), F.count("*").alias("_rows"))
    checks = counts.agg(
        F.coalesce(F.bool_and((F.col("_n") == 1) & (F.col("_rows") == 1)), F.lit(True)).alias("one_envelope_per_input_row"), F.coalesce(F.bool_and("_same"), F.lit(True)).alias("envelopes_follow_input_order"),
        F.coalesce(F.bool_and(F.coalesce("_ended", F.lit(False))), F.lit(True)).alias("all_terminal"),
    )
    return checks.join(F.broadcast(found.agg((F.count("*") == 0).alias("all_envelopes_valid"))))
