"""Observations of companies on other sites: what may be published, and what it adds up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarv.functions.url import host

#: Where observations may come from, what they may be, and how they may have been got.
PLATFORMS = (
    "company_site", "google_places", "linkedin", "facebook", "instagram", "x", "youtube", "tiktok", "glassdoor", "indeed", "job_board", "news", "openstreetmap", "brreg",
    "apple_app_store", "google_play", "wikidata", "wikipedia", "company_directory",
)
SIGNALS = ("company_profile", "profile_handle", "profile_metrics", "place_summary", "review", "review_summary", "job_posting", "workforce_snapshot", "public_post", "public_mention", "buzz_metrics")
MODES = ("official_api", "licensed_api", "company_authorized_export", "permitted_public_page")
INDEPENDENT = ("customer_review", "employee_review", "licensed_news", "public_news", "public_mention")
LABELS = ("positive", "neutral", "negative", "mixed")
#: An opinion is told from so many items, of so many sites or people.
LEAST_ITEMS, LEAST_HOSTS, LEAST_PEOPLE, FRESH_DAYS = 10, 2, 10, 45


def _none(column: str) -> Column:
    return F.coalesce(F.trim(F.col(column).cast("string")), F.lit("")) == ""


def _not_in(column: str, allowed: tuple[str, ...]) -> Column:
    return ~F.coalesce(F.col(column).isin(*allowed), F.lit(False))


def observation_rules() -> list[tuple[Column, str]]:
    """What speaks against an observation, in order, with the reason."""
    labelled = F.col("sentiment_label").isNotNull()
    return [
        (_none("id"), "missing observation id"),
        (~F.coalesce(F.col("organisation_number").rlike("^[0-9]+$"), F.lit(False)), "missing or invalid organisation number"),
        (_not_in("platform", PLATFORMS), "unsupported platform"),
        (_not_in("signal_type", SIGNALS), "unsupported signal type"),
        (host(F.col("source_url")).isNull(), "missing or invalid source URL"),
        (_none("retrieved_at"), "missing retrieval time"),
        (F.length(F.coalesce("content_sha256", F.lit(""))) != 64, "missing content hash"),
        (~F.coalesce("exact_entity", F.lit(False)), "exact legal entity is not verified"),
        (_none("identity_proof"), "missing exact-entity proof"),
        (_not_in("acquisition_mode", MODES), "acquisition mode is not approved for publication"),
        (~F.coalesce(F.col("rights_status") == "approved", F.lit(False)), "source rights are not approved"),
        (F.coalesce(F.col("signal_type").isin("review", "public_post", "public_mention"), F.lit(False)) & _none("evidence_span"), "missing evidence span"),
        (labelled & _not_in("sentiment_label", LABELS), "unsupported sentiment label"),
        (labelled & _not_in("source_class", INDEPENDENT), "sentiment source is not independent"),
        (labelled & _none("sentiment_model_version"), "missing sentiment model version"),
    ]


def judged(observations: DataFrame) -> DataFrame:
    """``observations`` with ``reasons``, empty where one may be published."""
    return observations.withColumn("reasons", F.array_compact(F.array(*(F.when(wrong, why) for wrong, why in observation_rules()))))


def opinion_reasons(text: str = "text") -> Column:
    """Why an item isn't taken for an opinion; its span stands in for a missing text."""
    needed = [(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", f"missing {c}") for c in ("source_url", "retrieved_at", "evidence_span", "content_sha256")]
    needed.append((F.coalesce(F.nullif(F.col(text), F.lit("")), F.col("evidence_span"), F.lit("")) == "", "missing text"))
    rules = [(~F.coalesce("exact_entity", F.lit(False)), "exact company identity is not verified"), (_not_in("source_class", INDEPENDENT), "source is not an allowed independent class"), *needed]
    return F.array_compact(F.array(*(F.when(wrong, why) for wrong, why in rules)))


def review_label(rating: Column) -> Column:
    """Up to two stars are negative, from four on positive."""
    return F.when(rating <= 2, "negative").when(rating >= 4, "positive").when(rating.isNotNull(), "neutral")


def footprint(observations: DataFrame, as_of: Column, entity: str = "organisation_number") -> DataFrame:
    """One row an entity: how many of its observations hold, how fresh they are, and what they add up to.

    Everything but the published is only counted. The opinion is the mean of
    positive and negative items from ``LEAST_ITEMS`` on, if they come from
    ``LEAST_HOSTS`` sites or ``LEAST_PEOPLE`` people; ``mixed`` ones count as
    items but not in the mean. One aggregation, combined before the shuffle.
    """
    rows = judged(observations).withColumn("_ok", F.size("reasons") == 0)
    ok = F.col("_ok")
    age = F.unix_timestamp(as_of) - F.unix_timestamp(F.col("retrieved_at").cast("timestamp"))
    opinion = ok & F.col("sentiment_label").isNotNull()
    value = F.when(F.col("sentiment_label") == "negative", -1).when(F.col("sentiment_label") == "positive", 1).when(F.col("sentiment_label") == "neutral", 0)
    got = rows.groupBy(entity).agg(
        F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), F.count_if(ok & age.between(0, FRESH_DAYS * 86400)).alias("fresh"),
        F.count_if(ok & F.col("signal_type").isin("review", "review_summary")).alias("reviews"), F.count_distinct(F.when(ok & (F.col("signal_type") == "job_posting"), F.col("source_url"))).alias("jobs"),
        F.count_distinct(F.when(ok & F.col("signal_type").isin("public_post", "public_mention", "buzz_metrics"), F.col("source_url"))).alias("public_items"),
        F.count_if(opinion).alias("opinions"), F.count_distinct(F.when(opinion, host(F.col("source_url")))).alias("_hosts"), F.count_distinct(F.when(opinion, F.col("reviewer_id"))).alias("_people"), F.avg(F.when(opinion, value)).alias("_mean"),
    )
    ready = (F.col("opinions") >= LEAST_ITEMS) & ((F.col("_hosts") >= LEAST_HOSTS) | (F.col("_people") >= LEAST_PEOPLE))
    return got.withColumn("opinion", F.when(ready, F.round(50 + 50 * F.col("_mean"), 1))).drop("_hosts", "_people", "_mean")


def reasons_counted(observations: DataFrame, by: str = "platform") -> DataFrame:
    """``by, reason, n``: how often each reason speaks against observations."""
    return judged(observations).select(by, F.explode("reasons").alias("reason")).groupBy(by, "reason").agg(F.count("*").alias("n"))


