"""Facts that cite their evidence: derived, keyed, deduplicated, gathered and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarv.functions.url import web_address

SEPARATOR = "\u001f"
#: Fixed value: what a response says of its source, and what that makes of a claim.
AVAILABILITY = {"available": "available", "not_found": "not_available", "not_applicable": "not_applicable", "blocked": "blocked", "source_error": "failed", "not_fetched": "failed"}


def digest(*parts: Column, length: int) -> Column:
    """The first ``length`` hexadecimal digits of SHA-256 over the parts, joined by a unit separator; null as empty."""
    return F.substring(F.sha2(F.concat_ws(SEPARATOR, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, length)


def evidence_id(url: Column, content_sha256: Column, span: Column) -> Column:
    return F.concat(F.lit("ev-"), digest(url, content_sha256, span, length=20))


def claim_key(category: Column, field: Column, value: Column) -> Column:
    return digest(category, field, value, length=24)


def availability(status: Column) -> Column:
    mapping = F.create_map(*(F.lit(x) for pair in AVAILABILITY.items() for x in pair))
    return F.coalesce(F.try_element_at(mapping, status), F.lit("failed"))


def unpivot_facts(rows: DataFrame, keys: list[str], fields: dict[str, str]) -> DataFrame:
    """``keys, field, value``: one row for each column of ``fields`` that isn't null; 0 and false stay.

    ``fields`` maps columns to the names of their facts. One pass, no shuffle.
    """
    facts = F.array(*(F.struct(F.lit(name).alias("field"), F.col(column).cast("string").alias("value")) for column, name in fields.items()))
    return rows.select(*keys, F.inline(facts)).where("value is not null")


def nested_members(rows: DataFrame, keys: list[str], document: str, schema: str, path: tuple[str, ...]) -> DataFrame:
    """The members at ``path`` of a JSON document, one level of lists exploded after another.

    Rows whose document is null or isn't JSON have no members.
    """
    out = rows.select(*keys, F.from_json(document, schema).alias("_node"))
    for name in path:
        out = out.select(*keys, F.explode(F.col(f"_node.{name}")).alias("_node"))
    return out.select(*keys, "_node.*")


def cited(claims: DataFrame, entity: str = "organisation_number") -> DataFrame:
    """Claims that may be told: available, with address, hash and time of their evidence; each key once an entity.

    Adds ``evidence_id`` and ``claim_key``. Of claims with one key that with
    the smallest evidence holds, so the result doesn't depend on their order.
    """
    told = claims.where(F.col("status") == "available").where("source_url is not null and content_sha256 is not null and retrieved_at is not null and value is not null")
    told = told.withColumn("evidence_id", evidence_id(F.col("source_url"), F.col("content_sha256"), F.col("field"))).withColumn("claim_key", claim_key(F.coalesce(F.col("category"), F.lit("")), F.col("field"), F.col("value")))
    others = [c for c in told.columns if c not in (entity, "claim_key")]
    one = told.groupBy(entity, "claim_key").agg(F.min(F.struct(F.col("evidence_id").alias("_e"), F.col("retrieved_at").alias("_t"), F.struct(*others).alias("_row"))).alias("_best"))
    return one.select(entity, "claim_key", "_best._row.*")


def envelopes(inputs: DataFrame, claims: DataFrame, entity: str = "organisation_number", position: str = "position") -> DataFrame:
    """One row an input line: its number, how many claims and fields there are for it, and whether any.

    The claims themselves stay rows under their entity, which any number of
    lines may name; they are counted once an entity, never gathered.
    """
    counted = claims.groupBy(entity).agg(F.count("*").alias("n_claims"), F.count_distinct("field").alias("n_fields"))
    rows = inputs.join(counted, entity, "left")
    return rows.select(position, entity, F.coalesce("n_claims", F.lit(0)).alias("n_claims"), F.coalesce("n_fields", F.lit(0)).alias("n_fields"), F.col("n_claims").isNotNull().alias("found"))


def findings(evidence: DataFrame, key: str, url: str = "source_url", sha256: str = "content_sha256", at: str = "retrieved_at", content: str | None = None) -> DataFrame:
    """``key, code``: what is wrong with each piece of evidence, a row a finding."""
    checks = [
        (~web_address(F.col(url)), "invalid_url"),
        (~F.coalesce(F.col(sha256).rlike("^[0-9a-f]{64}$"), F.lit(False)), "invalid_hash"),
        (F.col(at).isNull(), "invalid_time"),
    ]
    if content:
        checks.append((F.col(sha256).rlike("^[0-9a-f]{64}$") & (F.sha2(F.col(content).cast("binary"), 256) != F.col(sha256)), "content_changed"))
    codes = F.array_compact(F.array(*(F.when(test, code) for test, code in checks)))
    return evidence.select(key, F.explode(codes).alias("code"))


def dangling(claims: DataFrame, evidence: DataFrame, key: str = "evidence_id") -> DataFrame:
    """Claims whose evidence isn't there."""
    return claims.join(evidence.select(key).distinct(), key, "left_anti")
