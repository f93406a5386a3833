"""Queries of the text and matching problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarv.llm import addresses, boilerplate, encoding, leakage, matching, mixing, splitting
from skarv.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.body_lines(table(spark, sf_dir, "page_contents"))


def p1_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's body as text; a page without one is left out."""
    pages = table(spark, sf_dir, "page_contents")
    lines = boilerplate.body_lines(pages).groupBy("page_id").agg(F.sort_array(F.collect_list("line_no")).alias("_lines"))
    split = F.split("text", "\n", -1)
    return pages.join(lines, "page_id").select("page_id", F.array_join(F.transform("_lines", lambda n: F.get(split, (n - 1).cast("int"))), "\n").alias("body"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.pairs(table(spark, sf_dir, "map_places"), table(spark, sf_dir, "registry")).select("organisation_number", "place_id").distinct()


def p3_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each matched place with the rule that resolved it and its confidence."""
    return matching.match(table(spark, sf_dir, "map_places"), table(spark, sf_dir, "registry"))


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    address, none = F.col("forretningsadresse"), F.lit(None).cast("string")
    registry = table(spark, sf_dir, "registry").select(F.col("row_id").alias("record"), address["adresse"].alias("address"), address["postnummer"].alias("code"), address["poststed"].alias("town"))
    claims = table(spark, sf_dir, "claims").select(F.col("claim_id").alias("record"), "address", none.alias("code"), none.alias("town"))
    return registry.unionByName(claims)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.same_location(addresses.locate(_addresses(spark, sf_dir), "record", "address", "code", "town"))


def p6_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records each location has."""
    return addresses.locate(_addresses(spark, sf_dir), "record", "address", "code", "town").groupBy("location").agg(F.count_distinct("record").alias("records"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.find_damage(table(spark, sf_dir, "claims"), "claim_id", ("name", "purpose")).select("claim_id", "column_name").distinct()


def p7_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged values with their restored text and the encodings that were mixed up."""
    return encoding.find_damage(table(spark, sf_dir, "claims"), "claim_id", ("name", "purpose"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents leak each item, and how much of it they carry at most."""
    items = table(spark, sf_dir, "eval_items")
    leaks = leakage.find_leaks(table(spark, sf_dir, "documents"), items).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("share").alias("most"))
    return items.select("item_id", "suite", "split").join(leaks, "item_id", "left").na.fill({"documents": 0})


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.unreachable(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture and how often it uses each."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares in tokens that the mixture reached."""
    return mixing.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(table(spark, sf_dir, "documents"))


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in pieces, those within the limit in one."""
    return splitting.split(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")


QUERIES = {f.__name__: f for f in (p1_found, p1_bodies, p3_found, p3_matches, p6_found, p6_locations, p7_found, p7_restored, p8_found, p8_report, p9_found, p9_mixture, p9_report, p10_found, p10_pieces)}
SQL: dict[str, str] = {}
