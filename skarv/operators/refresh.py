"""Two snapshots of entities compared field by field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarv.functions.canon import canonical_once

CHANGE = "field string, old_value string, new_value string, old_hash string, new_hash string"


def diff(previous: DataFrame, current: DataFrame, key: str, tracked: list[str], status: str | None = None) -> DataFrame:
    """``key, field, old_value, new_value, old_hash, new_hash``: the tracked fields that differ, a row each.

    * Values are JSON and compared in canonical form, whatever the order of
      keys and members; null is a value.
    * With ``status`` only entities that are ``available`` in both are
      compared, so that an outage isn't a change.
    * Entities in one snapshot only are left to ``only_in``. Comparing a
      snapshot with itself yields nothing.

    One join on the key; the fields are unpivoted behind it.
    """
    side = lambda df, tag: df.select(key, *(F.col(c).cast("string").alias(f"{tag}{c}") for c in tracked), *([F.col(status).alias(f"{tag}_status")] if status else []))
    both = side(previous, "a_").join(side(current, "b_"), key)
    if status:
        both = both.where("a__status = 'available' and b__status = 'available'")
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"a_{c}").alias("_a"), F.col(f"b_{c}").alias("_b")) for c in tracked))
    rows = both.select(key, F.inline(pairs)).where("not (_a <=> _b)").select(key, "field", canonical_once("_a").alias("old_value"), canonical_once("_b").alias("new_value"))
    rows = rows.where("not (old_value <=> new_value)")
    return rows.select("*", F.sha2("old_value", 256).alias("old_hash"), F.sha2("new_value", 256).alias("new_hash"))


def only_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The keys of ``a`` that ``b`` doesn't have."""
    return a.select(key).distinct().join(b, key, "left_anti")


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many keys either side has alone."""
    both = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full")
    return both.agg(F.count_if(F.col("_b").isNull()).alias("only_previous"), F.count_if(F.col("_a").isNull()).alias("only_current"))
