"""Events of a crawl: pages, errors and ends, merged into what is known of each seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarv.functions.url import homepage

#: Fixed value: what is said of a seed that no event tells of.
NO_EVENT = "No page event emitted; request was rejected before download (for example by robots.txt)."
#: Pages larger than this aren't kept.
LARGEST_PAGE = 5_000_000


def merged_pages(events: DataFrame, entity: str = "organisation_number") -> DataFrame:
    """One row an entity and ``final_url``: the event retrieved last, and ``is_homepage``, true of the newest homepage alone.

    The homepage comes first, then ``final_url``: ``place`` sorts them so.
    Pages are never gathered, so an entity may have any number.
    """
    good = events.where("error is null and final_url is not null")
    time = F.struct("retrieved_at", "event_id")
    pages = good.groupBy(entity, "final_url").agg(F.max_by(F.struct("event_id", "page_kind", "retrieved_at"), time).alias("_e"))
    home = good.where("page_kind = 'home'").groupBy(entity).agg(F.max_by("final_url", time).alias("_home"))
    rows = pages.join(home, entity, "left").withColumn("is_homepage", F.coalesce(F.col("final_url") == F.col("_home"), F.lit(False)))
    return rows.select(entity, "final_url", "_e.*", "is_homepage", F.concat(F.when(F.col("is_homepage"), "0 ").otherwise("1 "), F.col("final_url")).alias("place"))


def errors(events: DataFrame, entity: str = "organisation_number") -> DataFrame:
    """``entity, requested_url, error``: each distinct error once."""
    return events.where("error is not null").select(entity, "requested_url", "error").distinct()


def missing_seeds(seeds: DataFrame, events: DataFrame, finished: Column, entity: str = "organisation_number", website: str = "website") -> DataFrame:
    """An error for each seed with a website that no event tells of; none before the crawl has ``finished``."""
    asked = seeds.where(F.col(website).isNotNull() & finished).join(events.select(entity).distinct(), entity, "left_anti")
    made = asked.select(entity, homepage(F.col(website)).alias("requested_url"), F.lit("homepage").alias("page_kind"), F.lit(NO_EVENT).alias("error"))
    return made.where("requested_url is not null").distinct()


def page_event(html: Column, text: Column, status: Column, size: Column) -> Column:
    """Why a capture isn't a page: null where it is one."""
    return F.when(~F.coalesce(status == 200, F.lit(False)), F.concat(F.lit("HTTP "), F.coalesce(status.cast("string"), F.lit("0")))).when(size > LARGEST_PAGE, "too large").when((F.coalesce(html, F.lit("")) == "") & (F.coalesce(text, F.lit("")) == ""), "empty")


def run_report(seeds: DataFrame, events: DataFrame, entity: str = "organisation_number") -> DataFrame:
    """One row: seeds, events, pages, errors, events a seed with any, and the share of seeds that ended."""
    per = events.groupBy(entity).agg(F.count("*").alias("_events"), F.count_if(F.col("error").isNull()).alias("_pages"))
    rows = seeds.select(entity).distinct().join(per, entity, "left")
    total = rows.agg(F.count("*").alias("seeds"), F.count("_events").alias("ended"), F.coalesce(F.sum("_events"), F.lit(0)).alias("events"), F.coalesce(F.sum("_pages"), F.lit(0)).alias("pages"))
    return total.select("seeds", "events", "pages", (F.col("events") - F.col("pages")).alias("errors"), F.round(F.col("events") / F.col("ended"), 4).alias("events_per_seed"), F.round(F.col("ended") / F.col("seeds"), 4).alias("terminal_coverage"))
