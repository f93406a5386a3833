"""Queries that run streams over what their source has now, and the SQL of the same over the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

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


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return events.timed(events.read_files(spark, sf, "events.parquet"))


def _plain(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in rows.dtypes))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS events FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(events.materialise(events.tumbling_counts(_events(spark, sf), ["event_type"], "1 hour"), "complete"))


@query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) - o * INTERVAL 30 MINUTE AS window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS events FROM events, range(2) r(o) GROUP BY ALL")
def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(events.materialise(events.sliding_counts(_events(spark, sf), ["event_type"], "1 hour", "30 minutes"), "complete"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, user_id, count(*) AS events FROM n GROUP BY user_id, s""")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(events.materialise(events.sessions(_events(spark, sf), ["user_id"], "6 hours"), "complete"))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def stream_latest_state(spark: SparkSession, sf: str) -> DataFrame:
    return events.materialise(events.latest_states(_events(spark, sf), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"]), "complete")


@query("SELECT DISTINCT event_id FROM events")
def stream_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return events.materialise(events.distinct_events(_events(spark, sf), ["event_id"]).select("event_id"), "append").select("event_id")


@query("SELECT CAST(user_id AS VARCHAR) AS key, o AS old_value, event_type AS new_value, ts AS at FROM (SELECT *, lag(event_type) OVER w AS o, row_number() OVER w AS n FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)) WHERE n > 1 AND o IS DISTINCT FROM event_type")
def stream_change_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of each user's kind of event, told as they arrive."""
    feed = events.change_feed(events.read_files(spark, sf, "events.parquet"), "user_id", "ts", "event_type")
    return _plain(events.materialise(feed, "append").select("key", "old_value", "new_value", F.timestamp_micros("at").alias("at")))
