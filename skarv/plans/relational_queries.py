"""Queries of the relational core over the star schema, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarv.operators import aggregates, claims, refresh, relational
from skarv.session import table

MONEY = "decimal(18,2)"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(make):
        QUERIES[make.__name__] = make
        if sql is not None:
            SQL[make.__name__] = sql
        return make

    return add


@query("SELECT r_name AS region, n_name AS nation, count(*) AS orders, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def join_inner_rollup(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    by_customer = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast(MONEY)).alias("v"))
    rows = by_customer.join(customer, "c_custkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.sum("n").alias("orders"), F.sum("v").cast("double").alias("revenue"))


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY ALL")
def join_left_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return table(spark, sf, "customer").select("c_custkey").join(counts, "c_custkey", "left").na.fill(0, ["orders"])


@query("SELECT coalesce(c_nationkey, s_nationkey) AS nation, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM (SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_acctbal < 0 GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON c_nationkey = s_nationkey")
def join_full_nations(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").where("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = table(spark, sf, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nation", "full").na.fill(0, ["customers", "suppliers"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def join_semi_urgent(spark: SparkSession, sf: str) -> DataFrame:
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_partkey IS NOT NULL)")
def join_anti_unreturned(spark: SparkSession, sf: str) -> DataFrame:
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").join(returned, "p_partkey", "left_anti").select("p_partkey")


@query("""SELECT l.event_id, r.event_id AS before_id FROM (SELECT * FROM events WHERE event_type = (SELECT min(event_type) FROM events)) l
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = (SELECT max(event_type) FROM events) GROUP BY ALL) r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_last_event(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    kinds = events.agg(F.min("event_type").alias("_first"), F.max("event_type").alias("_last"))
    both = events.join(F.broadcast(kinds))  # one row
    left = both.where("event_type = _first").select("event_id", "user_id", "ts")
    right = both.where("event_type = _last").groupBy("user_id", F.col("ts").alias("at")).agg(F.max("event_id").alias("before_id"))
    return relational.as_of_join(left, right, "user_id", "ts", "at", ["before_id"], 86_400.0).select("event_id", "before_id")


@query("SELECT s_suppkey, count(*) AS customers FROM supplier JOIN customer ON c_acctbal >= s_acctbal AND c_acctbal < s_acctbal + 50 GROUP BY ALL")
def range_join_balances(spark: SparkSession, sf: str) -> DataFrame:
    bands = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 50).alias("high"))
    held = relational.range_join(table(spark, sf, "customer").select("c_acctbal"), bands, "c_acctbal", "low", "high", 50.0)
    return held.groupBy("s_suppkey").agg(F.count("*").alias("customers"))


@query("SELECT c_custkey FROM customer ORDER BY sha256('20260824:' || c_custkey), c_custkey LIMIT 100")
def hash_topk_sample(spark: SparkSession, sf: str) -> DataFrame:
    return relational.hash_sample(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 100, "20260824")


@query("""WITH chosen AS (SELECT c_custkey, c_acctbal > 9000 AS kept FROM customer ORDER BY c_acctbal > 9000 DESC, CASE WHEN c_acctbal > 9000 THEN sha256('20260825:preserved:' || c_custkey) ELSE sha256('20260825:' || c_custkey) END, c_custkey LIMIT 100),
placed AS (SELECT *, row_number() OVER (ORDER BY sha256('20260825:order:' || c_custkey), c_custkey) AS n FROM chosen)
SELECT c_custkey, kept, CASE WHEN n <= 60 THEN 'development' WHEN n <= 80 THEN 'validation' ELSE 'held_out' END AS split FROM placed""")
def preserved_sample_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") > 9000).alias("kept"))
    chosen = relational.preserved_sample(rows, "c_custkey", F.col("kept"), 100, "20260825")
    order = F.struct(relational.seeded_rank(F.col("c_custkey"), "20260825:order"), F.col("c_custkey"))
    return relational.split_by_rank(chosen, order, {"development": 0.6, "validation": 0.2, "held_out": 0.2}, 100)


@query("SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('7:' || o_orderkey), o_orderkey) <= 20")
def stratified_hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    return relational.stratified_sample(table(spark, sf, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], "o_orderkey", 20, 7)


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_order(spark: SparkSession, sf: str) -> DataFrame:
    return relational.latest_per_key(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) = 1")
def first_line_per_pair(spark: SparkSession, sf: str) -> DataFrame:
    return relational.first_per_key(table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"), ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])


@query("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def set_union_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).unionByName(table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))).distinct()


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf, "orders").select(F.col("o_custkey").alias("k")))


@query("SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def set_intersection_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k")).intersect(table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("k")))


@query("""SELECT o_orderkey, row_number() OVER w AS n, rank() OVER r AS rank, dense_rank() OVER r AS dense, ntile(4) OVER w AS quarter, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after,
 (sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE AS running FROM orders
 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), r AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def window_functions(spark: SparkSession, sf: str) -> DataFrame:
    w, r = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.row_number().over(w).alias("n"), F.rank().over(r).alias("rank"), F.dense_rank().over(r).alias("dense"), F.ntile(4).over(w).alias("quarter"),
        F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"),
        F.sum(F.col("o_totalprice").cast(MONEY)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("running"),
    )


@query("""SELECT o_orderkey, count(*) OVER w AS prior_runs, round((avg(CAST(o_totalprice AS DECIMAL(18,2))) OVER w)::DOUBLE, 6) AS prior_mean, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 6) AS gain
 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def running_history(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    mean = F.sum(F.col("o_totalprice").cast(MONEY)).over(prior).cast("double") / F.nullif(F.count("*").over(prior), F.lit(0))
    return table(spark, sf, "orders").select("o_orderkey", F.count("*").over(prior).alias("prior_runs"), F.round(mean, 6).alias("prior_mean"), F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 6).alias("gain"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS rows, grouping_id(o_orderstatus, o_orderpriority) AS level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_counts(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.counts_by(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], "rollup")


@query("SELECT l_returnflag, l_linestatus, count(*) AS rows, grouping_id(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.counts_by(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "cube")


@query("SELECT event_type, count(value) AS n, round_even(quantile_disc(value, 0.5), 3) AS p50, round_even(quantile_disc(value, 0.95), 3) AS p95, round_even(max(value), 3) AS max FROM events GROUP BY ALL")
def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.latency_summary(table(spark, sf, "events"), "value", ["event_type"])


@query("SELECT count(*) AS keys, sum(n)::BIGINT AS total, quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.95) AS p95, max(n) AS max FROM (SELECT user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1)")
def spread_over_users(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.spread_over(table(spark, sf, "events"), "user_id")


@query("""SELECT found, wanted, "right", coalesce("right" / nullif(found, 0), 1.0) AS precision, coalesce("right" / nullif(wanted, 0), 1.0) AS recall FROM (SELECT count(f) AS found, count(w) AS wanted, count(*) FILTER (f IS NOT NULL AND w IS NOT NULL) AS "right"
 FROM (SELECT DISTINCT o_custkey AS k, 1 AS f FROM orders WHERE o_totalprice > 100000) a FULL JOIN (SELECT c_custkey AS k, 1 AS w FROM customer WHERE c_acctbal > 0) b USING (k))""")
def precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("k"))
    return aggregates.precision_recall(found, table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), ["k"])


@query("""SELECT strategy, runs, mean_gain, mean_gain + 0.35 * sqrt(ln(sum(runs) OVER () + 1.0) / (runs + 1)) AS priority FROM (SELECT event_type AS strategy, count(value) AS runs, round_even(avg(value), 3) AS mean_gain FROM events GROUP BY 1)""")
def upper_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.upper_confidence(table(spark, sf, "events").withColumnRenamed("event_type", "strategy"), "strategy", "value")


@query("""WITH y AS (SELECT o_custkey, year(o_orderdate) AS year, count(*) AS orders, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS revenue, max(o_orderpriority) AS priority FROM orders GROUP BY ALL)
SELECT o_custkey, year, 'orders' AS field, CAST(orders AS VARCHAR) AS value FROM y UNION ALL SELECT o_custkey, year, 'revenue', CAST(revenue AS VARCHAR) FROM y UNION ALL SELECT o_custkey, year, 'priority', priority FROM y WHERE priority IS NOT NULL""")
def unpivoted_facts(spark: SparkSession, sf: str) -> DataFrame:
    yearly = table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast(MONEY)).alias("revenue"), F.max("o_orderpriority").alias("priority"))
    return claims.unpivot_facts(yearly, ["o_custkey", "year"], {"orders": "orders", "revenue": "revenue", "priority": "priority"})


def _totals(spark: SparkSession, sf: str, until: str) -> DataFrame:
    rows = table(spark, sf, "orders").where(F.col("o_orderdate") < until)
    return rows.groupBy("o_custkey").agg(F.count("*").cast("string").alias("orders"), F.to_json(F.struct(F.max("o_orderpriority").alias("last"), F.min("o_orderpriority").alias("first"))).alias("priorities"))


@query("""WITH t AS (SELECT o_custkey, count(*) FILTER (o_orderdate < DATE '1998-01-01') AS a, count(*) AS b, max(o_orderpriority) FILTER (o_orderdate < DATE '1998-01-01') AS al, max(o_orderpriority) AS bl, min(o_orderpriority) FILTER (o_orderdate < DATE '1998-01-01') AS af, min(o_orderpriority) AS bf FROM orders WHERE o_orderdate < DATE '2100-01-01' GROUP BY 1),
c AS (SELECT o_custkey, 'orders' AS field, CAST(a AS VARCHAR) AS old_value, CAST(b AS VARCHAR) AS new_value FROM t WHERE a > 0 AND a <> b UNION ALL SELECT o_custkey, 'priorities', '{"first":"' || af || '","last":"' || al || '"}', '{"first":"' || bf || '","last":"' || bl || '"}' FROM t WHERE a > 0 AND (al <> bl OR af <> bf))
SELECT *, sha256(old_value) AS old_hash, sha256(new_value) AS new_hash FROM c""")
def refresh_diff(spark: SparkSession, sf: str) -> DataFrame:
    return refresh.diff(_totals(spark, sf, "1998-01-01"), _totals(spark, sf, "2100-01-01"), "o_custkey", ["orders", "priorities"])


@query("""SELECT user_id, count(*) FILTER (fresh) AS fresh, count(DISTINCT event_type) FILTER (fresh) AS kinds, round_even(avg(value) FILTER (fresh), 6) AS mean_value, count(*) FILTER (NOT fresh) AS stale
 FROM (SELECT *, ts <= e AND ts >= e - INTERVAL 5 DAY AS fresh FROM events, (SELECT max(ts) AS e FROM events)) WHERE user_id IS NOT NULL GROUP BY 1""")
def footprint_rollup(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    rows = events.join(F.broadcast(events.agg(F.max("ts").alias("_end")))).where("user_id is not null")  # one row
    fresh = (F.col("ts") <= F.col("_end")) & (F.col("ts") >= F.col("_end") - F.expr("INTERVAL 5 DAYS"))
    return rows.groupBy("user_id").agg(F.count_if(fresh).alias("fresh"), F.count_distinct(F.when(fresh, F.col("event_type"))).alias("kinds"), F.bround(F.avg(F.when(fresh, F.col("value"))), 6).alias("mean_value"), F.count_if(~fresh).alias("stale"))


@query("""SELECT user_id, n_sources, CASE WHEN n_sources >= 2 THEN CASE WHEN a IS NULL THEN 'neutral' WHEN a = b THEN a ELSE 'mixed' END END AS label FROM (SELECT user_id, count(DISTINCT event_type) AS n_sources, min(l) FILTER (l <> 'neutral') AS a, max(l) FILTER (l <> 'neutral') AS b
 FROM (SELECT *, CASE WHEN value > 90 THEN 'positive' WHEN value < 10 THEN 'negative' ELSE 'neutral' END AS l FROM events) GROUP BY 1)""")
def settled_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumn("l", F.when(F.col("value") > 90, "positive").when(F.col("value") < 10, "negative").otherwise("neutral"))
    return aggregates.settled_label(rows, ["user_id"], "event_type", "l")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders")
def global_positions(spark: SparkSession, sf: str) -> DataFrame:
    return relational.numbered(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "position")


@query()
def drawn_sample(spark: SparkSession, sf: str) -> DataFrame:
    return relational.drawn_sample(table(spark, sf, "customer").select("c_custkey"), ["c_custkey"], 100, 20260823)
