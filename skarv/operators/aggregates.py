"""Summaries, rates and quality measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latency_summary(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """``n, p50, p95, max``, rounded to three places half to even; nulls over no value."""
    disc = lambda q: F.bround(F.expr(f"percentile_disc({q}) within group (order by `{value}`)"), 3)
    columns = (F.count(value).alias("n"), disc(0.5).alias("p50"), disc(0.95).alias("p95"), F.bround(F.max(value), 3).alias("max"))
    return rows.groupBy(*by).agg(*columns) if by else rows.agg(*columns)


def spread_over(rows: DataFrame, key: str) -> DataFrame:
    """How evenly rows spread over ``key``: ``keys, total, p50, p95, max`` of the counts."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    disc = lambda q: F.expr(f"percentile_disc({q}) within group (order by n)").cast("long")
    return counts.agg(F.count("*").alias("keys"), F.sum("n").alias("total"), disc(0.5).alias("p50"), disc(0.95).alias("p95"), F.max("n").alias("max"))


def best_state(rows: DataFrame, by: list[str], state: str, priority: list[str]) -> DataFrame:
    """The state of the highest priority in each group; states not listed come last."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col(state)), F.lit(0))
    rank = F.when(rank == 0, len(priority) + 1).otherwise(rank)
    return rows.groupBy(*by).agg(F.min_by(F.col(state), F.struct(rank, F.col(state))).alias(state))


def coverage(rows: DataFrame, key: str, area: str, covered: Column, areas: list[str]) -> DataFrame:
    """One row a key with a boolean an area, and whether all are covered."""
    out = rows.groupBy(key).agg(*(F.coalesce(F.bool_or((F.col(area) == a) & covered), F.lit(False)).alias(a) for a in areas))
    return out.withColumn("all_areas", F.expr(" and ".join(f"`{a}`" for a in areas)))


def counts_by(rows: DataFrame, keys: list[str], how: str = "rollup") -> DataFrame:
    """Counts with their totals: ``rollup`` along the keys, ``cube`` over all of their subsets."""
    grouped = rows.rollup(*keys) if how == "rollup" else rows.cube(*keys)
    return grouped.agg(F.count("*").alias("rows"), F.grouping_id().cast("long").alias("level"))


def precision_recall(found: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``found, wanted, right, precision, recall`` of two sets; a rate over nothing is 1."""
    both = found.select(*keys).distinct().withColumn("_f", F.lit(1)).join(wanted.select(*keys).distinct().withColumn("_w", F.lit(1)), keys, "full")
    sums = both.agg(F.count("_f").alias("found"), F.count("_w").alias("wanted"), F.count_if(F.col("_f").isNotNull() & F.col("_w").isNotNull()).alias("right"))
    rate = lambda n: F.coalesce(F.try_divide("right", n), F.lit(1.0))
    return sums.select("*", rate("found").alias("precision"), rate("wanted").alias("recall"))


def confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    return rows.groupBy(gold, predicted).agg(F.count("*").alias("n"))


def label_quality(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """``label, support, precision, recall, f1`` for each label that occurs; 0 where a rate has no case.

    Built from the confusion counts: one shuffle of the rows, already combined.
    """
    counts = confusion(rows, gold, predicted)
    mine = counts.select(F.col(gold).alias("label"), F.col("n").alias("support"), F.lit(0).alias("given"), F.when(F.col(gold) == F.col(predicted), F.col("n")).otherwise(0).alias("right"))
    its = counts.select(F.col(predicted).alias("label"), F.lit(0).alias("support"), F.col("n").alias("given"), F.lit(0).alias("right"))
    sums = mine.unionByName(its).where("label is not null").groupBy("label").agg(*(F.sum(c).alias(c) for c in ("support", "given", "right")))
    rate = lambda n: F.coalesce(F.try_divide(F.col("right").cast("double"), F.col(n)), F.lit(0.0))
    rated = sums.select("label", "support", rate("given").alias("precision"), rate("support").alias("recall"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return rated.withColumn("f1", f1)


def settled_label(rows: DataFrame, by: list[str], source: str, label: str, least: int = 2, neutral: str = "neutral", mixed: str = "mixed") -> DataFrame:
    """One label a group from independent sources: ``n_sources, label``.

    Fewer than ``least`` sources abstain (null); one label beside ``neutral``
    wins, several are ``mixed``, none is ``neutral``.
    """
    told = rows.groupBy(*by).agg(F.count_distinct(source).alias("n_sources"), F.min(F.when(F.col(label) != neutral, F.col(label))).alias("_a"), F.max(F.when(F.col(label) != neutral, F.col(label))).alias("_b"))
    settled = F.when(F.col("n_sources") >= least, F.when(F.col("_a").isNull(), neutral).when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(mixed))
    return told.select(*by, "n_sources", settled.alias("label"))


def upper_confidence(rows: DataFrame, strategy: str, gain: str, weight: float = 0.35) -> DataFrame:
    """``runs, mean_gain, priority`` a strategy: its mean gain and a bonus for having been tried seldom."""
    runs = rows.groupBy(strategy).agg(F.count(gain).alias("runs"), F.bround(F.avg(gain), 3).alias("mean_gain"))
    total = runs.agg(F.sum("runs").alias("_total"))
    bonus = F.sqrt(F.log(F.col("_total") + 1.0) / (F.col("runs") + 1))
    return runs.join(F.broadcast(total)).select(strategy, "runs", "mean_gain", (F.col("mean_gain") + weight * bonus).alias("priority"))


def value_at_rank(rows: DataFrame, keys: list[str], value: str, index) -> DataFrame:
    """``keys, value``: each group's value at the place that ``index`` makes of the group's size, from 0, in ascending order.

    Counted by distinct values first, so what a task sorts is a group's values
    and not its rows. Nulls count as none.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    ahead = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("_to", F.sum("_n").over(ahead)).join(sizes, keys).withColumn("_at", index(F.col("_size")))
    return placed.where((F.col("_at") < F.col("_to")) & (F.col("_at") >= F.col("_to") - F.col("_n"))).select(*keys, value)


def quality_summary(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """One row: gold items, those predicted, accuracy over all, coverage, and the mean F1 of the labels that gold has."""
    known = rows.where(F.col(gold).isNotNull())
    totals = known.agg(F.count("*").alias("items"), F.count(predicted).alias("predicted"), F.count_if(F.col(gold) == F.col(predicted)).alias("_right"))
    labels = known.select(F.col(gold).alias("label"), F.col(predicted).alias("_p")).groupBy("label").agg(F.count("*").alias("_support"), F.count_if(F.col("label") == F.col("_p")).alias("_hit"))
    said = known.groupBy(F.col(predicted).alias("label")).agg(F.count("*").alias("_said"))
    f1 = labels.join(said, "label", "left").select((2 * F.col("_hit") / (F.col("_support") + F.coalesce("_said", F.lit(0)))).alias("_f1")).agg(F.avg("_f1").alias("macro_f1"))
    both = totals.join(F.broadcast(f1))
    return both.select("items", "predicted", F.round(F.col("_right") / F.col("items"), 6).alias("accuracy"), F.round(F.col("predicted") / F.col("items"), 6).alias("coverage"), F.round("macro_f1", 6).alias("macro_f1"))
