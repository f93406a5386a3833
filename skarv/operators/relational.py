"""Keyed, ranked and sampled selections, and joins on what isn't equality.

All are plans of joins, windows and top-k that Catalyst places; none collects.
Rankings are by seeded hashes, so that a result depends on the rows and never
on their order or partitions.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarv.functions.url import host_suffixes
from skarv.session import cut


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by ``order``, nulls first; combined before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.struct(*others).alias("_row"))).alias("_best"))
    return best.select(*keys, "_best._row.*").select(*rows.columns)


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is first by ``order``, nulls first."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.struct(*others).alias("_row"))).alias("_best"))
    return best.select(*keys, "_best._row.*").select(*rows.columns)


def seeded_rank(key: Column, seed: str | int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def hash_sample(rows: DataFrame, key: str, count: int, seed: str | int) -> DataFrame:
    """The ``count`` rows of the smallest seeded hashes; a bounded top-k in each partition, no full sort."""
    return rows.orderBy(seeded_rank(F.col(key), seed), key).limit(count)


def preserved_sample(rows: DataFrame, key: str, preserved: Column, count: int, seed: str | int) -> DataFrame:
    """``count`` rows, those ``preserved`` first, each part by its own seeded hash."""
    rank = F.when(preserved, seeded_rank(F.col(key), f"{seed}:preserved")).otherwise(seeded_rank(F.col(key), seed))
    return rows.orderBy(F.coalesce(preserved, F.lit(False)).desc(), rank, key).limit(count)


def stratified_sample(rows: DataFrame, stratum: list[str], key: str, count: int, seed: str | int) -> DataFrame:
    """At most ``count`` rows a stratum, by seeded hash.

    The window keeps ``count`` rows in each partition before the shuffle (a
    group limit), so a stratum may hold any share of the rows.
    """
    order = Window.partitionBy(*stratum).orderBy(seeded_rank(F.col(key), seed), F.col(key))
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= count).drop("_n")


def first_per_host(rows: DataFrame, host: str, key: str, count: int, seed: str | int, excluded: DataFrame | None = None) -> DataFrame:
    """``count`` rows in seeded order, the first of each host, none of the hosts ``excluded``."""
    if excluded is not None:
        rows = rows.join(excluded, host, "left_anti")
    ranked = rows.where(F.col(host).isNotNull()).withColumn("_rank", seeded_rank(F.col(key), seed))
    return first_per_key(ranked, [host], ["_rank", key]).orderBy("_rank", key).limit(count).drop("_rank")


def split_by_rank(rows: DataFrame, rank: Column, shares: dict[str, float], total: int) -> DataFrame:
    """``rows`` with ``split``: named parts of ``total`` rows by position in ``rank``, sizes rounded half to even.

    For samples of a size that is known: the positions come from one window
    over ``total`` rows.
    """
    position = F.row_number().over(Window.orderBy(rank))
    bound, split = 0, None
    for name, share in shares.items():
        bound += round(share * total)
        split = F.when(position <= bound, name) if split is None else split.when(position <= bound, name)
    return rows.withColumn("split", split.otherwise(name))


def _measure(rows: DataFrame, time: str) -> Column:
    """A time or number as a double, for slicing."""
    kind = rows.schema[time].dataType.simpleString()
    if kind.startswith("timestamp") or kind == "date":
        return F.unix_micros(F.col(time).cast("timestamp")) / 1_000_000
    return F.col(time).cast("double")


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], width: float) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` at or before its time, null if there is none.

    Both sides are cut into slices of ``width`` (seconds, for times) and
    stacked; the last value is carried along each slice of a key, and into a
    slice comes what the slices before it end with. So a hot key is as many
    groups as it has slices, and no pair is made that the result doesn't have.
    """
    kind = right.select(F.struct(*values).alias("v")).schema["v"].dataType
    a = left.withColumn("_time", F.col(left_time)).withColumn("_slice", F.floor(_measure(left, left_time) / width)).withColumn("_side", F.lit(1)).withColumn("_value", F.lit(None).cast(kind))
    b = right.select(F.col(key), F.col(right_time).alias("_time"), F.floor(_measure(right, right_time) / width).alias("_slice"), F.lit(0).alias("_side"), F.struct(*values).alias("_value"))
    both = a.unionByName(b, allowMissingColumns=True)
    ends = both.groupBy(key, "_slice").agg(F.max(F.when(F.col("_side") == 0, F.struct("_time", F.col("_value").alias("_v")))).alias("_end"))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    entering = ends.select(key, "_slice", F.last("_end", ignorenulls=True).over(before).getField("_v").alias("_in"))
    within = Window.partitionBy(key, "_slice").orderBy("_time", "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_value", F.last("_value", ignorenulls=True).over(within)).where("_side = 1").join(entering, [key, "_slice"], "left")
    out = F.coalesce("_value", "_in")
    return carried.select(*left.columns, *(out.getField(v).alias(v) for v in values))


def range_join(points: DataFrame, ranges: DataFrame, point: str, start: str, end: str, width: float) -> DataFrame:
    """Each point with the ranges ``[start, end)`` that hold it.

    Ranges are cut at multiples of ``width``, longer ones at multiples of
    twice, four times and so on the width, so that each is in two or three
    slices however long it is. A point meets the ranges of its slice at each
    length that occurs; how many lengths there are grows with the logarithm of
    the longest range, and they are all that reaches the driver.
    """
    length = F.greatest(F.col(end) - F.col(start), F.lit(0)) / width
    sized = ranges.where(F.col(start) < F.col(end)).withColumn("_level", F.when(length > 1, F.ceil(F.log2(length))).otherwise(F.lit(0)).cast("int"))
    levels = sorted(r[0] for r in sized.select("_level").distinct().collect())
    slice_of = lambda column, level: F.floor(column / (F.lit(float(width)) * F.pow(F.lit(2.0), level))).cast("long")
    slices = sized.withColumn("_slice", F.explode(F.sequence(slice_of(F.col(start), F.col("_level")), slice_of(F.col(end), F.col("_level")))))
    placed = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_slice", slice_of(F.col(point), F.col("_level")))
    held = placed.join(slices, ["_level", "_slice"])
    return held.where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_level", "_slice")


def suffix_join(rows: DataFrame, host: str, domains: DataFrame, domain: str, how: str = "left_anti") -> DataFrame:
    """Rows whose host is, or is under, a listed domain (``left_semi``), or isn't (``left_anti``).

    The test on endings becomes an equality: a host is exploded into its
    endings once, whatever the length of the list.
    """
    names = rows.select(host).where(F.col(host).isNotNull()).distinct().withColumn("_ending", F.explode(host_suffixes(F.col(host))))
    listed = names.join(domains.select(F.lower(F.col(domain)).alias("_ending")).distinct(), "_ending", "left_semi").select(host).distinct()
    return rows.join(listed, host, how)


def changelog(rows: DataFrame, key: str, order: list[str], status: str, active: str) -> DataFrame:
    """The rows now ``active`` of a log in which the last row of a key holds."""
    return latest_per_key(rows, [key], order).where(F.col(status) == active)


def numbered(rows: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """``rows`` with their position from 0 in ``order``, without a window over all of them.

    The rows are range-partitioned, sorted and written to the shared folder;
    a number in its partition and the sizes of the partitions before it, one
    number a partition on the driver, make the position.
    """
    placed = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())
    offsets, at = [], 0
    for part, count in sizes:
        offsets += [F.lit(part), F.lit(at)]
        at += count
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    start = F.element_at(F.create_map(*offsets), F.col("_part")) if offsets else F.lit(0)
    return placed.withColumn(name, (inside + start).cast("long")).drop("_part")


def drawn_sample(rows: DataFrame, order: list[str], count: int, seed: int) -> DataFrame:
    """``count`` rows by positions drawn from their number alone with the Mersenne Twister, in the order drawn as ``draw``."""
    placed = numbered(rows, order, "_position")
    n = placed.count()
    drawn = random.Random(seed).sample(range(n), min(count, n))
    picks = rows.sparkSession.createDataFrame([(p, i) for i, p in enumerate(drawn)], "_position long, draw int")
    return placed.join(F.broadcast(picks), "_position").drop("_position")  # ``count`` rows
