"""What changed between full snapshots.

Each key is windowed by the index of its snapshots: a lagged hash that differs
is a change, a gap in the indexes a removal and, at its end, an addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarv.functions.canon import value_hash
from skarv.functions.dates import any_day
from skarv.functions.ids import nine_digits

CHANGES = "source_row_key string, field string, snapshot string, change string"


def snapshot_changes(
    rows: DataFrame,
    key: str = "source_row_key",
    field: str = "field",
    snapshot: str = "as_of",
    value: str = "value",
    status: str = "status",
    order: tuple[str, ...] = ("retrieved_at", "row_id"),
) -> DataFrame:
    """Rows ``(source_row_key, field, snapshot, change)`` from full deliveries.

    * The key is its nine digits, the snapshot the day in ``snapshot``; a row
      without either or without a field belongs to no record and is left out.
    * Of the rows for one key, field and snapshot the one that is last by
      ``order`` holds (nulls first); repeated rows change nothing.
    * ``added`` and ``removed`` need a row of any status; ``changed`` needs two
      ``available`` rows in neighbouring snapshots whose JSON differs. A null
      value of an available row counts as a value of its own.
    * The first snapshot yields nothing; so does an empty table.
    * Other columns are ignored, whatever their names.

    Two shuffles, both of hashes: the first is pre-aggregated on the map side,
    so that a hot key reaches the second with one row a snapshot. The days are
    broadcast: there are no more of them than the calendar has.
    """
    told = rows.select(
        nine_digits(F.col(key)).alias("_key"),
        F.col(field).alias("_field"),
        any_day(F.col(snapshot)).alias("_day"),
        F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.when(F.col(status) == "available", value_hash(F.coalesce(F.col(value), F.lit("\u0000")))).alias("hash")).alias("_row"),
    ).where("_key is not null and _field is not null and _day is not null")
    last = told.groupBy("_key", "_field", "_day").agg(F.max("_row").getField("hash").alias("_hash"))

    days = rows.select(any_day(F.col(snapshot)).alias("_day")).where("_day is not null").distinct()
    days = days.select("_day", F.row_number().over(Window.orderBy("_day")).alias("_at"), F.lead("_day").over(Window.orderBy("_day")).alias("_next"))

    chain = Window.partitionBy("_key", "_field").orderBy("_at")
    placed = last.join(F.broadcast(days), "_day").select(
        "_key", "_field", "_day", "_next", "_at", "_hash",
        F.lag("_at").over(chain).alias("_before"), F.lag("_hash").over(chain).alias("_was"), F.lead("_at").over(chain).alias("_after"),
    )
    here = F.date_format("_day", "yyyy-MM-dd")
    came = F.when((F.col("_at") > 1) & ((F.col("_before") < F.col("_at") - 1) | F.col("_before").isNull()), F.struct(here.alias("snapshot"), F.lit("added").alias("change")))
    other = F.when((F.col("_before") == F.col("_at") - 1) & (F.col("_was") != F.col("_hash")), F.struct(here.alias("snapshot"), F.lit("changed").alias("change")))
    went = F.when(F.col("_next").isNotNull() & ((F.col("_after") > F.col("_at") + 1) | F.col("_after").isNull()), F.struct(F.date_format("_next", "yyyy-MM-dd").alias("snapshot"), F.lit("removed").alias("change")))
    return placed.select(F.col("_key").alias(key), F.col("_field").alias(field), F.inline(F.array_compact(F.array(came, other, went))))
