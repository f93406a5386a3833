"""Streams: windows, late rows, duplicates, latest states and change feeds.

Each operator takes a DataFrame that may be a stream, so that batch and stream
share their plan; ``materialise`` runs one over what a source has now.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skarv.session import shared_dir


def read_files(spark: SparkSession, folder: str, name: str, most_files: int = 1000) -> DataFrame:
    """A stream of the parquet files ``name`` in a folder, new ones as they come."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", most_files).parquet(folder)


def timed(events: DataFrame, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Events with their time as a timestamp and a watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def tumbling_counts(events: DataFrame, keys: list[str], size: str, time: str = "ts") -> DataFrame:
    return _flat(events.groupBy(F.window(time, size).alias("_w"), *keys).agg(F.count("*").alias("events")), keys)


def sliding_counts(events: DataFrame, keys: list[str], size: str, step: str, time: str = "ts") -> DataFrame:
    return _flat(events.groupBy(F.window(time, size, step).alias("_w"), *keys).agg(F.count("*").alias("events")), keys)


def sessions(events: DataFrame, keys: list[str], gap: str, time: str = "ts") -> DataFrame:
    """Runs of events with less than ``gap`` between neighbours."""
    return _flat(events.groupBy(F.session_window(time, gap).alias("_w"), *keys).agg(F.count("*").alias("events")), keys)


def _flat(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, "events")


def distinct_events(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once while the watermark lasts; state older than it is let go."""
    return events.dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def latest_states(events: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of each key's last event."""
    best = F.max(F.struct(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.struct(*values).alias("_v")))
    return events.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best._v.*")


def change_feed(events: DataFrame, key: str, order: str, value: str, idle: str | None = None) -> DataFrame:
    """``key, old_value, new_value, at``: a row whenever a key's value differs from the last one told.

    The state is one value a key; with ``idle`` it is let go when the
    watermark has passed that long beyond the key's last event, so ``events``
    then need one on ``order``. Within a batch events are taken by ``order``;
    an event older than the state is late and changes nothing.
    """
    after = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = []
        if state.hasTimedOut:
            state.remove()
        else:
            seen, last, at = (True, *state.get) if state.exists else (False, None, None)
            for new, when in sorted(((v, t) for f in frames for v, t in zip(f["_value"], f["_at"])), key=lambda x: (x[1], x[0] or "")):
                if at is not None and when < at:
                    continue
                if seen and new != last:
                    rows.append((keys[0], last, new, when))
                seen, last, at = True, new, int(when)
            if seen:
                state.update((last, at))
                if after is not None:
                    state.setTimeoutTimestamp(max(at // 1000, state.getCurrentWatermarkMs()) + after)
        yield pd.DataFrame(rows, columns=["key", "old_value", "new_value", "at"])

    time = F.col(order).cast("timestamp") if idle is None else F.col(order)
    plain = events.select(F.col(key).cast("string").alias("_key"), F.col(value).cast("string").alias("_value"), F.unix_micros(time).alias("_at"), *([F.col(order)] if idle else [])).where("_key is not null and _at is not null")
    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.EventTimeTimeout
    return plain.groupBy("_key").applyInPandasWithState(step, "key string, old_value string, new_value string, at long", "value string, at long", "append", timeout)


def freshness(events: DataFrame, time: str, as_of: str, days: int) -> DataFrame:
    """Events that aren't older than ``days`` before ``as_of`` nor later than it."""
    end = F.lit(as_of).cast("timestamp")
    return events.where((F.col(time).cast("timestamp") <= end) & (F.col(time).cast("timestamp") >= end - F.make_dt_interval(F.lit(days))))


def materialise(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what its source has now and read the result back from the shared folder.

    Offsets and state are checkpointed there, so a lost executor costs its
    tasks only; a batch that is run again replaces what it wrote before.
    """
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{'all' if mode == 'complete' else f'batch={number}'}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    read = spark.read.schema(stream.schema)
    return read.parquet(f"{folder}/out/all") if mode == "complete" else read.option("basePath", f"{folder}/out").parquet(f"{folder}/out/*")
