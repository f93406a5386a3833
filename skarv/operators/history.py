"""History of changing attributes: gapless versions with the period each one held.

Late and corrected updates rebuild only the chains they touch: the raw changes
of those chains are retrieved, all their intervals are built anew, and the old
chains are replaced. ``ChainStore`` keeps the result on a file system and
replaces buckets of chains atomically by a manifest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarv.functions.canon import canonical
from skarv.functions.dates import any_day, iso_day, utc_day
from skarv.session import cut, release, shared_dir

CHAIN = ("source_row_key", "field")
VERSIONS = "source_row_key string, field string, value string, valid_from string, valid_to string"


def effective_day(rows: DataFrame, effective_at: str = "effective_at", as_of: str = "as_of", retrieved_at: str = "retrieved_at") -> Column:
    """The UTC day of ``effective_at``, else the day in ``as_of``, else the day of retrieval."""
    kind = rows.schema[retrieved_at].dataType.simpleString()
    return F.coalesce(iso_day(F.col(effective_at)), any_day(F.col(as_of)), utc_day(F.col(retrieved_at), kind))


def speaking(rows: DataFrame) -> DataFrame:
    """The rows that tell of a chain: ``source_row_key, field, _day, retrieved_at, row_id, value``, the value null where the source says there is none.

    Only ``available`` and ``not_found`` rows speak; rows without key, field
    or any day are left out.
    """
    kept = rows.where(F.col("status").isin("available", "not_found") & F.col("source_row_key").isNotNull() & F.col("field").isNotNull())
    value = F.when(F.col("status") == "available", canonical(F.coalesce(F.col("value"), F.lit("null"))))
    return kept.select(*CHAIN, effective_day(rows).alias("_day"), "retrieved_at", "row_id", value.alias("value")).where("_day is not null")


def chain_changes(told: DataFrame) -> DataFrame:
    """One row a chain and day of ``speaking`` rows: the value that holds, or null where the source says there is none.

    Of several for one chain and day the one retrieved last holds, of those
    retrieved at once the one with the highest ``row_id``. The aggregation
    combines on the map side, so a chain never has more rows behind the
    shuffle than the calendar has days.
    """
    return told.groupBy(*CHAIN, "_day").agg(F.max(F.struct("retrieved_at", "row_id", "value")).getField("value").alias("value"))


def chains_of(told: DataFrame) -> DataFrame:
    """All versions of the chains in ``speaking`` rows."""
    chain = Window.partitionBy(*CHAIN).orderBy("_day")
    turns = (
        chain_changes(told)
        .select(*CHAIN, "_day", "value", F.lag("value").over(chain).alias("_was"), F.row_number().over(chain).alias("_n"))
        .where((F.col("_n") == 1) | ~F.col("value").eqNullSafe(F.col("_was")))
    )
    day = F.date_format("_day", "yyyy-MM-dd")
    return turns.select(*CHAIN, "value", day.alias("valid_from"), F.coalesce(F.lead(day).over(chain), F.lit("")).alias("valid_to")).where("value is not null")


def build_chains(rows: DataFrame) -> DataFrame:
    """All versions of the chains in ``rows``: ``source_row_key, field, value, valid_from, valid_to``.

    A version runs from the day its value first holds until a different value
    holds or the source says ``not_found``; a value that returns is a new
    version. ``valid_to`` is exclusive and empty for an open version. An empty
    table has no versions; repeated rows change nothing.
    """
    return chains_of(speaking(rows))


def touched_chains(updates: DataFrame) -> DataFrame:
    return updates.select(*CHAIN).where("source_row_key is not null and field is not null").distinct()


def apply_updates(history: DataFrame, changes: DataFrame, updates: DataFrame, build=build_chains) -> DataFrame:
    """The history after ``updates``; ``changes`` is the raw log including them.

    Only the touched chains' raw changes are read on past the semi-join, only
    those chains are rebuilt, all others pass through as they are.
    """
    touched = touched_chains(updates)
    rebuilt = build(changes.join(touched, list(CHAIN), "left_semi"))
    return history.join(touched, list(CHAIN), "left_anti").unionByName(rebuilt)


def history_as_delivered(changes: DataFrame, late_days: int = 90) -> DataFrame:
    """The whole history: a first load, then what arrived in the last ``late_days`` days as updates.

    Both go through a ``ChainStore``, whose manifest the late ones replace.
    The cut lies ``late_days`` before the last retrieval; wherever it lies the
    result is the same, since a touched chain is rebuilt from all its changes.
    """
    spark = changes.sparkSession
    last = changes.agg(F.max("retrieved_at").alias("_last"))
    # Days and values are read once, for both loads.
    told = cut(speaking(changes).join(F.broadcast(last), how="left").withColumn("_late", F.coalesce(F.col("retrieved_at") > F.col("_last") - F.make_dt_interval(F.lit(late_days)), F.lit(True))).drop("_last"))
    late = touched_chains(told.where("_late"))
    store = ChainStore(spark, f"{shared_dir(spark)}/chains-{uuid.uuid4().hex}", temporary=True)
    # Chains that the late rows touch would be built for nothing.
    first = told.where("not _late").join(late, list(CHAIN), "left_anti")
    store.apply(first, first, build=chains_of)
    store.apply(told, late, build=chains_of)
    release(told)
    return store.read()


class ChainStore:
    """Versions on a shared file system, in buckets of chains that a manifest names.

    ``apply`` writes the touched buckets beside the old ones, under a name no
    other writer has, then a manifest beside the others, which it renames into
    its place once it is whole. A reader or a lost writer never sees half of
    an update, what a lost writer left stands in nobody's way, and of two
    writers of one version the second fails. Buckets no manifest names can be
    deleted at any time. A ``temporary`` store goes with the application.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, temporary: bool = False):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        jvm = spark._jvm
        self._root = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if temporary:
            self._fs.deleteOnExit(self._root)

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def version(self) -> int:
        if not self._fs.exists(self._root):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root)]
        return max([0, *(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))])

    def _manifest(self, version: int) -> dict[str, str]:
        if version == 0:
            return {}
        stream = self._fs.open(self._at(f"manifest-{version:09d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*CHAIN), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None) -> DataFrame:
        parts = self._manifest(self.version() if version is None else version)
        if not parts:
            return self.spark.createDataFrame([], VERSIONS)
        return self.spark.read.schema(VERSIONS).parquet(*sorted(parts.values()))

    def apply(self, changes: DataFrame, updates: DataFrame, build=build_chains) -> int:
        """Rebuild the chains that ``updates`` touch; returns the new version."""
        before = self.version()
        parts, target = self._manifest(before), f"{self.path}/data-{before + 1:09d}-{uuid.uuid4().hex}"
        touched = touched_chains(updates).withColumn("_bucket", self._bucket())
        hit = [r[0] for r in touched.select("_bucket").distinct().collect()]  # at most ``buckets`` numbers
        if not hit:
            return before
        old = [parts[str(b)] for b in hit if str(b) in parts]
        history = self.spark.read.schema(VERSIONS).parquet(*old) if old else self.spark.createDataFrame([], VERSIONS)
        new = apply_updates(history, changes, updates, build).withColumn("_bucket", self._bucket())
        # A bucket is the work of several tasks where there are more tasks than buckets.
        spread = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        new.repartition(F.col("_bucket"), F.pmod(F.hash(*CHAIN), F.lit(spread))).write.partitionBy("_bucket").parquet(target)
        for b in hit:
            place = f"{target}/_bucket={b}"
            if self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(place)):
                parts[str(b)] = place
            else:
                parts.pop(str(b), None)
        self._commit(before + 1, json.dumps(parts, sort_keys=True))
        return before + 1

    def _commit(self, version: int, manifest: str) -> None:
        """Writes a manifest whole and renames it into its place, which fails if the version exists."""
        jvm, draft = self.spark._jvm, self._at(f"draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(manifest.encode()))
        out.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        qualified = self._fs.makeQualified(self._root).toUri()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified, self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._at(f"manifest-{version:09d}.json")), options)
        except Exception:
            self._fs.delete(draft, False)
            raise
