"""Sinks: ordered JSON lines, a store of contents by their hash, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json_lines(rows: DataFrame, path: str, order: list[str]) -> None:
    """Range-partitioned, sorted JSON lines: the files in the order of their names are the rows in order.

    The committer makes them appear whole or not at all.
    """
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").json(path)


def content_path(sha256: Column) -> Column:
    """The place of a content in the store."""
    return F.concat(F.substring(sha256, 1, 2), F.lit("/"), sha256, F.lit(".bin"))


def store_contents(contents: DataFrame, path: str, content: str = "content") -> None:
    """Add contents to a store partitioned by the first two letters of their hash.

    What the store has already isn't written again; only hashes are compared.
    Two writers at once may both write a new content: ``stored_contents``
    gives each once whoever wrote it, and equal hashes are equal contents.
    """
    spark: SparkSession = contents.sparkSession
    new = contents.select(F.sha2(F.col(content).cast("binary"), 256).alias("sha256"), F.col(content).cast("binary").alias("content")).where("sha256 is not null").dropDuplicates(["sha256"])
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        new = new.join(spark.read.parquet(path).select("sha256"), "sha256", "left_anti")
    new.withColumn("prefix", F.substring("sha256", 1, 2)).repartition("prefix").write.mode("append").partitionBy("prefix").parquet(path)


def stored_contents(spark: SparkSession, path: str) -> DataFrame:
    """``sha256, content`` of a store, each content once."""
    return spark.read.schema("sha256 string, content binary, prefix string").parquet(path).select("sha256", "content").dropDuplicates(["sha256"])


def report(rows: DataFrame) -> DataFrame:
    """Rows as one JSON text a row, without null fields."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("report"))


def append_history(history: DataFrame, new: DataFrame, order: str, keep: int = 100) -> DataFrame:
    """A history with new entries, the latest ``keep`` of them: a bounded top-k."""
    return history.unionByName(new).orderBy(F.col(order).desc()).limit(keep)
