"""Sessions, table loading and the shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "skarv", cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session as the tests and the bench use it; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where that is unset and the session runs in one process (tests), a
    folder of our own is made. A cluster without the setting is refused: its
    executors would each write to disks of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or None
    context = spark.sparkContext._jsc.sc().getCheckpointDir()
    if named is None:
        if context.isDefined():
            return context.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"skarv-shared-{os.getpid()}")
    if not context.isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: The folders that ``cut`` wrote and nothing has removed yet.
_WRITTEN: set[str] = set()


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a written table in the shared folder: no lineage, and sizes that adaptive plans can see.

    The table outlives any executor. It goes when the application ends, or
    earlier by ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    place, files = _file_system(spark, path)
    files.deleteOnExit(place)
    df.write.parquet(path)
    _WRITTEN.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Removes the tables behind frames that ``cut`` gave and that nothing will read again."""
    for frame in frames:
        path = getattr(frame, "_cut_path", None)
        if path in _WRITTEN:
            place, files = _file_system(frame.sparkSession, path)
            files.delete(place, True)
            _WRITTEN.discard(path)


def release_all(spark: SparkSession) -> None:
    """Removes all that ``cut`` wrote so far, for a session that goes on to other queries."""
    for path in sorted(_WRITTEN):
        place, files = _file_system(spark, path)
        files.delete(place, True)
    _WRITTEN.clear()
