"""Tables written in the shared folder, and helpers that keep partitions bounded."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a table that may be broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a session on one
    machine may go without that setting and gets a folder of its own; on a
    cluster its absence is an error, as executors would not find each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="meshwright-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder; what is written there is deleted when the driver's JVM ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}")
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    system.deleteOnExit(place)
    return system.makeQualified(place).toString()  # with its scheme, so that all readers mean the same file system


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, survives the loss of executors, and gives the
    planner the true size of the table.
    """
    spark = df.sparkSession
    path = shared_path(spark, "stage")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unbroadcast(df: DataFrame) -> DataFrame:
    """``df`` as a side of the next join, which then sorts and merges whatever the sizes seem to be.

    Sizes are those of compressed files, of which rows in memory are many
    times; a side that seems small would be built in the driver's memory.
    """
    return df.hint("merge")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def partitions_for(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Partitions of at most about ``rows_each`` rows, not fewer than the session's width unless rows are few."""
    needed = math.ceil(rows / max(1, rows_each))
    return max(1, needed, min(shuffle_width(spark), math.ceil(rows / 5_000)))
