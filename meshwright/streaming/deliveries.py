"""Streams of deliveries: records counted once, and orphans as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import norm_id


def first_of_stream(stream: DataFrame, key: str, received: str, late: str = "30 days") -> DataFrame:
    """The first delivery of each record of a stream; state is kept for ``late`` behind the newest row.

    A row without a key passes as it is, told apart by its content.
    """
    rest = [c for c in stream.columns if c not in (key, received)]
    keyed = stream.withColumn("_key", F.coalesce(norm_id(key), F.concat(F.lit("\x00"), F.xxhash64(*rest).cast("string"))))
    return keyed.withWatermark(received, late).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def counts_by_window(stream: DataFrame, time: str, by: list[str], window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows per window and group, late ones up to ``late``."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("since"), *by, "n")
