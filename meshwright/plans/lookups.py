"""Joins to a unique side that stay even when one key holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import BROADCAST_ROWS, stage

#: Rows of one key from which the key is joined by broadcasting its single partner.
HOT_ROWS = 100_000
#: Keys so joined at most, those of most rows first; no other holds more than this part of all rows.
HOT_KEYS = 1_000


def lookup(many: DataFrame, one: DataFrame, on: list[str], how: str = "left", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``many`` joined to ``one`` (unique on ``on``), hot keys apart.

    Keys with more than ``hot_rows`` rows in ``many`` are joined by broadcast and
    never shuffled; there are at most ``HOT_KEYS`` of them, whatever the rows,
    so their partners are a proven small table. All others, each below a
    thousandth of the rows, meet in an ordinary join. Rows without a key, which
    might be many, meet nothing and aren't shuffled either. ``many`` is read
    several times and should be a staged table.
    """
    given = many.dropna(subset=on)
    hot = given.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).orderBy(F.desc("_n")).limit(HOT_KEYS).select(*on)
    rows = hot.collect()
    if rows:
        keys = F.broadcast(many.sparkSession.createDataFrame([tuple(r) for r in rows], hot.schema))
        out = given.join(keys, on, "left_anti").join(one, on, how).unionByName(given.join(keys, on, "left_semi").join(F.broadcast(one.join(keys, on, "left_semi")), on, how))
    else:
        out = given.join(one, on, how)
    if how != "left":
        return out
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in one.schema if f.name not in on]
    without = None
    for c in on:
        test = F.col(c).isNull()
        without = test if without is None else without | test
    return out.unionByName(many.filter(without).select("*", *missing))


def apart(rows: DataFrame, by: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` of the groups of at most ``most`` rows, and those of the larger ones (None: there are none).

    The list of larger groups is a written table, broadcast while it is small
    and joined like any other beyond that. ``rows`` should be a staged table.
    """
    few = stage(rows.groupBy(by).count().filter(F.col("count") > most).select(by))
    n = few.count()
    if not n:
        return rows, None
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(few), by, "left_anti"), rows.join(F.broadcast(few), by, "left_semi")
    marked = stage(lookup(rows, few.withColumn("_large", F.lit(True)), [by], "left"))
    return marked.filter("_large is null").drop("_large"), marked.filter("_large").drop("_large")
