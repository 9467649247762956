"""Records out of deliveries: a record counts once, received when its first row was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_deliveries(df: DataFrame, key: list[str], received: str) -> DataFrame:
    """One whole row per ``key``: the one received first; of several received together the one of least content hash.

    Rows whose whole key is null stay apart by content (they merge only with
    rows equal in every other column), so they can't pile up in one group.
    Rows without a time come last.
    """
    rest = [f"`{c}`" for c in df.columns if c not in (*key, received)]
    keys = [f"`{c}`" for c in key]
    content = f"xxhash64({', '.join(rest)})" if rest else "0L"
    apart = f"case when {' and '.join(f'{k} is null' for k in keys)} then {content} end"
    # A row with none before it is the first. (A row number would sort all rows before the shuffle too, for the few that repeat.)
    first = f"lag(true) over (partition by {', '.join([*keys, apart])} order by `{received}` asc nulls last, {content}) is null"
    return df.select("*", F.expr(first).alias("_first")).filter("_first").drop("_first")


def month_of(ts: str | Column) -> Column:
    """``YYYY-MM`` in the session's time zone (the engine runs in UTC)."""
    return F.date_format(ts, "yyyy-MM")
