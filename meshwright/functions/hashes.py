"""Ids and revisions made from content."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ABSENT = '"__undefined__"'


def stable_json(*values: Column) -> Column:
    """A JSON array of texts and numbers; a null is ``null``."""

    def one(v: Column) -> Column:
        return F.coalesce(F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2), F.lit("null"))

    return F.concat(F.lit("["), F.concat_ws(",", *map(one, values)), F.lit("]"))


def stable_text(value) -> str:
    """The same for nested Python values: members sorted by name."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def content_id(prefix: str, *values: Column) -> Column:
    """``prefix:`` and 24 hex digits of the values' SHA-256."""
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(stable_json(*values), 256), 1, 24))


def fingerprint(*values: Column) -> Column:
    return F.sha2(stable_json(*values), 256)


def revision(rows: DataFrame, by: list[str], values: list[str], digits: int = 32) -> DataFrame:
    """One hash of each group's content, whatever the order of its rows.

    Rows are hashed first and four 48-bit parts of their hashes summed up, which
    takes partial sums before the shuffle, so no group is gathered as a
    whole: sums don't depend on order, and equal rows count.
    """
    row = fingerprint(*[F.col(v) for v in values])
    part = lambda k: F.conv(F.substring("_h", 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")
    sums = rows.select(*by, row.alias("_h")).groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(part(k)).alias(f"_s{k}") for k in range(4)])
    return sums.select(*by, "n_rows", F.substring(F.sha2(F.concat_ws("-", *[F.col(f"_s{k}").cast("string") for k in range(4)], F.col("n_rows").cast("string")), 256), 1, digits).alias("revision"))
