"""Search, facets, pages, decisions and allocation: ranking and windows over records."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_token

#: Ranks of a hit.
EXACT_ID, ID_PREFIX, NAME, NAME_PREFIX, KIND, TOKEN, PART = 100, 90, 80, 70, 60, 50, 40


def search_rank(query: str, ids: list[Column], name: Column, kinds: list[Column], texts: list[Column]) -> Column:
    """Rank of a hit, null for none. All columns are in lower case and trimmed; a query of one letter hits ids only."""
    q = F.lit(query)
    any_ = lambda tests: F.coalesce(F.greatest(*[F.coalesce(t, F.lit(False)).cast("int") for t in tests], F.lit(0)), F.lit(0)) == 1
    rank = F.when(any_([i == q for i in ids]), EXACT_ID)
    if len(query) < 2:
        return rank
    return (
        rank.when(any_([i.startswith(q) for i in ids]), ID_PREFIX).when(name == q, NAME).when(name.startswith(q), NAME_PREFIX).when(any_([k == q for k in kinds]), KIND)
        .when(any_([contains_token(t, q) for t in (name, *texts)]), TOKEN).when(any_([t.contains(q) for t in (name, *kinds, *texts)]), PART)
    )


def facets(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, n) of several fields in one pass, by grouping sets; null counts as ``unknown``."""
    named = rows.select(*[F.coalesce(F.nullif(F.col(f), F.lit("")), F.lit("unknown")).alias(f) for f in fields])
    grouped = named.groupingSets([[F.col(f)] for f in fields], *[F.col(f) for f in fields]).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    top = 1 << len(fields)
    which = F.lit(None).cast("string")
    for k, f in enumerate(fields):
        which = F.when(F.col("g") == top - 1 - (1 << (len(fields) - 1 - k)), f).otherwise(which)
    return grouped.select(which.alias("field"), F.coalesce(*[F.col(f) for f in fields]).alias("value"), "n")


def signature(query: dict) -> str:
    """Hash of a query, to bind a cursor to it."""
    return hashlib.sha256(json.dumps(query, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:24]


def encode_cursor(**values) -> str:
    return base64.urlsafe_b64encode(json.dumps(values, sort_keys=True).encode()).decode().rstrip("=")


def decode_cursor(cursor: str | None, revision: str, query: dict) -> dict | None:
    """The values of a cursor; one of another revision or query, or a broken one, is an error."""
    if not cursor:
        return None
    try:
        values = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError as e:
        raise ValueError("invalid cursor") from e
    if not isinstance(values, dict) or values.get("revision") != revision or values.get("query") != signature(query):
        raise ValueError("stale cursor")
    return values


def page_by_offset(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page by position: a top-k, no full sort reaches one task."""
    return rows.orderBy(*order).offset(offset).limit(limit) if offset else rows.orderBy(*order).limit(limit)


def page_by_key(rows: DataFrame, score: str, key: str, limit: int, after: tuple[float | None, str] | None = None) -> DataFrame:
    """The page behind a (score, key), by score from the highest, without score last, then by key; the filter reaches the scan."""
    if after is not None:
        value, last = after
        tied = (F.col(score).isNull() if value is None else F.col(score) == value) & (F.col(key) > last)
        rows = rows.filter(tied if value is None else tied | (F.col(score) < value) | F.col(score).isNull())
    return rows.orderBy(F.col(score).desc_nulls_last(), key).limit(limit)


def decisions(rows: DataFrame, group: list[str], score: str, key: str) -> DataFrame:
    """``rows`` with place, second (the next score) and margin within their decision: by score from the highest, then by key."""
    order = Window.partitionBy(*group).orderBy(F.col(score).desc_nulls_last(), key)
    out = rows.withColumn("place", F.row_number().over(order)).withColumn("second", F.lead(score).over(order)).withColumn("n_group", F.count(F.lit(1)).over(Window.partitionBy(*group)))
    return out.withColumn("margin", F.col(score) - F.coalesce("second", F.lit(0.0)))


def conflicts(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    """Decisions with several rows: how many and the first."""
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n_rows"), F.min(key).alias("first_row")).filter("n_rows > 1")


def first_per(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter("_n = 1").drop("_n")


def numbered(rows: DataFrame, base: str, order: list[str], alias: str = "numbered") -> DataFrame:
    """``base``, then ``base:2``, ``base:3`` ... where a base repeats."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return rows.withColumn(alias, F.when(n == 1, F.col(base)).otherwise(F.concat_ws(":", base, n.cast("string"))))


def allocate(rows: DataFrame, capacity: DataFrame, group: list[str], score: str, key: str) -> DataFrame:
    """``rows`` with place and accepted: in order of score each takes one of its group's free places (capacity: group..., free).

    A row that is turned down frees nothing, so the i-th is accepted just when
    fewer than ``free`` come before it: no loop is needed.
    """
    order = Window.partitionBy(*group).orderBy(F.col(score).desc_nulls_last(), key)
    return rows.withColumn("place", F.row_number().over(order)).join(capacity, group, "left").withColumn("accepted", F.col("place") <= F.coalesce("free", F.lit(0))).drop("free")


def pair_by_place(left: DataFrame, right: DataFrame, group: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """The n-th of ``left`` with the n-th of ``right`` in each group."""
    a = left.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*left_order)))
    b = right.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*right_order)))
    return a.join(b, [*group, "place"])


def histogram(rows: DataFrame, group: list[str], value: str, bounds: list[float]) -> DataFrame:
    """(group..., bound, n): cumulative counts up to each bound, null for all."""
    counts = rows.groupBy(*group).agg(*[F.sum((F.col(value) <= b).cast("long")).alias(f"_b{k}") for k, b in enumerate(bounds)], F.count(value).alias("_all"))
    each = F.array(*[F.struct(F.lit(float(b)).alias("bound"), F.coalesce(f"_b{k}", F.lit(0)).cast("long").alias("n")) for k, b in enumerate(bounds)], F.struct(F.lit(None).cast("double").alias("bound"), F.col("_all").alias("n")))
    return counts.select(*group, F.inline(each))


def precision_recall(rows: DataFrame, group: list[str], predicted: Column, actual: Column) -> DataFrame:
    """Counts and ratios of a yes/no prediction."""
    count = lambda t: F.sum(F.coalesce(t, F.lit(False)).cast("long"))
    out = rows.groupBy(*group).agg(count(predicted & actual).alias("true_positive"), count(predicted & ~actual).alias("false_positive"), count(~predicted & actual).alias("false_negative"))
    ratio = lambda a, b: F.round(F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0)), 6)
    return out.withColumn("precision", ratio("true_positive", "false_positive")).withColumn("recall", ratio("true_positive", "false_negative"))
