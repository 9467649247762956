"""Generation of proposed relations: generators united, scored and decided in one plan.

Every generator gives rows of one form (``COLUMNS``); what they share, nodes and
paths, is staged once. Of several ways to the same proposal the nearest stays;
each decision (the end of a line, a device on a line, a stated reference, a
mounting) then ranks its proposals by score; ends without any proposal are told
as unresolved. Nothing is gathered but by aggregation and windows over one
decision, whose rows lie within a few metres of one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import score

COLUMNS = ["scope", "candidate_type", "endpoint_id", "target_id", "distance", "fit", "role"]


def union(parts: list[DataFrame]) -> DataFrame:
    """Proposals of all generators; of the same proposal the nearest, then the best fitting."""
    every = reduce(DataFrame.unionByName, [p.select(*COLUMNS) for p in parts])
    best = every.groupBy("scope", "candidate_type", "endpoint_id", "target_id").agg(F.expr("min(struct(coalesce(distance, 0D) as d, -fit as f, distance, fit, role)) as m"))
    return best.selectExpr("scope", "candidate_type", "endpoint_id", "target_id", "m.distance", "m.fit", "m.role")


def scored(proposals: DataFrame) -> DataFrame:
    """``proposals`` with their score: nearness (stated ones count as at hand), fit, statement, and the role of the end."""
    stated = F.col("candidate_type") == "explicit_metadata"
    total = score.weighted(
        distance=F.when(stated, 1.0).otherwise(score.gaussian(F.col("distance"))), interface=F.col("fit"), explicit=F.when(stated, 1.0).otherwise(0.0), context=F.lit(0.6),
        endpoint=F.when(F.col("role") == "inline", 1.0).otherwise(0.9), style=F.lit(0.5), capacity=F.lit(1.0),
    )
    return proposals.withColumn("score", total)


def decided(rows: DataFrame) -> DataFrame:
    """``rows`` with place and outcome within their decision (scope, endpoint_id; on lines the device decides)."""
    group = "partition by scope, case when role = 'inline' then concat('inline:', target_id) else endpoint_id end"
    order = f"({group} order by score desc, endpoint_id, target_id, candidate_type)"
    placed = rows.selectExpr("*", f"row_number() over {order} as place", f"max(score) over ({group}) as top", f"count(1) over ({group}) as n", f"score - coalesce(lead(score) over {order}, 0D) as margin")
    placed = placed.selectExpr("*", f"max(case when place = 1 then margin end) over ({group}) as lead")
    outcome = f"case when top < {score.ACCEPTANCE} then 'below_threshold' when n > 1 and lead < {score.MARGIN} then 'ambiguous' when place = 1 then 'recommended' else 'not_selected' end"
    return placed.selectExpr("scope", "candidate_type", "endpoint_id", "target_id", "distance", "fit", "score", "place", f"{outcome} as outcome")


def unresolved(ends: DataFrame, proposals: DataFrame) -> DataFrame:
    """Ends (scope, endpoint_id) without a proposal, in the form of ``decided``."""
    left = ends.select("scope", "endpoint_id").distinct().join(proposals.select("scope", "endpoint_id").distinct(), ["scope", "endpoint_id"], "left_anti")
    return left.selectExpr("scope", "'unresolved_termination' as candidate_type", "endpoint_id", "cast(null as string) as target_id", "cast(null as double) as distance", "0D as fit", "0D as score", "1 as place", "'unresolved' as outcome")


def without_weaker(edges: DataFrame, ends: list[str], is_special: str, weak: str, strong: str) -> DataFrame:
    """Edges less those that are ``weak`` at a special end which has a ``strong`` edge too.

    ``is_special`` and the tests are SQL over the edges' columns, ``is_special``
    with ``{end}`` for the end. Windows run over one special end; its edges are
    aggregated to a yes or no before they are joined back.
    """
    held = edges
    special = reduce(DataFrame.unionByName, [edges.where(is_special.format(end=e)).selectExpr("scope", f"{e} as special", f"({strong}) as s") for e in ends])
    strong_ends = special.groupBy("scope", "special").agg(F.expr("max(s) as s")).where("s")
    for e in ends:
        held = held.join(strong_ends.selectExpr("scope", f"special as {e}", "s as _s"), ["scope", e], "left").where(f"not (coalesce(_s, false) and ({is_special.format(end=e)}) and ({weak}))").drop("_s")
    return held.select(*edges.columns)
