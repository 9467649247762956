"""Scores of proposed relations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the parts of a score.
WEIGHTS = {"distance": 0.30, "interface": 0.25, "explicit": 0.15, "context": 0.15, "endpoint": 0.05, "style": 0.05, "capacity": 0.05}
SIGMA = 2.5
#: Least score of a proposal, and by how much it must beat the next.
ACCEPTANCE, MARGIN = 0.55, 0.12


def gaussian(distance: Column, sigma: float = SIGMA) -> Column:
    return F.exp(-(distance * distance) / (2 * sigma * sigma))


def weighted(**parts: Column) -> Column:
    """Weighted sum of the parts, each held within 0..1, rounded to 6 places; missing parts count 0."""
    total = F.lit(0.0)
    for name, part in parts.items():
        total = total + F.lit(WEIGHTS[name]) * F.coalesce(F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return F.round(total, 6)


def context(same_site: Column, same_folder: Column, shared: Column) -> Column:
    """1 for the same folder, .8 with words in common, .6 for the same site, else .3."""
    return F.when(same_folder, 1.0).when(shared > 0, 0.8).when(same_site, 0.6).otherwise(0.3)


def style(same: Column, both: Column) -> Column:
    return F.when(same, 1.0).when(both, 0.25).otherwise(0.5)


def endpoint_role(wanted: Column, found: Column) -> Column:
    """Whether the end of a line is the one that was asked for: 1, .9 where nothing was asked, .5 against it; inline 1 or 0."""
    return F.when((wanted == "inline") | (found == "inline"), F.when(wanted.eqNullSafe(found), 1.0).otherwise(0.0)).when(wanted.isNull(), 0.9).when(wanted == found, 1.0).otherwise(0.5)


def stratum(distance: Column) -> Column:
    """Distance classes of the accuracy report."""
    return F.when(distance.isNull(), "none").when(distance <= 2, "0-2").when(distance <= 4, "2-4").when(distance <= 6, "4-6").otherwise("none")
