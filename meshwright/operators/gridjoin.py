"""Distance joins of points and lines on a grid of metres.

Rows of cells run along parallels; the cells of each row are as wide as the
row's highest latitude needs, and wrap around at the date line, so no pair
within reach is missed anywhere on the sphere. One side is put into the cell it
lies in, the other into all cells within reach; what meets in a cell is decided
by the exact distance. Cells are equi-join keys beside the scope, so a scope
that holds a third of all rows is spread over its cells.

Defined results: places out of bounds or not finite take no part; no scope
equals the scope ``''``; pairs at exactly the radius count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo

_DEGREE = math.pi * geo.EARTH_RADIUS / 180
#: Longest piece, in cells, into which a segment is cut before cells are listed.
PIECE_CELLS = 4


def _row(lat: str, cell: float) -> str:
    return f"cast(floor({lat} * {_DEGREE / cell!r}D) as bigint)"


def _cells_in_row(row: str, cell: float) -> str:
    """Number of cells around the earth in a row; its widest parallel tells."""
    parallel = f"least(greatest(abs({row} * {cell / _DEGREE!r}D), abs(({row} + 1) * {cell / _DEGREE!r}D)) + 1e-9D, 90D)"
    return f"cast(greatest(floor({360 * _DEGREE / cell!r}D * greatest(cos(radians({parallel})), 0D)), 1) as bigint)"


def _column_at(lon: str, count: str, aside: str = "") -> str:
    return f"cast(floor(({lon} + 180D) / 360D * {count} {aside}) as bigint)"


def in_cell(df: DataFrame, cell: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``df`` with the cell (_row, _col) of its place."""
    rows = df.where(geo.valid_sql(lon, lat)).selectExpr("*", f"{_row(lat, cell)} as _row")
    count = _cells_in_row("_row", cell)
    return rows.selectExpr("*", f"pmod({_column_at(lon, count)}, {count}) as _col")


def covered_cells(df: DataFrame, cell: float, west: str, south: str, east: str, north: str, reach: float) -> DataFrame:
    """``df`` once for each cell within ``reach`` metres of its box."""
    up = repr(reach / _DEGREE)
    rows = df.selectExpr("*", f"explode(sequence({_row(f'greatest({south} - {up}D, -90D)', cell)}, {_row(f'least({north} + {up}D, 90D)', cell)})) as _row")
    rows = rows.selectExpr("*", f"{_cells_in_row('_row', cell)} as _count")
    # Within a row, cells are never narrower than ``cell`` metres except where one cell is the whole row.
    # Parallels shrink by less than 1 % within reach of a row of 1,000 cells or more; nearer to a pole whole cells are added.
    aside = math.ceil(reach / cell)
    part = f"case when _count < 1000 then {float(aside)!r}D else {min(aside, 1.01 * reach / cell)!r}D end"
    rows = rows.selectExpr("*", f"{_column_at(west, '_count', f'- {part}')} as _low", f"{_column_at(east, '_count', f'+ {part}')} as _high")
    listed = rows.selectExpr("*", "explode(case when _high - _low + 1 >= _count then sequence(0L, _count - 1) else sequence(_low, _high) end) as _at")
    return listed.selectExpr("*", "pmod(_at, _count) as _col").drop("_count", "_low", "_high", "_at")


def near_points(left: DataFrame, right: DataFrame, radius: float, cell: float | None = None) -> DataFrame:
    """Pairs of ``left`` (scope, left_id, lon, lat, any others) and ``right`` (scope, right_id, lon, lat, any others) within ``radius`` metres, with ``distance``.

    Other columns are carried along; their names must differ between the sides.
    In a ``cell`` wider than the radius more pairs meet, but a left row is put
    into fewer cells: 9 at the radius, 2 or 3 at four times that.
    """
    cell = max(cell or radius, 1.0)
    own = lambda df, named: [c for c in df.columns if c not in ("scope", named, "lon", "lat")]
    others = [*own(left, "left_id"), *own(right, "right_id")]
    a = left.selectExpr("coalesce(scope, '') as scope", "left_id", "lon as lon1", "lat as lat1", *own(left, "left_id")).where(geo.valid_sql("lon1", "lat1"))
    a = covered_cells(a, cell, "lon1", "lat1", "lon1", "lat1", radius)
    b = in_cell(right.selectExpr("coalesce(scope, '') as scope", "right_id", "lon", "lat", *own(right, "right_id")), cell)
    met = a.join(b, ["scope", "_row", "_col"]).selectExpr("scope", "left_id", "right_id", f"{geo.haversine_sql('lon1', 'lat1', 'lon', 'lat')} as distance", *others)
    return met.where(f"distance <= {radius!r}D")


def nearest(pairs: DataFrame, keep: int = 2) -> DataFrame:
    """Each left row's nearest partner, with the distance of the second (null: none); ties by id."""
    order = Window.partitionBy("scope", "left_id").orderBy("distance", "right_id")
    ranked = pairs.withColumn("place", F.row_number().over(order)).withColumn("second", F.lead("distance").over(order))
    return ranked.filter("place = 1").drop("place")


def unique_nearest(pairs: DataFrame, margin: float, ratio: float) -> DataFrame:
    """``nearest`` with ``is_unique``: the second is absent, ``margin`` metres farther, or ``ratio`` times as far."""
    first = nearest(pairs)
    apart = F.col("second").isNull() | (F.col("second") - F.col("distance") >= margin) | ((F.col("distance") > 0) & (F.col("second") / F.col("distance") >= ratio))
    return first.withColumn("is_unique", F.coalesce(apart, F.lit(True)))


_TURNED = "{a} + ({b} - {a}) - 360D * round(({b} - {a}) / 360D)"


def _segments(lines: DataFrame) -> DataFrame:
    """(scope, line_id, seg, ax, ay, bx, by) of lines (scope, line_id, line)."""
    pairs = "inline(transform(sequence(1, size(line) - 1), i -> named_struct('seg', i - 1, 'a', line[i - 1], 'b', line[i])))"
    flat = lines.where("size(line) >= 2").selectExpr("scope", "line_id", pairs)
    return flat.selectExpr("scope", "line_id", "seg", "a.lon as ax", "a.lat as ay", f"{_TURNED.format(a='a.lon', b='b.lon')} as bx", "b.lat as by")


def segments(lines: DataFrame) -> DataFrame:
    """(scope, line_id, seg, ax, ay, bx, by, length, measure) of lines (scope, line_id, line): each segment and where it begins along its line.

    A segment runs the short way round, so ``bx`` may lie beyond 180 degrees.
    """
    flat = _segments(lines).selectExpr("*", f"{geo.haversine_sql('ax', 'ay', 'bx', 'by')} as length")
    return flat.selectExpr("*", "coalesce(sum(length) over (partition by scope, line_id order by seg rows between unbounded preceding and 1 preceding), 0D) as measure")


def _length_sql(upto: str) -> str:
    """SQL of the length of ``line`` up to its place number ``upto`` (from 0)."""
    step = geo.haversine_sql("line[i - 1].lon", "line[i - 1].lat", "line[i].lon", "line[i].lat")
    return f"case when {upto} > 0 then aggregate(sequence(1, {upto}), 0D, (s, i) -> s + {step}) else 0D end"


def line_ends(lines: DataFrame) -> DataFrame:
    """(scope, line_id, role, lon, lat, lon2, lat2): both ends of each line, with the next place inwards."""
    end = lambda role, a, b: F.struct(F.lit(role).alias("role"), a["lon"].alias("lon"), a["lat"].alias("lat"), b["lon"].alias("lon2"), b["lat"].alias("lat2"))
    ends = F.array(end("start", F.element_at("line", 1), F.element_at("line", 2)), end("end", F.element_at("line", -1), F.element_at("line", -2)))
    return lines.filter(F.size("line") >= 2).select("scope", "line_id", F.inline(ends))


def _in_cells(segs: DataFrame, cell: float, reach: float, piece: int = PIECE_CELLS) -> DataFrame:
    """Segments in pieces of a few cells, each in all cells within reach, so long ones don't fill their whole box."""
    cut = segs.selectExpr("*", f"cast(greatest(ceil(greatest(abs(by - ay), abs(bx - ax)) * {_DEGREE / (piece * cell)!r}D), 1) as int) as _n").selectExpr("*", "explode(sequence(0, _n - 1)) as _k")
    at = lambda a, b, k: f"{a} + ({b} - {a}) * (({k}) / _n)"
    ends = {"x0": at("ax", "bx", "_k"), "x1": at("ax", "bx", "_k + 1"), "y0": at("ay", "by", "_k"), "y1": at("ay", "by", "_k + 1")}
    cut = cut.selectExpr("*", *[f"{v} as _{k}" for k, v in ends.items()]).drop("_n", "_k")
    covered = covered_cells(cut, cell, "least(_x0, _x1)", "least(_y0, _y1)", "greatest(_x0, _x1)", "greatest(_y0, _y1)", reach)
    return covered.drop("_x0", "_x1", "_y0", "_y1")


def points_on_lines(points: DataFrame, lines: DataFrame, radius: float, cell: float | None = None) -> DataFrame:
    """(scope, line_id, point_id, distance, measure, to_start, to_end): points within ``radius`` metres of a line, at the nearest place of it.

    The nearest of equally near segments is the first. ``measure`` is metres
    along the line, ``to_end`` what is left of it. Both are worked out for the
    lines that are met only, so segments need no running sums.
    """
    cell = cell or max(4 * radius, 5.0)
    lines = lines.selectExpr("coalesce(scope, '') as scope", "line_id", "line")
    place = in_cell(points.selectExpr("coalesce(scope, '') as scope", "point_id", "lon", "lat"), cell)
    met = _in_cells(_segments(lines), cell, radius, 2).join(place, ["scope", "_row", "_col"])
    east = lambda x: f"radians(({x} - ax) - 360D * round(({x} - ax) / 360D)) * {geo.EARTH_RADIUS}D * cos(radians(lat))"
    north = lambda y: f"radians({y} - ay) * {geo.EARTH_RADIUS}D"
    met = met.selectExpr("scope", "line_id", "point_id", "seg", f"{east('lon')} as px", f"{north('lat')} as py", f"{east('bx')} as qx", f"{north('by')} as qy")
    met = met.selectExpr("scope", "line_id", "point_id", "seg", "px", "py", "qx", "qy", "case when qx * qx + qy * qy > 0 then least(greatest((px * qx + py * qy) / (qx * qx + qy * qy), 0D), 1D) else 0D end as t")
    met = met.selectExpr("scope", "line_id", "point_id", "seg", "t", "sqrt((px - t * qx) * (px - t * qx) + (py - t * qy) * (py - t * qy)) as distance").where(f"distance <= {radius!r}D")
    best = met.groupBy("scope", "line_id", "point_id").agg(F.expr("min(struct(distance, seg, t)) as m"))
    told = best.join(lines, ["scope", "line_id"]).selectExpr("scope", "line_id", "point_id", "m.distance", f"{_length_sql('m.seg')} as s0", f"{_length_sql('m.seg + 1')} as s1", f"{_length_sql('size(line) - 1')} as total", "m.t as t")
    return told.selectExpr("scope", "line_id", "point_id", "distance", "s0 + t * (s1 - s0) as measure", "s0 + t * (s1 - s0) as to_start", "total - (s0 + t * (s1 - s0)) as to_end")


def crossings(lines: DataFrame, cell: float = 50.0, digits: int = 9) -> DataFrame:
    """(scope, first_line, second_line, lon, lat): places where two lines of a scope cross, rounded; each place once."""
    covered = _in_cells(_segments(lines), cell, 0.0)
    a, b = covered.alias("a"), covered.alias("b")
    on = (F.col("a.scope") == F.col("b.scope")) & (F.col("a._row") == F.col("b._row")) & (F.col("a._col") == F.col("b._col")) & (F.col("a.line_id") < F.col("b.line_id"))
    turn = F.col("a.ax") + geo.turned(F.col("b.ax") - F.col("a.ax")) - F.col("b.ax")  # both on one side of the date line
    found, t, _ = geo.crossing(*[F.col(f"a.{c}") for c in ("ax", "ay", "bx", "by")], F.col("b.ax") + turn, F.col("b.ay"), F.col("b.bx") + turn, F.col("b.by"))
    at = lambda p, q: F.round(F.col(f"a.{p}") + t * (F.col(f"a.{q}") - F.col(f"a.{p}")), digits)
    return a.join(b, on).filter(found).select("a.scope", F.col("a.line_id").alias("first_line"), F.col("b.line_id").alias("second_line"), at("ax", "bx").alias("lon"), at("ay", "by").alias("lat")).distinct()


def overlaps(lines: DataFrame, cell: float = 50.0) -> DataFrame:
    """(scope, first_line, second_line): lines of which two segments lie on one line and share a stretch of it."""
    covered = _in_cells(_segments(lines), cell, 0.0)
    a, b = covered.alias("a"), covered.alias("b")
    on = (F.col("a.scope") == F.col("b.scope")) & (F.col("a._row") == F.col("b._row")) & (F.col("a._col") == F.col("b._col")) & (F.col("a.line_id") < F.col("b.line_id"))
    turn = F.col("a.ax") + geo.turned(F.col("b.ax") - F.col("a.ax")) - F.col("b.ax")
    c = lambda s, n: F.col(f"{s}.{n}") + turn if s == "b" and n in ("ax", "bx") else F.col(f"{s}.{n}")
    dx, dy = c("a", "bx") - c("a", "ax"), c("a", "by") - c("a", "ay")
    flat = lambda p, q: F.abs(dx * (c("b", q) - c("a", "ay")) - dy * (c("b", p) - c("a", "ax"))) <= 1e-10

    def shared(p: str, q: str) -> Column:
        high = F.least(F.greatest(c("a", p), c("a", q)), F.greatest(c("b", p), c("b", q)))
        return high - F.greatest(F.least(c("a", p), c("a", q)), F.least(c("b", p), c("b", q))) > 1e-10

    stretch = F.when(F.abs(dx) >= F.abs(dy), shared("ax", "bx")).otherwise(shared("ay", "by"))
    return a.join(b, on).filter(flat("ax", "ay") & flat("bx", "by") & stretch).select("a.scope", F.col("a.line_id").alias("first_line"), F.col("b.line_id").alias("second_line")).distinct()


def duplicate_lines(lines: DataFrame, digits: int = 10) -> DataFrame:
    """(scope, line_id, first_line, n_lines): lines with the same places in either direction."""
    text = lambda line: F.array_join(F.transform(line, lambda p: F.format_string(f"%.{digits}f,%.{digits}f", p["lon"], p["lat"])), "|")
    keyed = lines.withColumn("_k", F.sha2(F.least(text(F.col("line")), text(F.reverse("line"))), 256))
    group = Window.partitionBy("scope", "_k")
    return keyed.select("scope", "line_id", F.min("line_id").over(group).alias("first_line"), F.count(F.lit(1)).over(group).alias("n_lines")).filter("n_lines > 1")


def end_pairs(ends: DataFrame, radius: float, degrees: float) -> DataFrame:
    """(scope, first_end, second_end, distance, deviation): ends of different lines within ``radius`` that run on into each other.

    ``ends`` has scope, line_id, role, lon, lat, lon2, lat2; deviation is that
    of the angle between the outgoing directions from a straight line, 180 for
    a line without direction.
    """
    ends = ends.withColumn("end_id", F.concat_ws(":", "line_id", "role"))
    near = near_points(ends.select("scope", F.col("end_id").alias("left_id"), "lon", "lat"), ends.select("scope", F.col("end_id").alias("right_id"), "lon", "lat"), radius).filter("left_id < right_id")
    side = lambda s: ends.select("scope", F.col("end_id").alias(f"{s}_id"), F.col("line_id").alias(f"{s}_line"), *[F.col(c).alias(f"{s}_{c}") for c in ("lon", "lat", "lon2", "lat2")])
    both = near.join(side("left"), ["scope", "left_id"]).join(side("right"), ["scope", "right_id"]).filter("left_line != right_line")
    vector = lambda s: geo.local_metres(F.col(f"{s}_lon2"), F.col(f"{s}_lat2"), F.col(f"{s}_lon"), F.col(f"{s}_lat"), F.col(f"{s}_lat"))
    (ux, uy), (vx, vy) = vector("left"), vector("right")
    norm = F.sqrt((ux * ux + uy * uy) * (vx * vx + vy * vy))
    cosine = F.greatest(F.least((ux * vx + uy * vy) / F.when(norm > 0, norm), F.lit(1.0)), F.lit(-1.0))
    deviation = F.coalesce(180 - F.degrees(F.acos(cosine)), F.lit(180.0))
    return both.withColumn("deviation", deviation).filter(F.col("deviation") <= degrees).select("scope", F.col("left_id").alias("first_end"), F.col("right_id").alias("second_end"), "distance", "deviation")
