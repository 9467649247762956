"""Geometry as column expressions: places out of JSON and WKT texts, distances, boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import trim_sql, trimmed

#: Mean radius of the earth in metres.
EARTH_RADIUS = 6_371_008.8


def has_coordinates(column: str) -> Column:
    """Whether the JSON text holds anything: not null, not blank, not ``[]``."""
    text = trimmed(column)
    return F.coalesce(F.regexp_replace(text, r"\s", "") != "[]", F.lit(False))


def _position(parts: Column) -> Column:
    lon, lat = F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def point_from_json(column: str) -> Column:
    """struct(lon, lat) of ``[lon, lat, ...]``; numbers may be quoted."""
    return _position(F.from_json(F.col(column), "array<string>"))


def point_from_wkt(column: str) -> Column:
    pattern = r"(?i)^\s*(?:SRID\s*=\s*\d+\s*;)?\s*POINT\s*(?:ZM|Z|M)?\s*\(\s*([^\s,)]+)\s+([^\s,)]+)[^,)]*\)"
    return F.struct(*[F.regexp_extract(F.col(column), pattern, i).try_cast("double").alias(n) for i, n in ((1, "lon"), (2, "lat"))])


def rings_from_json(column: str) -> Column:
    """array<array<struct(lon, lat)>> of nested arrays; a single bare ring is taken as the outer one."""
    nested = F.from_json(F.col(column), "array<array<array<string>>>")
    bare = F.from_json(F.col(column), "array<array<string>>")
    rings = F.transform(nested, lambda r: F.transform(r, _position))
    single = F.array(F.transform(bare, _position))
    return F.when(F.col(column).rlike(r"^\s*\[\s*\[\s*\["), rings).otherwise(single)


def rings_from_wkt(column: str) -> Column:
    body = F.regexp_extract(F.col(column), r"(?is)^\s*(?:SRID\s*=\s*\d+\s*;)?\s*POLYGON\s*(?:ZM|Z|M)?\s*\(\s*\((.*)\)\s*\)\s*$", 1)
    rings = F.split(body, r"\)\s*,\s*\(")
    return F.when(body != "", F.transform(rings, lambda r: F.transform(F.split(r, ","), lambda p: _position(F.split(F.trim(p), r"\s+")))))


def finite(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.abs(c) < 1e9, F.lit(False))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance in metres on the sphere."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def haversine_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """SQL of ``haversine``."""
    return f"2 * {EARTH_RADIUS}D * asin(least(1D, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2D) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2D))))"


def valid_sql(lon: str, lat: str) -> str:
    """SQL of ``position_valid``; a null is false in a filter."""
    return f"({lon} between -180D and 180D and {lat} between -90D and 90D)"


HAS_COORDINATES_SQL = rf"coalesce(regexp_replace({trim_sql('coordinates')}, r'\s', '') != '[]', false)"
_PLACE = "named_struct('lon', try_cast(try_element_at({0}, 1) as double), 'lat', try_cast(try_element_at({0}, 2) as double))"
_POINT_WKT = r"r'(?i)^\s*(?:SRID\s*=\s*\d+\s*;)?\s*POINT\s*(?:ZM|Z|M)?\s*\(\s*([^\s,)]+)\s+([^\s,)]+)[^,)]*\)'"
_LINE_WKT = r"regexp_extract(geometry, r'(?i)LINESTRING\s*(?:ZM|Z|M)?\s*\((.*)\)', 1)"
#: The place of a point out of ``coordinates``, or ``geometry`` where that has no value, as struct(lon, lat).
POINT_SQL = f"case when {HAS_COORDINATES_SQL} then {_PLACE.format("from_json(coordinates, 'array<string>')")} else named_struct('lon', try_cast(regexp_extract(geometry, {_POINT_WKT}, 1) as double), 'lat', try_cast(regexp_extract(geometry, {_POINT_WKT}, 2) as double)) end"
#: The places of a line likewise, as an array.
LINE_SQL = rf"transform(case when {HAS_COORDINATES_SQL} then from_json(coordinates, 'array<array<string>>') when {_LINE_WKT} != '' then transform(split({_LINE_WKT}, ','), p -> split(trim(p), r'\s+')) end, p -> {_PLACE.format('p')})"


def morton(lon: Column, lat: Column) -> Column:
    """Z-order of a place: the bits of 28-bit longitude and latitude, interleaved."""

    def spread(x: Column) -> Column:
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
        return x

    cell = lambda c, low, span: F.least(F.greatest(F.floor((c - low) / span * (1 << 28)), F.lit(0)), F.lit((1 << 28) - 1)).cast("long")
    return spread(cell(lon, -180.0, 360.0)).bitwiseOR(F.shiftleft(spread(cell(lat, -90.0, 180.0)), 1))


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """Metres of a degree of longitude and of latitude at ``lat`` (equirectangular)."""
    one = math.pi * EARTH_RADIUS / 180
    return F.cos(F.radians(lat)) * one, F.lit(one)


def position_valid(lon: Column, lat: Column) -> Column:
    """Longitude and latitude within the earth's bounds."""
    return finite(lon) & finite(lat) & F.abs(lon).between(0, 180) & F.abs(lat).between(0, 90)


def coordinate_key(lon: Column, lat: Column, digits: int = 9) -> Column:
    return F.format_string(f"%.{digits}f,%.{digits}f", lon, lat)


def turned(delta: Column) -> Column:
    """A difference of longitudes the short way round."""
    return delta - 360 * F.round(delta / 360)


def local_metres(lon: Column, lat: Column, lon0: Column, lat0: Column, reference: Column) -> tuple[Column, Column]:
    """x and y from an origin, equirectangular at the latitude ``reference``."""
    return F.radians(turned(lon - lon0)) * EARTH_RADIUS * F.cos(F.radians(reference)), F.radians(lat - lat0) * EARTH_RADIUS


def project(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """Position along a segment (0..1) of the place nearest to a point, and the squared distance to it."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / square, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return t, ex * ex + ey * ey


def crossing(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> tuple[Column, Column, Column]:
    """(found, t, u): where two segments cross, t along the first and u along the second; parallel ones don't."""
    rx, ry, sx, sy = bx - ax, by - ay, dx - cx, dy - cy
    det = rx * sy - ry * sx
    safe = F.when(F.abs(det) > 1e-18, det)
    t, u = ((cx - ax) * sy - (cy - ay) * sx) / safe, ((cx - ax) * ry - (cy - ay) * rx) / safe
    slack = 1e-10
    return F.coalesce(t.between(-slack, 1 + slack) & u.between(-slack, 1 + slack), F.lit(False)), t, u


def ring_area(ring: Column) -> Column:
    """Twice signed shoelace sum halved, in square degrees, of an array of struct(lon, lat); open rings are closed."""
    n = F.size(ring)
    term = lambda p, i: p["lon"] * F.get(ring, (i + 1) % n)["lat"] - F.get(ring, (i + 1) % n)["lon"] * p["lat"]
    return F.aggregate(F.transform(ring, term), F.lit(0.0), lambda a, x: a + x) / 2


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Web Mercator in the unit square, y down."""
    sine = F.least(F.greatest(F.sin(F.radians(lat)), F.lit(-0.9999)), F.lit(0.9999))
    return (lon + 180) / 360, F.lit(0.5) - F.log((1 + sine) / (1 - sine)) / (4 * math.pi)


def grid_cell(lon: Column, lat: Column, reference: Column | float, metres: float) -> tuple[Column, Column]:
    """Column and row of a metre grid at a reference latitude."""
    reference = F.lit(reference) if isinstance(reference, (int, float)) else reference
    return F.floor(F.radians(lon) * EARTH_RADIUS * F.cos(F.radians(reference)) / metres), F.floor(F.radians(lat) * EARTH_RADIUS / metres)


def boxes_meet(a: list[Column], b: list[Column]) -> Column:
    """Whether two boxes (west, south, east, north) have a place in common; null meets nothing."""
    return F.coalesce((a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1]), F.lit(False))


def rotated_corners(west: Column, south: Column, east: Column, north: Column, degrees: Column) -> Column:
    """Corners of an overlay's box turned about its centre, from the north-west clockwise."""
    cx, cy = (west + east) / 2, (south + north) / 2
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    turn = lambda x, y: F.struct((cx + (x - cx) * c - (y - cy) * s).alias("lon"), (cy + (x - cx) * s + (y - cy) * c).alias("lat"))
    return F.array(turn(west, north), turn(east, north), turn(east, south), turn(west, south))
