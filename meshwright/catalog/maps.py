"""Queries over names and shapes: text functions, geometry, distance joins, linework."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, score, text
from ..operators import gridjoin as g
from ..operators import labels
from ..plans.staging import stage
from ..sources import kml
from . import views
from .views import sql_with

_NORM = "trim(regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', ' ', 'g'))"
_HAV = "2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians({d} - {b}) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians({c} - {a}) / 2), 2))))"


def _hav(a: str, b: str, c: str, d: str) -> str:
    return _HAV.format(a=a, b=b, c=c, d=d)


def text_tokens(spark: SparkSession, d: str) -> DataFrame:
    tokens = text.token_text(F.col("source_name"))
    return views.assets(spark, d, "source_name").select("object_id", tokens.alias("token_text"), text.snake_case(F.col("source_name")).alias("snake"), F.array_join(text.label_tokens(tokens), " ").alias("label"), text.first_number(F.col("source_name")).alias("number"))


def text_label_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Every name by which a line may call a device."""
    rows = views.assets(spark, d, "source_name").select("object_id", text.token_text(F.col("source_name")).alias("t"))
    words = text.label_tokens(F.col("t"))
    return rows.select("object_id", F.explode(text.label_aliases(words, F.col("t"))).alias("a")).select("object_id", F.array_join("a", " ").alias("alias"))


def text_locations(spark: SparkSession, d: str) -> DataFrame:
    """Location functions on folder paths of assets (``RJBT/site/family/name``)."""
    path = F.concat_ws("/", F.lit("RJBT"), "site_id", "network_family", "source_name")
    rows = views.assets(spark, d).select("object_id", text.folder_segments(path).alias("s"))
    s = F.col("s")
    return rows.select("object_id", text.location_key(s).alias("location_key"), text.facility_scope(s).alias("facility"), text.mounting_scope(s).alias("mounting_scope"), text.location_group(s).alias("location_group"))


def text_shared_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Words that the name of an asset shares with its parent's."""
    rows = views.assets(spark, d, "dv", "asset_id", "parent_id", "source_name").select("dv", "asset_id", "parent_id", text.token_text(F.col("source_name")).alias("t"))
    parents = rows.select("dv", F.col("asset_id").alias("parent_id"), F.col("t").alias("u"))
    return rows.join(parents, ["dv", "parent_id"]).select("dv", "asset_id", text.shared_tokens(F.col("u"), F.col("t")).alias("n_shared"))


def geo_positions(spark: SparkSession, d: str) -> DataFrame:
    rows = views.points(spark, d)
    x, y = geo.mercator(F.col("lon"), F.col("lat"))
    col, row = geo.grid_cell(F.col("lon"), F.col("lat"), -11.0, 25.0)
    return rows.select("geometry_id", geo.coordinate_key(F.col("lon"), F.col("lat")).alias("place"), F.floor(x * (1 << 24)).alias("pixel_x"), F.floor(y * (1 << 24)).alias("pixel_y"), col.alias("grid_col"), row.alias("grid_row"))


def geo_validity(spark: SparkSession, d: str) -> DataFrame:
    """Why points have no place: counts by stored flag and check."""
    place = F.when(geo.has_coordinates("coordinates"), geo.point_from_json("coordinates")).otherwise(geo.point_from_wkt("geometry"))
    rows = views.geometries(spark, d).filter("kind = 'point'").select("valid", place.alias("p"))
    ok = F.coalesce(geo.position_valid(F.col("p.lon"), F.col("p.lat")), F.lit(False))
    return rows.groupBy("valid", ok.alias("in_bounds")).agg(F.count(F.lit(1)).alias("n"))


def geo_polygon_areas(spark: SparkSession, d: str) -> DataFrame:
    """Area of the outer ring (square degrees times 1e9), corners and holes of each region."""
    rings = F.when(geo.has_coordinates("coordinates"), geo.rings_from_json("coordinates")).otherwise(geo.rings_from_wkt("geometry"))
    rows = views.geometries(spark, d).filter("valid and kind = 'polygon'").select("geometry_id", rings.alias("r")).filter("size(r) > 0")
    outer = F.element_at("r", 1)
    closed = F.element_at(outer, 1) == F.element_at(outer, -1)
    return rows.select("geometry_id", F.round(F.abs(geo.ring_area(outer)) * 1e9, 3).alias("area"), F.size(F.array_distinct(outer)).alias("n_corners"), (F.size("r") - 1).alias("n_holes"), closed.alias("closed"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return views.lines(spark, d).selectExpr("dv as scope", "geometry_id as line_id", "line")


def _devices(spark: SparkSession, d: str) -> DataFrame:
    return views.devices(spark, d)


def line_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Segments of each line with their length and the measure at which they begin."""
    return g.segments(_lines(spark, d)).select("line_id", "seg", F.round("length", 6).alias("length"), F.round("measure", 6).alias("measure"))


def line_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return g.duplicate_lines(_lines(spark, d)).select("line_id", "first_line", "n_lines")


def line_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return g.overlaps(_lines(spark, d)).select("first_line", "second_line")


def line_crossings(spark: SparkSession, d: str) -> DataFrame:
    return g.crossings(_lines(spark, d), digits=6).groupBy("first_line", "second_line").agg(F.count(F.lit(1)).alias("n_places"))


SEARCH_METRES, INLINE_METRES, INLINE_MARGIN, JUNCTION_METRES, POLE_METRES = 6.0, 2.0, 5.0, 30.0, 5.0


def _ends(spark: SparkSession, d: str) -> DataFrame:
    return g.line_ends(_lines(spark, d)).selectExpr("*", "concat_ws(':', 'endpoint', line_id, role) as left_id")


def _end_pairs(spark: SparkSession, d: str, ends: DataFrame | None = None) -> DataFrame:
    ends = (_ends(spark, d) if ends is None else ends).select("scope", "left_id", "lon", "lat")
    devices = _devices(spark, d).where("asset_type != 'pole'").selectExpr("dv as scope", "geometry_id as right_id", "lon", "lat")
    return g.near_points(ends, devices, SEARCH_METRES)


def endpoint_devices(spark: SparkSession, d: str) -> DataFrame:
    """Devices within reach of the ends of lines, with the part of the score that distance gives."""
    return _end_pairs(spark, d).select(F.col("left_id").alias("endpoint_id"), F.col("right_id").alias("geometry_id"), F.round("distance", 6).alias("distance"), F.round(score.gaussian(F.col("distance")), 6).alias("distance_score"))


def endpoint_unresolved(spark: SparkSession, d: str) -> DataFrame:
    """Ends of lines without a device in reach."""
    ends = stage(_ends(spark, d).select("scope", "left_id", "lon", "lat"))
    return ends.join(_end_pairs(spark, d, ends).select("scope", "left_id").distinct(), ["scope", "left_id"], "left_anti").selectExpr("scope as dv", "left_id as endpoint_id")


def endpoint_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The nearest device of each end; two within 0.75 m of each other are ambiguous."""
    first = g.nearest(_end_pairs(spark, d))
    return first.select(F.col("left_id").alias("endpoint_id"), F.col("right_id").alias("geometry_id"), F.round("distance", 6).alias("distance"), F.coalesce(F.col("second") - F.col("distance") < 0.75, F.lit(False)).alias("ambiguous"))


def inline_devices(spark: SparkSession, d: str) -> DataFrame:
    """Devices on a line away from its ends."""
    devices = _devices(spark, d).where("asset_type != 'pole'").selectExpr("dv as scope", "geometry_id as point_id", "lon", "lat")
    met = g.points_on_lines(devices, _lines(spark, d), INLINE_METRES).where(f"to_start > {INLINE_MARGIN} and to_end > {INLINE_MARGIN}")
    return met.selectExpr("line_id", "point_id as geometry_id", "round(distance, 5) as distance", "round(measure, 3) as measure")


def continuations(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of ends as ``end_pairs`` gives them, no device being near either."""
    ends = stage(_ends(spark, d))
    taken = _end_pairs(spark, d, ends).select("scope", "left_id").distinct()
    return g.end_pairs(stage(ends.join(taken, ["scope", "left_id"], "left_anti")), SEARCH_METRES, 30.0)


def endpoint_continuations(spark: SparkSession, d: str) -> DataFrame:
    """Ends of two lines that run on into each other, no device being near either."""
    return continuations(spark, d).select("first_end", "second_end", F.round("distance", 5).alias("distance"), F.round("deviation", 4).alias("deviation"))


def nearest_junction(spark: SparkSession, d: str) -> DataFrame:
    """The nearest junction box of each camera within 30 m, and whether it is clearly the nearest."""
    devices = _devices(spark, d)
    cameras = devices.filter("asset_type like 'cctv%'").select(F.col("dv").alias("scope"), F.col("geometry_id").alias("left_id"), "lon", "lat")
    boxes = devices.filter("asset_type = 'junction_box'").select(F.col("dv").alias("scope"), F.col("geometry_id").alias("right_id"), "lon", "lat")
    found = g.unique_nearest(g.near_points(cameras, boxes, JUNCTION_METRES), 5.0, 1.25)
    return found.select(F.col("left_id").alias("camera_id"), F.col("right_id").alias("box_id"), F.round("distance", 5).alias("distance"), "is_unique")


def pole_mounting(spark: SparkSession, d: str) -> DataFrame:
    """The pole on which a device is mounted: same number in the name within 10 m, else the nearest within 5 m unless another is as near."""
    devices = _devices(spark, d)
    number = text.first_number(F.col("source_name"))
    own = devices.filter("asset_type != 'pole'").select(F.col("dv").alias("scope"), F.col("geometry_id").alias("left_id"), "lon", "lat", number.alias("number"))
    poles = devices.filter("asset_type = 'pole'").select(F.col("dv").alias("scope"), F.col("geometry_id").alias("right_id"), "lon", "lat", number.alias("pole_number"))
    pairs = g.near_points(own, poles, 2 * POLE_METRES)
    near = F.col("distance") <= POLE_METRES
    same = F.coalesce(F.col("number") == F.col("pole_number"), F.lit(False))
    told = pairs.groupBy("scope", "left_id").agg(
        F.sum(same.cast("int")).alias("n_same"), F.min(F.when(same, F.struct("distance", "right_id"))).alias("same"), F.sum(near.cast("int")).alias("n_near"),
        F.array_sort(F.collect_list(F.when(near, F.struct("distance", "right_id")))).alias("near"),
    )
    by_number = (F.col("n_same") == 1) & ((F.col("same.distance") <= POLE_METRES) | (F.col("n_near") == 0))
    first, second = F.get("near", F.lit(0)), F.get("near", F.lit(1))
    clear = second.isNull() | ((second["distance"] - first["distance"] > 0.35) & (second["distance"] > 1.5 * first["distance"]))
    choice = F.when(by_number, F.col("same")).when((F.col("n_near") > 0) & clear, first)
    rule = F.when(by_number, "number").when((F.col("n_near") > 0) & clear, "nearest").when(F.col("n_near") > 0, "ambiguous")
    return told.select(F.col("left_id").alias("geometry_id"), choice["right_id"].alias("pole_id"), rule.alias("rule")).filter("rule is not null")


def distance_strata(spark: SparkSession, d: str) -> DataFrame:
    rows = views.candidates(spark, d)
    return rows.groupBy(score.stratum(F.col("distance")).alias("stratum"), "candidate_type").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("candidate_status") == "confirmed").cast("long")).alias("n_confirmed"))


def candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores from parts: distance, explicit evidence, context and end of line."""
    rows = views.candidates(spark, d)
    explicit = F.col("candidate_type").isin("explicit_metadata", "line_label_connection")
    wanted = F.nullif(F.regexp_extract("endpoint_id", "(start|end|inline)$", 1), F.lit(""))
    total = score.weighted(
        distance=F.when(explicit, 1.0).otherwise(score.gaussian(F.col("distance"))), interface=F.lit(1.0), explicit=F.when(F.col("candidate_type") == "explicit_metadata", 1.0).otherwise(0.0),
        context=score.context(F.col("site_id") != "", F.lit(False), F.lit(0)), endpoint=score.endpoint_role(wanted, F.when(F.col("candidate_type") == "inline_device", "inline").otherwise(wanted)), style=F.lit(0.5), capacity=F.lit(1.0),
    )
    return rows.select("candidate_id", total.alias("total"))


QUERIES = {f.__name__: f for f in (
    text_tokens, text_label_aliases, text_locations, text_shared_tokens, geo_positions, geo_validity, geo_polygon_areas, line_lengths, line_duplicates, line_overlaps, line_crossings,
    endpoint_devices, endpoint_unresolved, endpoint_nearest, inline_devices, endpoint_continuations, nearest_junction, pole_mounting, distance_strata, candidate_scores,
)}

_WORDS = "list_transform(list_filter(string_split(t, ' '), lambda w: w <> ''), lambda w: case when regexp_full_match(w, '[0-9]+') then regexp_replace(w, '^0+([0-9])', '\\1') else w end)"
_SEGS = "segs as (select dv, line_id, seg, x1, y1, x1 + (x2 - x1) - 360 * round((x2 - x1) / 360) as x2, y2 from (select dv, geometry_id as line_id, i - 1 as seg, line[i][1] as x1, line[i][2] as y1, line[i + 1][1] as x2, line[i + 1][2] as y2 from (select *, unnest(range(1, len(line))) as i from lines)))"
_BOTH = "both_ as (select a.line_id as first_line, b.line_id as second_line, a.x1 as ax1, a.y1 as ay1, a.x2 as ax2, a.y2 as ay2, b.x1 - 360 * round((b.x1 - a.x1) / 360) as bx1, b.y1 as by1, b.x2 - 360 * round((b.x1 - a.x1) / 360) as bx2, b.y2 as by2 from segs a join segs b on a.dv = b.dv and a.line_id < b.line_id and least(a.y1, a.y2) <= greatest(b.y1, b.y2) + 1e-9 and greatest(a.y1, a.y2) >= least(b.y1, b.y2) - 1e-9)"
_ENDS = """ends as (select dv, 'endpoint:' || geometry_id || ':start' as endpoint_id, geometry_id as line_id, line[1][1] as lon, line[1][2] as lat, line[2][1] as lon2, line[2][2] as lat2 from lines
  union all select dv, 'endpoint:' || geometry_id || ':end', geometry_id, line[-1][1], line[-1][2], line[-2][1], line[-2][2] from lines)"""
_REACH = f"reach as (select e.endpoint_id, x.geometry_id, {_hav('e.lon', 'e.lat', 'x.lon', 'x.lat')} as distance from ends e join devices x on x.dv = e.dv and x.asset_type <> 'pole' and abs(x.lat - e.lat) < 0.0001 where {_hav('e.lon', 'e.lat', 'x.lon', 'x.lat')} <= 6)"

SQL = {
    "text_tokens": sql_with("assets") + f", n as (select object_id, source_name, {_NORM.format('source_name')} as t from assets) select object_id, t as token_text, lower(trim(regexp_replace(regexp_replace(source_name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '_')) as snake, array_to_string({_WORDS}, ' ') as label, try_cast(nullif(regexp_extract(source_name, '[0-9]+'), '') as bigint) as number from n",
    "text_label_aliases": sql_with("assets") + f""", n as (select object_id, {_NORM.format('source_name')} as t from assets), w as (select object_id, t, {_WORDS} as w from n),
      b as (select *, case when len(w) > 2 and list_contains(['exp', 'extended', 'wp', 'rekomendasi', 'recommendation'], w[-1]) then w[1:-2] else w end as b from w),
      a as (select object_id, unnest([w, b, case when b[1] = 'jb' and len(b) > 1 then b[2:] end, case when b[1] = 'jb' and b[2] = 'cctv' and len(b) > 2 then ['jb'] || b[3:] end,
        case when b[1] in ('cam', 'camera', 'kamera') and len(b) > 1 then ['c'] || b[2:] end, case when b[1] = 'server' then ['svr'] end,
        case when regexp_matches(t, '(^|\\s)(jb\\s+)?(rack\\s+server|server\\s+rack)(\\s|$)') then ['rs'] end, case when regexp_matches(t, '(^|\\s)(jb\\s+)?(rack\\s+server|server\\s+rack)(\\s|$)') then ['cr'] end,
        case when regexp_matches(t, '(^|\\s)(jb\\s+)?(rack\\s+server|server\\s+rack)(\\s|$)') then ['svr', 'office'] end]) as alias from b where len(w) > 0)
      select distinct object_id, array_to_string(alias, ' ') as alias from a where alias is not null""",
    "text_locations": sql_with("assets") + """, s as (select object_id, list_filter(list_transform(string_split('RJBT/' || site_id || '/' || network_family || '/' || source_name, '/'), lambda p: trim(regexp_replace(lower(p), '[^a-z0-9]+', ' ', 'g'))), lambda p: p <> '') as s from assets),
      m as (select *, list_position(list_transform(s, lambda p: regexp_matches(p, 'cable|kabel|cctv|camera|junction box|juction box|jucntion box|tiang|server|switch|router')), true) as k from s)
      select object_id, array_to_string(s[1:case when coalesce(k, 0) > 1 then k - 1 else 2 end], '/') as location_key, s[2] as facility, s[2] as mounting_scope, replace(s[2], ' ', '-') as location_group from m""",
    "text_shared_tokens": sql_with("assets") + f", n as (select dv, asset_id, parent_id, {_NORM.format('source_name')} as t from assets) select a.dv, a.asset_id, len(list_filter(string_split(a.t, ' '), lambda w: len(w) > 2 and list_contains(string_split(p.t, ' '), w)))::int as n_shared from n a join n p on p.dv = a.dv and p.asset_id = a.parent_id",
    "geo_positions": sql_with("points") + ", m as (select *, least(greatest(sin(radians(lat)), -0.9999), 0.9999) as s from points) select geometry_id, printf('%.9f,%.9f', lon, lat) as place, floor((lon + 180) / 360 * 16777216)::bigint as pixel_x, floor((0.5 - ln((1 + s) / (1 - s)) / (4 * pi())) * 16777216)::bigint as pixel_y, floor(radians(lon) * 6371008.8 * cos(radians(-11.0)) / 25.0)::bigint as grid_col, floor(radians(lat) * 6371008.8 / 25.0)::bigint as grid_row from m",
    "geo_validity": sql_with("placed") + r""", p as (select valid, try_cast(string_split(regexp_replace(js, '[\[\]]', '', 'g'), ',')[1] as double) as lon, try_cast(string_split(regexp_replace(js, '[\[\]]', '', 'g'), ',')[2] as double) as lat from placed where kind = 'point') select valid, coalesce(lon between -180 and 180 and lat between -90 and 90, false) as in_bounds, count(*) as n from p group by all""",
    "geo_polygon_areas": sql_with("placed") + r""", r as (select geometry_id, list_transform(string_split(regexp_replace(regexp_replace(js, '^\[\[\[', ''), '\]\]\]$', ''), ']],[['), lambda x: list_transform(string_split(x, '],['), lambda p: [string_split(p, ',')[1]::double, string_split(p, ',')[2]::double])) as r from placed where kind = 'polygon' and valid and js like '[[[%')
      select geometry_id, round(abs(list_sum(list_transform(range(1, len(r[1]) + 1), lambda i: r[1][i][1] * r[1][i % len(r[1]) + 1][2] - r[1][i % len(r[1]) + 1][1] * r[1][i][2])) / 2) * 1e9, 3) as area, len(list_distinct(r[1]))::int as n_corners, (len(r) - 1)::int as n_holes, r[1][1] = r[1][-1] as closed from r""",
    "line_lengths": sql_with("lines") + f", {_SEGS}, l as (select *, {_hav('x1', 'y1', 'x2', 'y2')} as length from segs) select line_id, seg::int as seg, round(length, 6) as length, round(coalesce(sum(length) over (partition by dv, line_id order by seg rows between unbounded preceding and 1 preceding), 0), 6) as measure from l",
    "line_duplicates": sql_with("lines") + ", k as (select dv, geometry_id, array_to_string(list_transform(line, lambda p: printf('%.10f,%.10f', p[1], p[2])), '|') as f, array_to_string(list_reverse(list_transform(line, lambda p: printf('%.10f,%.10f', p[1], p[2]))), '|') as b from lines) select geometry_id as line_id, min(geometry_id) over w as first_line, count(*) over w as n_lines from k window w as (partition by dv, least(f, b)) qualify n_lines > 1",
    "line_crossings": sql_with("lines") + f""", {_SEGS}, {_BOTH}, x as (select *, ((bx1 - ax1) * (by2 - by1) - (by1 - ay1) * (bx2 - bx1)) / det as t, ((bx1 - ax1) * (ay2 - ay1) - (by1 - ay1) * (ax2 - ax1)) / det as u from (select *, (ax2 - ax1) * (by2 - by1) - (ay2 - ay1) * (bx2 - bx1) as det from both_) where abs(det) > 1e-18)
      select first_line, second_line, count(distinct (round(ax1 + t * (ax2 - ax1), 6), round(ay1 + t * (ay2 - ay1), 6))) as n_places from x where t between -1e-10 and 1 + 1e-10 and u between -1e-10 and 1 + 1e-10 group by all""",
    "line_overlaps": sql_with("lines") + f""", {_SEGS}, {_BOTH} select distinct first_line, second_line from both_ where abs((ax2 - ax1) * (by1 - ay1) - (ay2 - ay1) * (bx1 - ax1)) <= 1e-10 and abs((ax2 - ax1) * (by2 - ay1) - (ay2 - ay1) * (bx2 - ax1)) <= 1e-10
      and case when abs(ax2 - ax1) >= abs(ay2 - ay1) then least(greatest(ax1, ax2), greatest(bx1, bx2)) - greatest(least(ax1, ax2), least(bx1, bx2)) > 1e-10 else least(greatest(ay1, ay2), greatest(by1, by2)) - greatest(least(ay1, ay2), least(by1, by2)) > 1e-10 end""",
    "endpoint_devices": sql_with("devices", "lines") + f", {_ENDS}, {_REACH} select endpoint_id, geometry_id, round(distance, 6) as distance, round(exp(-(distance * distance) / 12.5), 6) as distance_score from reach",
    "endpoint_unresolved": sql_with("devices", "lines") + f", {_ENDS}, {_REACH} select dv, endpoint_id from ends where endpoint_id not in (select endpoint_id from reach)",
    "endpoint_nearest": sql_with("devices", "lines") + f", {_ENDS}, {_REACH} select endpoint_id, geometry_id, round(distance, 6) as distance, coalesce(lead(distance) over w - distance < 0.75, false) as ambiguous from reach window w as (partition by endpoint_id order by distance, geometry_id) qualify row_number() over w = 1",
    "inline_devices": sql_with("devices", "lines") + f""", {_SEGS}, l as (select *, {_hav('x1', 'y1', 'x2', 'y2')} as length from segs), m as (select *, coalesce(sum(length) over (partition by dv, line_id order by seg rows between unbounded preceding and 1 preceding), 0) as measure, sum(length) over (partition by dv, line_id) as total from l),
      q as (select m.*, x.geometry_id, radians(x.lon - x1 - 360 * round((x.lon - x1) / 360)) * 6371008.8 * cos(radians(x.lat)) as px, radians(x.lat - y1) * 6371008.8 as py, radians(x2 - x1) * 6371008.8 * cos(radians(x.lat)) as qx, radians(y2 - y1) * 6371008.8 as qy from m join devices x on x.dv = m.dv and x.asset_type <> 'pole' and x.lat between least(y1, y2) - 0.0001 and greatest(y1, y2) + 0.0001),
      t as (select *, case when qx * qx + qy * qy > 0 then least(greatest((px * qx + py * qy) / (qx * qx + qy * qy), 0), 1) else 0 end as t from q), r as (select *, sqrt(pow(px - t * qx, 2) + pow(py - t * qy, 2)) as distance, measure + t * length as at_m from t),
      b as (select * from r where distance <= 2 qualify row_number() over (partition by line_id, geometry_id order by distance, seg) = 1)
      select line_id, geometry_id, round(distance, 5) as distance, round(at_m, 3) as measure from b where at_m > 5 and total - at_m > 5""",
    "endpoint_continuations": sql_with("devices", "lines") + f""", {_ENDS}, {_REACH}, f as (select *, line_id || ':' || string_split(endpoint_id, ':')[-1] as end_id, radians(lon2 - lon - 360 * round((lon2 - lon) / 360)) * cos(radians(lat)) as ux, radians(lat2 - lat) as uy from ends where endpoint_id not in (select endpoint_id from reach)),
      p as (select a.end_id as first_end, b.end_id as second_end, {_hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} as distance, a.ux * b.ux + a.uy * b.uy as dot, sqrt((a.ux * a.ux + a.uy * a.uy) * (b.ux * b.ux + b.uy * b.uy)) as norm from f a join f b on a.dv = b.dv and a.line_id <> b.line_id and a.end_id < b.end_id and abs(a.lat - b.lat) < 0.0001)
      select first_end, second_end, round(distance, 5) as distance, round(180 - degrees(acos(greatest(least(dot / norm, 1), -1))), 4) as deviation from p where distance <= 6 and norm > 0 and 180 - degrees(acos(greatest(least(dot / norm, 1), -1))) <= 30""",
    "nearest_junction": sql_with("devices") + f""", p as (select c.geometry_id as camera_id, b.geometry_id as box_id, {_hav('c.lon', 'c.lat', 'b.lon', 'b.lat')} as distance from devices c join devices b on b.dv = c.dv and b.asset_type = 'junction_box' and abs(b.lat - c.lat) < 0.0004 where c.asset_type like 'cctv%'),
      n as (select *, lead(distance) over w as second, row_number() over w as n from p where distance <= 30 window w as (partition by camera_id order by distance, box_id))
      select camera_id, box_id, round(distance, 5) as distance, coalesce(second is null or second - distance >= 5 or (distance > 0 and second / distance >= 1.25), true) as is_unique from n where n = 1""",
    "pole_mounting": sql_with("devices") + f""", m as (select *, try_cast(nullif(regexp_extract(source_name, '[0-9]+'), '') as bigint) as number from devices), p as (select o.geometry_id, b.geometry_id as pole_id, coalesce(o.number = b.number, false) as same, {_hav('o.lon', 'o.lat', 'b.lon', 'b.lat')} as distance from m o join m b on b.dv = o.dv and b.asset_type = 'pole' and abs(b.lat - o.lat) < 0.0002 where o.asset_type <> 'pole'),
      r as (select geometry_id, count(*) filter (same) as n_same, min((distance, pole_id)) filter (same) as s, count(*) filter (distance <= 5) as n_near, list_sort(list((distance, pole_id)) filter (distance <= 5)) as near from p where distance <= 10 group by 1),
      q as (select *, n_same = 1 and (s[1] <= 5 or n_near = 0) as by_number, n_near > 0 and (n_near = 1 or (near[2][1] - near[1][1] > 0.35 and near[2][1] > 1.5 * near[1][1])) as clear from r)
      select geometry_id, case when by_number then s[2] when clear then near[1][2] end as pole_id, case when by_number then 'number' when clear then 'nearest' when n_near > 0 then 'ambiguous' end as rule from q where by_number or n_near > 0""",
    "distance_strata": sql_with("candidates") + " select case when distance <= 2 then '0-2' when distance <= 4 then '2-4' when distance <= 6 then '4-6' else 'none' end as stratum, candidate_type, count(*) as n, count(*) filter (candidate_status = 'confirmed') as n_confirmed from candidates group by all",
    "candidate_scores": sql_with("candidates") + """, r as (select *, nullif(regexp_extract(coalesce(endpoint_id, ''), '(start|end|inline)$', 1), '') as wanted from candidates), f as (select *, case when candidate_type = 'inline_device' then 'inline' else wanted end as found from r)
      select candidate_id, round(0.30 * coalesce(case when candidate_type in ('explicit_metadata', 'line_label_connection') then 1.0 else least(greatest(exp(-(distance * distance) / 12.5), 0), 1) end, 0) + 0.25 + 0.15 * case when candidate_type = 'explicit_metadata' then 1.0 else 0.0 end + 0.15 * case when site_id <> '' then 0.6 else 0.3 end
        + 0.05 * case when coalesce(wanted = 'inline', false) or coalesce(found = 'inline', false) then case when wanted is not distinct from found then 1.0 else 0.0 end when wanted is null then 0.9 when wanted = found then 1.0 else 0.5 end + 0.025 + 0.05, 6) as total from f""",
}


def label_matches(spark: SparkSession, d: str) -> DataFrame:
    """Devices of which the names of lines speak, also by the last two words of their names."""
    own = views.assets(spark, d).select(F.col("dv").alias("scope"), "object_id", "object_role", F.col("source_name").alias("name"))
    lines = own.filter("object_role = 'cable_path'").select("scope", F.col("object_id").alias("line_id"), "name")
    devices = own.filter("object_role = 'device_node'").select("scope", F.col("object_id").alias("device_id"), "name")
    return labels.match_labels(lines, devices, 2).select("line_id", "device_id", "label")


def kml_placemarks(spark: SparkSession, d: str) -> DataFrame:
    """Placemark elements of points and lines."""
    points = views.points(spark, d).select("geometry_id", F.lit("Point").alias("kind"), F.array(F.struct("lon", "lat")).alias("line"))
    lines = views.lines(spark, d).select("geometry_id", F.lit("LineString").alias("kind"), "line")
    return points.unionByName(lines).select("geometry_id", kml.placemark(F.col("geometry_id"), F.col("kind"), F.transform("line", lambda p: F.struct(p["lon"].cast("decimal(12,9)").alias("lon"), p["lat"].cast("decimal(12,9)").alias("lat")))).alias("xml"))


QUERIES |= {"label_matches": label_matches, "kml_placemarks": kml_placemarks}
SQL |= {
    "label_matches": sql_with("assets") + f""", w as (select dv, object_id, object_role, {_WORDS} as w from (select *, {_NORM.format('source_name')} as t from assets)), d as (select dv, object_id, unnest(list_distinct(list_filter([array_to_string(w, ' '), case when len(w) > 2 then array_to_string(w[-2:], ' ') end, case when w[1] = 'server' then 'svr' end] || case when array_to_string(w, ' ') like '%server rack%' or array_to_string(w, ' ') like '%rack server%' then ['rs', 'cr', 'svr office'] else [] end, lambda x: x is not null and x <> ''))) as run from w where object_role = 'device_node'),
      k as (select dv, run, min(object_id) as device_id from d group by all having min(object_id) = max(object_id)), p as (select dv, object_id as line_id, w, unnest(range(1, len(w) + 1)) as i from w where object_role = 'cable_path'),
      r as (select dv, line_id, i, n, array_to_string(w[i:i + n - 1], ' ') as run from (select *, unnest(range(1, least(6, len(w) - i + 1) + 1)) as n from p)), f as (select * from r join k using (dv, run)),
      o as (select * from f where not exists (select 1 from f g where g.dv = f.dv and g.line_id = f.line_id and g.i <= f.i and g.i + g.n >= f.i + f.n and g.n > f.n)) select line_id, device_id, run as label from o qualify row_number() over (partition by dv, line_id, device_id order by i, n desc) = 1""",
    "kml_placemarks": sql_with("points", "lines") + """, g as (select geometry_id, 'Point' as kind, [[lon, lat]] as line from points union all select geometry_id, 'LineString', line from lines) select geometry_id, '<Placemark><name>' || geometry_id || '</name><' || kind || '><coordinates>' || array_to_string(list_transform(line, lambda p: p[1]::decimal(12, 9)::varchar || ',' || p[2]::decimal(12, 9)::varchar), ' ') || '</coordinates></' || kind || '></Placemark>' as xml from g""",
}
