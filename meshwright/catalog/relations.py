"""Queries that generate relations: kinds of devices, explicit references, candidates, issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import score, text
from ..operators import devices as k
from ..operators import gridjoin as g
from ..operators import relations as r
from ..plans.staging import stage, unbroadcast
from . import maps, views
from .views import sql_with

_TEXT = "concat_ws(' ', asset_type, category, source_name)"


def _worded(rows: DataFrame) -> DataFrame:
    """``rows`` with the token texts that the tests read."""
    return rows.withColumn("t", text.token_text(F.expr(_TEXT))).withColumn("nm", text.token_text(F.col("source_name")))


def _kinds() -> list[str]:
    return [f"{v} as {n}" for n, v in k.kinds("regexp_like").items()]


def device_classes(spark: SparkSession, d: str) -> DataFrame:
    """What kind of device each asset is, its likely profile and its family's plain name."""
    rows = _worded(views.assets(spark, d, "asset_type", "category", "source_name", "object_role", "network_family"))
    return rows.selectExpr("object_id", *_kinds(), f"{k.profile('regexp_like')} as profile", f"{k.family('network_family')} as family")


def _explicit(assets: DataFrame) -> DataFrame:
    """Stated references of assets: parent and upstream, one row each; held: whether the version has the target."""
    own = assets.where("asset_id != ''")
    stated = own.selectExpr("dv", "asset_id", "site_id", "inline(array(named_struct('relation_type', 'parent', 'direction', 'target_to_source', 'target_id', parent_id), named_struct('relation_type', 'upstream', 'direction', 'source_to_target', 'target_id', upstream_id)))").where("target_id is not null")
    ends = own.groupBy("dv", F.col("asset_id").alias("target_id")).agg(F.min("site_id").alias("target_site"))
    return stated.join(unbroadcast(ends), ["dv", "target_id"], "left")


def explicit_references(spark: SparkSession, d: str) -> DataFrame:
    """Stated references by what becomes of them: usable, to itself, dangling, across sites."""
    verdict = "case when target_site is null then 'dangling' when target_id = asset_id then 'self' when target_site <> site_id then 'cross_site' else 'usable' end"
    own = views.assets(spark, d, "dv", "asset_id", "parent_id", "upstream_id", "site_id")
    return _explicit(own).groupBy("dv", "relation_type", F.expr(verdict).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def _parts(spark: SparkSession, d: str, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and paths of assets with what compatibility reads, staged."""
    own = own.drop("parent_id", "upstream_id")
    sited = views.of_features(views.points(spark, d), unbroadcast(own.where("object_role = 'device_node'")))
    nodes = _worded(sited).selectExpr("dv as scope", "geometry_id", "asset_id as target_id", "lon", "lat", "site_id", "network_family", "t", f"{k.domain('network_family', 't', 'regexp_like')} as node_domain", *_kinds())
    named = _worded(own.where("object_role = 'cable_path'"))
    paths = views.of_features(views.lines(spark, d), unbroadcast(named.selectExpr("dv", "feature_id", "site_id as path_site", "network_family as path_family", f"{k.domain('network_family', 't', 'regexp_like')} as path_domain")))
    return stage(nodes), stage(paths.selectExpr("dv as scope", "geometry_id as line_id", "line", "path_site", "path_family", "path_domain"))


#: Metres of a cell in which ends, devices, lines and poles meet: most are then put into few cells, and few more pairs meet.
_CELL = 4 * maps.SEARCH_METRES
_PATH = ["path_site", "path_family", "path_domain"]
_NODE = ["target_id", "site_id", "network_family", "node_domain", "t", "is_pole", "is_junction", "is_rack", "is_inline"]


def relation_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Proposals of all generators, decided, and the ends without one.

    Each distance join is staged before all are united: as one plan, the driver
    would plan and compile them together, again after each of their stages.
    No join broadcasts, as every table here grows with the input.
    """
    own = stage(views.assets(spark, d, "dv", "feature_id", "asset_id", "asset_type", "category", "network_family", "site_id", "source_name", "object_role", "parent_id", "upstream_id").drop("object_id", "received_at"))
    nodes, paths = map(unbroadcast, _parts(spark, d, own))
    ends = stage(g.line_ends(paths.select("scope", "line_id", "line")).join(paths.select("scope", "line_id", *_PATH), ["scope", "line_id"]).selectExpr("scope", "concat_ws(':', 'endpoint', line_id, role) as left_id", "lon", "lat", *_PATH))
    devices = nodes.selectExpr("scope", "geometry_id as right_id", "lon", "lat", *_NODE)
    fit = f"{k.fit('regexp_like')} as fit"
    near = stage(g.near_points(ends, devices, maps.SEARCH_METRES, _CELL).selectExpr("scope", "'cable_termination' as candidate_type", "left_id as endpoint_id", "target_id", "distance", fit, "'end' as role").where("fit > 0"))
    met = stage(g.points_on_lines(nodes.where("is_inline").selectExpr("scope", "geometry_id as point_id", "lon", "lat"), paths.select("scope", "line_id", "line"), maps.INLINE_METRES, _CELL).where(f"to_start > {maps.INLINE_MARGIN} and to_end > {maps.INLINE_MARGIN}").select("scope", "line_id", "point_id", "distance"))
    inline = met.join(paths.select("scope", "line_id", *_PATH), ["scope", "line_id"]).join(nodes.selectExpr("scope", "geometry_id as point_id", *_NODE), ["scope", "point_id"])
    inline = inline.selectExpr("scope", "'inline_device' as candidate_type", "concat_ws(':', 'endpoint', line_id, 'inline') as endpoint_id", "target_id", "distance", fit, "'inline' as role").where("fit > 0")
    mounted = g.near_points(nodes.where("not is_pole").selectExpr("scope", "geometry_id as left_id", "lon", "lat"), nodes.where("is_pole").selectExpr("scope", "geometry_id as right_id", "lon", "lat", "target_id"), maps.POLE_METRES, _CELL)
    mounted = stage(mounted.selectExpr("scope", "'mounting' as candidate_type", "concat('mount:', left_id) as endpoint_id", "target_id", "distance", "1.0D as fit", "'end' as role"))
    stated = _explicit(own).where("target_site = site_id and target_id <> asset_id").selectExpr("dv as scope", "'explicit_metadata' as candidate_type", "concat_ws(':', 'explicit', relation_type, asset_id) as endpoint_id", "target_id", "cast(null as double) as distance", "1.0D as fit", "'end' as role")
    proposals = stage(r.union([near, inline, mounted, stated]))
    found = r.decided(r.scored(proposals)).unionByName(r.unresolved(ends.selectExpr("scope", "left_id as endpoint_id"), unbroadcast(proposals)))
    return found.selectExpr("scope as dv", "candidate_type", "endpoint_id", "target_id", "round(distance, 5) as distance", "fit", "round(score, 5) as score", "place", "outcome")


def camera_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges that stay when each camera's edges of unknown length give way to its edges of known length."""
    cameras = views.assets(spark, d, "dv", "asset_id", "category").where("category = 'cctv_camera' and asset_id != ''").select("dv", "asset_id").distinct()
    flag = lambda c: cameras.selectExpr("dv as scope", f"asset_id as {c}", f"true as {c}_camera")
    edges = views.graph(spark, d, "dv", "length").selectExpr("dv as scope", "edge_id", "source_id as a", "target_id as b", "length").join(flag("a"), ["scope", "a"], "left").join(flag("b"), ["scope", "b"], "left")
    return r.without_weaker(edges, ["a", "b"], "coalesce({end}_camera, false)", "length is null", "length is not null").selectExpr("scope as dv", "edge_id")


def dataset_validation(spark: SparkSession, d: str) -> DataFrame:
    """Findings of each version: assets without id, name or geometry, repeated ids, invalid geometries, stated targets that are missing, links to itself."""
    own = stage(views.assets(spark, d, "dv", "asset_id", "feature_id", "source_name", "parent_id", "upstream_id", "object_role"))
    shapes = stage(views.geometries(spark, d, "dv", "feature_id", "valid"))
    code = lambda rows, c: rows.selectExpr("dv", f"'{c}' as code")
    drawn = shapes.where("feature_id != ''").select("dv", "feature_id").distinct()
    links = own.selectExpr("dv", "asset_id", "explode(array(parent_id, upstream_id)) as target_id").where("target_id is not null")
    held = own.where("asset_id != ''").selectExpr("dv", "asset_id as target_id").distinct()
    findings = [
        code(own.where("asset_id = ''"), "asset_id_missing"), code(own.where("source_name = ''"), "asset_name_missing"), code(own.where("object_role != 'visual_only'").join(drawn, ["dv", "feature_id"], "left_anti"), "asset_without_geometry"),
        code(own.where("asset_id != ''").groupBy("dv", "asset_id").count().where("count > 1"), "asset_id_repeated"), code(shapes.where("not coalesce(valid, false)"), "geometry_invalid"),
        code(links.join(held, ["dv", "target_id"], "left_anti"), "reference_dangling"), code(links.where("asset_id = target_id"), "reference_to_itself"),
    ]
    every = findings[0]
    for f in findings[1:]:
        every = every.unionByName(f)
    return every.groupBy("dv", "code").agg(F.count(F.lit(1)).alias("n"))


def introduced_issues(spark: SparkSession, d: str) -> DataFrame:
    """Missing references of the second store's edges that the first store's don't have: issues a change of stores would bring."""
    rows = views.read(spark, d, "graph_edges")
    ids = {c: views.id_sql(c) for c in ("dataset_version_id", "source_node_id", "target_node_id")}
    ends = rows.selectExpr(f"lower({views.trim_sql('store')}) as store", f"coalesce({ids['dataset_version_id']}, '') as dv", f"explode(array({ids['source_node_id']}, {ids['target_node_id']})) as asset_id").where("asset_id is not null").distinct()
    missing = stage(ends.join(views.assets(spark, d, "dv", "asset_id").select("dv", "asset_id").distinct(), ["dv", "asset_id"], "left_anti"))
    side = lambda s: missing.where(f"store = '{s}'").select("dv", "asset_id")
    return side("json").join(side("postgres"), ["dv", "asset_id"], "left_anti")


QUERIES = {f.__name__: f for f in (device_classes, explicit_references, relation_candidates, camera_edges, dataset_validation, introduced_issues)}

_LIKE = "regexp_matches"
#: Full-width letters, which compatibility forms resolve and DuckDB's ``strip_accents`` doesn't.
_WIDE, _PLAIN = "".join(chr(0xFF41 + i) for i in range(26)), "".join(chr(97 + i) for i in range(26))
_TYPED = f"translate(lower(coalesce(asset_type, '') || ' ' || coalesce(category, '') || ' ' || coalesce(source_name, '')), '{_WIDE}', '{_PLAIN}')"
_W = f"{maps._NORM.format(_TYPED)} as t, {maps._NORM.format('source_name')} as nm"


def _duck(sql: str) -> str:
    return sql.replace("0D", "0").replace("5D", "5").replace("9D", "9")


_KINDS = ", ".join(f"coalesce({v}, false) as {n}" for n, v in k.kinds(_LIKE).items())
_EXPLICIT = """own as (select * from assets where asset_id <> ''), st as (select dv, asset_id, site_id, 'parent' as relation_type, parent_id as target_id from own where parent_id is not null union all select dv, asset_id, site_id, 'upstream', upstream_id from own where upstream_id is not null),
  en as (select dv, asset_id as target_id, min(site_id) as target_site from own group by all), ex as (select st.*, target_site from st left join en using (dv, target_id))"""

SQL = {
    "device_classes": sql_with("assets") + f", w as (select *, {_W} from assets) select object_id, {_KINDS}, {k.profile(_LIKE)} as profile, {k.family('network_family')} as family from w",
    "explicit_references": sql_with("assets") + f", {_EXPLICIT} select dv, relation_type, case when target_site is null then 'dangling' when target_id = asset_id then 'self' when target_site <> site_id then 'cross_site' else 'usable' end as verdict, count(*) as n from ex group by all",
    "relation_candidates": sql_with("devices", "lines") + f""", {_EXPLICIT}, nw as (select *, {_W} from devices), nodes as (select dv, geometry_id, asset_id as target_id, lon, lat, site_id, network_family, t, {k.domain('network_family', 't', _LIKE)} as node_domain, {_KINDS} from nw),
  pw as (select *, {_W} from assets where object_role = 'cable_path' and feature_id <> ''), paths as (select l.dv, l.geometry_id as line_id, l.line, p.site_id as path_site, p.network_family as path_family, {k.domain('p.network_family', 'p.t', _LIKE)} as path_domain from lines l join pw p using (dv, feature_id)),
  ends as (select dv, 'endpoint:' || line_id || ':start' as endpoint_id, line[1][1] as x, line[1][2] as y, path_site, path_family, path_domain from paths union all select dv, 'endpoint:' || line_id || ':end', line[-1][1], line[-1][2], path_site, path_family, path_domain from paths),
  e0 as (select e.*, n.* exclude (dv), {maps._hav('e.x', 'e.y', 'n.lon', 'n.lat')} as distance from ends e join nodes n on n.dv = e.dv and abs(n.lat - e.y) < 0.0001),
  near as (select dv, 'cable_termination' as candidate_type, endpoint_id, target_id, distance, {_duck(k.fit(_LIKE))} as fit, 'end' as role from e0 where distance <= 6),
  sg as (select *, {maps._hav('x1', 'y1', 'x2', 'y2')} as length from (select * exclude (x2), x1 + (x2 - x1) - 360 * round((x2 - x1) / 360) as x2 from (select dv, line_id, path_site, path_family, path_domain, i - 1 as seg, line[i][1] as x1, line[i][2] as y1, line[i + 1][1] as x2, line[i + 1][2] as y2 from (select *, unnest(range(1, len(line))) as i from paths)))),
  ms as (select *, coalesce(sum(length) over (partition by dv, line_id order by seg rows between unbounded preceding and 1 preceding), 0) as measure, sum(length) over (partition by dv, line_id) as total from sg),
  q as (select ms.*, n.* exclude (dv), radians(n.lon - x1 - 360 * round((n.lon - x1) / 360)) * 6371008.8 * cos(radians(n.lat)) as px, radians(n.lat - y1) * 6371008.8 as py, radians(x2 - x1) * 6371008.8 * cos(radians(n.lat)) as qx, radians(y2 - y1) * 6371008.8 as qy from ms join nodes n on n.dv = ms.dv and n.is_inline and n.lat between least(y1, y2) - 0.0001 and greatest(y1, y2) + 0.0001),
  tt as (select *, case when qx * qx + qy * qy > 0 then least(greatest((px * qx + py * qy) / (qx * qx + qy * qy), 0), 1) else 0 end as tq from q), rr as (select *, sqrt(pow(px - tq * qx, 2) + pow(py - tq * qy, 2)) as distance, measure + tq * length as at_m from tt),
  bb as (select * from rr where distance <= 2 qualify row_number() over (partition by line_id, geometry_id order by distance, seg) = 1),
  inl as (select dv, 'inline_device' as candidate_type, 'endpoint:' || line_id || ':inline' as endpoint_id, target_id, distance, {_duck(k.fit(_LIKE))} as fit, 'inline' as role from bb where at_m > 5 and total - at_m > 5),
  mo as (select a.dv, 'mounting', 'mount:' || a.geometry_id, b.target_id, {maps._hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} as distance, 1.0, 'end' from nodes a join nodes b on a.dv = b.dv and not a.is_pole and b.is_pole and abs(a.lat - b.lat) < 0.0001),
  al as (select * from near where fit > 0 union all select * from inl where fit > 0 union all select * from mo where distance <= 5 union all select dv, 'explicit_metadata', 'explicit:' || relation_type || ':' || asset_id, target_id, null, 1.0, 'end' from ex where target_site = site_id and target_id <> asset_id),
  un as (select * from al qualify row_number() over (partition by dv, candidate_type, endpoint_id, target_id order by coalesce(distance, 0), fit desc) = 1),
  sc as (select *, round(0.30 * case when candidate_type = 'explicit_metadata' then 1.0 else exp(-(distance * distance) / 12.5) end + 0.25 * fit + case when candidate_type = 'explicit_metadata' then 0.15 else 0 end + 0.15 * 0.6 + 0.05 * case when role = 'inline' then 1.0 else 0.9 end + 0.025 + 0.05, 6) as score, case when role = 'inline' then 'inline:' || target_id else endpoint_id end as grp from un),
  pl as (select *, row_number() over w as place, max(score) over (partition by dv, grp) as top, count(*) over (partition by dv, grp) as n, score - coalesce(lead(score) over w, 0) as margin from sc window w as (partition by dv, grp order by score desc, endpoint_id, target_id, candidate_type)),
  ld as (select *, max(case when place = 1 then margin end) over (partition by dv, grp) as ahead from pl)
  select dv, candidate_type, endpoint_id, target_id, round(distance, 5) as distance, fit::double as fit, round(score, 5) as score, place::int as place, case when top < {score.ACCEPTANCE} then 'below_threshold' when n > 1 and ahead < {score.MARGIN} then 'ambiguous' when place = 1 then 'recommended' else 'not_selected' end as outcome from ld
  union all select distinct dv, 'unresolved_termination', endpoint_id, null, null, 0, 0, 1, 'unresolved' from ends where (dv, endpoint_id) not in (select dv, endpoint_id from un)""",
    "camera_edges": sql_with("assets", "graph") + """, c as (select distinct dv, asset_id from assets where category = 'cctv_camera' and asset_id <> ''), s as (select g.dv, c.asset_id from graph g join c on c.dv = g.dv and c.asset_id in (g.source_id, g.target_id) where g.length is not null)
      select dv, edge_id from graph g where not (length is null and exists (select 1 from s where s.dv = g.dv and s.asset_id in (g.source_id, g.target_id)))""",
    "dataset_validation": sql_with("assets", "geometries") + """, l as (select dv, asset_id, parent_id as target_id from assets where parent_id is not null union all select dv, asset_id, upstream_id from assets where upstream_id is not null), f as (
      select dv, 'asset_id_missing' as code from assets where asset_id = '' union all select dv, 'asset_name_missing' from assets where source_name = ''
      union all select dv, 'asset_without_geometry' from assets where object_role <> 'visual_only' and (dv, feature_id) not in (select dv, feature_id from geometries where feature_id <> '')
      union all select dv, 'asset_id_repeated' from (select dv, asset_id from assets where asset_id <> '' group by all having count(*) > 1) union all select dv, 'geometry_invalid' from geometries where not coalesce(valid, false)
      union all select dv, 'reference_dangling' from l where (dv, target_id) not in (select dv, asset_id from assets where asset_id <> '') union all select dv, 'reference_to_itself' from l where asset_id = target_id) select dv, code, count(*) as n from f group by all""",
    "introduced_issues": sql_with("assets") + f""", e as (select distinct lower(trim(store)) as store, {views._e('dataset_version_id')} as dv, unnest([{views._i('source_node_id')}, {views._i('target_node_id')}]) as asset_id from graph_edges), m as (select * from e where asset_id is not null and (dv, asset_id) not in (select dv, asset_id from assets))
      select dv, asset_id from m where store = 'json' and (dv, asset_id) not in (select dv, asset_id from m where store = 'postgres')""",
}
