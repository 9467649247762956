"""Queries p1 to p5: the general data problems on the network tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.ids import id_or_empty, norm_id, trimmed
from ..operators import copies, hierarchy, orphans, snapshots, spatial
from ..plans.records import first_deliveries, month_of
from ..plans.staging import stage
from .tables import read


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _key(kind: str, scope, value):
    return F.concat_ws(orphans.SEP, F.lit(kind), scope, value)


def _references(spark: SparkSession, d: str) -> DataFrame:
    """Each reference with a value: table, field, version, record, month, key and time."""
    endpoint = norm_id("source_endpoint_id")
    geometry = norm_id(F.regexp_extract(endpoint, r"^endpoint\s*:(.*?)(?::\s*(?:start|end|inline))?$", 1))
    parts = {
        ("topology_interfaces", "interface_id"): {"component_id": ("component", norm_id("component_id")), "owner_asset_id": ("asset", norm_id("owner_asset_id"))},
        ("topology_candidates", "candidate_id"): {
            "source_endpoint_id": ("geometry", F.when(~endpoint.startswith("explicit"), F.coalesce(geometry, endpoint))),
            "target_asset_id": ("asset", norm_id("target_asset_id")),
        },
    }
    frames = []
    for (table, record), fields in parts.items():
        rows = read(spark, d, table).select(
            norm_id(record).alias("record_id"), id_or_empty("dataset_version_id").alias("dataset_version_id"), "created_at", "received_at", *[v.alias(f) for f, (_, v) in fields.items()]
        )
        rows = first_deliveries(rows, ["record_id"], "received_at")
        each = F.array(*[F.struct(F.lit(f).alias("field_name"), F.when(F.col(f).isNotNull(), _key(kind, F.col("dataset_version_id"), F.col(f))).alias("ref_key")) for f, (kind, _) in fields.items()])
        frames.append(
            rows.select(
                F.lit(table).alias("table_name"), "dataset_version_id", F.coalesce("record_id", F.lit("")).alias("record_id"), month_of("created_at").alias("period_month"), F.col("received_at").alias("ref_at"), F.inline(each)
            ).filter("ref_key is not null")
        )
    return _union(frames)


def _parents(spark: SparkSession, d: str) -> DataFrame:
    frames = []
    for table, kind, key in (("topology_components", "component", "component_id"), ("classified_objects", "asset", "asset_id"), ("source_geometries", "geometry", "source_geometry_id")):
        rows = read(spark, d, table)
        if table != "source_geometries":
            rows = rows.filter(F.coalesce(F.lower(trimmed("status")), F.lit("")) != "removed")
        frames.append(rows.filter(norm_id(key).isNotNull()).select(_key(kind, id_or_empty("dataset_version_id"), norm_id(key)).alias("key"), F.col("received_at").alias("available_at")))
    return _union(frames)


P1_COLUMNS = ["table_name", "field_name", "dataset_version_id", "record_id", "period_month"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.find_orphans(_references(spark, d), _parents(spark, d)).select(*P1_COLUMNS)


def p1_monthly(spark: SparkSession, d: str) -> DataFrame:
    """References and orphans per table, field and month."""
    references = _references(spark, d)
    by = ["table_name", "field_name", "period_month"]
    return orphans.count_orphans(orphans.find_orphans(references, _parents(spark, d)), references, by)


_WS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(8195) || chr(12288)"


def sql_id(column: str) -> str:
    return f"nullif(lower(trim({column}, {_WS})), '')"


def sql_text(column: str) -> str:
    return f"coalesce(trim({column}, {_WS}), '')"


_P1_BODY = f"""
with i as (
  select 'topology_interfaces' as table_name, {sql_id('interface_id')} as record_id, min(coalesce({sql_id('dataset_version_id')}, '')) as dv,
         min(created_at) as created_at, min(received_at) as received_at, min({sql_id('component_id')}) as a, min({sql_id('owner_asset_id')}) as b
  from topology_interfaces group by 2
), c as (
  select 'topology_candidates' as table_name, {sql_id('candidate_id')} as record_id, min(coalesce({sql_id('dataset_version_id')}, '')) as dv,
         min(created_at) as created_at, min(received_at) as received_at, min({sql_id('source_endpoint_id')}) as a, min({sql_id('target_asset_id')}) as b
  from topology_candidates group by 2
), refs as (
  select table_name, 'component_id' as field_name, 'component' as kind, dv, record_id, created_at, received_at, a as k from i
  union all select table_name, 'owner_asset_id', 'asset', dv, record_id, created_at, received_at, b from i
  union all select table_name, 'source_endpoint_id', 'geometry', dv, record_id, created_at, received_at, trim(regexp_extract(a, '^endpoint\\s*:(.*?)(:\\s*(start|end|inline))?$', 1)) from c where a not like 'explicit%'
  union all select table_name, 'target_asset_id', 'asset', dv, record_id, created_at, received_at, b from c
), parents as (
  select 'component' as kind, coalesce({sql_id('dataset_version_id')}, '') as dv, {sql_id('component_id')} as k, min(received_at) as since from topology_components where coalesce(status, '') <> 'removed' group by all
  union all select 'asset', coalesce({sql_id('dataset_version_id')}, ''), {sql_id('asset_id')}, min(received_at) from classified_objects where coalesce(status, '') <> 'removed' group by all
  union all select 'geometry', coalesce({sql_id('dataset_version_id')}, ''), {sql_id('source_geometry_id')}, min(received_at) from source_geometries group by all
), judged as (
  select r.*, not exists (select 1 from parents p where p.kind = r.kind and p.dv = r.dv and p.k = r.k and p.since <= r.received_at) as orphan
  from refs r where r.k is not null
)
"""

LINKS = ["parent_asset_id", "upstream_asset_id"]


def _links(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "classified_objects").select(id_or_empty("dataset_version_id").alias("dataset_version_id"), norm_id("asset_id").alias("node"), *[norm_id(f).alias(f) for f in LINKS])
    each = F.array(*[F.struct(F.lit(f).alias("link_field"), F.col(f).alias("parent")) for f in LINKS])
    return rows.select("dataset_version_id", "node", F.inline(each))


_BY = ["link_field", "dataset_version_id"]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d)
    found = hierarchy.resolve(links, _BY)
    given = links.filter("parent is not null and node is not null").select(*_BY, "node").distinct()
    return found.join(given, [*_BY, "node"], "left_semi").select(*_BY, F.col("node").alias("asset_id"), F.col("root").alias("root_asset_id"), F.col("level").alias("level_no"))


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path from the root of every asset, with or without a link."""
    found = hierarchy.resolve(_links(spark, d), _BY, paths=True)
    return found.select(*_BY, F.col("node").alias("asset_id"), F.col("level").alias("level_no"), F.array_join("path", "/").alias("path"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every asset below every asset."""
    found = hierarchy.resolve(_links(spark, d), _BY, paths=True)
    return hierarchy.descendants(found, _BY).select(*_BY, F.col("ancestor").alias("asset_id"), F.col("node").alias("descendant_id"), "levels")


_P2_BODY = f"""
with recursive o as (
  select coalesce({sql_id('dataset_version_id')}, '') as dv, {sql_id('asset_id')} as node, min({sql_id('parent_asset_id')}) as p, min({sql_id('upstream_asset_id')}) as u
  from classified_objects where {sql_id('asset_id')} is not null group by all
), raw as (
  select 'parent_asset_id' as link_field, dv, node, p as parent from o union all select 'upstream_asset_id', dv, node, u from o
), links as (
  select r.link_field, r.dv, r.node, r.parent as given, h.node as parent from raw r left join o h on h.dv = r.dv and h.node = r.parent
), walk as (
  select link_field, dv, node, node as root, 0 as level, node as path from links where parent is null
  union all
  select l.link_field, l.dv, l.node, w.root, w.level + 1, w.path || '/' || l.node from walk w join links l on l.link_field = w.link_field and l.dv = w.dv and l.parent = w.node
)
"""


P3_FIELDS = snapshots.Fields(texts=("source_name", "asset_type", "network_family", "source_status"), numbers=(("lon", 0.000001), ("lat", 0.000001)), exact=("port_count",))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "asset_snapshots").select(
        id_or_empty("dataset_id").alias("series"), norm_id("snapshot_id").alias("snapshot"), F.col("snapshot_at").alias("at"), norm_id("asset_id").alias("key"), F.coalesce(trimmed("object_ref"), F.lit("")).alias("ref"), F.col("received_at").alias("received"), *P3_FIELDS.names
    )
    found = snapshots.diff_snapshots(rows, P3_FIELDS)
    return found.select(F.col("series").alias("dataset_id"), F.col("snapshot").alias("snapshot_id"), F.col("key").alias("asset_id"), "before_ref", "after_ref", "field_name")


def p3_summary(spark: SparkSession, d: str) -> DataFrame:
    """Assets added, removed and changed per snapshot, and the changes per field."""
    found = p3_found(spark, d)
    kind = F.when(F.col("before_ref") == "", "added").when(F.col("after_ref") == "", "removed").otherwise("changed")
    return found.groupBy("dataset_id", "snapshot_id", kind.alias("change_type"), "field_name").agg(F.count(F.lit(1)).alias("n_assets"))


_VERSION_TEXTS = ["version_name", "source_filename", "source_checksum", "validation_status", "publication_status", "status"]
_EDGE_TEXTS = ["verification_status", "direction", "network_family"]


def _copies(spark: SparkSession, d: str) -> DataFrame:
    def vals(ids, texts, others):
        pairs = [(f, norm_id(f)) for f in ids] + [(f, trimmed(f)) for f in texts] + [(f, F.col(f).cast("string")) for f in others]
        return F.map_filter(F.create_map(*[x for f, v in pairs for x in (F.lit(f), v)]), lambda k, v: v.isNotNull())

    side = F.lower(trimmed("store")).alias("side")
    versions = read(spark, d, "dataset_versions").select(
        F.lit("dataset_versions").alias("table_name"), id_or_empty("dataset_version_id").alias("record_id"), side, F.map_concat(vals(["dataset_id", "branch_id"], _VERSION_TEXTS, ["source_size"]), copies.json_leaves("payload", "payload")).alias("vals")
    )
    edges = read(spark, d, "graph_edges").select(
        F.lit("graph_edges").alias("table_name"), id_or_empty("edge_id").alias("record_id"), side, vals(["dataset_version_id", "relation_id", "source_node_id", "target_node_id"], _EDGE_TEXTS, ["length_meters"]).alias("vals")
    )
    return versions.unionByName(edges)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.compare_copies(_copies(spark, d), ("postgres", "json"), {"length_meters": 0.001})


def p4_summary(spark: SparkSession, d: str) -> DataFrame:
    return p4_found(spark, d).groupBy("table_name", "difference", "field_name").agg(F.count(F.lit(1)).alias("n_records"))


def p4_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the two stores compared by what they link, a key that parallel edges share: rows of each version without a partner."""
    edge = read(spark, d, "graph_edges")
    fields = [("relation_id", norm_id("relation_id")), *[(f, trimmed(f)) for f in _EDGE_TEXTS]]
    vals = F.map_filter(F.create_map(*[x for f, v in fields for x in (F.lit(f), v)]), lambda k, v: v.isNotNull())
    key = F.concat_ws(orphans.SEP, id_or_empty("dataset_version_id"), id_or_empty("source_node_id"), id_or_empty("target_node_id"))
    # Deliveries of one edge again are no parallel edges.
    rows = edge.select(F.lit("graph_edges").alias("table_name"), key.alias("record_id"), F.lower(trimmed("store")).alias("side"), norm_id("edge_id").alias("edge_id"), "received_at", F.to_json(vals).alias("v"))
    rows = first_deliveries(rows, ["side", "edge_id"], "received_at").select("table_name", "record_id", "side", F.from_json("v", "map<string,string>").alias("vals"))
    found = copies.compare_copies(rows, ("postgres", "json"), once=False).filter("difference != 'differs'")
    return found.groupBy(F.substring_index("record_id", orphans.SEP, 1).alias("dataset_version_id"), "difference").agg(F.count(F.lit(1)).alias("n_rows"))


_P3_BODY = f"""
with r as (
  select coalesce({sql_id('dataset_id')}, '') as dataset_id, {sql_id('snapshot_id')} as snapshot_id, {sql_id('asset_id')} as asset_id, min(snapshot_at) as snap_at, min({sql_text('object_ref')}) as ref,
    min({sql_text('source_name')}) as source_name, min({sql_text('asset_type')}) as asset_type, min({sql_text('network_family')}) as network_family, min({sql_text('source_status')}) as source_status,
    min(lon) as lon, min(lat) as lat, min(port_count) as port_count
  from asset_snapshots where {sql_id('asset_id')} is not null group by all
), s as (
  select dataset_id, snapshot_id, lead(snapshot_id) over w as next_id, row_number() over w as n from (select dataset_id, snapshot_id, min(snap_at) as snap_at from r group by all) window w as (partition by dataset_id order by snap_at, snapshot_id)
), a as (select r.* from r join s using (dataset_id, snapshot_id) where n > 1
), b as (select r.* replace (s.next_id as snapshot_id) from r join s using (dataset_id, snapshot_id) where next_id is not null
), j as (
  select coalesce(a.dataset_id, b.dataset_id) as dataset_id, coalesce(a.snapshot_id, b.snapshot_id) as snapshot_id, coalesce(a.asset_id, b.asset_id) as asset_id, coalesce(b.ref, '') as before_ref, coalesce(a.ref, '') as after_ref,
    case when a.asset_id is null or b.asset_id is null then [''] else list_filter([
      case when a.source_name <> b.source_name then 'source_name' end, case when a.asset_type <> b.asset_type then 'asset_type' end, case when a.network_family <> b.network_family then 'network_family' end,
      case when a.source_status <> b.source_status then 'source_status' end,
      case when a.lon is distinct from b.lon and coalesce(abs(a.lon - b.lon) >= 0.000000999999, true) then 'lon' end, case when a.lat is distinct from b.lat and coalesce(abs(a.lat - b.lat) >= 0.000000999999, true) then 'lat' end,
      case when a.port_count is distinct from b.port_count then 'port_count' end], lambda x: x is not null) end as fields
  from a full join b on a.dataset_id = b.dataset_id and a.snapshot_id = b.snapshot_id and a.asset_id = b.asset_id
), p3 as (select dataset_id, snapshot_id, asset_id, before_ref, after_ref, unnest(fields) as field_name from j)
"""


_P4_VERSION_FIELDS = [(f, sql_id(f)) for f in ("dataset_id", "branch_id")] + [(f, f"nullif({sql_text(f)}, '')") for f in _VERSION_TEXTS] + [("source_size", "source_size::varchar")]
_P4_EDGE_FIELDS = [(f, sql_id(f)) for f in ("dataset_version_id", "relation_id", "source_node_id", "target_node_id")] + [(f, f"nullif({sql_text(f)}, '')") for f in _EDGE_TEXTS] + [("length_meters", "length_meters::varchar")]


def _long(source: str, table: str, fields) -> str:
    return " union all ".join(f"select '{table}' as table_name, record_id, side, '{f}' as field_name, {v} as v from {source}" for f, v in fields)


_P4_BODY = f"""
with v as (
  select {sql_id('dataset_version_id')} as record_id, lower(trim(store)) as side, * exclude (store), row_number() over (partition by {sql_id('dataset_version_id')}, lower(trim(store)) order by received_at) as n from dataset_versions
), e as (
  select {sql_id('edge_id')} as record_id, lower(trim(store)) as side, * exclude (store), row_number() over (partition by {sql_id('edge_id')}, lower(trim(store)) order by received_at) as n from graph_edges
), v1 as (select * from v where n = 1), e1 as (select * from e where n = 1),
leaf as (
  select record_id, side, t.fullkey, t.type, t.value, t.atom from v1, json_tree(v1.payload) as t where t.type not in ('OBJECT', 'NULL') and not contains(t.fullkey, '[')
), vals as (
  {_long('v1', 'dataset_versions', _P4_VERSION_FIELDS)}
  union all {_long('e1', 'graph_edges', _P4_EDGE_FIELDS)}
  union all select 'dataset_versions', record_id, side, 'payload' || replace(substr(fullkey, 2), '"', ''),
    case when type in ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') then 'n:' || (value::varchar)::double when type = 'ARRAY' then 'a:' || value::varchar when type = 'BOOLEAN' then 'b:' || value::varchar else 's:' || (value ->> '$') end from leaf
), held as (
  select 'dataset_versions' as table_name, record_id, bool_or(side = 'postgres') as p, bool_or(side = 'json') as j from v1 group by record_id
  union all select 'graph_edges', record_id, bool_or(side = 'postgres'), bool_or(side = 'json') from e1 group by record_id
), wide as (
  select table_name, record_id, field_name, max(v) filter (side = 'postgres') as a, max(v) filter (side = 'json') as b from vals where v is not null group by all
), p4 as (
  select table_name, record_id, 'missing_in_' || case when p then 'json' else 'postgres' end as difference, '' as field_name from held where not (p and j)
  union all
  select table_name, record_id, 'differs', field_name from wide join held using (table_name, record_id) where p and j and a is distinct from b
    and not (field_name = 'length_meters' and coalesce(abs(try_cast(a as double) - try_cast(b as double)) < 0.000999999, false))
)
"""


def _valid(spark: SparkSession, d: str, kind: str) -> DataFrame:
    rows = read(spark, d, "source_geometries").filter("valid").filter(F.lower(trimmed("geometry_type")) == kind)
    return rows.select(id_or_empty("dataset_version_id").alias("scope"), norm_id("source_geometry_id").alias("id"), norm_id("source_feature_id").alias("owner"), "coordinates", "geometry")


def _points(spark: SparkSession, d: str) -> DataFrame:
    place = F.when(geo.has_coordinates("coordinates"), geo.point_from_json("coordinates")).otherwise(geo.point_from_wkt("geometry"))
    return _valid(spark, d, "point").select("scope", "id", "owner", F.inline(F.array(place)))  # a generator: the text is parsed once, however often its parts are used


def _regions(spark: SparkSession, d: str) -> DataFrame:
    rings = F.when(geo.has_coordinates("coordinates"), geo.rings_from_json("coordinates")).otherwise(geo.rings_from_wkt("geometry"))
    return _valid(spark, d, "polygon").select("scope", "id", F.explode(F.array(rings)).alias("rings"))


#: Metres within which two points are near.
NEAR_METRES = 3.0


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    blocks = spatial.build_blocks(stage(_points(spark, d)))  # the bounds of ranges are sampled from it, so texts are parsed once
    near = spatial.near_pairs(blocks, NEAR_METRES).withColumn("kind", F.lit("near"))
    within = spatial.containing(blocks, _regions(spark, d)).withColumn("kind", F.lit("inside"))
    return near.unionByName(within).select("kind", F.col("first_id").alias("first_geometry_id"), F.col("second_id").alias("second_geometry_id"))


_P5_BODY = rf"""
with g as (
  select coalesce({sql_id('dataset_version_id')}, '') as dv, {sql_id('source_geometry_id')} as id, min({sql_id('source_feature_id')}) as owner, lower(geometry_type) as kind, min(geometry) as wkt,
    min(case when regexp_replace({sql_text('coordinates')}, '\s', '', 'g') in ('', '[]') then null else regexp_replace(coordinates, '[\s"]', '', 'g') end) as js
  from source_geometries where valid group by 1, 2, 4
), body as (
  select dv, id, owner, kind, case when js is not null then js
    else regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(wkt), '^[^(]*', ''), '\s*,\s*', ',', 'g'), '\(\s*', '[', 'g'), '\s*\)', ']', 'g'), '([^\s,\[\]]+)\s+([^\s,\[\]]+)(\s+[^,\[\]]+)?', '[\1,\2]', 'g'), '^\[\[([^\[\]]*)\]\]$', '[\1]') end as js
  from g
), points as (
  select dv, id, owner, try_cast(string_split(regexp_replace(js, '[\[\]]', '', 'g'), ',')[1] as double) as lon, try_cast(string_split(regexp_replace(js, '[\[\]]', '', 'g'), ',')[2] as double) as lat
  from body where kind = 'point'
), placed as (select * from points where isfinite(lon) and isfinite(lat)
), rings as (
  select dv, id, unnest(string_split(regexp_replace(regexp_replace(js, '^\[\[\[', ''), '\]\]\]$', ''), ']],[[')) as ring, row_number() over () as k from body where kind = 'polygon' and js is not null
), corners as (
  select dv, id, k, ring, string_split(ring, '],[') as c from rings
), edges as (
  select dv, id, string_split(c[i], ',') as a, string_split(c[i % len(c) + 1], ',') as b from (select *, unnest(range(1, len(c) + 1)) as i from corners where len(c) >= 3)
), e as (
  select dv, id, try_cast(a[1] as double) as x1, try_cast(a[2] as double) as y1, try_cast(b[1] as double) as x2, try_cast(b[2] as double) as y2 from edges
), box as (select dv, id, min(x1) as lx, max(x1) as hx, min(y1) as ly, max(y1) as hy from e group by all
), inside as (
  select p.id as pid, e.id as gid from box join placed p on p.dv = box.dv and p.lon between lx and hx and p.lat between ly and hy join e on e.dv = box.dv and e.id = box.id
  group by 1, 2 having count(*) filter ((y1 > p.lat) <> (y2 > p.lat) and p.lon < (x2 - x1) * (p.lat - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1
), near as (
  select a.id as one, b.id as two from placed a join placed b on a.dv = b.dv and a.owner is distinct from b.owner and a.id < b.id and b.lat between a.lat - 0.0001 and a.lat + 0.0001
  where 2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 3
)
"""

QUERIES = {"p1_found": p1_found, "p1_monthly": p1_monthly, "p2_found": p2_found, "p2_paths": p2_paths, "p2_descendants": p2_descendants, "p3_found": p3_found, "p3_summary": p3_summary, "p4_found": p4_found, "p4_summary": p4_summary, "p4_duplicates": p4_duplicates, "p5_found": p5_found}
SQL = {
    "p1_found": _P1_BODY + "select table_name, field_name, dv as dataset_version_id, record_id, strftime(created_at, '%Y-%m') as period_month from judged where orphan",
    "p1_monthly": _P1_BODY + "select table_name, field_name, strftime(created_at, '%Y-%m') as period_month, count(*) as n_references, count(*) filter (orphan) as n_orphans from judged group by all",
    "p2_found": _P2_BODY + "select l.link_field, l.dv as dataset_version_id, l.node as asset_id, coalesce(w.root, 'cycle') as root_asset_id, coalesce(w.level, -1)::int as level_no from links l left join walk w using (link_field, dv, node) where l.given is not null",
    "p2_paths": _P2_BODY + "select l.link_field, l.dv as dataset_version_id, l.node as asset_id, coalesce(w.level, -1)::int as level_no, w.path from links l left join walk w using (link_field, dv, node)",
    "p2_descendants": _P2_BODY + "select link_field, dv as dataset_version_id, parts[i] as asset_id, node as descendant_id, (len(parts) - i)::int as levels from (select link_field, dv, node, parts, unnest(range(1, len(parts))) as i from (select *, string_split(path, '/') as parts from walk))",
    "p3_found": _P3_BODY + "select * from p3",
    "p3_summary": _P3_BODY + "select dataset_id, snapshot_id, case when before_ref = '' then 'added' when after_ref = '' then 'removed' else 'changed' end as change_type, field_name, count(*) as n_assets from p3 group by all",
    "p4_found": _P4_BODY + "select * from p4",
    "p4_summary": _P4_BODY + "select table_name, difference, field_name, count(*) as n_records from p4 group by all",
    "p4_duplicates": _P4_BODY + f"""select dv as dataset_version_id, 'missing_in_' || case when n > 0 then 'json' else 'postgres' end as difference, sum(abs(n))::bigint as n_rows
      from (select coalesce({sql_id('dataset_version_id')}, '') as dv, coalesce({sql_id('source_node_id')}, '') as a, coalesce({sql_id('target_node_id')}, '') as b, count(*) filter (side = 'postgres') - count(*) filter (side = 'json') as n from e1 group by all) where n <> 0 group by all""",
    "p5_found": _P5_BODY + "select 'near' as kind, one as first_geometry_id, two as second_geometry_id from near union all select 'inside', least(pid, gid), greatest(pid, gid) from inside",
}
