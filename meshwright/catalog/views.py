"""The network tables as records: deliveries collapsed, ids normalised; and the same for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import geo
from ..functions.ids import id_sql, trim_sql
from ..plans.records import first_deliveries
from .tables import read


def _records(spark: SparkSession, d: str, table: str, key: str, columns: dict[str, str], wanted: tuple[str, ...], where: str = "true") -> DataFrame:
    """First deliveries of a table with the wanted columns (all, if none is named); others aren't read."""
    chosen = [key, *(w for w in wanted or columns if w != key)]
    rows = read(spark, d, table).where(where).selectExpr(*[f"{columns[c]} as {c}" for c in chosen], "received_at")
    return first_deliveries(rows, [key], "received_at")


def _e_sql(c: str) -> str:
    return f"coalesce({id_sql(c)}, '')"


def _t_sql(c: str) -> str:
    return f"coalesce({trim_sql(c)}, '')"


_ASSETS = (
    {"object_id": id_sql("classified_object_id"), "dv": _e_sql("dataset_version_id"), "feature_id": _e_sql("source_feature_id"), "asset_id": _e_sql("asset_id"), "site_id": _e_sql("site_id")}
    | {c: _t_sql(c) for c in ("source_name", "object_role", "network_family", "asset_type", "category", "classification_status", "status")}
    | {"parent_id": id_sql("parent_asset_id"), "upstream_id": id_sql("upstream_asset_id"), "classification_score": "classification_score"}
)
_KIND = f"lower({trim_sql('geometry_type')})"
_GEOMETRIES = {"geometry_id": id_sql("source_geometry_id"), "dv": _e_sql("dataset_version_id"), "feature_id": _e_sql("source_feature_id"), "kind": _KIND, "valid": "valid", "coordinates": "coordinates", "geometry": "geometry"}
_EDGES = {
    "edge_id": id_sql("edge_id"), "dv": _e_sql("dataset_version_id"), "source_id": id_sql("source_node_id"), "target_id": id_sql("target_node_id"), "relation_id": id_sql("relation_id"),
    "verification": _t_sql("verification_status"), "direction": _t_sql("direction"), "family": _t_sql("network_family"), "length": "length_meters",
}
_CANDIDATES = (
    {"candidate_id": id_sql("candidate_id"), "dv": _e_sql("dataset_version_id"), "endpoint_id": id_sql("source_endpoint_id"), "target_id": id_sql("target_asset_id"), "site_id": _e_sql("site_id")}
    | {c: _t_sql(c) for c in ("candidate_type", "network_family", "candidate_status", "proposal_status")} | {"score": "score", "distance": "distance_meters"}
)
_INTERFACES = (
    {"interface_id": id_sql("interface_id"), "dv": _e_sql("dataset_version_id"), "owner_id": id_sql("owner_asset_id"), "component_id": id_sql("component_id")}
    | {c: _t_sql(c) for c in ("interface_type", "service_domain", "media_type", "direction", "status")} | {c: c for c in ("capacity", "occupancy", "is_proxy")}
)


def assets(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return _records(spark, d, "classified_objects", "object_id", _ASSETS, columns)


def geometries(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return _records(spark, d, "source_geometries", "geometry_id", _GEOMETRIES, columns)


def _placed(spark: SparkSession, d: str, kind: str, place: str, valid: str) -> DataFrame:
    """Valid geometries of a kind with their parsed places: the texts are filtered and parsed before deliveries are collapsed, so they aren't shuffled."""
    ids = [f"{_GEOMETRIES[c]} as {c}" for c in ("geometry_id", "dv", "feature_id")]
    rows = read(spark, d, "source_geometries").where(f"valid and {_KIND} = '{kind}'").selectExpr(*ids, place, "received_at")
    return first_deliveries(rows.where(valid), ["geometry_id"], "received_at").drop("received_at")


def points(spark: SparkSession, d: str) -> DataFrame:
    """geometry_id, dv, feature_id, lon, lat of valid points."""
    return _placed(spark, d, "point", f"inline(array({geo.POINT_SQL}))", geo.valid_sql("lon", "lat"))  # a generator: the text is parsed once, however often its parts are used


def of_features(places: DataFrame, own: DataFrame, how: str = "inner") -> DataFrame:
    """``places`` joined to the records of their features; a place or a record without a feature has no partner."""
    return places.join(own.where("feature_id != ''"), ["dv", "feature_id"], how)


def devices(spark: SparkSession, d: str) -> DataFrame:
    """Points of assets: geometry_id, dv, asset_id, asset_type, site_id, lon, lat."""
    own = assets(spark, d, "dv", "feature_id", "asset_id", "asset_type", "category", "network_family", "site_id", "source_name", "object_role").where("object_role = 'device_node'").drop("object_id", "object_role", "received_at")
    return of_features(points(spark, d), own)


def lines(spark: SparkSession, d: str) -> DataFrame:
    """geometry_id, dv, feature_id, line array<struct(lon, lat)> of valid lines with two places at least."""
    return _placed(spark, d, "linestring", f"explode(array({geo.LINE_SQL})) as line", f"size(line) >= 2 and forall(line, p -> coalesce({geo.valid_sql('p.lon', 'p.lat')}, false))")


def edges(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Edges of the first store: edge_id, dv, source_id, target_id, verification, direction, family, length."""
    return _records(spark, d, "graph_edges", "edge_id", _EDGES, columns, f"lower({trim_sql('store')}) = 'postgres'")


def graph(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Confirmed edges with both ends, no loops."""
    held = edges(spark, d, *dict.fromkeys(("verification", "source_id", "target_id", *columns))) if columns else edges(spark, d)
    return held.where("verification = 'confirmed' and source_id is not null and target_id is not null and source_id != target_id")


def candidates(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return _records(spark, d, "topology_candidates", "candidate_id", _CANDIDATES, columns)


def interfaces(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return _records(spark, d, "topology_interfaces", "interface_id", _INTERFACES, columns)


_WS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(8195) || chr(12288)"


def _i(column: str) -> str:
    return f"nullif(lower(trim({column}, {_WS})), '')"


def _e(column: str) -> str:
    return f"coalesce({_i(column)}, '')"


def _t(column: str) -> str:
    return f"coalesce(trim({column}, {_WS}), '')"


def _view(name: str, table: str, key: str, columns: dict[str, str], where: str = "true") -> str:
    listed = ", ".join(f"{v} as {k}" for k, v in columns.items())
    return f"{name} as (select * exclude (n_) from (select {_i(key)} as {key.replace('classified_object_id', 'object_id').replace('source_geometry_id', 'geometry_id')}, {listed}, received_at, row_number() over (partition by {_i(key)} order by received_at) as n_ from {table} where {where}) where n_ = 1)"


SQL_VIEWS = {
    "assets": _view(
        "assets", "classified_objects", "classified_object_id",
        {"dv": _e("dataset_version_id"), "feature_id": _e("source_feature_id"), "asset_id": _e("asset_id"), "site_id": _e("site_id")}
        | {c: _t(c) for c in ("source_name", "object_role", "network_family", "asset_type", "category", "classification_status", "status")}
        | {"parent_id": _i("parent_asset_id"), "upstream_id": _i("upstream_asset_id"), "classification_score": "classification_score"},
    ),
    "edges": _view(
        "edges", "graph_edges", "edge_id",
        {"dv": _e("dataset_version_id"), "source_id": _i("source_node_id"), "target_id": _i("target_node_id"), "relation_id": _i("relation_id"), "verification": _t("verification_status"), "direction": _t("direction"), "family": _t("network_family"), "length": "length_meters"},
        "lower(trim(store)) = 'postgres'",
    ),
    "graph": "graph as (select * from edges where verification = 'confirmed' and source_id is not null and target_id is not null and source_id <> target_id)",
    "candidates": _view(
        "candidates", "topology_candidates", "candidate_id",
        {"dv": _e("dataset_version_id"), "endpoint_id": _i("source_endpoint_id"), "target_id": _i("target_asset_id"), "site_id": _e("site_id")}
        | {c: _t(c) for c in ("candidate_type", "network_family", "candidate_status", "proposal_status")} | {"score": "score", "distance": "distance_meters"},
    ),
    "interfaces": _view(
        "interfaces", "topology_interfaces", "interface_id",
        {"dv": _e("dataset_version_id"), "owner_id": _i("owner_asset_id"), "component_id": _i("component_id")}
        | {c: _t(c) for c in ("interface_type", "service_domain", "media_type", "direction", "status")} | {c: c for c in ("capacity", "occupancy", "is_proxy")},
    ),
    "geometries": _view("geometries", "source_geometries", "source_geometry_id", {"dv": _e("dataset_version_id"), "feature_id": _e("source_feature_id"), "kind": "lower(geometry_type)", "valid": "valid", "coordinates": "coordinates", "geometry": "geometry"}),
    "placed": r"""placed as (select geometry_id, dv, feature_id, kind, valid, case when regexp_replace(coalesce(coordinates, ''), '\s', '', 'g') not in ('', '[]') then regexp_replace(coordinates, '[\s"]', '', 'g')
      else regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(geometry), '^[^(]*', ''), '\s*,\s*', ',', 'g'), '\(\s*', '[', 'g'), '\s*\)', ']', 'g'), '([^\s,\[\]]+)\s+([^\s,\[\]]+)(\s+[^,\[\]]+)?', '[\1,\2]', 'g') end as js from geometries)""",
    "points": r"""points as (select * from (select geometry_id, dv, feature_id, try_cast(string_split(regexp_replace(js, '[\[\]]', '', 'g'), ',')[1] as double) as lon, try_cast(string_split(regexp_replace(js, '[\[\]]', '', 'g'), ',')[2] as double) as lat
      from placed where kind = 'point' and valid) where lon between -180 and 180 and lat between -90 and 90)""",
    "devices": "devices as (select p.*, a.asset_id, a.asset_type, a.category, a.network_family, a.site_id, a.source_name from points p join assets a on a.dv = p.dv and a.feature_id = p.feature_id where a.object_role = 'device_node')",
    "lines": r"""lines as (select geometry_id, dv, feature_id, line from (select geometry_id, dv, feature_id, list_transform(string_split(regexp_replace(regexp_replace(js, '^\[+', ''), '\]+$', ''), '],['), lambda p: [try_cast(string_split(p, ',')[1] as double), try_cast(string_split(p, ',')[2] as double)]) as line
      from placed where kind = 'linestring' and valid) where len(line) >= 2 and len(list_filter(line, lambda p: p[1] between -180 and 180 and p[2] between -90 and 90)) = len(line))""",
}
_NEEDS = {"graph": ["edges"], "placed": ["geometries"], "points": ["geometries", "placed"], "devices": ["assets", "geometries", "placed", "points"], "lines": ["geometries", "placed"]}


def sql_with(*names: str, recursive: bool = False) -> str:
    """``WITH`` and the named views, ready for more."""
    wanted = [n for n in SQL_VIEWS if n in names or any(n in _NEEDS.get(x, ()) for x in names)]
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(SQL_VIEWS[n] for n in wanted)
