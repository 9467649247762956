"""Queries over single records: details, ids, attributes, ports, parity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import attributes, hashes
from ..functions.ids import id_or_empty, norm_id, trimmed
from ..operators import identity
from . import views
from .tables import read
from .views import sql_with

#: Names of a version's document that stand for a field.
ALIASES = {"n_assets": ["total assets", "totalassets"], "n_errors": ["errors"], "n_points": ["totalPoints"], "stage": ["processing stage"]}


def asset_detail(spark: SparkSession, d: str) -> DataFrame:
    """Interfaces, occupancy, edges and candidates of every junction box."""
    boxes = views.assets(spark, d).filter("asset_type = 'junction_box'").select("dv", "asset_id").distinct()
    ports = views.interfaces(spark, d).groupBy("dv", F.col("owner_id").alias("asset_id")).agg(F.count(F.lit(1)).alias("n_interfaces"), F.sum("occupancy").alias("occupied"), F.sum("capacity").alias("capacity"))
    ends = views.graph(spark, d).select("dv", F.explode(F.array("source_id", "target_id")).alias("asset_id")).groupBy("dv", "asset_id").agg(F.count(F.lit(1)).alias("n_edges"))
    open_ = views.candidates(spark, d).filter("candidate_status in ('candidate', 'ambiguous')").groupBy("dv", F.col("target_id").alias("asset_id")).agg(F.count(F.lit(1)).alias("n_candidates"))
    out = boxes
    for part in (ports, ends, open_):
        out = out.join(part, ["dv", "asset_id"], "left")
    return out.na.fill(0, ["n_interfaces", "occupied", "capacity", "n_edges", "n_candidates"])


def expanded_ports(spark: SparkSession, d: str) -> DataFrame:
    """One row per port of each active interface, up to its capacity."""
    rows = views.interfaces(spark, d).filter("status = 'active' and owner_id is not null")
    return rows.select("interface_id", F.explode(attributes.port_ids(F.col("owner_id"), F.col("interface_type"), F.col("capacity"))).alias("port_id"))


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of assets as if cables carried none: by name among all assets of the dataset version, and by feature among those that are no cables."""
    own = views.assets(spark, d)
    given = F.col("object_role") != "cable_path"
    objects = own.select("object_id", F.col("dv").alias("dataset"), F.when(given, F.col("asset_id")).alias("given_id"), F.col("feature_id").alias("feature"), F.col("source_name").alias("name"))
    keys = F.array(F.struct(F.lit("name").alias("key_kind"), F.col("source_name").alias("key_value")), F.when(given, F.struct(F.lit("feature").alias("key_kind"), F.col("feature_id").alias("key_value"))))
    registry = own.select(F.col("dv").alias("dataset"), F.inline(F.filter(keys, lambda k: k.isNotNull())), F.col("asset_id").alias("stable_id"))
    return identity.assign_ids(objects, registry, ["feature", "name"])


def document_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the versions' summaries by alias."""
    rows = read(spark, d, "dataset_versions").filter(F.lower(trimmed("store")) == "postgres").select(norm_id("dataset_version_id").alias("dv"), F.from_json(F.get_json_object("payload", "$.summary"), "map<string,string>").alias("m")).dropDuplicates(["dv"])
    return rows.select("dv", F.explode(attributes.semantic_fields(F.map_entries("m"), ALIASES)).alias("field_name", "value"))


def store_parity(spark: SparkSession, d: str) -> DataFrame:
    """Whether both stores hold the same graph of each version: hashes of ids, ends and families."""
    rows = read(spark, d, "graph_edges").select(F.lower(trimmed("store")).alias("store"), id_or_empty("dataset_version_id").alias("dv"), id_or_empty("edge_id").alias("e"), id_or_empty("source_node_id").alias("s"), id_or_empty("target_node_id").alias("t"), F.coalesce(trimmed("network_family"), F.lit("")).alias("f")).distinct()
    found = hashes.revision(rows, ["dv", "store"], ["e", "s", "t", "f"])
    side = lambda s: F.max(F.when(F.col("store") == s, F.col("revision")))
    return found.groupBy("dv").agg((side("postgres").eqNullSafe(side("json"))).alias("same"), F.sum("n_rows").alias("n_rows"))


def masked_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of assets, hidden where the asset is under review."""
    return views.assets(spark, d).select("object_id", attributes.masked(F.col("source_name"), F.col("classification_status") == "classified").alias("shown"))


QUERIES = {f.__name__: f for f in (asset_detail, expanded_ports, stable_ids, document_fields, store_parity, masked_names)}

_HASH = ", ".join(f"sum(('0x' || substr(h, {1 + 12 * k}, 12))::bigint) as s{k}" for k in range(4))
_T = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(8195) || chr(12288)"
SQL = {
    "asset_detail": sql_with("assets", "graph", "candidates", "interfaces") + ", b as (select distinct dv, asset_id from assets where asset_type = 'junction_box'), p as (select dv, owner_id as asset_id, count(*) as n_interfaces, sum(occupancy)::bigint as occupied, sum(capacity)::bigint as capacity from interfaces group by all), e as (select dv, asset_id, count(*) as n_edges from (select dv, source_id as asset_id from graph union all select dv, target_id from graph) group by all), c as (select dv, target_id as asset_id, count(*) as n_candidates from candidates where candidate_status in ('candidate', 'ambiguous') group by all) select dv, asset_id, coalesce(n_interfaces, 0) as n_interfaces, coalesce(occupied, 0) as occupied, coalesce(capacity, 0) as capacity, coalesce(n_edges, 0) as n_edges, coalesce(n_candidates, 0) as n_candidates from b left join p using (dv, asset_id) left join e using (dv, asset_id) left join c using (dv, asset_id)",
    "expanded_ports": sql_with("interfaces") + " select interface_id, owner_id || '/interface/' || replace(replace(interface_type, '_', ' '), ' ', '-') || '/' || lpad(i::varchar, 2, '0') as port_id from (select *, unnest(range(1, capacity + 1)) as i from interfaces where status = 'active' and owner_id is not null and capacity > 0)",
    "stable_ids": sql_with("assets") + """, r as (select dv, source_name, min(asset_id) as low, max(asset_id) as high from assets where source_name <> '' group by all), m as (select object_id, a.dv, case when object_role <> 'cable_path' then nullif(asset_id, '') end as given, feature_id, low, high from assets a left join r on r.dv = a.dv and r.source_name = a.source_name)
      select object_id, case when given is not null then given when low = high then low when low is null then 'AUTO-' || upper(substr(sha256(dv || '|feature|' || feature_id), 1, 24)) end as stable_id, case when given is not null then 'given' when low <> high then 'conflict' when low is not null then 'registry' else 'made' end as status from m""",
    "document_fields": f"with p as (select nullif(lower(trim(dataset_version_id, {_T})), '') as dv, min(payload) as payload from dataset_versions where lower(trim(store)) = 'postgres' group by 1), f as (select dv, unnest([('n_assets', payload ->> '$.summary.totalAssets'), ('n_errors', payload ->> '$.summary.errors'), ('n_points', payload ->> '$.summary.totalPoints')]) as x from p) select dv, x[1] as field_name, x[2] as value from f where x[2] is not null",
    "store_parity": f"with r as (select distinct lower(trim(store)) as store, coalesce(lower(trim(dataset_version_id, {_T})), '') as dv, coalesce(lower(trim(edge_id, {_T})), '') as e, coalesce(lower(trim(source_node_id, {_T})), '') as s, coalesce(lower(trim(target_node_id, {_T})), '') as t, coalesce(trim(network_family, {_T}), '') as f from graph_edges), h as (select dv, store, sha256('[\"' || e || '\",\"' || s || '\",\"' || t || '\",\"' || f || '\"]') as h from r), q as (select dv, store, count(*) as n_rows, {_HASH} from h group by all) select dv, max((s0, s1, s2, s3, n_rows)) filter (store = 'postgres') is not distinct from max((s0, s1, s2, s3, n_rows)) filter (store = 'json') as same, sum(n_rows)::bigint as n_rows from q group by dv",
    "masked_names": sql_with("assets") + " select object_id, case when classification_status = 'classified' then source_name end as shown from assets",
}
