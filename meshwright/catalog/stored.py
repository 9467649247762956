"""Queries over stores and over planted rows: upserts, merges, version tables, logs, metrics; copies and stretches of lines, lines named after devices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashes, score, text
from ..operators import gridjoin as g
from ..operators import labels
from ..plans.records import first_deliveries
from ..plans.staging import shared_path
from ..sources import stores
from . import maps, views
from .tables import read
from .views import sql_with


def _side(spark: SparkSession, d: str, store: str) -> DataFrame:
    """The edges of a store: edge_id, dv, family, origin."""
    rows = read(spark, d, "graph_edges").where(f"lower({views.trim_sql('store')}) = '{store}'")
    rows = rows.selectExpr(f"{views.id_sql('edge_id')} as edge_id", f"coalesce({views.id_sql('dataset_version_id')}, '') as dv", f"coalesce({views.trim_sql('network_family')}, '') as family", f"'{store}' as origin", "received_at")
    return first_deliveries(rows, ["edge_id"], "received_at").drop("received_at")


def _by_origin(rows: DataFrame) -> DataFrame:
    return rows.groupBy("dv", "family", "origin").agg(F.count(F.lit(1)).alias("n"))


def store_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The first store after the second's edges were put into it."""
    return _by_origin(stores.upsert(_side(spark, d, "postgres"), _side(spark, d, "json"), ["edge_id"]))


def store_merge(spark: SparkSession, d: str) -> DataFrame:
    """Both stores merged; of an edge in both the first store's record stays."""
    return _by_origin(stores.merge_documents([_side(spark, d, "postgres"), _side(spark, d, "json")], ["edge_id"]))


def version_store(spark: SparkSession, d: str) -> DataFrame:
    """A table of versions: the first store's edges written, the versions of the second replaced, read back."""
    path = shared_path(spark, "versions")
    for store in ("postgres", "json"):
        stores.replace_versions(_side(spark, d, store).where("dv != ''"), path, "dv")
    held = spark.read.schema("edge_id string, family string, origin string, dv string").parquet(path)
    return held.groupBy("dv", "origin").agg(F.count(F.lit(1)).alias("n"))


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """A log of confirmed candidates, written and read back: values under secret names are masked."""
    path = shared_path(spark, "log")
    rows = views.candidates(spark, d, "candidate_status", "target_id").where("candidate_status = 'confirmed'")
    stores.append_log(rows.selectExpr("candidate_id", "map('target', coalesce(target_id, ''), 'apiKey', candidate_id) as attributes"), path)
    back = spark.read.schema("candidate_id string, attributes map<string,string>").json(path)
    return back.selectExpr("candidate_id", "attributes['target'] as target", "attributes['apiKey'] as api_key")


def metric_lines(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of candidates by type and status as lines of text exposition."""
    rows = views.candidates(spark, d, "candidate_type", "candidate_status").groupBy("candidate_type", "candidate_status").agg(F.count(F.lit(1)).alias("n"))
    return stores.prometheus(rows.selectExpr("'candidates' as metric", "map('type', candidate_type, 'status', candidate_status) as labels", "cast(n as double) as value"))


def text_positions(spark: SparkSession, d: str) -> DataFrame:
    """Where the first word of an asset's name occurs again in it."""
    rows = views.assets(spark, d, "source_name").select("object_id", text.label_tokens(text.token_text(F.concat_ws(" ", "source_name", "source_name"))).alias("w")).where("size(w) > 0")
    return rows.select("object_id", F.array_join(F.transform(text.sequence_at(F.col("w"), F.slice("w", 1, 1)), lambda i: i.cast("string")), ",").alias("places"))


def content_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return views.graph(spark, d, "dv", "family").select("edge_id", hashes.fingerprint(F.col("dv"), F.col("source_id"), F.col("target_id"), F.col("family")).alias("fingerprint"))


def style_scores(spark: SparkSession, d: str) -> DataFrame:
    """How an asset's family and its parent's go together as styles do: the same, both known, one unknown."""
    own = views.assets(spark, d, "dv", "asset_id", "parent_id", "network_family")
    above = own.groupBy("dv", F.col("asset_id").alias("parent_id")).agg(F.min("network_family").alias("f"))
    rows = own.join(above, ["dv", "parent_id"])
    value = score.style((F.col("f") == F.col("network_family")) & (F.col("f") != ""), (F.col("f") != "") & (F.col("network_family") != ""))
    return rows.select("object_id", value.alias("style"))


def name_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Names that assets of several versions bear."""
    return views.assets(spark, d, "dv", "source_name").where("source_name != ''").groupBy("source_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dv").alias("n_versions")).where("n > 1")


def planted_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Every line with a copy drawn from its other end: what ``duplicate_lines`` finds."""
    lines = maps._lines(spark, d)
    copies = lines.selectExpr("scope", "concat(line_id, '~') as line_id", "reverse(line) as line")
    return g.duplicate_lines(lines.unionByName(copies)).select("line_id", "first_line", "n_lines")


def planted_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Every line with a copy of its first stretch: what ``overlaps`` finds."""
    lines = maps._lines(spark, d)
    copies = lines.selectExpr("scope", "concat(line_id, '~') as line_id", "slice(line, 1, 2) as line")
    return g.overlaps(lines.unionByName(copies)).where("second_line = concat(first_line, '~')").select("first_line", "second_line")


def planted_labels(spark: SparkSession, d: str) -> DataFrame:
    """Lines named after both ends of each edge: the devices that ``match_labels`` finds in their names."""
    own = views.assets(spark, d, "dv", "asset_id", "source_name", "object_role")
    names = own.where("asset_id != ''").groupBy("dv", "asset_id").agg(F.min("source_name").alias("name"))
    end = lambda c: names.selectExpr("dv", f"asset_id as {c}", f"name as {c}_name")
    lines = views.graph(spark, d, "dv").join(end("source_id"), ["dv", "source_id"]).join(end("target_id"), ["dv", "target_id"]).selectExpr("dv as scope", "edge_id as line_id", "concat_ws(' - ', source_id_name, target_id_name) as name")
    devices = own.where("object_role = 'device_node'").selectExpr("dv as scope", "object_id as device_id", "source_name as name")
    return labels.match_labels(lines, devices, 0).select("line_id", "device_id", "label")


QUERIES = {f.__name__: f for f in (store_upsert, store_merge, version_store, log_lines, metric_lines, text_positions, content_fingerprints, style_scores, name_duplicates, planted_duplicates, planted_overlaps, planted_labels)}

_BOTH = f"""r as (select nullif(lower(trim(edge_id, {views._WS})), '') as edge_id, {views._e('dataset_version_id')} as dv, {views._t('network_family')} as family, lower(trim(store)) as origin, received_at from graph_edges),
  s as (select * from r qualify row_number() over (partition by origin, edge_id order by received_at) = 1)"""
_KEY = lambda line: f"least(array_to_string(list_transform({line}, lambda p: printf('%.10f,%.10f', p[1], p[2])), '|'), array_to_string(list_reverse(list_transform({line}, lambda p: printf('%.10f,%.10f', p[1], p[2]))), '|'))"

SQL = {
    "store_upsert": f"with {_BOTH} select dv, family, origin, count(*) as n from s where origin = 'json' or edge_id not in (select edge_id from s where origin = 'json') group by all",
    "store_merge": f"with {_BOTH} select dv, family, origin, count(*) as n from s where origin = 'postgres' or edge_id not in (select edge_id from s where origin = 'postgres') group by all",
    "version_store": f"with {_BOTH} select dv, origin, count(*) as n from s where dv <> '' and (origin = 'json' or dv not in (select dv from s where origin = 'json')) group by all",
    "log_lines": sql_with("candidates") + " select candidate_id, coalesce(target_id, '') as target, '***' as api_key from candidates where candidate_status = 'confirmed'",
    "metric_lines": sql_with("candidates") + """ select 'candidates{status="' || candidate_status || '",type="' || candidate_type || '"} ' || count(*) as line from candidates group by candidate_status, candidate_type""",
    "text_positions": sql_with("assets") + f", n as (select object_id, {maps._NORM.format(chr(39) + chr(39) + ' || source_name || ' + chr(39) + ' ' + chr(39) + ' || source_name')} as t from assets), x as (select object_id, {maps._WORDS} as w from n) select object_id, array_to_string(list_filter(list_transform(range(1, len(w) + 1), lambda i: case when w[i] = w[1] then i - 1 end), lambda i: i is not null), ',') as places from x where len(w) > 0",
    "content_fingerprints": sql_with("graph") + """ select edge_id, sha256('["' || dv || '","' || source_id || '","' || target_id || '","' || family || '"]') as fingerprint from graph""",
    "style_scores": sql_with("assets") + ", p as (select dv, asset_id, min(network_family) as f from assets group by all) select a.object_id, case when f = network_family and f <> '' then 1.0 when f <> '' and network_family <> '' then 0.25 else 0.5 end::double as style from assets a join p on p.dv = a.dv and p.asset_id = a.parent_id",
    "name_duplicates": sql_with("assets") + " select source_name, count(*) as n, count(distinct dv) as n_versions from assets where source_name <> '' group by all having count(*) > 1",
    "planted_duplicates": sql_with("lines") + f", k as (select dv, geometry_id as line_id, {_KEY('line')} as k from lines union all select dv, geometry_id || '~', {_KEY('list_reverse(line)')} from lines) select line_id, min(line_id) over (partition by dv, k) as first_line, count(*) over (partition by dv, k) as n_lines from k",
    "planted_overlaps": sql_with("lines") + " select geometry_id as first_line, geometry_id || '~' as second_line from lines where line[1] <> line[2]",
    "planted_labels": sql_with("assets", "graph") + f""", nm as (select dv, asset_id, min(source_name) as name from assets where asset_id <> '' group by all), ln as (select g.dv, g.edge_id as line_id, a.name || ' - ' || b.name as source_name from graph g join nm a on a.dv = g.dv and a.asset_id = g.source_id join nm b on b.dv = g.dv and b.asset_id = g.target_id),
      p0 as (select dv, line_id, {maps._WORDS} as w from (select *, {maps._NORM.format('source_name')} as t from ln)), wd as (select dv, object_id, t, {maps._WORDS} as w from (select *, {maps._NORM.format('source_name')} as t from assets where object_role = 'device_node')),
      b as (select *, case when len(w) > 2 and list_contains(['exp', 'extended', 'wp', 'rekomendasi', 'recommendation'], w[-1]) then w[1:-2] else w end as b from wd),
      al as (select dv, object_id, unnest([w, b, case when b[1] = 'jb' and len(b) > 1 then b[2:] end, case when b[1] = 'jb' and b[2] = 'cctv' and len(b) > 2 then ['jb'] || b[3:] end, case when b[1] in ('cam', 'camera', 'kamera') and len(b) > 1 then ['c'] || b[2:] end, case when b[1] = 'server' then ['svr'] end]) as alias from b where len(w) > 0),
      d as (select distinct dv, object_id, array_to_string(alias, ' ') as run from al where alias is not null), k as (select dv, run, min(object_id) as device_id from d group by all having min(object_id) = max(object_id)),
      m as (select dv, max(len(string_split(run, ' '))) as most from d group by all), p as (select dv, line_id, w, most, unnest(range(1, len(w) + 1)) as i from p0 join m using (dv)),
      r as (select dv, line_id, i, n, array_to_string(w[i:i + n - 1], ' ') as run from (select *, unnest(range(1, least(most, len(w) - i + 1) + 1)) as n from p)), f as (select * from r join k using (dv, run)),
      o as (select * from f where not exists (select 1 from f g where g.dv = f.dv and g.line_id = f.line_id and g.i <= f.i and g.i + g.n >= f.i + f.n and g.n > f.n)) select line_id, device_id, run as label from o qualify row_number() over (partition by dv, line_id, device_id order by i, n desc) = 1""",
}
