"""Queries over the graphs of confirmed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import norm_id, trimmed
from ..operators import graph as g
from ..plans.staging import stage
from . import maps, views
from .tables import read
from .views import sql_with


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return views.graph(spark, d, "dv", "direction", "length", "family").selectExpr("dv as scope", "source_id as a", "target_id as b", "direction", "length", "family", "edge_id")


def _links(spark: SparkSession, d: str) -> DataFrame:
    return views.graph(spark, d, "dv").selectExpr("dv as scope", "source_id as a", "target_id as b")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return views.assets(spark, d, "dv", "asset_id", "status").filter("status != 'removed'").select(F.col("dv").alias("scope"), F.col("asset_id").alias("node")).distinct()


def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Degree of every asset; isolated ones have 0."""
    return g.degrees(_edges(spark, d), _nodes(spark, d)).select(F.col("scope").alias("dv"), F.col("node").alias("asset_id"), "degree")


def graph_isolated(spark: SparkSession, d: str) -> DataFrame:
    found = g.degrees(_edges(spark, d), _nodes(spark, d))
    return found.groupBy(F.col("scope").alias("dv")).agg(F.count(F.lit(1)).alias("n_nodes"), F.sum((F.col("degree") == 0).cast("long")).alias("n_isolated"))


def graph_components(spark: SparkSession, d: str) -> DataFrame:
    return g.components(_links(spark, d)).select(F.col("scope").alias("dv"), F.col("node").alias("asset_id"), "component")


def graph_component_summary(spark: SparkSession, d: str) -> DataFrame:
    """Nodes, edges and total length of each component; no length if any edge lacks one."""
    edges = stage(_edges(spark, d))
    parts = stage(g.components(edges))
    sizes = parts.groupBy("scope", "component").agg(F.count(F.lit(1)).alias("n_nodes"))
    own = edges.join(parts.select("scope", F.col("node").alias("a"), "component"), ["scope", "a"]).groupBy("scope", "component").agg(
        F.count(F.lit(1)).alias("n_edges"), F.round(F.when(F.count("length") == F.count(F.lit(1)), F.sum("length")), 3).alias("length")
    )
    return sizes.join(own, ["scope", "component"]).withColumnRenamed("scope", "dv")


def _roots(edges: DataFrame) -> DataFrame:
    return stage(g.survey(edges).filter("node = root").select("scope", "component", "node"))


def graph_roots(spark: SparkSession, d: str) -> DataFrame:
    """The root of each component: the node of most edges, the least id among equals."""
    return g.survey(_links(spark, d)).filter("node = root").selectExpr("scope as dv", "component", "node as root_id")


def trace_hops(spark: SparkSession, d: str) -> DataFrame:
    """Hops of every node from its component's root, whatever the edges' directions."""
    return g.survey(_links(spark, d)).selectExpr("scope as dv", "node as asset_id", "hops")


def trace_downstream(spark: SparkSession, d: str) -> DataFrame:
    """What the roots reach along directed edges."""
    edges = stage(_edges(spark, d))
    return g.reach(g.directed_arcs(edges), _roots(edges).select("scope", "node")).select(F.col("scope").alias("dv"), F.col("node").alias("asset_id"), "hops")


def _upstream(spark: SparkSession, d: str, **limit: int) -> DataFrame:
    edges = stage(_edges(spark, d))
    back = g.directed_arcs(edges).select("scope", F.col("b").alias("a"), F.col("a").alias("b"))
    return g.reach(back, _roots(edges).select("scope", "node"), **limit).select(F.col("scope").alias("dv"), F.col("node").alias("asset_id"), "hops")


def trace_upstream(spark: SparkSession, d: str) -> DataFrame:
    """What leads to the roots along directed edges."""
    return _upstream(spark, d)


def trace_upstream_near(spark: SparkSession, d: str) -> DataFrame:
    """What leads to the roots along directed edges in at most 4 hops."""
    return _upstream(spark, d, most=4)


def trace_paths(spark: SparkSession, d: str) -> DataFrame:
    """Shortest paths from the roots: hops and the node before."""
    edges = stage(_edges(spark, d))
    found = g.shortest_paths(g.both_ways(edges), _roots(edges).select("scope", "node"))
    return found.select(F.col("scope").alias("dv"), F.col("node").alias("asset_id"), "hops", F.col("before").alias("before_id"))


def trace_tainted(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that the roots reach through at least one undirected edge."""
    edges = stage(_edges(spark, d))
    found = g.tainted(g.directed_arcs(edges), edges.filter("direction = 'undirected'"), _roots(edges).select("scope", "node"))
    return found.select(F.col("scope").alias("dv"), F.col("node").alias("asset_id"))


def trace_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why a downstream trace from an asset to its upstream asset finds no path, or that it does: isolated, other component, against the direction."""
    edges = stage(_edges(spark, d))
    parts = stage(g.components(edges))
    asked = views.assets(spark, d, "dv", "asset_id", "upstream_id").filter("upstream_id is not null").select(F.col("dv").alias("scope"), F.col("asset_id").alias("node"), F.col("upstream_id").alias("target")).distinct()
    part = lambda c: parts.select("scope", F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
    joined = asked.join(part("node"), ["scope", "node"], "left").join(part("target"), ["scope", "target"], "left")
    direct = edges.select("scope", F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("target")), F.struct(F.col("b").alias("node"), F.col("a").alias("target"))))).distinct().withColumn("adjacent", F.lit(True))
    joined = joined.join(direct, ["scope", "node", "target"], "left")
    reason = (
        F.when(F.col("adjacent"), "adjacent").when(F.col("node_part").isNull(), "isolated_source").when(F.col("target_part").isNull(), "isolated_target").when(F.col("node_part") != F.col("target_part"), "different_component").otherwise("connected")
    )
    return joined.groupBy(F.col("scope").alias("dv"), reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def impact_failure(spark: SparkSession, d: str) -> DataFrame:
    """What is cut off from each root when its best linked neighbour fails."""
    return g.root_failures(_links(spark, d)).selectExpr("scope as dv", "node as asset_id")


def impact_groups(spark: SparkSession, d: str) -> DataFrame:
    """The cut-off assets by site and category."""
    lost = g.root_failures(_links(spark, d))
    own = views.assets(spark, d, "dv", "asset_id", "site_id", "category").groupBy(F.col("dv").alias("scope"), F.col("asset_id").alias("node")).agg(F.min("site_id").alias("site_id"), F.min("category").alias("category"))
    return lost.join(own, ["scope", "node"], "left").groupBy(F.col("scope").alias("dv"), F.coalesce("site_id", F.lit("unknown")).alias("site_id"), F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count(F.lit(1)).alias("n_assets"))


def graph_directions(spark: SparkSession, d: str) -> DataFrame:
    """Whether all, some or none of a version's edges are directed."""
    directed = F.sum((F.col("direction") != "undirected").cast("long"))
    rows = _edges(spark, d).groupBy(F.col("scope").alias("dv")).agg(F.count(F.lit(1)).alias("n_edges"), directed.alias("n_directed"))
    return rows.withColumn("coverage", F.when(F.col("n_directed") == F.col("n_edges"), "complete").when(F.col("n_directed") > 0, "partial").otherwise("none"))


def graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of each asset with the first edge that links them."""
    arcs = _edges(spark, d).select("scope", F.inline(F.array(F.struct("a", "b", "edge_id"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "edge_id"))))
    return arcs.groupBy(F.col("scope").alias("dv"), F.col("a").alias("asset_id"), F.col("b").alias("neighbour_id")).agg(F.min("edge_id").alias("edge_id"))


def graph_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """Edges between active cameras and junction boxes: the induced subgraph."""
    nodes = views.assets(spark, d).filter("status = 'active' and category in ('cctv_camera', 'junction_box')").select(F.col("dv").alias("scope"), F.col("asset_id").alias("node")).distinct()
    return g.within(_edges(spark, d), nodes).select(F.col("scope").alias("dv"), "edge_id")


def relation_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """One edge for each unordered pair of ends and family: confirmed first, then known length, then the least id."""
    rows = views.edges(spark, d).filter("source_id is not null and target_id is not null")
    rank = F.struct((F.col("verification") != "confirmed").alias("v"), F.col("length").isNull().alias("l"), "edge_id")
    kept = rows.groupBy("dv", F.least("source_id", "target_id").alias("first_id"), F.greatest("source_id", "target_id").alias("second_id"), "family").agg(F.min(rank).alias("r"), F.count(F.lit(1)).alias("n_edges"))
    return kept.select("dv", "first_id", "second_id", "family", F.col("r.edge_id").alias("edge_id"), "n_edges")


def graph_validation(spark: SparkSession, d: str) -> DataFrame:
    """Findings per version: loops, unconfirmed, dangling and duplicate edges, ends without asset."""
    edges = views.edges(spark, d)
    nodes = views.assets(spark, d).select("dv", F.col("asset_id").alias("node"), F.lit(True).alias("held")).distinct()
    end = lambda c: nodes.select("dv", F.col("node").alias(c), F.col("held").alias(f"{c}_held"))
    rows = edges.join(end("source_id"), ["dv", "source_id"], "left").join(end("target_id"), ["dv", "target_id"], "left")
    pair = Window.partitionBy("dv", F.least("source_id", "target_id"), F.greatest("source_id", "target_id"), "family")
    rows = rows.withColumn("same", F.when(F.col("source_id").isNotNull() & F.col("target_id").isNotNull(), F.count(F.lit(1)).over(pair)))
    codes = F.array(
        F.when(F.col("verification") != "confirmed", "non_confirmed_edge_in_graph"), F.when(F.col("source_id").isNull() | F.col("target_id").isNull(), "dangling_edge"), F.when(F.col("source_id") == F.col("target_id"), "accidental_self_loop"),
        F.when(F.col("same") > 1, "duplicate_edge"), F.when((F.col("source_id").isNotNull() & F.col("source_id_held").isNull()) | (F.col("target_id").isNotNull() & F.col("target_id_held").isNull()), "unknown_asset"),
    )
    return rows.select("dv", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code")).groupBy("dv", "code").agg(F.count(F.lit(1)).alias("n"))


def collapsed_edges(spark: SparkSession, d: str) -> DataFrame:
    """Devices that confirmed candidates attach one after the other to the same cable, that is to a line and those it runs on into, as edges."""
    rows = views.candidates(spark, d).filter("candidate_status = 'confirmed' and target_id is not null")
    parts = lambda k: F.nullif(F.regexp_extract("endpoint_id", "^endpoint:(.*):(start|inline|end)$", k), F.lit(""))
    place = F.when(parts(2) == "start", 0).when(parts(2) == "inline", 1).otherwise(2)
    attached = rows.select(F.col("dv").alias("scope"), parts(1).alias("line"), place.alias("place"), F.col("target_id").alias("device"))
    end = lambda c, k: F.regexp_extract(c, "^(.*):(start|end)$", k)
    joints = maps.continuations(spark, d).select("scope", end("first_end", 1).alias("a"), end("first_end", 2).alias("a_end"), end("second_end", 1).alias("b"), end("second_end", 2).alias("b_end"))
    return g.collapse(attached, joints).select(F.col("scope").alias("dv"), F.col("a").alias("first_id"), F.col("b").alias("second_id"), F.col("cable").alias("line_id"))


def relation_delta(spark: SparkSession, d: str) -> DataFrame:
    """Edges of one store against the other, as sets of ids per version: added, removed, retained."""
    rows = read(spark, d, "graph_edges").select(F.lower(trimmed("store")).alias("store"), F.coalesce(norm_id("dataset_version_id"), F.lit("")).alias("dv"), norm_id("edge_id").alias("edge_id")).distinct()
    held = rows.groupBy("dv", "edge_id").agg(F.max((F.col("store") == "postgres").cast("int")).alias("p"), F.max((F.col("store") == "json").cast("int")).alias("j"))
    kind = F.when((F.col("p") == 1) & (F.col("j") == 1), "retained").when(F.col("j") == 1, "added").otherwise("removed")
    return held.groupBy("dv", kind.alias("change")).agg(F.count(F.lit(1)).alias("n_edges"))


QUERIES = {f.__name__: f for f in (
    graph_degrees, graph_isolated, graph_components, graph_component_summary, graph_roots, trace_hops, trace_downstream, trace_upstream, trace_upstream_near, trace_paths, trace_tainted, trace_reasons, impact_failure, impact_groups,
    graph_directions, graph_neighbours, graph_subgraph, relation_dedupe, graph_validation, collapsed_edges, relation_delta,
)}

_BOTH = "arcs as (select dv, source_id as a, target_id as b from graph union select dv, target_id, source_id from graph)"
_PARTS = "walk as (select dv, a as node, a as r from arcs union select w.dv, x.b, w.r from walk w join arcs x on x.dv = w.dv and x.a = w.node and w.r < x.b), parts as (select dv, node, min(r) as component from walk group by all)"
_DEGREE = "ends as (select dv, source_id as node from graph union all select dv, target_id from graph), degree as (select dv, node, count(*) as degree from ends group by all)"
_ROOTS = "roots as (select dv, component, (min((-degree, node)))[2] as node from parts join degree using (dv, node) group by all)"
_DIRECTED = "directed as (select dv, source_id as a, target_id as b from graph where direction in ('source_to_target', 'bidirectional') union select dv, target_id, source_id from graph where direction in ('target_to_source', 'bidirectional'))"


def _walk(name: str, arcs: str, starts: str, more: str = "") -> str:
    return f"{name} as (select dv, node, 0 as hops from {starts} union select w.dv, x.b, w.hops + 1 from {name} w join {arcs} x on x.dv = w.dv and x.a = w.node where w.hops < 60 {more})"


_FULL = sql_with("graph", recursive=True) + f", {_BOTH}, {_PARTS}, {_DEGREE}, {_ROOTS}"
_LOST = f"""{_FULL}, near as (select r.dv, r.component, a.b as node, degree from roots r join arcs a on a.dv = r.dv and a.a = r.node join degree d on d.dv = r.dv and d.node = a.b),
  failed as (select dv, (min((-degree, node)))[2] as node from near group by dv, component),
  safe as (select * from arcs x where not exists (select 1 from failed f where f.dv = x.dv and f.node in (x.a, x.b))),
  after_ as (select dv, node from roots union select w.dv, x.b from after_ w join safe x on x.dv = w.dv and x.a = w.node),
  lost as (select dv, node from parts where (dv, node) not in (select dv, node from after_) and (dv, node) not in (select dv, node from failed))"""

SQL = {
    "graph_degrees": sql_with("assets", "graph") + " select dv, asset_id, sum(n)::bigint as degree from (select dv, source_id as asset_id, 1 as n from graph union all select dv, target_id, 1 from graph union all (select distinct dv, asset_id, 0 from assets where status <> 'removed')) group by all",
    "graph_isolated": sql_with("assets", "graph") + ", d as (select dv, asset_id, sum(n)::bigint as degree from (select dv, source_id as asset_id, 1 as n from graph union all select dv, target_id, 1 from graph union all (select distinct dv, asset_id, 0 from assets where status <> 'removed')) group by all) select dv, count(*) as n_nodes, count(*) filter (degree = 0) as n_isolated from d group by all",
    "graph_components": _FULL + " select dv, node as asset_id, component from parts",
    "graph_component_summary": _FULL + ", s as (select dv, component, count(*) as n_nodes from parts group by all), e as (select g.dv, component, count(*) as n_edges, round(case when count(length) = count(*) then sum(length) end, 3) as length from graph g join parts p on p.dv = g.dv and p.node = g.source_id group by all) select * from s join e using (dv, component)",
    "graph_roots": _FULL + " select dv, component, node as root_id from roots",
    "trace_hops": _FULL + ", " + _walk("w", "arcs", "roots") + " select dv, node as asset_id, min(hops)::int as hops from w group by all",
    "trace_downstream": _FULL + f", {_DIRECTED}, " + _walk("w", "directed", "roots") + " select dv, node as asset_id, min(hops)::int as hops from w group by all",
    "trace_upstream": _FULL + f", {_DIRECTED}, back as (select dv, b as a, a as b from directed), " + _walk("w", "back", "roots", "and w.hops < 4") + " select dv, node as asset_id, min(hops)::int as hops from w group by all",
    "trace_paths": _FULL + ", " + _walk("w", "arcs", "roots") + ", h as (select dv, node, min(hops)::int as hops from w group by all), s as (select x.dv, x.b as node, min(x.a) as before_id from arcs x join h p on p.dv = x.dv and p.node = x.a join h q on q.dv = x.dv and q.node = x.b where q.hops = p.hops + 1 group by all) select dv, node as asset_id, hops, before_id from h left join s using (dv, node)",
    "trace_tainted": _FULL + f", {_DIRECTED}, loose as (select dv, source_id as a, target_id as b from graph where direction = 'undirected' union select dv, target_id, source_id from graph where direction = 'undirected'), step as (select dv, a, b, 0 as t from directed union select dv, a, b, 1 from loose), w as (select dv, node, 0 as t from roots union select w.dv, s.b, greatest(w.t, s.t) from w join step s on s.dv = w.dv and s.a = w.node) select dv, node as asset_id from w where t = 1",
    "trace_reasons": sql_with("assets", "graph", recursive=True) + f", {_BOTH}, {_PARTS}, q as (select distinct dv, asset_id, upstream_id from assets where upstream_id is not null) select q.dv, case when exists (select 1 from arcs x where x.dv = q.dv and x.a = q.asset_id and x.b = q.upstream_id) then 'adjacent' when s.component is null then 'isolated_source' when t.component is null then 'isolated_target' when s.component <> t.component then 'different_component' else 'connected' end as reason, count(*) as n from q left join parts s on s.dv = q.dv and s.node = q.asset_id left join parts t on t.dv = q.dv and t.node = q.upstream_id group by all",
    "impact_failure": _LOST + " select dv, node as asset_id from lost",
    "impact_groups": _LOST.replace("with recursive ", "with recursive " + sql_with("assets")[len("with "):] + ", ", 1) + ", own as (select dv, asset_id as node, min(site_id) as site_id, min(category) as category from assets group by all) select dv, coalesce(site_id, 'unknown') as site_id, coalesce(category, 'unknown') as category, count(*) as n_assets from lost left join own using (dv, node) group by all",
    "graph_directions": sql_with("graph") + " select dv, n_edges, n_directed, case when n_directed = n_edges then 'complete' when n_directed > 0 then 'partial' else 'none' end as coverage from (select dv, count(*) as n_edges, count(*) filter (direction <> 'undirected') as n_directed from graph group by all)",
    "graph_neighbours": sql_with("graph") + " select dv, asset_id, neighbour_id, min(edge_id) as edge_id from (select dv, source_id as asset_id, target_id as neighbour_id, edge_id from graph union all select dv, target_id, source_id, edge_id from graph) group by all",
    "graph_subgraph": sql_with("assets", "graph") + ", n as (select distinct dv, asset_id from assets where status = 'active' and category in ('cctv_camera', 'junction_box')) select g.dv, edge_id from graph g where (g.dv, source_id) in (select dv, asset_id from n) and (g.dv, target_id) in (select dv, asset_id from n)",
    "relation_dedupe": sql_with("edges") + " select dv, least(source_id, target_id) as first_id, greatest(source_id, target_id) as second_id, family, arg_min(edge_id, (verification <> 'confirmed', length is null, edge_id)) as edge_id, count(*) as n_edges from edges where source_id is not null and target_id is not null group by 1, 2, 3, 4",
    "graph_validation": sql_with("assets", "edges") + """, n as (select distinct dv, asset_id from assets), e as (select *, (dv, source_id) in (select dv, asset_id from n) as s, (dv, target_id) in (select dv, asset_id from n) as t, count(*) over (partition by dv, least(source_id, target_id), greatest(source_id, target_id), family) as same from edges)
      select dv, code, count(*) as n from (select dv, unnest([case when verification <> 'confirmed' then 'non_confirmed_edge_in_graph' end, case when source_id is null or target_id is null then 'dangling_edge' end, case when source_id = target_id then 'accidental_self_loop' end,
      case when source_id is not null and target_id is not null and same > 1 then 'duplicate_edge' end, case when (source_id is not null and not s) or (target_id is not null and not t) then 'unknown_asset' end]) as code from e) where code is not null group by all""",
    "collapsed_edges": sql_with("candidates") + """, a as (select dv, regexp_extract(endpoint_id, '^endpoint:(.*):(start|inline|end)$', 1) as line, case regexp_extract(endpoint_id, '^endpoint:(.*):(start|inline|end)$', 2) when 'start' then 0 when 'inline' then 1 else 2 end as place, target_id as device from candidates where candidate_status = 'confirmed' and target_id is not null and endpoint_id like 'endpoint:%'),
      n as (select *, lead(device) over (partition by dv, line order by place, device) as nxt from a) select dv, least(device, nxt) as first_id, greatest(device, nxt) as second_id, min(line) as line_id from n where nxt is not null and nxt <> device group by 1, 2, 3""",
    "relation_delta": "with r as (select distinct lower(trim(store)) as store, coalesce(nullif(lower(trim(dataset_version_id, ' ' || chr(9) || chr(10) || chr(160) || chr(8195))), ''), '') as dv, nullif(lower(trim(edge_id, ' ' || chr(9) || chr(10) || chr(160) || chr(8195))), '') as edge_id from graph_edges), h as (select dv, edge_id, bool_or(store = 'postgres') as p, bool_or(store = 'json') as j from r group by all) select dv, case when p and j then 'retained' when j then 'added' else 'removed' end as change, count(*) as n_edges from h group by all",
}
SQL["trace_upstream_near"] = SQL["trace_upstream"]  # this SQL stops at 4 hops
