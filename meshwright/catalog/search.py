"""Queries over the catalog of assets, candidates and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, hashes, score, text
from ..functions.ids import id_or_empty, norm_id, text_or_empty, trimmed
from ..operators import classify, copies, ranking
from . import views
from .tables import read
from .views import sql_with

QUERY = "cctv fixed"
FACETS = ["site_id", "network_family", "category", "asset_type", "object_role", "classification_status", "status"]
BOX = (95.0, -11.0, 100.0, -10.0)


def catalog_assets(spark: SparkSession, d: str) -> DataFrame:
    """Assets with their geometries, box and topology status."""
    places = views.points(spark, d).groupBy("dv", "feature_id").agg(*map(F.expr, ("count(1) as n_points", "min(lon) as west", "min(lat) as south", "max(lon) as east", "max(lat) as north")))
    ends = views.graph(spark, d, "dv", "source_id", "target_id").selectExpr("dv", "explode(array(source_id, target_id)) as asset_id", "1 as e", "0 as c")
    open_ = views.candidates(spark, d, "dv", "candidate_status", "target_id").where("candidate_status not in ('rejected', 'skipped', 'revoked') and target_id is not null").selectExpr("dv", "target_id as asset_id", "0 as e", "1 as c")
    links = ends.unionByName(open_).groupBy("dv", "asset_id").agg(F.expr("sum(e) as n_edges"), F.expr("sum(c) as n_candidates"))
    own = views.assets(spark, d, "dv", "asset_id", "feature_id", "object_role").where("object_role != 'visual_only'").select("object_id", "dv", "asset_id", "feature_id")
    joined = own.join(places.where("feature_id != ''"), ["dv", "feature_id"], "left").join(links.where("asset_id != ''"), ["dv", "asset_id"], "left")
    return joined.selectExpr(
        "object_id", "coalesce(n_points, 0) as n_points", "west", "south", "east", "north", "coalesce(n_edges, 0) as n_edges", "coalesce(n_candidates, 0) as n_candidates",
        "case when n_edges > 0 then 'connected' when n_candidates > 0 then 'pending-review' else 'isolated' end as topology_status",
    )


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    low = lambda c: F.lower(F.col(c))
    rank = ranking.search_rank(QUERY, [low("asset_id"), F.col("object_id")], low("source_name"), [low("asset_type"), low("category")], [low("site_id")])
    return views.assets(spark, d, "asset_id", "source_name", "asset_type", "category", "site_id", "object_role").filter("object_role != 'visual_only'").select("object_id", low("source_name").alias("name"), "asset_id", rank.alias("rank")).filter("rank is not null")


def catalog_search(spark: SparkSession, d: str) -> DataFrame:
    """First page of a search: 50 hits by rank, name and id."""
    return ranking.page_by_offset(_ranked(spark, d), [F.desc("rank"), F.col("name"), F.col("object_id")], 50)


def catalog_search_next(spark: SparkSession, d: str) -> DataFrame:
    """Second page of the same."""
    return ranking.page_by_offset(_ranked(spark, d), [F.desc("rank"), F.col("name"), F.col("object_id")], 50, 50)


def catalog_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Hits by rank over the whole catalog."""
    return _ranked(spark, d).groupBy("rank").agg(F.count(F.lit(1)).alias("n_hits"))


def catalog_facets(spark: SparkSession, d: str) -> DataFrame:
    return ranking.facets(views.assets(spark, d, *FACETS), FACETS)


def catalog_sites(spark: SparkSession, d: str) -> DataFrame:
    """Assets, points, box and points outside the box of interest for each site."""
    own = views.assets(spark, d, "dv", "feature_id", "site_id", "object_role").filter("object_role != 'visual_only'")
    counts = own.groupBy("site_id").agg(F.count(F.lit(1)).alias("n_assets"))
    inside = geo.boxes_meet([F.col("lon"), F.col("lat"), F.col("lon"), F.col("lat")], [F.lit(v) for v in BOX])
    places = views.of_features(views.points(spark, d), own.select("dv", "feature_id", "site_id")).groupBy("site_id").agg(
        F.count(F.lit(1)).alias("n_points"), F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"), F.sum((~inside).cast("long")).alias("n_outside")
    )
    return counts.join(places, "site_id", "left").na.fill(0, ["n_points", "n_outside"])


def catalog_box(spark: SparkSession, d: str) -> DataFrame:
    """Lines and points whose box meets a box."""
    axis = lambda c: F.transform("line", lambda p: p[c])
    lines = views.lines(spark, d).select("geometry_id", *[f(axis(c)).alias(n) for n, f, c in (("west", F.array_min, "lon"), ("south", F.array_min, "lat"), ("east", F.array_max, "lon"), ("north", F.array_max, "lat"))])
    points = views.points(spark, d).select("geometry_id", F.col("lon").alias("west"), F.col("lat").alias("south"), F.col("lon").alias("east"), F.col("lat").alias("north"))
    return lines.unionByName(points).filter(geo.boxes_meet([F.col(c) for c in ("west", "south", "east", "north")], [F.lit(v) for v in BOX])).select("geometry_id")


def catalog_filters(spark: SparkSession, d: str) -> DataFrame:
    """Several filters at once: families, roles, a list of categories, the state."""
    return views.assets(spark, d).filter("network_family in ('cctv', 'lan') and object_role = 'device_node' and category in ('cctv_camera', 'junction_box', 'network_device') and status = 'active' and classification_score >= 0.5").select("object_id")


def catalog_summary(spark: SparkSession, d: str) -> DataFrame:
    return views.geometries(spark, d, "feature_id", "kind", "valid").groupBy("kind", "valid").agg(F.count(F.lit(1)).alias("n_geometries"), F.count_distinct("feature_id").alias("n_features"))


def catalog_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Asset names that occur more than once in a version."""
    return views.assets(spark, d).filter("source_name != ''").groupBy("dv", "source_name").agg(F.count(F.lit(1)).alias("n"), F.min("asset_id").alias("first_id")).filter("n > 1")


def catalog_inventory(spark: SparkSession, d: str) -> DataFrame:
    """What is missing in each version's inventory."""
    missing = lambda c: F.sum((F.col(c) == "").cast("long")).alias(f"no_{c}")
    return views.assets(spark, d).groupBy("dv").agg(
        F.count(F.lit(1)).alias("n_assets"), *[missing(c) for c in ("asset_id", "source_name", "site_id", "asset_type", "category")], F.sum(F.col("parent_id").isNull().cast("long")).alias("no_parent"), F.sum((F.col("classification_status") != "classified").cast("long")).alias("not_classified")
    )


def catalog_networks(spark: SparkSession, d: str) -> DataFrame:
    """Geometries of each family by kind, with their box."""
    own = views.assets(spark, d, "dv", "feature_id", "network_family").select("dv", "feature_id", "network_family")
    places = views.points(spark, d).select("dv", "feature_id", F.lit("point").alias("kind"), F.col("lon").alias("x0"), F.col("lon").alias("x1"))
    lines = views.lines(spark, d).select("dv", "feature_id", F.lit("line").alias("kind"), F.array_min(F.transform("line", lambda p: p["lon"])).alias("x0"), F.array_max(F.transform("line", lambda p: p["lon"])).alias("x1"))
    return views.of_features(places.unionByName(lines), own).groupBy("network_family", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("west"), F.max("x1").alias("east"))


def catalog_numbered(spark: SparkSession, d: str) -> DataFrame:
    """Asset ids made unique across versions: the n-th version of an asset gets ``:n``."""
    return ranking.numbered(views.assets(spark, d).select("asset_id", "object_id"), "asset_id", ["object_id"]).select("object_id", "numbered")


def pole_groups(spark: SparkSession, d: str) -> DataFrame:
    """Children of each parent asset."""
    return views.assets(spark, d).filter("parent_id is not null").groupBy("dv", "parent_id").agg(F.count(F.lit(1)).alias("n_children"), F.min("source_name").alias("first_child"))


def classify_names(spark: SparkSession, d: str) -> DataFrame:
    """Role and family of each asset by the words of its name and the kinds of its geometries."""
    kinds = views.geometries(spark, d, "dv", "feature_id", "kind", "valid").filter("valid and feature_id != ''").groupBy("dv", "feature_id").agg(F.collect_set("kind").alias("kinds"))
    rows = views.assets(spark, d, "dv", "feature_id", "source_name").select("object_id", "dv", "feature_id", text.token_text(F.col("source_name")).alias("t")).join(kinds, ["dv", "feature_id"], "left").withColumn("kinds", F.expr("coalesce(kinds, cast(array() as array<string>))"))
    found = classify.first_rule("t", "kinds")
    return rows.select("object_id", found.alias("f")).select("object_id", F.coalesce("f.role", F.lit("unknown")).alias("role"), F.coalesce("f.family", F.lit("unknown")).alias("family"))


def classify_agreement(spark: SparkSession, d: str) -> DataFrame:
    """The rules' roles against the stored ones."""
    stored = views.assets(spark, d, "object_role").select("object_id", "object_role")
    return classify_names(spark, d).join(stored, "object_id").groupBy("object_role", "role").agg(F.count(F.lit(1)).alias("n"))


def vocabulary_exact(spark: SparkSession, d: str) -> DataFrame:
    """Types that are a canonical value, its label or an alias as they stand."""
    terms = read(spark, d, "vocabulary_terms").filter("field_name = 'asset_type'")
    names = terms.select("canonical_value", F.explode(F.concat(F.array("canonical_value", "label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).filter("name is not null").groupBy(F.lower("name").alias("name")).agg(F.min("canonical_value").alias("canonical_value"))
    return views.assets(spark, d).select("object_id", F.lower("asset_type").alias("name")).join(names, "name").select("object_id", "canonical_value")


def payload_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Leaves of the versions' documents, counted by path."""
    rows = read(spark, d, "dataset_versions").select(norm_id("dataset_version_id").alias("id"), F.map_keys(copies.json_leaves("payload", "payload")).alias("k")).select("id", F.explode("k").alias("path")).distinct()
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("n_versions"))


def candidate_counts(spark: SparkSession, d: str) -> DataFrame:
    return views.candidates(spark, d).groupBy("dv", "candidate_status").agg(F.count(F.lit(1)).alias("n"))


def candidate_page(spark: SparkSession, d: str) -> DataFrame:
    """A page by key behind a cursor: score from the highest, then id."""
    rows = views.candidates(spark, d).select("candidate_id", "score", "candidate_type", "distance")
    return ranking.page_by_key(rows, "score", "candidate_id", 100, (0.8, ""))


def candidate_filter(spark: SparkSession, d: str) -> DataFrame:
    return views.candidates(spark, d).filter("candidate_status in ('candidate', 'ambiguous') and network_family = 'fiber_optic' and proposal_status = 'recommended' and score between 0.5 and 0.9 and distance <= 5").select("candidate_id")


def _decided(spark: SparkSession, d: str) -> DataFrame:
    inline = F.col("candidate_type") == "inline_device"
    key = F.when(inline, F.concat(F.lit("inline:"), F.coalesce("target_id", F.lit("")))).otherwise(F.concat(F.lit("endpoint:"), F.coalesce("endpoint_id", F.lit(""))))
    rows = views.candidates(spark, d).filter("endpoint_id is not null").withColumn("decision", key)
    return ranking.decisions(rows, ["dv", "decision"], "score", "candidate_id")


def candidate_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Each candidate's place in its decision, and what follows from scores alone."""
    rows = _decided(spark, d)
    best = Window.partitionBy("dv", "decision")
    top, margin = F.max(F.when(F.col("place") == 1, F.col("score"))).over(best), F.max(F.when(F.col("place") == 1, F.col("margin"))).over(best)
    status = (
        F.when(F.coalesce(top, F.lit(0.0)) < score.ACCEPTANCE, "below_threshold").when((F.col("n_group") > 1) & (margin < score.MARGIN), "ambiguous").when(F.col("place") == 1, "recommended").otherwise("not_selected")
    )
    return rows.select("candidate_id", "place", F.round("margin", 6).alias("margin"), status.alias("outcome"))


def candidate_best(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).filter("place = 1").select("dv", "decision", "candidate_id")


def candidate_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Ends of lines with more than one confirmed candidate."""
    rows = views.candidates(spark, d).filter("candidate_status = 'confirmed' and endpoint_id is not null")
    return ranking.conflicts(rows, ["dv", "endpoint_id"], "candidate_id")


def candidate_queues(spark: SparkSession, d: str) -> DataFrame:
    """Review queues: data issues, choices to make, ready ones."""
    queue = F.when(F.col("endpoint_id").isNull() | F.col("target_id").isNull(), "data_issues").when((F.col("proposal_status") == "needs_choice") | (F.col("candidate_status") == "ambiguous"), "needs_choice").otherwise("ready")
    return views.candidates(spark, d).filter("candidate_status in ('candidate', 'ambiguous')").groupBy("dv", queue.alias("queue")).agg(F.count(F.lit(1)).alias("n"))


def _free(spark: SparkSession, d: str) -> DataFrame:
    free = F.greatest(F.coalesce("capacity", F.lit(0)) - F.coalesce("occupancy", F.lit(0)), F.lit(0))
    return views.interfaces(spark, d).filter("status = 'active' and owner_id is not null").groupBy("dv", F.col("owner_id").alias("target_id")).agg(F.sum(free).alias("free"))


def capacity_allocation(spark: SparkSession, d: str) -> DataFrame:
    """Confirmed and open candidates take the free places of their target's interfaces in order of score."""
    rows = views.candidates(spark, d).filter("candidate_status in ('confirmed', 'candidate') and target_id is not null").select("dv", "target_id", "candidate_id", "score")
    return ranking.allocate(rows, _free(spark, d), ["dv", "target_id"], "score", "candidate_id").select("candidate_id", "place", "accepted")


def port_allocation(spark: SparkSession, d: str) -> DataFrame:
    """The n-th confirmed candidate of an asset gets its n-th interface."""
    left = views.candidates(spark, d).filter("candidate_status = 'confirmed' and target_id is not null").select("dv", F.col("target_id").alias("asset_id"), "candidate_id")
    right = views.interfaces(spark, d).filter("status = 'active' and owner_id is not null").select("dv", F.col("owner_id").alias("asset_id"), "interface_id")
    return ranking.pair_by_place(left, right, ["dv", "asset_id"], ["candidate_id"], ["interface_id"]).select("candidate_id", "interface_id")


def interface_occupancy(spark: SparkSession, d: str) -> DataFrame:
    """Interfaces by type: how many are over, full, part used, free."""
    state = F.when(F.col("occupancy") > F.col("capacity"), "over").when(F.col("occupancy") == F.col("capacity"), "full").when(F.col("occupancy") > 0, "part").otherwise("free")
    return views.interfaces(spark, d).groupBy("interface_type", state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.sum("capacity").alias("capacity"), F.sum("occupancy").alias("occupancy"))


def interface_compatibility(spark: SparkSession, d: str) -> DataFrame:
    """Candidates against the interfaces of their target: those whose medium and domain fit the candidate's family."""
    medium = F.when(F.col("network_family") == "fiber_optic", "fiber").when(F.col("network_family") == "lan", "copper").otherwise("unknown")
    rows = views.candidates(spark, d).filter("target_id is not null").select("dv", F.col("target_id").alias("owner_id"), "candidate_id", medium.alias("medium"))
    ports = views.interfaces(spark, d).filter("status = 'active' and owner_id is not null and service_domain != 'mounting'").select("dv", "owner_id", "interface_id", "media_type", F.coalesce("is_proxy", F.lit(False)).alias("proxy"))
    fits = (F.col("medium") == "unknown") | (F.col("media_type") == "unknown") | (F.col("medium") == F.col("media_type"))
    met = rows.join(ports, ["dv", "owner_id"]).filter(fits).withColumn("fit", F.when(F.col("proxy"), 0.85).otherwise(1.0))
    return ranking.first_per(met, ["candidate_id"], [F.desc("fit"), F.col("interface_id")]).select("candidate_id", "interface_id", "fit")


def accuracy_report(spark: SparkSession, d: str) -> DataFrame:
    """How well recommendations foretell confirmations, by type and distance."""
    rows = views.candidates(spark, d).filter("candidate_status in ('confirmed', 'rejected', 'revoked')").withColumn("stratum", score.stratum(F.col("distance")))
    return ranking.precision_recall(rows, ["candidate_type", "stratum"], F.col("proposal_status") == "recommended", F.col("candidate_status") == "confirmed")


def version_diff(spark: SparkSession, d: str) -> DataFrame:
    """Assets of each version against the one before it in its dataset and branch, with the risk of each change."""
    versions = read(spark, d, "dataset_versions").filter(F.lower(trimmed("store")) == "postgres").select(norm_id("dataset_version_id").alias("dv"), id_or_empty("dataset_id").alias("dataset"), "created_at").groupBy("dv").agg(F.min("dataset").alias("dataset"), F.min("created_at").alias("made"))
    before = F.lag("dv").over(Window.partitionBy("dataset").orderBy("made", "dv"))
    steps = versions.withColumn("previous", before).filter("previous is not null").select("dv", "previous")
    tracked = ["source_name", "object_role", "network_family", "category", "asset_type", "site_id", "status"]
    own = views.assets(spark, d).filter("asset_id != ''").groupBy("dv", "asset_id").agg(F.min(F.struct(*tracked)).alias("v"))
    new = own.join(steps, "dv").select("dv", "asset_id", F.col("v").alias("n"))
    old = own.withColumnRenamed("dv", "previous").join(steps, "previous").select("dv", "asset_id", F.col("v").alias("o"))
    change = lambda kind, risk, field="": F.struct(F.lit(kind).alias("change_type"), F.lit(risk).alias("risk"), F.lit(field).alias("field_name"))
    differ = F.filter(F.array(*[F.when(F.col(f"o.{f}") != F.col(f"n.{f}"), change("site_changed" if f == "site_id" else "asset_metadata_changed", "high" if f == "site_id" else "medium", f)) for f in tracked]), lambda x: x.isNotNull())
    found = F.when(F.col("o").isNull(), F.array(change("asset_added", "medium"))).when(F.col("n").isNull(), F.array(change("asset_removed", "high"))).otherwise(differ)
    return old.join(new, ["dv", "asset_id"], "full_outer").select("dv", "asset_id", F.inline(found))


def version_diff_summary(spark: SparkSession, d: str) -> DataFrame:
    return version_diff(spark, d).groupBy("dv", "change_type", "risk").agg(F.count(F.lit(1)).alias("n"))


def content_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of edges made from what they link."""
    return views.graph(spark, d).select("edge_id", hashes.content_id("edge", F.col("dv"), F.least("source_id", "target_id"), F.greatest("source_id", "target_id"), F.col("family")).alias("content_id"))


def graph_revisions(spark: SparkSession, d: str) -> DataFrame:
    """A hash of each version's graph that doesn't depend on the order of rows."""
    return hashes.revision(views.graph(spark, d), ["dv"], ["edge_id", "source_id", "target_id", "family"])


def parity_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows, records and ids of each table."""
    keys = {"source_geometries": "source_geometry_id", "classified_objects": "classified_object_id", "topology_components": "component_id", "topology_interfaces": "interface_id", "topology_candidates": "candidate_id", "graph_edges": "edge_id", "dataset_versions": "dataset_version_id"}
    out = None
    for table, key in keys.items():
        one = read(spark, d, table).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(norm_id(key)).alias("n_ids")).select(F.lit(table).alias("table_name"), "n_rows", "n_ids")
        out = one if out is None else out.unionByName(one)
    return out


def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative buckets of event values by type."""
    return ranking.histogram(read(spark, d, "events"), ["event_type"], "value", [1, 5, 10, 25, 50, 100])


def metric_families(spark: SparkSession, d: str) -> DataFrame:
    """Gauges in one table: candidates by type and status, assets by role, interfaces by type."""
    gauge = lambda rows, name, a, b: rows.groupBy(F.lit(name).alias("metric"), F.col(a).alias("label_one"), F.col(b).alias("label_two")).agg(F.count(F.lit(1)).alias("value"))
    return gauge(views.candidates(spark, d), "candidates", "candidate_type", "candidate_status").unionByName(gauge(views.assets(spark, d), "assets", "object_role", "network_family")).unionByName(gauge(views.interfaces(spark, d), "interfaces", "interface_type", "service_domain"))


def late_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """How long after their making records arrived, by day."""
    rows = read(spark, d, "classified_objects").select(norm_id("classified_object_id").alias("id"), "created_at", "received_at").groupBy("id").agg(F.min("created_at").alias("c"), F.min("received_at").alias("r"))
    return rows.groupBy(F.date_diff("r", "c").alias("days")).agg(F.count(F.lit(1)).alias("n"))


def snapshot_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Assets of each snapshot by family, with totals (rollup)."""
    rows = read(spark, d, "asset_snapshots").select(id_or_empty("dataset_id").alias("dataset"), norm_id("snapshot_id").alias("snapshot"), norm_id("asset_id").alias("asset"), text_or_empty("network_family").alias("family")).distinct()
    return rows.rollup("dataset", "family").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("snapshot").alias("n_snapshots"), F.grouping_id().cast("int").alias("level"))


def document_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Asset ids that texts mention, by kind of asset."""
    ids = F.regexp_extract_all(F.col("text"), F.lit("[A-Z]{2,4}-[0-9]{9}"), F.lit(0))
    rows = read(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(ids)).alias("mention"))
    return rows.groupBy(F.split("mention", "-")[0].alias("kind")).agg(F.count(F.lit(1)).alias("n_mentions"), F.count_distinct("doc_id").alias("n_documents"), F.count_distinct("mention").alias("n_assets"))


QUERIES = {f.__name__: f for f in (
    catalog_assets, catalog_search, catalog_search_next, catalog_ranks, catalog_facets, catalog_sites, catalog_box, catalog_filters, catalog_summary, catalog_duplicates, catalog_inventory, catalog_networks, catalog_numbered, pole_groups,
    classify_names, classify_agreement, vocabulary_exact, payload_leaves, candidate_counts, candidate_page, candidate_filter, candidate_decisions, candidate_best, candidate_conflicts, candidate_queues, capacity_allocation, port_allocation,
    interface_occupancy, interface_compatibility, accuracy_report, version_diff, version_diff_summary, content_ids, graph_revisions, parity_counts, latency_histogram, metric_families, late_deliveries, snapshot_rollup, document_mentions,
)}

_RANK = f"""ranked as (select object_id, lower(source_name) as name, asset_id, case when lower(asset_id) = '{QUERY}' or object_id = '{QUERY}' then 100 when lower(asset_id) like '{QUERY}%' or object_id like '{QUERY}%' then 90 when lower(source_name) = '{QUERY}' then 80 when lower(source_name) like '{QUERY}%' then 70
  when lower(asset_type) = '{QUERY}' or lower(category) = '{QUERY}' then 60 when contains(lower(source_name), '{QUERY}') or contains(lower(site_id), '{QUERY}') then 50 when contains(lower(asset_type), '{QUERY}') or contains(lower(category), '{QUERY}') then 40 end as rank from assets where object_role <> 'visual_only')"""


def _rule_sql() -> str:
    order = sorted(range(len(classify.RULES)), key=lambda k: (-classify.RULES[k][4], -max(map(len, classify.RULES[k][0])), classify.RULES[k][0][0]))
    tests = []
    for k in order:
        words, _, _, kind, _ = classify.RULES[k]
        hit = " or ".join(f"t = '{w}' or " + (f"contains(' ' || t || ' ', ' {w} ')" if len(w) <= 3 else f"contains(t, '{w}')") for w in words)
        tests.append(f"when ({hit})" + (f" and list_contains(kinds, '{kind}')" if kind else "") + f" then {k}")
    return "case " + " ".join(tests) + " end"


_CLASSIFIED = sql_with("assets", "geometries") + f""", k as (select dv, feature_id, list(distinct kind) as kinds from geometries where valid group by all), n as (select object_id, object_role, coalesce(kinds, []) as kinds, trim(regexp_replace(lower(strip_accents(source_name)), '[^a-z0-9]+', ' ', 'g')) as t from assets left join k using (dv, feature_id)),
  r as (select object_id, object_role, {_rule_sql()} as rule from n), c as (select object_id, object_role, case rule {' '.join(f"when {k} then '{r[1]}'" for k, r in enumerate(classify.RULES))} else 'unknown' end as role, case rule {' '.join(f"when {k} then '{r[2]}'" for k, r in enumerate(classify.RULES))} else 'unknown' end as family from r)"""
_DECIDED = sql_with("candidates") + """, k as (select *, case when candidate_type = 'inline_device' then 'inline:' || coalesce(target_id, '') else 'endpoint:' || endpoint_id end as decision from candidates where endpoint_id is not null),
  p as (select *, row_number() over w as place, score - coalesce(lead(score) over w, 0) as margin, count(*) over (partition by dv, decision) as n_group from k window w as (partition by dv, decision order by score desc nulls last, candidate_id))"""
_DIFF = """, v as (select nullif(lower(trim(dataset_version_id, ' ' || chr(9) || chr(10) || chr(160))), '') as dv, min(lower(trim(dataset_id))) as dataset, min(created_at) as made from dataset_versions where lower(trim(store)) = 'postgres' group by 1),
  s as (select dv, lag(dv) over (partition by dataset order by made, dv) as previous from v), own as (select dv, asset_id, min((source_name, object_role, network_family, category, asset_type, site_id, status)) as v from assets where asset_id <> '' group by all),
  n as (select o.dv, asset_id, o.v from own o join s on s.dv = o.dv where previous is not null), o as (select s.dv, asset_id, o.v from own o join s on s.previous = o.dv),
  j as (select coalesce(n.dv, o.dv) as dv, coalesce(n.asset_id, o.asset_id) as asset_id, o.v as ov, n.v as nv, n.dv is null as gone, o.dv is null as fresh from o full join n on o.dv = n.dv and o.asset_id = n.asset_id),
  f as (select dv, asset_id, unnest(case when fresh then [('asset_added', 'medium', '')] when gone then [('asset_removed', 'high', '')] else list_filter([""" + ", ".join(f"case when ov[{i}] <> nv[{i}] then ('{'site_changed' if f == 'site_id' else 'asset_metadata_changed'}', '{'high' if f == 'site_id' else 'medium'}', '{f}') end" for i, f in enumerate(["source_name", "object_role", "network_family", "category", "asset_type", "site_id", "status"], 1)) + "], lambda x: x is not null) end) as c from j), diff as (select dv, asset_id, c[1] as change_type, c[2] as risk, c[3] as field_name from f)"

SQL = {
    "catalog_assets": sql_with("assets", "graph", "candidates", "points") + """, b as (select dv, feature_id, count(*) as n_points, min(lon) as west, min(lat) as south, max(lon) as east, max(lat) as north from points group by all), g as (select dv, asset_id, count(*) as n_edges from (select dv, source_id as asset_id from graph union all select dv, target_id from graph) group by all),
      c as (select dv, target_id as asset_id, count(*) as n_candidates from candidates where candidate_status not in ('rejected', 'skipped', 'revoked') and target_id is not null group by all)
      select object_id, coalesce(n_points, 0) as n_points, west, south, east, north, coalesce(n_edges, 0) as n_edges, coalesce(n_candidates, 0) as n_candidates, case when n_edges > 0 then 'connected' when n_candidates > 0 then 'pending-review' else 'isolated' end as topology_status from assets left join b using (dv, feature_id) left join g using (dv, asset_id) left join c using (dv, asset_id) where object_role <> 'visual_only'""",
    "catalog_search": sql_with("assets") + f", {_RANK} select object_id, name, asset_id, rank from ranked where rank is not null order by rank desc, name, object_id limit 50",
    "catalog_search_next": sql_with("assets") + f", {_RANK} select object_id, name, asset_id, rank from ranked where rank is not null order by rank desc, name, object_id limit 50 offset 50",
    "catalog_ranks": sql_with("assets") + f", {_RANK} select rank, count(*) as n_hits from ranked where rank is not null group by all",
    "catalog_facets": sql_with("assets") + " " + " union all ".join(f"select '{f}' as field, coalesce(nullif({f}, ''), 'unknown') as value, count(*) as n from assets group by 2" for f in FACETS),
    "catalog_sites": sql_with("assets", "points") + f", o as (select * from assets where object_role <> 'visual_only'), c as (select site_id, count(*) as n_assets from o group by all), p as (select site_id, count(*) as n_points, min(lon) as west, min(lat) as south, max(lon) as east, max(lat) as north, count(*) filter (not (lon between {BOX[0]} and {BOX[2]} and lat between {BOX[1]} and {BOX[3]})) as n_outside from points join o using (dv, feature_id) group by all) select site_id, n_assets, coalesce(n_points, 0) as n_points, west, south, east, north, coalesce(n_outside, 0) as n_outside from c left join p using (site_id)",
    "catalog_box": sql_with("points", "lines") + f", b as (select geometry_id, lon as w, lat as s, lon as e, lat as n from points union all select geometry_id, list_min(list_transform(line, lambda p: p[1])), list_min(list_transform(line, lambda p: p[2])), list_max(list_transform(line, lambda p: p[1])), list_max(list_transform(line, lambda p: p[2])) from lines) select geometry_id from b where w <= {BOX[2]} and e >= {BOX[0]} and s <= {BOX[3]} and n >= {BOX[1]}",
    "catalog_filters": sql_with("assets") + " select object_id from assets where network_family in ('cctv', 'lan') and object_role = 'device_node' and category in ('cctv_camera', 'junction_box', 'network_device') and status = 'active' and classification_score >= 0.5",
    "catalog_summary": sql_with("geometries") + " select kind, valid, count(*) as n_geometries, count(distinct feature_id) as n_features from geometries group by all",
    "catalog_duplicates": sql_with("assets") + " select dv, source_name, count(*) as n, min(asset_id) as first_id from assets where source_name <> '' group by all having count(*) > 1",
    "catalog_inventory": sql_with("assets") + " select dv, count(*) as n_assets, " + ", ".join(f"count(*) filter ({c} = '') as no_{c}" for c in ("asset_id", "source_name", "site_id", "asset_type", "category")) + ", count(*) filter (parent_id is null) as no_parent, count(*) filter (classification_status <> 'classified') as not_classified from assets group by all",
    "catalog_networks": sql_with("assets", "points", "lines") + ", g as (select dv, feature_id, 'point' as kind, lon as x0, lon as x1 from points union all select dv, feature_id, 'line', list_min(list_transform(line, lambda p: p[1])), list_max(list_transform(line, lambda p: p[1])) from lines) select network_family, kind, count(*) as n, min(x0) as west, max(x1) as east from g join assets using (dv, feature_id) group by all",
    "catalog_numbered": sql_with("assets") + ", n as (select object_id, asset_id, row_number() over (partition by asset_id order by object_id) as n from assets) select object_id, case when n = 1 then asset_id else asset_id || ':' || n end as numbered from n",
    "pole_groups": sql_with("assets") + " select dv, parent_id, count(*) as n_children, min(source_name) as first_child from assets where parent_id is not null group by all",
    "classify_names": _CLASSIFIED + " select object_id, role, family from c",
    "classify_agreement": _CLASSIFIED + " select object_role, role, count(*) as n from c group by all",
    "vocabulary_exact": sql_with("assets") + ", t as (select lower(n) as name, min(canonical_value) as canonical_value from (select canonical_value, unnest([canonical_value, label] || coalesce(aliases, [])) as n from vocabulary_terms where field_name = 'asset_type') where n is not null group by 1) select object_id, canonical_value from assets join t on t.name = lower(asset_type)",
    "payload_leaves": "with l as (select distinct lower(trim(dataset_version_id, ' ' || chr(9) || chr(10) || chr(160))) as id, 'payload' || replace(substr(t.fullkey, 2), '\"', '') as path from dataset_versions v, json_tree(v.payload) as t where t.type not in ('OBJECT', 'NULL') and not contains(t.fullkey, '[')) select path, count(*) as n_versions from l group by all",
    "candidate_counts": sql_with("candidates") + " select dv, candidate_status, count(*) as n from candidates group by all",
    "candidate_page": sql_with("candidates") + " select candidate_id, score, candidate_type, distance from candidates where score < 0.8 or score is null or (score = 0.8 and candidate_id > '') order by score desc nulls last, candidate_id limit 100",
    "candidate_filter": sql_with("candidates") + " select candidate_id from candidates where candidate_status in ('candidate', 'ambiguous') and network_family = 'fiber_optic' and proposal_status = 'recommended' and score between 0.5 and 0.9 and distance <= 5",
    "candidate_decisions": _DECIDED + ", b as (select *, max(case when place = 1 then score end) over (partition by dv, decision) as top, max(case when place = 1 then margin end) over (partition by dv, decision) as m from p) select candidate_id, place::int as place, round(margin, 6) as margin, case when coalesce(top, 0) < 0.55 then 'below_threshold' when n_group > 1 and m < 0.12 then 'ambiguous' when place = 1 then 'recommended' else 'not_selected' end as outcome from b",
    "candidate_best": _DECIDED + " select dv, decision, candidate_id from p where place = 1",
    "candidate_conflicts": sql_with("candidates") + " select dv, endpoint_id, count(*) as n_rows, min(candidate_id) as first_row from candidates where candidate_status = 'confirmed' and endpoint_id is not null group by all having count(*) > 1",
    "candidate_queues": sql_with("candidates") + " select dv, case when endpoint_id is null or target_id is null then 'data_issues' when proposal_status = 'needs_choice' or candidate_status = 'ambiguous' then 'needs_choice' else 'ready' end as queue, count(*) as n from candidates where candidate_status in ('candidate', 'ambiguous') group by all",
    "capacity_allocation": sql_with("candidates", "interfaces") + ", f as (select dv, owner_id as target_id, sum(greatest(coalesce(capacity, 0) - coalesce(occupancy, 0), 0)) as free from interfaces where status = 'active' and owner_id is not null group by all), r as (select *, row_number() over (partition by dv, target_id order by score desc nulls last, candidate_id) as place from candidates where candidate_status in ('confirmed', 'candidate') and target_id is not null) select candidate_id, place::int as place, place <= coalesce(free, 0) as accepted from r left join f using (dv, target_id)",
    "port_allocation": sql_with("candidates", "interfaces") + ", a as (select dv, target_id as asset_id, candidate_id, row_number() over (partition by dv, target_id order by candidate_id) as place from candidates where candidate_status = 'confirmed' and target_id is not null), b as (select dv, owner_id as asset_id, interface_id, row_number() over (partition by dv, owner_id order by interface_id) as place from interfaces where status = 'active' and owner_id is not null) select candidate_id, interface_id from a join b using (dv, asset_id, place)",
    "interface_occupancy": sql_with("interfaces") + " select interface_type, case when occupancy > capacity then 'over' when occupancy = capacity then 'full' when occupancy > 0 then 'part' else 'free' end as state, count(*) as n, sum(capacity)::bigint as capacity, sum(occupancy)::bigint as occupancy from interfaces group by all",
    "interface_compatibility": sql_with("candidates", "interfaces") + ", m as (select candidate_id, interface_id, case when coalesce(is_proxy, false) then 0.85 else 1.0 end as fit from (select *, case network_family when 'fiber_optic' then 'fiber' when 'lan' then 'copper' else 'unknown' end as medium from candidates) c join interfaces i on i.dv = c.dv and i.owner_id = c.target_id where i.status = 'active' and service_domain <> 'mounting' and (medium = 'unknown' or media_type = 'unknown' or medium = media_type)) select candidate_id, interface_id, fit::double as fit from m qualify row_number() over (partition by candidate_id order by fit desc, interface_id) = 1",
    "accuracy_report": sql_with("candidates") + ", c as (select candidate_type, case when distance <= 2 then '0-2' when distance <= 4 then '2-4' when distance <= 6 then '4-6' else 'none' end as stratum, count(*) filter (proposal_status = 'recommended' and candidate_status = 'confirmed') as true_positive, count(*) filter (proposal_status = 'recommended' and candidate_status <> 'confirmed') as false_positive, count(*) filter (proposal_status <> 'recommended' and candidate_status = 'confirmed') as false_negative from candidates where candidate_status in ('confirmed', 'rejected', 'revoked') group by all) select *, round(true_positive / nullif(true_positive + false_positive, 0), 6) as precision, round(true_positive / nullif(true_positive + false_negative, 0), 6) as recall from c",
    "version_diff": sql_with("assets") + _DIFF + " select * from diff",
    "version_diff_summary": sql_with("assets") + _DIFF + " select dv, change_type, risk, count(*) as n from diff group by all",
    "content_ids": sql_with("graph") + """ select edge_id, 'edge:' || substr(sha256('["' || dv || '","' || least(source_id, target_id) || '","' || greatest(source_id, target_id) || '","' || family || '"]'), 1, 24) as content_id from graph""",
    "graph_revisions": sql_with("graph") + """, h as (select dv, sha256('["' || edge_id || '","' || source_id || '","' || target_id || '","' || family || '"]') as h from graph), s as (select dv, count(*) as n_rows, """ + ", ".join(f"sum(('0x' || substr(h, {1 + 12 * k}, 12))::bigint) as s{k}" for k in range(4)) + """ from h group by all) select dv, n_rows, substr(sha256(s0 || '-' || s1 || '-' || s2 || '-' || s3 || '-' || n_rows), 1, 32) as revision from s""",
    "parity_counts": " union all ".join(f"select '{t}' as table_name, count(*) as n_rows, count(distinct nullif(lower(trim({k}, ' ' || chr(9) || chr(10) || chr(160) || chr(8195))), '')) as n_ids from {t}" for t, k in {"source_geometries": "source_geometry_id", "classified_objects": "classified_object_id", "topology_components": "component_id", "topology_interfaces": "interface_id", "topology_candidates": "candidate_id", "graph_edges": "edge_id", "dataset_versions": "dataset_version_id"}.items()),
    "latency_histogram": "select event_type, bound, n from (select event_type, unnest([" + ", ".join(f"{{'bound': {b}::double, 'n': count(*) filter (value <= {b})}}" for b in (1, 5, 10, 25, 50, 100)) + ", {'bound': null, 'n': count(value)}], recursive := true) from events group by event_type)",
    "metric_families": sql_with("assets", "candidates", "interfaces") + " select 'candidates' as metric, candidate_type as label_one, candidate_status as label_two, count(*) as value from candidates group by all union all select 'assets', object_role, network_family, count(*) from assets group by all union all select 'interfaces', interface_type, service_domain, count(*) from interfaces group by all",
    "late_deliveries": "with r as (select nullif(lower(trim(classified_object_id)), '') as id, min(created_at) as c, min(received_at) as r from classified_objects group by 1) select date_diff('day', c::date, r::date)::int as days, count(*) as n from r group by all",
    "snapshot_rollup": "with r as (select distinct coalesce(lower(trim(dataset_id)), '') as dataset, lower(trim(snapshot_id)) as snapshot, nullif(lower(trim(asset_id, ' ' || chr(9) || chr(10) || chr(160) || chr(8195))), '') as asset, coalesce(trim(network_family, ' ' || chr(9) || chr(10) || chr(160) || chr(8195)), '') as family from asset_snapshots) select dataset, family, count(*) as n, count(distinct snapshot) as n_snapshots, grouping(dataset, family)::int as level from r group by rollup (dataset, family)",
    "document_mentions": "with m as (select doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z]{2,4}-[0-9]{9}'))) as mention from documents) select string_split(mention, '-')[1] as kind, count(*) as n_mentions, count(distinct doc_id) as n_documents, count(distinct mention) as n_assets from m group by all",
}
