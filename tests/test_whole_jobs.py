import numpy as np

from meshwright.catalog import graphs, records
from meshwright.operators import copies, graph, labels


def _objects(spark, folder, rows):
    """classified_objects of (object, role, feature, asset, name), in one dataset version."""
    given = ["classified_object_id", "object_role", "source_feature_id", "asset_id", "source_name"]
    blank = ["dataset_version_id", "site_id", "network_family", "asset_type", "category", "classification_status", "status", "parent_asset_id", "upstream_asset_id"]
    schema = ", ".join(f"{c} string" for c in [*given, *blank]) + ", classification_score double, received_at timestamp"
    spark.createDataFrame([(*r, "d", *[None] * 10) for r in rows], schema).write.parquet(f"{folder}/classified_objects.parquet")


def test_the_registry_holds_names_of_any_length_and_features(spark, tmp_path):
    rows = [
        ("1", "cable_path", "f1", "c1", "odd"), ("2", "cable_path", "f2", "c2", "even"), ("3", "cable_path", "f3", "c3", "twins"), ("4", "cable_path", "f4", "c4", "twins"),
        ("5", "cable_path", "f5", "c5", None), ("6", "device_node", "f5", "a5", "x"), ("7", "cable_path", "f6", "c6", None),
    ]
    _objects(spark, tmp_path, rows)
    found = {r["object_id"]: (r["stable_id"], r["status"]) for r in records.stable_ids(spark, str(tmp_path)).collect()}
    assert found["1"] == ("c1", "registry") and found["2"] == ("c2", "registry") and found["3"] == found["4"] == (None, "conflict")
    assert found["5"] == ("a5", "registry") and found["6"] == ("a5", "given") and found["7"][1] == "made"


def test_devices_follow_each_other_along_joined_lines(spark):
    attached = spark.createDataFrame([("s", "z1", 0, "p"), ("s", "m3", 0, "q"), ("s", "m3", 2, "r"), ("s", "k4", 1, "t")], "scope string, line string, place int, device string")
    joints = spark.createDataFrame([("s", "z1", "end", "a2", "end"), ("s", "a2", "start", "m3", "end"), ("s", "k4", "start", "z1", "end")], "scope string, a string, a_end string, b string, b_end string")
    found = {tuple(r) for r in graph.collapse(attached, joints).collect()}
    assert found == {("s", "p", "r", "a2", 3), ("s", "q", "r", "a2", 3), ("s", "p", "t", "a2", 3)}  # across a2, which has no device; t and r lie on two branches


def test_collapsed_edges_reads_the_joints(spark, tmp_path):
    _objects(spark, tmp_path, [])
    shape = "source_geometry_id string, dataset_version_id string, source_feature_id string, geometry_type string, valid boolean, coordinates string, geometry string, received_at timestamp"
    lines = [(k, "d", k, "linestring", True, c, None, None) for k, c in (("g1", "[[107.0,-6.0],[107.001,-6.0]]"), ("g2", "[[107.00101,-6.0],[107.002,-6.0]]"))]
    spark.createDataFrame(lines, shape).write.parquet(f"{tmp_path}/source_geometries.parquet")
    texts = ["candidate_id", "source_endpoint_id", "target_asset_id", "candidate_status", "dataset_version_id", "site_id", "candidate_type", "network_family", "proposal_status"]
    schema = ", ".join(f"{c} string" for c in texts) + ", score double, distance_meters double, received_at timestamp"
    rows = [("c1", "endpoint:g1:start", "x", "confirmed", "d", *[None] * 7), ("c2", "endpoint:g2:end", "y", "confirmed", "d", *[None] * 7)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/topology_candidates.parquet")
    assert [tuple(r) for r in graphs.collapsed_edges(spark, str(tmp_path)).collect()] == [("d", "x", "y", "g1")]


def test_a_large_key_is_paired_at_the_least_cost(spark):
    row = lambda i, d: {"a": f"a{i}", "b": f"b{i % 7}", "c": f"c{i % 11}", "d": d}
    rows = [("t", "hot", "p", row(i, "old")) for i in range(120)] + [("t", "hot", "j", row(i, "new")) for i in range(0, 120, 2)]
    df = spark.createDataFrame(rows, "table_name string, record_id string, side string, vals map<string,string>")
    out = [tuple(r)[2:] for r in copies.compare_copies(df, ("p", "j"), exact_rows=16).collect()]
    assert sorted(out) == [("differs", "d")] * 60 + [("missing_in_j", "")] * 60


def test_both_ways_of_pairing_cost_the_same():
    rnd = np.random.default_rng(3)
    for n, m in ((1, 1), (9, 9), (20, 33), (33, 20), (40, 40)):
        left, right = ([{f: str(rnd.integers(3)) for f in "abcd"} | {"x": str(rnd.random())} for _ in range(k)] for k in (n, m))
        cost = lambda rows: sum(sum(left[i].get(f) != right[j].get(f) for f in "abcd") + (abs(float(left[i]["x"]) - float(right[j]["x"])) >= 0.3) for i, j in rows if i >= 0 and j >= 0)
        one, two = (copies.pair_rows(left, right, {"x": 0.3}, k) for k in (100, 0))
        assert cost(one) == cost(two) and len(one) == len(two) == max(n, m)


def test_the_upstream_trace_has_no_limit(spark, tmp_path):
    texts = ["store", "edge_id", "source_node_id", "target_node_id", "verification_status", "direction", "dataset_version_id", "relation_id", "network_family"]
    ends = [(f"n{i + 1}", f"n{i}") for i in range(6)] + [("n0", "x"), ("n0", "y")]  # n0 is the root
    rows = [("postgres", f"e{i}", a, b, "confirmed", "source_to_target", "d", *[None] * 4) for i, (a, b) in enumerate(ends)]
    spark.createDataFrame(rows, ", ".join(f"{c} string" for c in texts) + ", length_meters double, received_at timestamp").write.parquet(f"{tmp_path}/graph_edges.parquet")
    hops = lambda query: {r["asset_id"]: r["hops"] for r in query(spark, str(tmp_path)).collect()}
    assert hops(graphs.trace_upstream) == {f"n{i}": i for i in range(7)}
    assert hops(graphs.trace_upstream_near) == {f"n{i}": i for i in range(5)}


def test_reach_goes_on_beyond_10000_hops(spark):
    arcs = spark.range(10_050).selectExpr("'s' as scope", "cast(id as string) as a", "cast(id + 1 as string) as b")
    start = spark.createDataFrame([("s", "0")], "scope string, node string")
    assert graph.reach(arcs, start).agg({"hops": "max"}).first()[0] == 10_050
    assert graph.reach(arcs, start, 7).count() == 8


def test_long_scopes_are_walked_to_the_end_across_the_cluster(spark, monkeypatch):
    monkeypatch.setattr(graph, "LEVELS_HELD", 2)
    arcs = spark.range(5).selectExpr("'s' as scope", "cast(id as string) as a", "cast(id + 1 as string) as b")
    start = spark.createDataFrame([("s", "0")], "scope string, node string")
    assert {r["node"]: r["hops"] for r in graph.reach(arcs, start, block_rows=3).collect()} == {str(i): i for i in range(6)}


def test_names_of_many_words_match_whole(spark):
    names = "scope string, {} string, name string"
    lines = spark.createDataFrame([("s", "l1", "to ab cd ef gh ij kl mn op end"), ("t", "l2", "ab cd")], names.format("line_id"))
    devices = spark.createDataFrame([("s", "d1", "ab cd ef gh ij kl mn op"), ("s", "d2", "cd ef"), ("t", "d3", "ab cd")], names.format("device_id"))
    assert {(r["line_id"], r["device_id"]) for r in labels.match_labels(lines, devices).collect()} == {("l1", "d1"), ("l2", "d3")}
