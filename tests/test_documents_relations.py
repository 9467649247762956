import io
import zipfile

import pytest

from meshwright.catalog import relations as generated
from meshwright.functions import geo
from meshwright.operators import devices, gridjoin, relations
from meshwright.plans.staging import stage
from meshwright.sources import kml


def _doc(body):
    return ('<kml xmlns="http://www.opengis.net/kml/2.2"><Document>' + body + "</Document></kml>").encode()


def _map(a, b):
    return f'<StyleMap id="{a}"><Pair><key>normal</key><styleUrl>{b}</styleUrl></Pair></StyleMap>'


@pytest.mark.parametrize("length", [2, 3, 4, 9, 40])
def test_styles_through_any_number_of_maps(spark, length):
    chain = '<Style id="s0"/>' + "".join(_map(f"s{i}", f"#s{i - 1}") for i in range(1, length + 1)) + _map("a", "#b") + _map("b", "#a") + _map("lost", "#none") + _map("self", "#self")
    marks = "".join(f"<Placemark><name>{u}</name><styleUrl>{u}</styleUrl></Placemark>" for u in (f"#s{length}", "#a", "#lost", "#self", "#gone", "http://x#y")) + "<Placemark><name>bare</name></Placemark>"
    files = spark.createDataFrame([("one", _doc(chain + marks)), ("two", _doc("<Placemark><name>n</name><styleUrl>#s0</styleUrl></Placemark>")), ("three", None)], "path string, content binary")
    found = {(r["path"], r["name"]): (r["ref"], r["status"]) for r in kml.resolve_styles(kml.parse_files(files)).collect()}
    assert found[("one", f"#s{length}")] == ("#s0", "resolved") and found[("one", "#a")] == ("#a", "cycle") and found[("one", "#lost")] == ("#none", "missing")
    assert found[("one", "#self")][1] == "cycle" and found[("one", "#gone")] == ("#gone", "missing") and found[("one", "http://x#y")][1] == "external" and found[("one", "bare")][1] == "none"
    assert found[("two", "n")] == ("#s0", "missing")


def test_styles_are_resolved_without_joins(spark):
    texts = "path string, document string, record string, seq int, name string, style_url string"
    doc = lambda p, d, to: [(p, d, "placemark", 1, "x", "#m"), (p, d, "style", 0, "m", to), (p, d, "style", 0, "s", None), (p, d, "style", 0, "loop", "#loop"), (p, d, "style", 0, "in", "#loop"), (p, d, "placemark", 2, "y", "#in")]
    rows = doc("p", "a", "#s") + doc("p", "b", "#gone") + doc(None, "a", "#s") + [("p", "a", "style", 0, "m", "#z"), ("p", "a", "style", 0, None, None)]
    df = kml.resolve_styles(spark.createDataFrame(rows, texts).repartition(5))
    found = {(r["path"], r["document"], r["name"]): (r["ref"], r["status"]) for r in df.collect()}
    assert found == {
        ("p", "a", "x"): ("#s", "resolved"), ("p", "b", "x"): ("#gone", "missing"), (None, "a", "x"): ("#m", "missing"),
        ("p", "a", "y"): ("#in", "cycle"), ("p", "b", "y"): ("#in", "cycle"), (None, "a", "y"): ("#in", "missing"),
    }
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_generators_are_staged_before_they_are_united(spark, monkeypatch):
    joins = []
    monkeypatch.setattr(generated, "stage", lambda df: (joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join ")), stage(df))[1])
    found = generated.relation_candidates(spark, "/root/testdata/sf0.001")
    assert {r[0] for r in found.select("candidate_type").distinct().collect()} >= {"cable_termination", "unresolved_termination"}
    assert max(joins) <= 4
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 4


def test_candidates_are_joined_without_broadcasts(spark, monkeypatch):
    plans = []
    planned = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(generated, "stage", lambda df: stage(planned(df)))
    planned(generated.relation_candidates(spark, "/root/testdata/sf0.001"))
    assert sum(p.count("SortMergeJoin") for p in plans) == 11
    assert not [p for p in plans if "Broadcast" in p or "ShuffledHashJoin" in p]


@pytest.mark.parametrize("cell", [None, 12.0, 24.0])
def test_wider_cells_find_the_same_pairs(spark, cell):
    lat, lon = "element_at(array(0D, 51.3D, -78.2D, 89.99D, 89.9995D, 89.99999D), cast(id % 6 + 1 as int))", "element_at(array(0D, 180D, -179.99999D, 130.7D), cast(id div 6 % 4 + 1 as int))"
    spread = lambda n, seed: spark.range(n).selectExpr("'s' as scope", f"cast(id as string) as {'left' if seed == 1 else 'right'}_id", f"least({lat} + (rand({seed}) - 0.5) * 6e-4, 90D) as lat", f"{lon} as x", f"rand({seed + 7}) as u").selectExpr("*", "(x + (u - 0.5) * 6e-4 / greatest(cos(radians(lat)), 1e-6) + 540D) % 360D - 180D as lon").drop("x", "u")
    left, right = (stage(spread(3000, i)) for i in (1, 2))
    found = {(r.left_id, r.right_id) for r in gridjoin.near_points(left, right, 6.0, cell).collect()}
    near = left.withColumnsRenamed({"lon": "lon1", "lat": "lat1"}).crossJoin(right.drop("scope")).where(f"{geo.haversine_sql('lon1', 'lat1', 'lon', 'lat')} <= 6")
    assert len(found) > 1000 and found == {(r.left_id, r.right_id) for r in near.collect()}


def test_wider_cells_are_fewer(spark):
    places = spark.range(4000).selectExpr("id", "(rand(1) - 0.5) * 350 as lon", "(rand(2) - 0.5) * 178 as lat")
    cells = lambda cell: gridjoin.covered_cells(places, cell, "lon", "lat", "lon", "lat", 6.0).count() / 4000
    assert 8.9 < cells(6.0) < 9.1 and cells(24.0) < 2.4


def test_folders_by_the_longest_alias(spark):
    aliases = spark.createDataFrame([("cctv", "camera"), ("cctv cable", "cable"), ("fo", "fiber"), ("", "none"), ("pole", "b"), ("pole", "a")], "alias string, category string")
    names = {"1": "north cctv cable", "2": "fo", "3": "fo north", "4": "the pole", "5": "flagpole", "6": ""}
    folders = spark.createDataFrame([(k, v.split()) for k, v in names.items()], "id string, words array<string>")
    found = {r["id"]: r["category"] for r in kml.folder_categories(folders, aliases).collect()}
    assert found == {"1": "cable", "2": "fiber", "3": "unmapped", "4": "a", "5": "unmapped", "6": "unmapped"}
    assert {r["category"] for r in kml.folder_categories(folders, aliases.limit(0)).collect()} == {"unmapped"}


def test_resources_of_archives(spark):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("Files/a.png", b"abc")
        z.writestr("bomb.png", b"0" * 1_000_000)
    rows = [("a", held.getvalue(), "files/A.png"), ("b", held.getvalue(), "../a.png"), ("c", b"no zip", "a.png"), ("d", held.getvalue(), "x.png"), ("e", held.getvalue(), "bomb.png"), ("f", None, None)]
    found = {r["path"]: (r["name"], r["size"], r["issue"]) for r in kml.resources(spark.createDataFrame(rows, "path string, content binary, wanted string")).collect()}
    assert found == {"a": ("Files/a.png", 3, None), "b": (None, None, "unsafe_resource_path"), "c": (None, None, "invalid_archive"), "d": (None, None, "resource_missing"), "e": ("bomb.png", 1_000_000, "resource_too_large"), "f": (None, None, "unsafe_resource_path")}


def test_weaker_edges_give_way_at_special_ends(spark):
    rows = [("s", "1", "cam", "x", None), ("s", "2", "y", "cam", 3.0), ("s", "3", "x", "y", None), ("s", "4", "cam2", "x", None), ("t", "5", "cam", "x", None)]
    edges = spark.createDataFrame(rows, "scope string, edge_id string, a string, b string, length double")
    kept = relations.without_weaker(edges, ["a", "b"], "{end} like 'cam%'", "length is null", "length is not null")
    assert sorted(r["edge_id"] for r in kept.collect()) == ["2", "3", "4", "5"] and kept.columns == edges.columns


def test_proposals_are_united_decided_and_completed(spark):
    one = spark.createDataFrame([("s", "cable_termination", "e1", "d1", 1.0, 1.0, "end"), ("s", "cable_termination", "e1", "d1", 2.0, 1.0, "end"), ("s", "cable_termination", "e1", "d2", 5.9, 0.9, "end"), ("s", "cable_termination", "e2", "d1", 1.0, 1.0, "end"), ("s", "cable_termination", "e2", "d2", 1.0, 1.0, "end")], "scope string, candidate_type string, endpoint_id string, target_id string, distance double, fit double, role string")
    two = spark.createDataFrame([("s", "explicit_metadata", "x1", "d3", None, 1.0, "end")], one.schema)
    proposals = relations.union([one, two])
    found = {(r["endpoint_id"], r["target_id"]): (r["place"], r["outcome"]) for r in relations.decided(relations.scored(proposals)).collect()}
    assert found == {("e1", "d1"): (1, "recommended"), ("e1", "d2"): (2, "not_selected"), ("e2", "d1"): (1, "ambiguous"), ("e2", "d2"): (2, "ambiguous"), ("x1", "d3"): (1, "recommended")}
    ends = spark.createDataFrame([("s", "e1"), ("s", "e9"), ("s", "e9")], "scope string, endpoint_id string")
    assert [(r["endpoint_id"], r["outcome"]) for r in relations.unresolved(ends, proposals).collect()] == [("e9", "unresolved")]


def test_kinds_of_devices(spark):
    rows = [("otb", "", "OTB 1"), ("", "", "JB 3.2 north"), ("junction_box", "", "box"), ("", "", "Server Rack JB"), ("", "", "RS 1"), ("", "", "tiang 4"), ("", "", "tiangan"), ("cctv_dome", "", "x")]
    df = spark.createDataFrame([(*r, r[2].lower().replace(".", " ")) for r in rows], "asset_type string, category string, source_name string, nm string").selectExpr("*", "trim(concat_ws(' ', asset_type, category, nm)) as t")
    found = [{n for n in devices.kinds("regexp_like") if r[n]} for r in df.selectExpr("source_name", *[f"{v} as {n}" for n, v in devices.kinds("regexp_like").items()]).collect()]
    assert found == [{"is_otb", "is_inline"}, {"is_junction", "is_extended", "is_inline"}, {"is_junction", "is_inline"}, {"is_rack", "is_inline"}, {"is_rack", "is_inline"}, {"is_pole"}, set(), {"is_camera"}]
