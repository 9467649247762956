from pyspark.sql import functions as F

from meshwright.functions import attributes, geo, score
from meshwright.operators import identity


def test_assign_ids(spark):
    objects = spark.createDataFrame([("1", "d", " A-1 ", "f1", "x"), ("2", "d", " ", "f2", "x"), ("3", "d", None, "f9", "y"), ("4", "d", None, None, " "), ("5", None, None, "f1", None)], "object_id string, dataset string, given_id string, feature string, name string")
    registry = spark.createDataFrame([("d", "feature", "f2", "R-1"), ("d", "name", "x", "R-2"), ("d", "name", "y", "R-3"), ("d", "name", "y", "R-3")], "dataset string, key_kind string, key_value string, stable_id string")
    found = {r["object_id"]: (r["stable_id"], r["status"]) for r in identity.assign_ids(objects, registry, ["feature", "name"]).collect()}
    assert found["1"] == ("A-1", "given") and found["2"] == (None, "conflict") and found["3"] == ("R-3", "registry") and found["4"] == (None, "unidentified")
    assert found["5"][1] == "made" and found["5"][0].startswith("AUTO-") and len(found["5"][0]) == 29
    assert identity.assign_ids(objects.limit(0), registry, ["feature"]).count() == 0 and identity.assign_ids(objects, registry.limit(0), ["feature"]).count() == 5


def test_attributes(spark):
    rows = spark.createDataFrame([([("Asset ID", " "), ("asset-id", "A"), ("assetId", "B"), ("IP Address", "1.2.3.4"), ("odd", "x")],), (None,)], "e array<struct<key:string,value:string>>")
    out = rows.select(attributes.semantic_fields(F.col("e"), {"asset_id": ["Asset ID", "assetId"], "ip": ["ip address"]})).collect()
    assert out[0][0] == {"asset_id": "A", "ip": "1.2.3.4"} and out[1][0] is None
    ports = spark.createDataFrame([("o", "LAN port", 2), ("o", "x", 0), ("o", "x", None)], "o string, k string, n int").select(attributes.port_ids(F.col("o"), F.col("k"), F.col("n"))).collect()
    assert [p[0] for p in ports] == [["o/interface/lan-port/01", "o/interface/lan-port/02"], [], []]


def test_geometry_and_scores(spark):
    one = spark.range(1)
    corners = one.select(geo.rotated_corners(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0), F.lit(90.0))).first()[0]
    assert [(round(c["lon"], 9), round(c["lat"], 9)) for c in corners] == [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)]
    ring = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 3.0), (0.0, 3.0))])
    assert one.select(F.abs(geo.ring_area(ring))).first()[0] == 6.0
    assert abs(one.select(geo.haversine(F.lit(179.9999), F.lit(0.0), F.lit(-179.9999), F.lit(0.0))).first()[0] - 22.239) < 0.01
    assert one.select(score.weighted(distance=F.lit(2.0), interface=F.lit(-1.0), explicit=F.lit(None).cast("double"))).first()[0] == 0.3
    assert one.select(geo.boxes_meet([F.lit(None).cast("double")] * 4, [F.lit(0.0)] * 4)).first()[0] is False
    places = spark.createDataFrame([("[1,2,3]",), (' [ "1" , "2" ] ',), ("[null,null]",), ("x",), (None,), ("[1e1,2]",)], "c string").select(geo.point_from_json("c").alias("p")).collect()
    assert [(p["p"]["lon"], p["p"]["lat"]) if p["p"] else None for p in places][:2] == [(1.0, 2.0)] * 2 and places[5]["p"]["lon"] == 10.0
    wkt = spark.createDataFrame([("SRID=4326;POINT(1 2)",), ("point z (1 2 3)",), ("POINT EMPTY",), ("POINT (NaN NaN)",), (None,)], "g string").select(geo.point_from_wkt("g").alias("p"), geo.finite("p.lon")).collect()
    assert [r[1] for r in wkt] == [True, True, False, False, False]
