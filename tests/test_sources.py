import zipfile

from pyspark.sql import functions as F

from meshwright.sources import kml, stores

DOC = """<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2" xmlns:gx="http://www.google.com/kml/ext/2.2"><Document>
<Style id="a"/><StyleMap id="m"><Pair><key>highlight</key><styleUrl>#b</styleUrl></Pair><Pair><key>normal</key><styleUrl>#a</styleUrl></Pair></StyleMap>
<StyleMap id="x"><Pair><key>normal</key><styleUrl>#y</styleUrl></Pair></StyleMap><StyleMap id="y"><Pair><key>normal</key><styleUrl>#x</styleUrl></Pair></StyleMap>
<Folder><name>Site</name><Folder><name>CCTV</name>
<Placemark><name>cam 1</name><description><![CDATA[<b>near</b> the gate]]></description><styleUrl>#m</styleUrl><ExtendedData><Data name="Asset ID"><value>CAM-1</value></Data><SchemaData><SimpleData name="port">8</SimpleData></SchemaData></ExtendedData><Point><coordinates>110.5,-7.25,12</coordinates></Point></Placemark>
<Placemark><styleUrl>#x</styleUrl><MultiGeometry><Point><coordinates>1,2</coordinates></Point><LineString><coordinates>1,2 3,4</coordinates></LineString></MultiGeometry></Placemark>
</Folder></Folder>
<Placemark><name>area</name><styleUrl>#none</styleUrl><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 4,0 4,4 0,4</coordinates></LinearRing></outerBoundaryIs><innerBoundaryIs><LinearRing><coordinates>1,1 2,1 2,2 1,1</coordinates></LinearRing></innerBoundaryIs></Polygon></Placemark>
<Placemark><name>bad</name><Point><coordinates>181,-95</coordinates></Point></Placemark>
<Placemark><name>track</name><gx:Track><when>2024</when><gx:coord>1 2 0</gx:coord><gx:coord>1 3 0</gx:coord></gx:Track></Placemark>
<GroundOverlay><name>plan</name><Icon><href>files/a.png</href></Icon><LatLonBox><north>1</north><south>0</south><east>2</east><west>1</west></LatLonBox></GroundOverlay>
<NetworkLink/></Document></kml>"""


def test_read_kml_and_kmz(spark, tmp_path):
    (tmp_path / "a.kml").write_text(DOC)
    with zipfile.ZipFile(tmp_path / "b.kmz", "w") as z:
        z.writestr("other.kml", "<kml/>")
        z.writestr("doc.kml", DOC)
    with zipfile.ZipFile(tmp_path / "c.kmz", "w") as z:
        z.writestr("../doc.kml", DOC)
    (tmp_path / "d.kml").write_text("<!DOCTYPE x><kml/>")
    (tmp_path / "e.kml").write_text("<kml><Folder>")
    rows = kml.read_kml(spark, str(tmp_path))
    found = rows.filter(F.col("path").endswith("a.kml") & (F.col("record") == "placemark")).orderBy("name").collect()
    by = {r["name"]: r for r in found}
    assert set(by) == {"cam 1", "Placemark 2", "area", "bad", "track"} or {"cam 1", "area", "bad", "track"} < set(by)
    cam = by["cam 1"]
    assert cam["folder_path"] == "Site/CCTV" and cam["description"] == "near the gate" and cam["attributes"] == {"Asset ID": "CAM-1", "port": "8"}
    assert cam["geometries"][0]["coordinates"] == "[110.5,-7.25,12.0]" and cam["geometries"][0]["valid"]
    multi = next(r for n, r in by.items() if n.startswith("Placemark"))
    assert [g["part"] for g in multi["geometries"]] == ["geometry[0].Point[0]", "geometry[0].LineString[1]"]
    assert by["area"]["geometries"][0]["coordinates"].startswith("[[[0.0,0.0],[4.0,0.0],[4.0,4.0],[0.0,4.0],[0.0,0.0]]") and by["area"]["geometries"][0]["valid"]
    assert not by["bad"]["geometries"][0]["valid"] and by["track"]["geometries"][0]["kind"] == "LineString"
    issues = {(r["path"][-5:], r["name"]) for r in rows.filter("record = 'issue'").collect()}
    assert issues == {("a.kml", "unsupported_element"), ("b.kmz", "unsupported_element"), ("c.kmz", "unsafe_archive_path"), ("d.kml", "unsafe_xml_declaration"), ("e.kml", "invalid_xml")}
    styles = {r["name"]: (r["status"], r["ref"]) for r in kml.resolve_styles(rows.filter(F.col("path").endswith("a.kml"))).collect()}
    assert styles["cam 1"] == ("resolved", "#a") and styles["area"][0] == "missing" and styles["bad"][0] == "none" and styles[multi["name"]][0] == "cycle"
    counts = {(r["what"], r["kind"], r["valid"]): r["n"] for r in kml.coverage(rows.filter(F.col("path").endswith("a.kml"))).collect()}
    assert counts[("geometry", "Point", True)] == 2 and counts[("overlay", "", None)] == 1
    assert [r["document"] for r in rows.filter(F.col("path").endswith("b.kmz")).select("document").distinct().collect()] == ["doc.kml"]


def test_write_kml_reads_back(spark, tmp_path):
    rows = spark.createDataFrame([("a & b", "Point", [(1.5, 2.25)]), ("line", "LineString", [(1.0, 2.0), (3.0, 4.0)])], "name string, kind string, line array<struct<lon:double,lat:double>>")
    kml.write_kml(rows.select(kml.placemark(F.col("name"), F.col("kind"), F.col("line")).alias("xml")), str(tmp_path / "out"))
    texts = [p.read_text() for p in (tmp_path / "out").iterdir() if p.name.startswith("part")]
    back = [r for t in texts for r in kml.parse(t) if r["record"] == "placemark"]
    assert {r["name"]: r["geometries"][0]["coordinates"] for r in back} == {"a & b": "[1.5,2.25]", "line": "[[1.0,2.0],[3.0,4.0]]"}


def test_many_versions_lie_in_few_files(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(0, 1200, 1, 4).selectExpr("nullif(concat('v', id % 300), 'v7') as dv", "id")
    stores.replace_versions(rows.where("id < 0"), path, "dv")
    stores.replace_versions(rows, path, "dv")
    stores.replace_versions(rows.where("dv is null or dv = 'v8'").selectExpr("dv", "-id as id", "'new' as more").where("id > -900"), path, "dv")
    found = sorted((r["dv"] or "", r["id"], r["more"]) for r in spark.read.option("mergeSchema", "true").parquet(path).collect())
    kept = [(f"v{i % 300}", i, None) for i in range(1200) if i % 300 not in (7, 8)]
    assert found == sorted(kept + [(v, -i, "new") for v, k in (("", 7), ("v8", 8)) for i in range(k, 900, 300)])
    assert len(list((tmp_path / "t").rglob("*.parquet"))) <= stores.FOLDERS


def test_stores(spark, tmp_path):
    rows = spark.createDataFrame([("v1", "a", 1), ("v2", "b", 2)], "dataset_version_id string, id string, n int")
    stores.replace_versions(rows, str(tmp_path / "t"))
    stores.replace_versions(rows.filter("n = 1").withColumn("n", F.lit(9)), str(tmp_path / "t"))
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [2, 9]
    changed = stores.upsert(rows, spark.createDataFrame([("v1", "a", 5), ("v3", None, 7)], rows.schema), ["dataset_version_id", "id"])
    assert sorted(r["n"] for r in changed.collect()) == [2, 5, 7]
    assert sorted(r["n"] for r in stores.merge_documents([rows, rows.withColumn("n", F.lit(0))], ["id"]).collect()) == [1, 2]
    lines = stores.prometheus(spark.createDataFrame([("up", {"b": 'q"', "a": "1"}, 2.0)], "metric string, labels map<string,string>, value double")).collect()
    assert lines[0]["line"] == 'up{a="1",b="q\\""} 2'
    stores.append_log(spark.createDataFrame([("e", {"token": "s", "x": "y"})], "event string, details map<string,string>"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).first()["details"]["token"] == "***"
    (tmp_path / "d.json").write_text('{"id": "v", "n": 3}')
    assert stores.read_records(spark, str(tmp_path / "d.json"), "id string, n int").first()["n"] == 3
