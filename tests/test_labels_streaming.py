import datetime as dt

from meshwright.operators import labels
from meshwright.streaming import deliveries

NAMES = "scope string, {} string, name string"


def test_labels(spark):
    lines = spark.createDataFrame([("s", "l1", "Kabel JB-004 - Kamera 07 WP"), ("s", "l2", "jb 4 extended"), ("s", "l3", None), ("t", "l4", "jb 4"), ("s", "l5", "cam x c 7 and 004")], NAMES.format("line_id"))
    devices = spark.createDataFrame([("s", "d1", "JB 004"), ("s", "d2", "Kamera 7"), ("s", "d3", "Tiang"), ("s", "d4", "tiang"), ("s", "d5", None)], NAMES.format("device_id"))
    found = {(r["line_id"], r["device_id"], r["label"]) for r in labels.match_labels(lines, devices).collect()}
    assert found == {("l1", "d1", "jb 4"), ("l1", "d2", "kamera 7"), ("l2", "d1", "jb 4"), ("l5", "d2", "c 7"), ("l5", "d1", "4")}
    assert labels.match_labels(lines, devices.limit(0)).count() == 0


def test_stream_of_deliveries(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, 1, n, tzinfo=dt.timezone.utc)
    kind = "id string, v int, at timestamp"
    spark.createDataFrame([("A", 1, day(1)), (" a ", 1, day(2)), ("b", 2, day(3)), (None, 3, day(3)), (None, 3, day(4))], kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    for name, df in (("firsts", deliveries.first_of_stream(stream, "id", "at")), ("counts", deliveries.counts_by_window(stream, "at", ["v"]))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append" if name == "firsts" else "complete").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r["v"] for r in spark.table("firsts").collect()) == [1, 2, 3]
    assert sum(r["n"] for r in spark.table("counts").collect()) == 5
