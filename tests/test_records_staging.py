import datetime as dt

import numpy as np
import pyarrow as pa
import pytest

from meshwright.operators import copies, orphans
from meshwright.plans import lookups, records, staging

T = [dt.datetime(2024, 1, d, tzinfo=dt.timezone.utc) for d in range(1, 9)]


def test_the_first_delivery_counts_as_a_whole(spark):
    rows = [("k", "b", "y", T[1]), ("k", "z", "a", T[0]), ("l", "q", None, None), ("l", "p", "p", T[2]), (None, "a", "a", T[3]), (None, "a", "a", T[1]), (None, "c", None, T[1])]
    found = records.first_deliveries(spark.createDataFrame(rows, "k string, `x y` string, z string, received timestamp"), ["k"], "received")
    assert found.columns == ["k", "x y", "z", "received"]
    got = sorted(((r[0], r[1], r[2]) for r in found.collect()), key=str)
    assert got == sorted([("k", "z", "a"), ("l", "p", "p"), (None, "a", "a"), (None, "c", None)], key=str)


def test_equal_hashes_of_different_keys_are_told_apart():
    hashes, keys = np.array([3, 5, 5, 5, 9]), pa.array(["a", "b", "c", "d", "e"])
    found = orphans._search(hashes, keys, np.array([5, 5, 5, 9, 1, 12, 3]), pa.array(["d", "b", "x", "e", "a", "e", "a"]))
    assert found.tolist() == [3, 1, -1, 4, -1, -1, 0]


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    session = type("Session", (), {"conf": type("C", (), {"get": lambda self, k, d: d})(), "sparkContext": Context()})()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_folder(session)


def test_larger_groups_apart_by_broadcast_and_by_join(spark, monkeypatch):
    rows = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 1), ("c", 1), ("c", 2), (None, 3)], "g string, n int")
    for most in (staging.BROADCAST_ROWS, 0):
        monkeypatch.setattr(lookups, "BROADCAST_ROWS", most)
        small, large = lookups.apart(rows, "g", 1)
        assert sorted(r["g"] or "" for r in small.collect()) == ["", "b"] and large.count() == 11
    assert lookups.apart(rows, "g", 9)[1] is None


def test_tolerances_of_texts_that_are_no_numbers(spark):
    rows = [("t", "1", "p", {"x": "many"}), ("t", "1", "j", {"x": "1.0"}), ("t", "2", "p", {"x": "1.0", "y": None}), ("t", "2", "j", {"x": "1.0004"}), ("t", "3", "p", {"x": "many"}), ("t", "3", "p", {"x": "few", "y": "a"}), ("t", "3", "j", {"x": "few"}), ("t", "3", "j", {"x": "2"})]
    df = spark.createDataFrame(rows, "table_name string, record_id string, side string, vals map<string,string>")
    got = sorted(tuple(r)[1:] for r in copies.compare_copies(df, ("p", "j"), {"x": 0.001}).collect())
    assert got == [("1", "differs", "x"), ("3", "differs", "x"), ("3", "differs", "y")]


@pytest.mark.parametrize("exact", [1, 2, 5, 11, 12, 13, 500])
def test_eleven_of_twelve_rows_pair_whatever_the_switch(spark, exact):
    left = [("t", "k", "p", {"a": str(i), "b": "old", "c": str(i % 3)}) for i in range(12)]
    right = [("t", "k", "j", {"a": str(i), "b": "new", "c": str(i % 3)}) for i in range(1, 12)]
    df = spark.createDataFrame(left + right, "table_name string, record_id string, side string, vals map<string,string>")
    got = sorted(tuple(r)[2:] for r in copies.compare_copies(df, ("p", "j"), exact_rows=exact).collect())
    assert got == [("differs", "b")] * 11 + [("missing_in_j", "")]
