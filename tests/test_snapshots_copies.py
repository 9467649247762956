import datetime as dt
import itertools
import random

import numpy as np

from meshwright.operators import copies, snapshots

FIELDS = snapshots.Fields(texts=("name",), numbers=(("lon", 0.000001),), exact=("ports",))
SCHEMA = "series string, snapshot string, at timestamp, key string, ref string, received timestamp, name string, lon double, ports int, pair string"


def _rows(spark, rows):
    day = lambda n: None if n is None else dt.datetime(2024, 1, 1 + n, tzinfo=dt.timezone.utc)
    return spark.createDataFrame([(s, p, day(t), k, r, day(t or 0), n, x, c, "clash") for s, p, t, k, r, n, x, c in rows], SCHEMA)


def _diff(spark, rows, **kw):
    return sorted(tuple(r) for r in snapshots.diff_snapshots(_rows(spark, rows), FIELDS, **kw).collect())


def test_snapshots(spark):
    rows = [
        ("d", "s2", 2, "a", "r3", " x ", 1.0000004, 1), ("d", "s1", 1, "a", "r1", "x", 1.0, 1), ("d", "s1", 1, "a", "r1", "x", 1.0, 1), ("d", "s1", 1, "b", "r2", None, None, None), ("d", "s2", 2, "c", "r4", "", 2.0, 2),
        ("d", "s3", 3, "c", "r5", None, 2.000001, 3), ("d", "s3", 3, "a", "r6", "X", None, 1), ("d", "s3", 3, None, "r7", "q", 1.0, 1), ("e", "t1", None, "a", "q1", "x", 1.0, 1), ("e", "t2", 1, "a", "q2", "x", float("nan"), 1),
    ]
    want = [
        ("d", "s2", "b", "r2", "", ""), ("d", "s2", "c", "", "r4", ""), ("d", "s3", "a", "r3", "r6", "lon"), ("d", "s3", "a", "r3", "r6", "name"), ("d", "s3", "c", "r4", "r5", "lon"), ("d", "s3", "c", "r4", "r5", "ports"), ("e", "t2", "a", "q1", "q2", "lon"),
    ]
    assert _diff(spark, rows) == want == _diff(spark, rows, hot_rows=1)
    assert _diff(spark, []) == []


def test_assignment_is_the_least():
    rnd = np.random.default_rng(1)
    for n, m in itertools.product(range(1, 6), repeat=2):
        cost = rnd.integers(0, 6, (n, m)).astype(float)
        got = copies.assign(cost)
        k = min(n, m)
        assert (got >= 0).sum() == k and len(set(got[got >= 0])) == k
        best = min(sum(cost[a, b] for a, b in zip(p, q)) for p in itertools.permutations(range(n), k) for q in [range(m)] if k == m) if n >= m else min(sum(cost[a, b] for a, b in enumerate(q)) for q in itertools.permutations(range(m), n))
        assert sum(cost[i, j] for i, j in enumerate(got) if j >= 0) == best


def test_leaves():
    a = copies.leaves('{"a": {"b": 1, "c": null}, "d": [1, {"x": null}], "e": true, "f": "1"}', "p")
    assert a == copies.leaves(' {"f":"1","d":[1.0,{}],"e":true,"a":{"b":1.00}}', "p")
    assert a["p.f"] != a["p.a.b"] and set(a) == {"p.a.b", "p.d", "p.e", "p.f"}
    assert copies.leaves("not json", "p") == {"p": "t:not json"} and copies.leaves(None, "p") == {} == copies.leaves("  ", "p")


def _compare(spark, rows, **kw):
    df = spark.createDataFrame([("t", k, s, v) for k, s, v in rows], "table_name string, record_id string, side string, vals map<string,string>")
    return sorted(tuple(r)[1:] for r in copies.compare_copies(df, ("p", "j"), {"len": 0.001}, **kw).collect())


def test_copies(spark):
    rows = [
        ("same", "p", {"a": "1", "len": "1.0"}), ("same", "j", {"a": "1", "len": "1.0004"}), ("gone", "p", {"a": "1"}), ("new", "j", {"a": "1"}), ("new", "j", {"a": "1"}),
        ("far", "p", {"len": "1.0", "b": None}), ("far", "j", {"len": "1.001", "c": "x"}), (None, "p", {"a": "1"}), (None, "j", {"a": "2"}),
        ("many", "p", {"a": "1", "b": "1"}), ("many", "p", {"a": "2", "b": "2"}), ("many", "j", {"a": "2", "b": "3"}), ("many", "j", {"a": "1", "b": "1"}), ("many", "j", {"a": "9", "b": "9"}),
    ]
    want = [("", "differs", "a"), ("far", "differs", "c"), ("far", "differs", "len"), ("gone", "missing_in_j", ""), ("many", "differs", "b"), ("many", "missing_in_p", ""), ("new", "missing_in_p", "")]
    assert _compare(spark, rows) == sorted(want)
    assert _compare(spark, rows, once=False) == sorted([*want, ("new", "missing_in_p", "")])
    assert _compare(spark, []) == []


def test_copies_of_a_large_key_lose_no_row(spark):
    rnd = random.Random(4)
    side = lambda s, n: [("hot", s, {"a": str(rnd.randrange(30)), "b": str(i), "s": s}) for i in range(n)]
    out = _compare(spark, side("p", 130) + side("j", 100), once=False, exact_rows=16)
    assert sum(o[1] == "missing_in_j" for o in out) == 30 and sum(o[2] == "s" for o in out) == 100 and not any(o[1] == "missing_in_p" for o in out)
