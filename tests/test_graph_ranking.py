import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from meshwright.functions import hashes, text
from meshwright.operators import classify, graph, ranking


def _bfs(arcs, starts, most=10_000):
    ahead = {}
    for s, a, b in arcs:
        if a is not None and b is not None:
            ahead.setdefault((s, a), set()).add(b)
    hops = {(s, n): 0 for s, n in starts if n is not None}
    queue = deque(hops)
    while queue:
        s, a = queue.popleft()
        if hops[(s, a)] < most:
            for b in ahead.get((s, a), ()):
                if (s, b) not in hops:
                    hops[(s, b)] = hops[(s, a)] + 1
                    queue.append((s, b))
    return hops


@pytest.fixture(scope="module")
def some(spark):
    rnd = random.Random(1)
    arcs = [(s, f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for s in ("a", "b") for _ in range(70)] + [("a", "n0", f"m{i}") for i in range(30)] + [("a", None, "n1"), ("a", "n1", "n1"), ("a", "n0", "m1")]
    return arcs, spark.createDataFrame(arcs, "scope string, a string, b string")


@pytest.mark.parametrize("block", [500_000, 90])
def test_reach_components_paths(spark, some, block):
    arcs, df = some
    starts = [("a", "n0"), ("b", "n3"), ("b", "nowhere"), ("b", None)]
    start = spark.createDataFrame(starts, "scope string, node string")
    for most in (10_000, 2):
        assert {(r["scope"], r["node"]): r["hops"] for r in graph.reach(df, start, most, block).collect()} == _bfs(arcs, starts, most)
    both = [(s, b, a) for s, a, b in arcs] + arcs
    parts = {(r["scope"], r["node"]): r["component"] for r in graph.components(df, block).collect()}
    for key in parts:
        assert parts[key] == min(n for _, n in _bfs(both, [key]))
    paths = {(r["scope"], r["node"]): (r["hops"], r["before"]) for r in graph.shortest_paths(df, start, block_rows=block).collect()}
    hops = _bfs(arcs, starts)
    for (s, n), (h, before) in paths.items():
        assert h == hops[(s, n)] and (before is None) == (h == 0)
        assert h == 0 or before == min(a for t, a, b in arcs if (t, b) == (s, n) and hops.get((s, a)) == h - 1)


def test_taint_impact_degrees(spark):
    edge = "scope string, a string, b string, direction string"
    rows = [("s", "r", "x", "source_to_target"), ("s", "x", "y", "undirected"), ("s", "z", "y", "target_to_source"), ("s", "r", "w", "bidirectional"), ("s", "q", "w", "source_to_target")]
    df = spark.createDataFrame(rows, edge)
    root = spark.createDataFrame([("s", "r")], "scope string, node string")
    assert {r["node"] for r in graph.tainted(graph.directed_arcs(df), df.filter("direction = 'undirected'"), root).collect()} == {"y", "z", "x"}
    failed = spark.createDataFrame([("s", "x")], "scope string, node string")
    assert {r["node"] for r in graph.impact(graph.both_ways(df), root, failed).collect()} == {"y", "z"}
    nodes = spark.createDataFrame([("s", "alone"), ("s", "r")], "scope string, node string")
    assert {r["node"]: r["degree"] for r in graph.degrees(df, nodes).collect()} == {"r": 2, "x": 2, "y": 2, "z": 1, "w": 2, "q": 1, "alone": 0}
    empty = df.limit(0)
    assert graph.components(empty).count() == 0 and graph.reach(empty, root).count() == 1
    assert graph.within(df, nodes).count() == 0


def test_pages_and_cursors(spark):
    rows = spark.createDataFrame([(f"c{i:02d}", None if i % 7 == 0 else (i % 5) / 10) for i in range(30)], "id string, score double")
    want = [r["id"] for r in rows.orderBy(F.col("score").desc_nulls_last(), "id").collect()]
    got, after = [], None
    while page := ranking.page_by_key(rows, "score", "id", 7, after).collect():
        got += [r["id"] for r in page]
        after = (page[-1]["score"], page[-1]["id"])
    assert got == want
    query = {"q": "x"}
    cursor = ranking.encode_cursor(revision="r1", query=ranking.signature(query), offset=5)
    assert ranking.decode_cursor(cursor, "r1", query)["offset"] == 5 and ranking.decode_cursor(None, "r1", query) is None
    for bad in (("r2", query), ("r1", {"q": "y"})):
        with pytest.raises(ValueError):
            ranking.decode_cursor(cursor, *bad)
    with pytest.raises(ValueError):
        ranking.decode_cursor("%%%", "r1", query)


def test_search_rank_and_allocation(spark):
    rows = spark.createDataFrame([("cam-1", "gate"), ("x", "cam-1"), ("cam-12", "q"), ("y", "the cam-1 pole"), ("z", None), (None, "cam-1 x")], "id string, name string")
    rank = ranking.search_rank("cam-1", [F.col("id")], F.col("name"), [F.lit("t")], [])
    assert [r[0] for r in rows.select(rank).collect()] == [100, 80, 90, 50, None, 70]
    free = spark.createDataFrame([("t", 2)], "target string, free int")
    wants = spark.createDataFrame([("t", "a", 0.5), ("t", "b", 0.9), ("t", "c", None), ("u", "d", 1.0)], "target string, id string, score double")
    assert {r["id"]: r["accepted"] for r in ranking.allocate(wants, free, ["target"], "score", "id").collect()} == {"b": True, "a": True, "c": False, "d": False}


def test_text_and_rules(spark):
    rows = spark.createDataFrame([("JB-CCTV 007 Extended WP",), ("Kamera 01",), ("Server",), ("Rack  Server",), ("Café_Ｘ",), (None,), ("",)], "n string")
    t = text.token_text(F.col("n"))
    w = text.label_tokens(t)
    out = rows.select(t.alias("t"), F.transform(text.label_aliases(w, t), lambda a: F.array_join(a, " ")).alias("a")).collect()
    assert out[0]["t"] == "jb cctv 007 extended wp" and out[0]["a"] == ["jb cctv 7 extended wp", "jb cctv 7", "cctv 7", "jb 7"]
    assert out[1]["a"] == ["kamera 1", "c 1"] and out[2]["a"] == ["server", "svr"] and out[3]["a"] == ["rack server", "rs", "cr", "svr office"]
    assert out[4]["t"] == "cafe x" and out[5]["t"] == "" == out[6]["t"] and out[5]["a"] == []
    found = spark.createDataFrame([("rack server jb", ["point"]), ("jalur lan", ["linestring"]), ("planet", ["point"]), ("tiang 3", ["point"]), ("tiang 3", [])], "t string, k array<string>").select(classify.first_rule(F.col("t"), F.col("k"))["role"]).collect()
    assert [r[0] for r in found] == ["device_node", "cable_path", None, "device_node", None]
    words = spark.createDataFrame([(["a", "b", "a", "b"], ["a", "b"])], "w array<string>, a array<string>")
    assert words.select(text.sequence_at(F.col("w"), F.col("a"))).first()[0] == [0, 2]


def test_revision_ignores_order(spark):
    rows = [("v", "a", "1"), ("v", "b", None), ("v", "b", None), ("w", None, "x")]
    one = hashes.revision(spark.createDataFrame(rows, "v string, a string, b string"), ["v"], ["a", "b"])
    two = hashes.revision(spark.createDataFrame(rows[::-1], "v string, a string, b string").repartition(3), ["v"], ["a", "b"])
    three = hashes.revision(spark.createDataFrame(rows[1:], "v string, a string, b string"), ["v"], ["a", "b"])
    as_dict = lambda df: {r["v"]: r["revision"] for r in df.collect()}
    assert as_dict(one) == as_dict(two) and as_dict(one)["v"] != as_dict(three)["v"]


def test_collapse(spark):
    attached = spark.createDataFrame([("s", "l1", 0, "a"), ("s", "l1", 2, "b"), ("s", "l2", 2, "c"), ("s", "l3", 0, "a"), ("s", "l3", 1, "b"), ("s", "l4", 0, "z"), ("s", None, 0, "z"), ("s", "l1", 1, None)], "scope string, line string, place int, device string")
    joints = spark.createDataFrame([("s", "l1", "l2")], "scope string, a string, b string")
    assert {tuple(r) for r in graph.collapse(attached, joints).collect()} == {("s", "a", "b", "l3", 1), ("s", "b", "c", "l1", 2)}
    assert graph.collapse(attached.limit(0), joints).count() == 0
