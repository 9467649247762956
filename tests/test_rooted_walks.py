import numpy as np

from meshwright.catalog import views
from meshwright.operators import classify, graph
from pyspark.sql import functions as F


def _edges(spark, seed=5):
    rnd = np.random.default_rng(seed)
    rows = [(f"s{k % 2}", f"n{a:03d}", f"n{b:03d}") for k, (a, b) in enumerate(rnd.integers(0, 12, (24, 2)).tolist())]
    rows += [("long", f"c{i:03d}", f"c{i + 1:03d}") for i in range(5)] + [("long", None, "x"), ("s0", "n001", "n001")]
    return spark.createDataFrame(rows, "scope string, a string, b string")


def test_one_pass_tells_what_the_single_operators_do(spark):
    edges = _edges(spark)
    parts = graph.components(edges)
    degree = graph.degrees(edges, parts.select("scope", "node"))
    roots = graph.roots(degree, parts)
    hops = graph.reach(graph.both_ways(edges), roots.select("scope", "node"))
    want = parts.join(roots.withColumnRenamed("node", "root"), ["scope", "component"]).join(degree, ["scope", "node"]).join(hops, ["scope", "node"]).select("scope", "node", "component", "degree", "root", "hops")
    for block in (graph.BLOCK_ROWS, 10):
        assert sorted(map(tuple, graph.survey(edges, block).collect())) == sorted(map(tuple, want.collect()))


def test_failures_of_the_roots_neighbours(spark):
    edges = _edges(spark)
    assert sorted(map(tuple, graph.root_failures(edges).collect())) == sorted(map(tuple, graph.root_failures(edges, 10).collect()))
    chain = spark.createDataFrame([("s", "a", "b"), ("s", "b", "c"), ("s", "c", "d"), ("s", "b", "e")], "scope string, a string, b string")
    assert sorted(r["node"] for r in graph.root_failures(chain).collect()) == ["d"]  # b is the root, its neighbour c fails
    assert graph.root_failures(chain.filter("false")).count() == 0


def test_places_without_a_feature_have_no_partner(spark):
    places = spark.createDataFrame([("d", "", 1), ("d", "f", 2)], "dv string, feature_id string, n int")
    own = spark.createDataFrame([("d", "", "x"), ("d", "f", "y")], "dv string, feature_id string, name string")
    assert [tuple(r) for r in views.of_features(places, own).collect()] == [("d", "f", 2, "y")]


def test_rules_by_precedence(spark):
    rows = [("kabel power utara", ["linestring"]), ("server rack 2", ["point"]), ("lan", []), ("lan", ["linestring"]), ("planet", ["linestring"]), ("", None)]
    df = spark.createDataFrame(rows, "t string, k array<string>").withColumn("f", classify.first_rule("t", "k"))
    assert [r["r"] and tuple(r["r"])[:2] for r in df.select(F.col("f").alias("r")).collect()] == [("cable_path", "infrastructure"), ("device_node", "infrastructure"), None, ("cable_path", "lan"), None, None]
