import datetime as dt
import random

from pyspark.sql import functions as F

from meshwright.operators import orphans

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
REFS = "ref_key string, ref_at timestamp, record string, _k string, keys int"
PARENTS = "key string, available_at timestamp"


def _at(n):
    return None if n is None else T0 + dt.timedelta(hours=n)


def _check(spark, refs, parents, **kw):
    least = {}
    for k, t in parents:
        if k is not None:
            least[k] = min(least.get(k, 10**9), -(10**9) if t is None else t)
    want = sorted((r[2] for r in refs if r[0] is not None and (r[0] not in least or least[r[0]] > (10**8 if r[1] is None else r[1]))), key=str)
    a = spark.createDataFrame([(k, _at(t), r, "x", 1) for k, t, r in refs], REFS)
    b = spark.createDataFrame([(k, _at(t)) for k, t in parents], PARENTS)
    found = orphans.find_orphans(a, b.filter("key is not null"), **kw)
    assert found.columns == a.columns
    assert sorted((r["record"] for r in found.collect()), key=str) == want


def test_against_brute_force_with_a_hot_key(spark):
    rnd = random.Random(3)
    parents = [(f"k{rnd.randrange(300)}", rnd.choice([None, *range(20)])) for _ in range(500)]
    refs = [(rnd.choice(["k1", "k1", f"k{rnd.randrange(400)}", "", "é" * 3]), rnd.choice([None, *range(20)]), f"r{i}") for i in range(1500)]
    _check(spark, refs, parents, range_rows=17, batch_rows=50)


def test_empty_sides_and_nulls(spark):
    _check(spark, [("a", 1, "r"), (None, 1, "s")], [])
    _check(spark, [], [("a", 1)])
    _check(spark, [(None, 1, "s")], [(None, 1), ("b", 2)])
    _check(spark, [("x" * 5000, 1, "r"), ("x" * 5000 + "y", 1, "s")], [("x" * 5000, 1)])


def test_counts(spark):
    refs = spark.createDataFrame([("t", "a"), ("t", "b"), (None, "c")], "t string, r string")
    out = {r["t"]: (r["n_references"], r["n_orphans"]) for r in orphans.count_orphans(refs.filter("r = 'a'"), refs, ["t"]).collect()}
    assert out == {"t": (2, 1), None: (1, 0)}
    assert orphans.count_orphans(refs, refs, ["t"]).agg(F.sum("n_orphans")).first()[0] == 3
