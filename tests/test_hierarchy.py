import random

import numpy as np

from meshwright.operators import hierarchy


def _brute(links):
    parent = {}
    for g, n, p in links:
        if n is not None:
            key = (g or "", n)
            parent[key] = min((x for x in (parent.get(key), p) if x is not None), default=None)
    out = {}
    for (g, n) in parent:
        path, at, seen = [n], n, {n}
        while True:
            up = parent[(g, at)]
            if up is None or (g, up) not in parent:
                out[(g, n)] = (at, len(path) - 1, path[::-1])
                break
            if up in seen:
                out[(g, n)] = ("cycle", -1, None)
                break
            seen.add(up)
            path.append(up)
            at = up
    return out


def _run(spark, links, **kw):
    df = spark.createDataFrame(links, "scope string, node string, parent string")
    return {(r["scope"], r["node"]): (r["root"], r["level"], r["path"]) for r in hierarchy.resolve(df, ["scope"], paths=True, **kw).collect()}


def _forest(rnd, n, scope):
    out = []
    for i in range(n):
        kind = rnd.random()
        p = f"n{i - 1}" if kind < 0.5 and i else f"n{rnd.randrange(n)}" if kind < 0.6 else f"n{rnd.randrange(max(1, i))}" if kind < 0.9 else rnd.choice([None, "gone", f"n{i}"])
        out.append((scope, f"n{i}", p))
    return out


def test_numpy_contraction_of_chains_and_cycles():
    n = 5000
    chain = np.arange(n) - 1
    root, depth = hierarchy.contract(chain)
    assert (root == 0).all() and (depth == np.arange(n)).all()
    ring = np.roll(np.arange(n), 1)
    assert (hierarchy.contract(ring)[0] == -2).all()
    assert hierarchy.contract(np.array([], dtype=np.int64))[0].size == 0


def test_small_groups_in_tasks(spark):
    rnd = random.Random(5)
    links = [x for s in ("a", "b", None) for x in _forest(rnd, 200, s)] + [("a", None, "n1"), ("a", "n1", None), ("a", "n3", "n0")]
    assert _run(spark, links) == _brute(links)


def test_large_group_across_the_cluster(spark):
    rnd = random.Random(8)
    links = _forest(rnd, 150, "big") + [("big", f"leaf{i}", "n5") for i in range(60)] + _forest(rnd, 20, "small")
    assert _run(spark, links, block_rows=40, hot_rows=30) == _brute(links)


def test_empty_and_descendants(spark):
    assert _run(spark, []) == {}
    df = spark.createDataFrame([("s", "a", None), ("s", "b", "a"), ("s", "c", "b")], "scope string, node string, parent string")
    rows = {(r["ancestor"], r["node"], r["levels"]) for r in hierarchy.descendants(hierarchy.resolve(df, ["scope"], paths=True), ["scope"]).collect()}
    assert rows == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}
