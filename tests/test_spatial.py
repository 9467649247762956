import random

import numpy as np

from meshwright.operators import gridjoin, spatial

POINTS = "scope string, id string, owner string, lon double, lat double"


def _brute_near(rows, radius):
    out, seen = set(), {}
    for s, i, o, x, y in rows:
        if i is not None and x is not None and y is not None and np.isfinite([x, y]).all():
            seen[(s or "", i, x, y)] = o or ""
    keys = list(seen.items())
    for k, ((s, i, x, y), o) in enumerate(keys):
        for (t, j, u, v), q in keys[k + 1 :]:
            if s == t and o != q and spatial.haversine(np.array([x]), np.array([y]), np.array([u]), np.array([v]))[0] <= radius:
                out.add((min(i, j), max(i, j)))
    return out


def _points(rnd, n, scope, lon, lat, spread):
    return [(scope, f"{scope}{i}", f"o{rnd.randrange(n)}", ((lon + rnd.uniform(-spread, spread) + 180) % 360) - 180, max(-90.0, min(90.0, lat + rnd.uniform(-spread, spread)))) for i in range(n)]


def test_near_against_brute_force(spark):
    rnd = random.Random(2)
    rows = _points(rnd, 300, "a", 10, 50, 0.0004) + _points(rnd, 100, "date", 180, 0, 0.0002) + _points(rnd, 60, "pole", 30, 89.9999, 0.0001) + [("dense", f"d{i}", f"o{i}", 5.0, 5.0) for i in range(40)]
    rows += [rows[0], ("a", None, "o", 10.0, 50.0), ("a", "nowhere", "o", None, 50.0), ("a", "nan", "o", float("nan"), 1.0), (None, "x", None, 1.0, 1.0), (None, "y", "o", 1.0, 1.0)]
    df = spark.createDataFrame(rows, POINTS)
    for block in (8_192, 25):
        found = [tuple(r) for r in spatial.near_pairs(spatial.build_blocks(df, block), 3.0).collect()]
        assert len(found) == len(set(found)) and set(found) == _brute_near(rows, 3.0)
    assert spatial.near_pairs(spatial.build_blocks(df.limit(0)), 3.0).count() == 0


def _inside(x, y, rings):
    odd = False
    for ring in rings:
        for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
            if (b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a:
                odd = not odd
    return odd


def test_containing_against_brute_force(spark):
    rnd = random.Random(6)
    rows = _points(rnd, 400, "a", 0, 0, 1.0) + _points(rnd, 50, "b", 0, 0, 1.0)
    shapes = []
    for k in range(30):
        x, y, r = rnd.uniform(-1, 1), rnd.uniform(-1, 1), rnd.uniform(0.05, 0.9)
        ring = [(float(x + r * np.cos(t)), float(y + r * np.sin(t))) for t in np.linspace(0, 2 * np.pi, 9)[:-1]]
        hole = [(float(x + r / 3 * np.cos(t)), float(y + r / 3 * np.sin(t))) for t in np.linspace(0, 2 * np.pi, 5)[:-1]]
        shapes.append(("ab"[k % 2], f"g{k}", [ring, hole] if k % 3 else [ring]))
    want = {tuple(sorted((i, g))) for s, i, _, x, y in rows for t, g, rings in shapes if s == t and _inside(x, y, rings)}
    kind = "scope string, id string, rings array<array<struct<lon:double,lat:double>>>"
    regions = spark.createDataFrame([*shapes, ("a", "flat", [[(0.0, 0.0), (1.0, 1.0)]]), ("a", "none", None), ("a", None, [[(0.0, 0.0), (1.0, 1.0), (1.0, 0.0)]]), shapes[0]], kind)
    for block in (8_192, 30):
        found = [tuple(r) for r in spatial.containing(spatial.build_blocks(spark.createDataFrame(rows, POINTS), block), regions).collect()]
        assert len(found) == len(set(found)) and set(found) == want
    assert spatial.containing(spatial.build_blocks(spark.createDataFrame(rows, POINTS)), regions.limit(0)).count() == 0


def test_grid_join_against_brute_force(spark):
    rnd = random.Random(9)
    rows = _points(rnd, 150, "a", 100, -10, 0.0006) + _points(rnd, 60, "d", 180, 60, 0.0003) + _points(rnd, 30, "p", 0, -89.9999, 0.0002)
    df = spark.createDataFrame(rows, POINTS)
    pairs = gridjoin.near_points(df.selectExpr("scope", "id as left_id", "lon", "lat"), df.selectExpr("scope", "id as right_id", "lon", "lat"), 12.0)
    found = [(r["left_id"], r["right_id"]) for r in pairs.collect()]
    x, y = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    want = {(a[1], b[1]) for k, a in enumerate(rows) for b, d in zip(rows, spatial.haversine(x[k], y[k], x, y)) if a[0] == b[0] and d <= 12.0}
    assert len(found) == len(set(found)) and set(found) == want


def test_lines(spark):
    place = lambda *p: [(float(a), float(b)) for a, b in p]
    rows = [("s", "l1", place((0, 0), (0.001, 0))), ("s", "l2", place((0.0005, -0.0005), (0.0005, 0.0005))), ("s", "l3", place((0.001, 0), (0, 0))), ("s", "l4", place((179.9999, 1), (-179.9999, 1))), ("s", "l5", place((180, 0.9999), (180, 1.0001))), ("s", "short", place((1, 1)))]
    df = spark.createDataFrame(rows, "scope string, line_id string, line array<struct<lon:double,lat:double>>")
    assert {(r["first_line"], r["second_line"]) for r in gridjoin.crossings(df).collect()} == {("l1", "l2"), ("l2", "l3"), ("l4", "l5")}
    assert {(r["first_line"], r["second_line"]) for r in gridjoin.overlaps(df).collect()} == {("l1", "l3")}
    assert {r["line_id"]: r["n_lines"] for r in gridjoin.duplicate_lines(df).collect()} == {"l1": 2, "l3": 2}
    points = spark.createDataFrame([("s", "on", 0.0003, 0.000001), ("s", "off", 0.0003, 0.001)], "scope string, point_id string, lon double, lat double")
    hit = {(r["line_id"], r["point_id"]): r["measure"] for r in gridjoin.points_on_lines(points, df, 2.0).collect()}
    assert set(hit) == {("l1", "on"), ("l3", "on")} and abs(hit[("l1", "on")] - 33.36) < 0.1
