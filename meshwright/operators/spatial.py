"""Points near other points, and the regions that contain them.

Method: dual-tree join. The points of all scopes are put in order of (scope,
Z-order of the place) by a range partitioning and cut into blocks of bounded
size, written to the shared folder. A block holds a forest of bounding boxes;
pairs of nodes are compared from the roots down: those too far apart are
discarded, those certainly near are accepted whole, the rest is refined to
their children and at last to points. Scopes that span several blocks get the
same treatment one level up: a tree over the boxes of their blocks, descended
across the cluster, gives the pairs of blocks that touch; these exchange only
the points that lie within reach of the other's box. Polygons descend the same
trees; a leaf that no edge of the polygon crosses is taken or left whole.

Boxes are three-dimensional (positions on the sphere), so the date line and
the poles need no special case; a pair that is not certain is decided by the
haversine formula.

Where: no task holds more than a few blocks. A dense spot costs what its pairs
cost to write, no more; a scope that holds a third of all points is spread over
its blocks.

Defined results: rows without a scope have the scope ``''``; rows without an
id or a finite place take no part; a repeated id within one place counts once.
Points on an edge are inside or not as the even-odd rule says; unclosed rings
are closed, rings of less than three corners ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS, finite, morton
from ..plans.lookups import lookup
from ..plans.staging import stage

BLOCK_ROWS = 8_192
LEAF, FAN = 8, 4
#: Children of a node of the trees over blocks.
BLOCK_FAN = 32
#: Pairs of points weighed at once.
CHUNK = 1_000_000
#: Metres by which boxes are taken larger, or near pairs closer, against rounding.
SLACK = 1e-5
POLYGONS_EACH = 256

BOX = ["x0", "y0", "z0", "x1", "y1", "z1"]
FLAT = ["lon0", "lat0", "lon1", "lat1"]


def positions(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    a, b = np.radians(lon), np.radians(lat)
    return EARTH_RADIUS * np.stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)], axis=1)


def haversine(lon1, lat1, lon2, lat2) -> np.ndarray:
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS * np.arcsin(np.minimum(1, np.sqrt(h)))


class Forest:
    """Trees of boxes over rows sorted by scope; nodes never mix scopes. The last level is that of the roots."""

    def __init__(self, scope: np.ndarray, values: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        n = len(scope)
        new = np.ones(n, dtype=bool)
        new[1:] = scope[1:] != scope[:-1]
        starts, group, each = np.arange(n), np.cumsum(new) - 1, leaf
        trees = int(group[-1]) + 1 if n else 0
        low, high = values, values
        self.levels: list[tuple[np.ndarray, ...]] = []
        self.scope_of_root = scope[new]
        while n and (not self.levels or len(starts) > trees):
            first = np.ones(len(group), dtype=bool)
            first[1:] = group[1:] != group[:-1]
            run = np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))
            cut = np.flatnonzero((np.arange(len(group)) - run) % each == 0)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            ends = np.append(cut[1:], len(group))
            group = group[cut]
            starts = cut
            rows = cut if not self.levels else self.levels[-1][4][cut]
            stops = np.append(rows[1:], n)
            # children (or rows) from, to; low and high corner; rows from, to
            self.levels.append((cut, ends, low, high, rows, stops))
            each = fan


def cross(a0, a1, b0, b1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (pair, i, j) with i in [a0, a1) and j in [b0, b1) of each pair of ranges."""
    wide = b1 - b0
    count = (a1 - a0) * wide
    pair = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
    return pair, a0[pair] + at // wide[pair], b0[pair] + at % wide[pair]


def _ranges_in_chunks(a0, a1, b0, b1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``cross`` in pieces of about CHUNK pairs; long ranges are cut."""
    if not len(a0):
        return
    wide = np.maximum(1, CHUNK // np.maximum(1, b1 - b0))
    pieces = -(-(a1 - a0) // wide)
    which = np.repeat(np.arange(len(a0)), pieces)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    s0 = a0[which] + nth * wide[which]
    s1 = np.minimum(s0 + wide[which], a1[which])
    t0, t1 = b0[which], b1[which]
    sums = np.cumsum((s1 - s0) * (t1 - t0))
    at, done = 0, 0
    while at < len(s0):
        to = max(at + 1, int(np.searchsorted(sums, done + CHUNK, side="right")))
        _, i, j = cross(s0[at:to], s1[at:to], t0[at:to], t1[at:to])
        yield i, j
        done, at = sums[to - 1], to


def near(scope: np.ndarray, lon: np.ndarray, lat: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of rows of one scope at most ``radius`` metres apart; rows are sorted by scope."""
    if not len(lon):
        return
    forest = Forest(scope, positions(lon, lat))
    # Chords are shorter than arcs; the chord of the radius bounds certain nearness.
    far, sure = radius + SLACK, 2 * EARTH_RADIUS * np.sin(radius / 2 / EARTH_RADIUS) - SLACK
    a = b = np.arange(len(forest.levels[-1][0]))
    for depth in range(len(forest.levels) - 1, -1, -1):
        start, end, low, high, rows, stops = forest.levels[depth]
        gap = np.maximum(0, np.maximum(low[a] - high[b], low[b] - high[a]))
        keep = (gap**2).sum(axis=1) <= far**2
        a, b = a[keep], b[keep]
        span = np.maximum(high[a] - low[b], high[b] - low[a])
        whole = (span**2).sum(axis=1) <= max(0.0, sure) ** 2
        for i, j in _ranges_in_chunks(rows[a[whole]], stops[a[whole]], rows[b[whole]], stops[b[whole]]):
            keep = i < j
            yield i[keep], j[keep]
        a, b = a[~whole], b[~whole]
        if depth:
            pair, i, j = cross(start[a], end[a], start[b], end[b])
            keep = (a[pair] != b[pair]) | (i <= j)
            a, b = i[keep], j[keep]
        else:
            for i, j in _ranges_in_chunks(rows[a], stops[a], rows[b], stops[b]):
                keep = i < j
                i, j = i[keep], j[keep]
                keep = haversine(lon[i], lat[i], lon[j], lat[j]) <= radius
                yield i[keep], j[keep]


class Polygons:
    """Edges of polygons, polygon by polygon."""

    def __init__(self, shapes: list[list[list[dict]]]):
        edges, counts = [np.zeros((0, 4))], []
        for rings in shapes:
            n = 0
            for ring in rings:
                ring = np.array([(p["lon"], p["lat"]) for p in ring or () if p is not None], dtype=float).reshape(-1, 2)
                ring = ring[np.isfinite(ring).all(axis=1)]
                if len(ring) >= 3:
                    edges.append(np.hstack([ring, np.roll(ring, -1, axis=0)]))
                    n += len(ring)
            counts.append(n)
        self.edges = np.vstack(edges)
        self.start = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def _with_edges(self, polygon: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position in ``polygon``, edge) for all edges, in pieces of about CHUNK."""
        size = self.start[polygon + 1] - self.start[polygon]
        sums, at, done = np.cumsum(size), 0, 0
        while at < len(polygon):
            to = max(at + 1, int(np.searchsorted(sums, done + CHUNK, side="right")))
            part = np.arange(at, to)
            one = np.repeat(part, size[part])
            nth = np.arange(len(one)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
            yield one, self.edges[self.start[polygon[one]] + nth]
            done, at = sums[to - 1], to

    def odd(self, polygon: np.ndarray, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        """Whether each place lies inside its polygon (even-odd rule)."""
        crossings = np.zeros(len(polygon), dtype=np.int64)
        for one, edge in self._with_edges(polygon):
            x1, y1, x2, y2 = edge.T
            x, y = lon[one], lat[one]
            over = (y1 > y) != (y2 > y)
            with np.errstate(divide="ignore", invalid="ignore"):
                hit = over & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            crossings += np.bincount(one[hit], minlength=len(polygon))
        return crossings % 2 == 1

    def boxes(self) -> np.ndarray:
        """(lon0, lat0, lon1, lat1) of each polygon; empty ones meet nothing."""
        out = np.tile([np.inf, np.inf, -np.inf, -np.inf], (len(self.start) - 1, 1))
        for k, (a, b) in enumerate(zip(self.start[:-1], self.start[1:])):
            if b > a:
                out[k] = [*self.edges[a:b, :2].min(axis=0), *self.edges[a:b, :2].max(axis=0)]
        return out

    def crossed(self, polygon: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the box of any edge of the polygon meets the node's box."""
        out = np.zeros(len(polygon), dtype=bool)
        for one, edge in self._with_edges(polygon):
            x1, y1, x2, y2 = edge.T
            meets = (np.minimum(x1, x2) <= high[one, 0]) & (np.maximum(x1, x2) >= low[one, 0]) & (np.minimum(y1, y2) <= high[one, 1]) & (np.maximum(y1, y2) >= low[one, 1])
            out[one[meets]] = True
        return out


def inside(scope: np.ndarray, lon: np.ndarray, lat: np.ndarray, polygons: Polygons, scopes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(polygon, row) of each row inside a polygon of its scope; rows are sorted by scope."""
    if not len(lon) or not len(scopes):
        return
    flat = np.stack([lon, lat], axis=1)
    forest = Forest(scope, flat)
    roots = {s: k for k, s in enumerate(forest.scope_of_root.tolist())}
    p = np.array([k for k, s in enumerate(scopes.tolist()) if s in roots], dtype=np.int64)
    node = np.array([roots[s] for s in scopes.tolist() if s in roots], dtype=np.int64)
    box = polygons.boxes()
    for depth in range(len(forest.levels) - 1, -1, -1):
        start, end, low, high, rows, stops = forest.levels[depth]
        keep = (box[p, :2] <= high[node]).all(axis=1) & (box[p, 2:] >= low[node]).all(axis=1)
        p, node = p[keep], node[keep]
        for at in range(0, len(p), 50_000):
            q, m = p[at : at + 50_000], node[at : at + 50_000]
            mixed = polygons.crossed(q, low[m], high[m])
            # No edge comes near: one corner of the box stands for all of it.
            sure = ~mixed
            sure[sure] = polygons.odd(q[sure], low[m[sure], 0], low[m[sure], 1])
            pair, row, _ = cross(rows[m[sure]], stops[m[sure]], np.zeros(sure.sum(), dtype=np.int64), np.ones(sure.sum(), dtype=np.int64))
            yield q[sure][pair], row
            p[at : at + 50_000] = np.where(mixed, q, -1)
        node, p = node[p >= 0], p[p >= 0]
        if depth:
            pair, child, _ = cross(start[node], end[node], np.zeros(len(node), dtype=np.int64), np.ones(len(node), dtype=np.int64))
            p, node = p[pair], child
        else:
            pair, row, _ = cross(rows[node], stops[node], np.zeros(len(node), dtype=np.int64), np.ones(len(node), dtype=np.int64))
            q = p[pair]
            keep = (flat[row] >= box[q, :2]).all(axis=1) & (flat[row] <= box[q, 2:]).all(axis=1)
            q, row = q[keep], row[keep]
            hit = polygons.odd(q, lon[row], lat[row])
            yield q[hit], row[hit]


# --- blocks -----------------------------------------------------------------


def _codes(column: pa.Array) -> np.ndarray:
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def build_blocks(points: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks (block, parts, scope, id, owner, lon, lat) of points (scope, id, owner, lon, lat); ``parts`` has each scope's box."""
    ordered = points.filter(F.col("id").isNotNull() & finite("lon") & finite("lat")).select(
        F.coalesce("scope", F.lit("")).alias("scope"), "id", F.coalesce("owner", F.lit("")).alias("owner"), "lon", "lat", morton(F.col("lon"), F.col("lat")).alias("z")
    )

    def pack(table: pa.Table, block: int) -> pa.RecordBatch:
        table = table.combine_chunks()
        columns = {c: table.column(c).chunk(0) for c in ("scope", "id", "owner", "lon", "lat")}
        lon, lat = columns["lon"].to_numpy(), columns["lat"].to_numpy()
        code, where = _codes(columns["scope"]), positions(lon, lat)
        cut = np.flatnonzero(np.diff(code, prepend=-1))
        low, high = np.minimum.reduceat(where, cut), np.maximum.reduceat(where, cut)
        flat = [f.reduceat(v, cut) for f in (np.minimum, np.maximum) for v in (lon, lat)]
        names = columns["scope"].take(pa.array(cut)).to_pylist()
        parts = [dict(zip(["scope", *BOX, *FLAT], [names[k], *low[k].tolist(), *high[k].tolist(), *[float(v[k]) for v in flat]])) for k in range(len(cut))]
        kind = pa.list_(pa.struct([("scope", pa.string()), *[(c, pa.float64()) for c in (*BOX, *FLAT)]]))
        lists = [pa.array([c.to_numpy(zero_copy_only=False)], pa.list_(c.type)) for c in columns.values()]
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([parts], kind), *lists], ["block", "parts", *columns])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, n, last = TaskContext.get().partitionId(), 0, [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, scopes = batch.column("id"), batch.column("scope")
            # Deliveries of one point lie side by side.
            same = np.zeros(batch.num_rows, dtype=bool)
            code, owner = _codes(ids), _codes(scopes)
            same[1:] = (code[1:] == code[:-1]) & (owner[1:] == owner[:-1])
            same[0] = last == (scopes[0].as_py(), ids[0].as_py())
            last = (scopes[-1].as_py(), ids[-1].as_py())
            held.append(batch.filter(pa.array(~same)))
            n += held[-1].num_rows
            while n >= block_rows:
                table = pa.Table.from_batches(held)
                yield pack(table.slice(0, block_rows), (task << 32) + number)
                number, held, n = number + 1, table.slice(block_rows).to_batches(), n - block_rows
        if n:
            yield pack(pa.Table.from_batches(held), (task << 32) + number)

    part = "array<struct<scope:string," + ",".join(f"{c}:double" for c in (*BOX, *FLAT)) + ">>"
    return stage(
        ordered.repartitionByRange("scope", "z", "id")
        .sortWithinPartitions("scope", "z", "id")
        .drop("z")
        .mapInArrow(blocks, f"block long, parts {part}, scope array<string>, id array<string>, owner array<string>, lon array<double>, lat array<double>")
    )


def _trees(parts: DataFrame) -> tuple[DataFrame, int]:
    """Nodes (scope, level, node, children) over the parts of each scope, and the number of levels."""
    ranked = parts.withColumn("node", F.row_number().over(Window.partitionBy("scope").orderBy("block")) - 1)
    most = parts.groupBy("scope").count().agg(F.max("count")).first()[0] or 0
    levels, box = [ranked.select("scope", F.lit(0).alias("level"), F.col("node").cast("long").alias("node"), "block", *BOX, *FLAT)], []
    for low, high in (("x0", "x1"), ("y0", "y1"), ("z0", "z1"), ("lon0", "lon1"), ("lat0", "lat1")):
        box += [F.min(low).alias(low), F.max(high).alias(high)]
    depth = 1
    while BLOCK_FAN**depth < most:
        below = levels[-1]
        levels.append(below.groupBy("scope", F.floor(F.col("node") / BLOCK_FAN).alias("up")).agg(*box).select("scope", F.lit(depth).alias("level"), F.col("up").alias("node"), F.lit(None).cast("long").alias("block"), *BOX, *FLAT))
        depth += 1
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
    children = nodes.groupBy("scope", (F.col("level") + 1).alias("level"), F.floor(F.col("node") / BLOCK_FAN).alias("node")).agg(F.collect_list(F.struct("node", "block", *BOX, *FLAT)).alias("children"))
    return stage(children.filter(F.col("level") <= depth)), depth


def _gap2(a: str, b: str):
    total = F.lit(0.0)
    for axis in "xyz":
        gap = F.greatest(F.lit(0.0), F.col(f"{a}.{axis}0") - F.col(f"{b}.{axis}1"), F.col(f"{b}.{axis}0") - F.col(f"{a}.{axis}1"))
        total = total + gap * gap
    return total


def _touching(trees: DataFrame, depth: int, radius: float) -> DataFrame:
    """(scope, a, b): pairs of parts of different blocks of a scope within reach, by descending pairs of nodes."""
    top = trees.filter(F.col("level") == depth).select("scope", F.col("children").alias("ca"), F.col("children").alias("cb"), F.lit(True).alias("same"))
    for level in range(depth - 1, -1, -1):
        pairs = top.select("scope", F.explode("ca").alias("a"), "cb", "same").select("scope", "a", F.explode("cb").alias("b"), "same")
        pairs = pairs.filter((~F.col("same") | (F.col("a.node") <= F.col("b.node"))) & (_gap2("a", "b") <= (radius + SLACK) ** 2))
        if not level:
            return pairs.filter("a.node != b.node").select("scope", "a", "b")
        pairs = stage(pairs.select("scope", F.col("a.node").alias("na"), F.col("b.node").alias("nb")))
        down = trees.filter(F.col("level") == level).select("scope", "node", "children")
        one = lookup(pairs, down.select("scope", F.col("node").alias("na"), F.col("children").alias("ca")), ["scope", "na"], "inner")
        two = lookup(stage(one), down.select("scope", F.col("node").alias("nb"), F.col("children").alias("cb")), ["scope", "nb"], "inner")
        top = two.select("scope", "ca", "cb", (F.col("na") == F.col("nb")).alias("same"))
    return top


PAIRS = "first_id string, second_id string"


def _named(ids: pa.Array, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    one, two = ids.take(pa.array(i)), ids.take(pa.array(j))
    swap = pc.greater(one, two)
    return pa.RecordBatch.from_arrays([pc.if_else(swap, two, one), pc.if_else(swap, one, two)], ["first_id", "second_id"])


def near_pairs(blocks: DataFrame, radius: float) -> DataFrame:
    """(first_id, second_id): points of one scope and different owners at most ``radius`` metres apart."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                scope, ids, owner, lon, lat = (row.column(c).flatten() for c in ("scope", "id", "owner", "lon", "lat"))
                code, who = _codes(scope), _codes(owner)
                for i, j in near(code, lon.to_numpy(), lat.to_numpy(), radius):
                    keep = who[i] != who[j]
                    yield _named(ids, i[keep], j[keep])

    found = blocks.select("scope", "id", "owner", "lon", "lat").mapInArrow(within, PAIRS)
    parts = blocks.select("block", F.explode("parts").alias("p")).select("block", "p.*")
    several = parts.groupBy("scope").count().filter("count > 1").select("scope")
    parts = stage(parts.join(several, "scope", "left_semi"))
    if not parts.take(1):
        return found
    trees, depth = _trees(parts)
    touching = stage(_touching(trees, depth, radius).withColumn("pair", F.monotonically_increasing_id()))
    other = lambda me, you, side: touching.select(F.col(f"{me}.block").alias("block"), F.struct("pair", F.lit(side).alias("side"), "scope", *[F.col(f"{you}.{c}").alias(c) for c in BOX]).alias("to"))
    wanted = other("a", "b", 0).unionByName(other("b", "a", 1)).groupBy("block").agg(F.collect_list("to").alias("to"))
    lists = ["scope", "id", "owner", "lon", "lat"]

    def slivers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                scope, ids, owner, lon, lat = (row.column(c).flatten() for c in lists)
                where, names = positions(lon.to_numpy(), lat.to_numpy()), np.array(scope.to_pylist(), dtype=object)
                for to in row.column("to")[0].as_py():
                    box = np.array([to[c] for c in BOX])
                    reach = ((where >= box[:3] - radius - SLACK) & (where <= box[3:] + radius + SLACK)).all(axis=1) & (names == to["scope"])
                    at = pa.array(np.flatnonzero(reach))
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), to["pair"])), pa.array(np.full(len(at), to["side"], dtype=np.int32)), *(c.take(at) for c in (ids, owner, lon, lat))], ["pair", "side", "id", "owner", "lon", "lat"]
                        )

    sent = blocks.select("block", *lists).join(wanted, "block").drop("block").mapInArrow(slivers, "pair long, side int, id string, owner string, lon double, lat double")

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            pair, side, lon, lat = (table.column(c).to_numpy() for c in ("pair", "side", "lon", "lat"))
            ids, who = table.column("id").chunk(0), _codes(table.column("owner").chunk(0))
            for i, j in near(pair, lon, lat, radius):
                keep = (side[i] != side[j]) & (who[i] != who[j])
                yield _named(ids, i[keep], j[keep])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 50_000:
                table = pa.Table.from_batches(held)
                pair = table.column("pair").to_numpy()
                whole = int(np.searchsorted(pair, pair[-1]))  # the last pair may go on
                if whole:
                    yield from done(table.slice(0, whole))
                    held, n = table.slice(whole).to_batches(), n - whole
        if n:
            yield from done(pa.Table.from_batches(held))

    across = sent.withColumn("z", morton(F.col("lon"), F.col("lat"))).repartition("pair").sortWithinPartitions("pair", "z").drop("z").mapInArrow(between, PAIRS)
    return found.unionByName(across)


def containing(blocks: DataFrame, polygons: DataFrame) -> DataFrame:
    """(first_id, second_id), the smaller id first: points of ``blocks`` inside polygons (scope, id, rings) of their scope."""
    corners = F.flatten("rings")
    regions = polygons.filter("id is not null and size(rings) > 0").select(F.coalesce("scope", F.lit("")).alias("scope"), "id", "rings").dropDuplicates(["scope", "id"])
    edge = lambda f, c: f(F.transform(F.filter(corners, lambda p: finite(p["lon"]) & finite(p["lat"])), lambda p: p[c]))
    regions = stage(regions.select("*", *[edge(f, c).alias(f"{c}{k}") for k, f in ((0, F.array_min), (1, F.array_max)) for c in ("lon", "lat")]).filter("lon0 is not null"))
    trees, depth = _trees(stage(blocks.select("block", F.explode("parts").alias("p")).select("block", "p.*")))
    place = regions.select("scope", "id", *FLAT)
    at = place.withColumn("node", F.lit(0).cast("long"))
    for level in range(depth, 0, -1):
        down = trees.filter(F.col("level") == level).select("scope", "node", "children")
        met = F.filter("children", lambda c: (c["lon0"] <= F.col("lon1")) & (c["lon1"] >= F.col("lon0")) & (c["lat0"] <= F.col("lat1")) & (c["lat1"] >= F.col("lat0")))
        at = lookup(at, down, ["scope", "node"], "inner").select("scope", "id", *FLAT, F.explode(met).alias("c"))
        at = stage(at.select("scope", "id", *FLAT, F.col("c.node").alias("node"), F.col("c.block").alias("block")))
    counts = at.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    sized = lookup(at.select("scope", "id", "block"), counts, ["block"], "inner")
    chunk = F.pmod(F.xxhash64("scope", "id"), F.ceil(F.col("n") / POLYGONS_EACH)).alias("chunk")
    full = lookup(stage(sized.select("scope", "id", "block", chunk)), regions.select("scope", "id", "rings"), ["scope", "id"], "inner")
    grouped = stage(full.groupBy("block", "chunk").agg(F.collect_list(F.struct("scope", "id", "rings")).alias("regions")))
    joined = lookup(grouped, blocks.select("block", "scope", F.col("id").alias("ids"), "lon", "lat"), ["block"], "inner").select("regions", "scope", "ids", "lon", "lat")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                scope, ids, lon, lat = (row.column(c).flatten() for c in ("scope", "ids", "lon", "lat"))
                encoded = scope.dictionary_encode()
                known = {s: c for c, s in enumerate(encoded.dictionary.to_pylist())}
                some = [r for r in row.column("regions")[0].as_py() if r["scope"] in known]
                names = pa.array([r["id"] for r in some], pa.string())
                shapes = Polygons([r["rings"] for r in some])
                for p, i in inside(encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), lon.to_numpy(), lat.to_numpy(), shapes, np.array([known[r["scope"]] for r in some])):
                    one, two = names.take(pa.array(p)), ids.take(pa.array(i))
                    swap = pc.greater(one, two)
                    yield pa.RecordBatch.from_arrays([pc.if_else(swap, two, one), pc.if_else(swap, one, two)], ["first_id", "second_id"])

    return joined.mapInArrow(test, PAIRS)
