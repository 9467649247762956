"""Graph operators: degree, components, traversal, failure and its impact.

Graphs come in scopes (a dataset version's). Scopes of up to ``block_rows``
arcs are walked whole inside tasks, all scopes of a partition at once, a level
of all of them a step, in numpy; larger ones across the cluster, one join a
level (or round), each level a table in the shared folder. A node with very
many neighbours is joined by broadcasting its one frontier row, see
``plans.lookups``. Nothing is collected to the driver but counts.

Defined results: arcs with a null end are left out; parallel arcs count once in
traversals and as they are in degrees; a start outside the graph reaches itself
at 0 hops.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lookups import apart, lookup
from ..plans.staging import partitions_for, stage

BLOCK_ROWS = 500_000
#: Levels after which those reached so far are written as one table, so that plans stay small.
LEVELS_HELD = 32
_SEP = "\x1f"


def both_ways(edges: DataFrame) -> DataFrame:
    """(scope, a, b) in both directions of edges (scope, a, b)."""
    return edges.select("scope", F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))


def directed_arcs(edges: DataFrame, direction: str = "direction", keep: tuple[str, ...] = ()) -> DataFrame:
    """Arcs along the stated direction of edges (scope, a, b, direction); undirected edges give none.

    ``source_to_target`` runs from a to b, ``target_to_source`` back,
    ``bidirectional`` both ways.
    """
    there = F.col(direction).isin("source_to_target", "bidirectional")
    back = F.col(direction).isin("target_to_source", "bidirectional")
    arcs = F.array(F.when(there, F.struct("a", "b")), F.when(back, F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return edges.select("scope", *keep, F.inline(F.filter(arcs, lambda x: x.isNotNull())))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(scope, node, degree) of ``nodes`` (scope, node) and of all ends of edges (scope, a, b)."""
    ends = both_ways(edges).filter("a is not null and b is not null").select("scope", F.col("a").alias("node"), F.lit(1).alias("n"))
    return ends.unionByName(nodes.select("scope", "node", F.lit(0).alias("n"))).groupBy("scope", "node").agg(F.sum("n").alias("degree"))


# --- walking whole scopes in tasks --------------------------------------------


def _levels(tails: np.ndarray, heads: np.ndarray, starts: np.ndarray, n: int, most: int | None) -> np.ndarray:
    """Hops of each of n nodes from the starts, -1 for unreached."""
    order = np.argsort(tails, kind="stable")
    heads = heads[order]
    first = np.searchsorted(tails[order], np.arange(n + 1))
    hops = np.full(n, -1)
    hops[starts] = 0
    frontier, step = np.unique(starts), 0
    while len(frontier) and (most is None or step < most):
        step += 1
        count = first[frontier + 1] - first[frontier]
        at = np.repeat(first[frontier] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        reached = np.unique(heads[at])
        frontier = reached[hops[reached] < 0]
        hops[frontier] = step
    return hops


def _labels(one: np.ndarray, two: np.ndarray, n: int) -> np.ndarray:
    """The least of 0..n-1 that each is linked to."""
    label = np.arange(n)
    while len(one):
        x, y = label[one], label[two]
        apart = x != y
        one, two, low, high = one[apart], two[apart], np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    return label


def _numbered(*columns: pa.Array) -> tuple[pa.Array, list[np.ndarray]]:
    """Sorted distinct texts, and the columns as their numbers."""
    whole = pa.concat_arrays(list(columns)).dictionary_encode()
    order = pc.sort_indices(whole.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[whole.indices.to_numpy(zero_copy_only=False)] if len(whole) else np.zeros(0, dtype=np.int64)
    cuts = np.cumsum([len(c) for c in columns])[:-1]
    return whole.dictionary.take(pa.array(order)), np.split(codes, cuts)


def _text(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)


def _whole(rows: DataFrame, count: int, block_rows: int, run, schema: str) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from run(pa.Table.from_batches(held)).to_batches(max_chunksize=50_000)

    return rows.repartition(partitions_for(rows.sparkSession, count, block_rows), "scope").mapInArrow(task, schema)


def _split(rows: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame | None, int]:
    """Rows of small scopes, of large ones (None: there are none), and the number of rows."""
    total = rows.count()
    if total <= block_rows:
        return rows, None, total
    return *apart(rows, "scope", block_rows), total


def reach(arcs: DataFrame, starts: DataFrame, most: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(scope, node, hops): what can be reached from any start (scope, node) of its scope along arcs (scope, a, b), and in how few hops; only up to ``most`` hops, if given."""
    arcs = arcs.filter("a is not null and b is not null").select("scope", "a", "b").distinct()
    marked = arcs.unionByName(starts.filter("node is not null").select("scope", F.col("node").alias("a"), F.lit(None).cast("string").alias("b")).distinct())
    small, large, total = _split(stage(marked), block_rows)

    def run(table: pa.Table) -> pa.Table:
        scope, a, b = (_text(table, c) for c in ("scope", "a", "b"))
        start = b.is_null()
        ends = pc.if_else(start, a, b)
        names, (tail, head) = _numbered(pc.binary_join_element_wise(scope, a, _SEP), pc.binary_join_element_wise(scope, ends, _SEP))
        begin = start.to_numpy(zero_copy_only=False)
        hops = _levels(tail[~begin], head[~begin], tail[begin], len(names), most)
        hit = np.flatnonzero(hops >= 0)
        parts = pc.split_pattern(names.take(pa.array(hit)), _SEP, max_splits=1)
        return pa.table([pc.list_element(parts, 0), pc.list_element(parts, 1), pa.array(hops[hit].astype(np.int32))], names=["scope", "node", "hops"])

    found = _whole(small, total, block_rows, run, "scope string, node string, hops int")
    if large is None:
        return found
    paths = stage(large.filter("b is not null"))
    frontier = stage(large.filter("b is null").select("scope", F.col("a").alias("node"), F.lit(0).alias("hops")))
    seen = frontier
    for step in itertools.count(1) if most is None else range(1, most + 1):
        ahead = lookup(paths, frontier.select("scope", F.col("node").alias("a")), ["scope", "a"], "left_semi")
        ahead = ahead.select("scope", F.col("b").alias("node")).distinct()
        frontier = stage(ahead.join(seen, ["scope", "node"], "left_anti").withColumn("hops", F.lit(step)))
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
        if step % LEVELS_HELD == 0:
            seen = stage(seen)
    return found.unionByName(seen)


def components(edges: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(scope, node, component): components named by their least node, of edges (scope, a, b)."""
    edges = edges.filter("a is not null and b is not null").select("scope", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    small, large, total = _split(stage(edges), block_rows)

    def run(table: pa.Table) -> pa.Table:
        scope, a, b = (_text(table, c) for c in ("scope", "a", "b"))
        names, (one, two) = _numbered(pc.binary_join_element_wise(scope, a, _SEP), pc.binary_join_element_wise(scope, b, _SEP))
        label = _labels(one, two, len(names))
        own, least = pc.split_pattern(names, _SEP, max_splits=1), pc.split_pattern(names.take(pa.array(label)), _SEP, max_splits=1)
        return pa.table([pc.list_element(own, 0), pc.list_element(own, 1), pc.list_element(least, 1)], names=["scope", "node", "component"])

    found = _whole(small, total, block_rows, run, "scope string, node string, component string")
    if large is None:
        return found
    # Large scopes: every node takes the least label among its neighbours', labels then jump to their own labels.
    arcs = stage(both_ways(large))
    labels = stage(arcs.groupBy("scope", F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")))
    while True:
        near = lookup(arcs, labels.select("scope", F.col("node").alias("b"), F.col("component").alias("c")), ["scope", "b"], "inner")
        offers = near.groupBy("scope", F.col("a").alias("node")).agg(F.min("c").alias("c"))
        lower = stage(labels.join(offers, ["scope", "node"]).select("scope", "node", F.col("component").alias("old"), F.least("component", "c").alias("component")))
        jump = lookup(lower, lower.select("scope", F.col("node").alias("component"), F.col("component").alias("far")), ["scope", "component"], "left")
        after = stage(jump.select("scope", "node", "old", F.coalesce("far", "component").alias("component")))
        labels = after.drop("old")
        if not after.filter("old != component").take(1):
            return found.unionByName(labels)


# --- walks from the roots of components, in one pass ----------------------------


def _first_of(group: np.ndarray, *rank: np.ndarray) -> np.ndarray:
    """Positions of the row of least rank in each group."""
    order = np.lexsort((*rank[::-1], group))
    first = np.ones(len(order), dtype=bool)
    first[1:] = group[order][1:] != group[order][:-1]
    return order[first]


def _rooted(tail: np.ndarray, head: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Component and degree of each of n nodes, and the components' roots: the node of most edges, the least among equals."""
    label, degree = _labels(tail, head, n), np.bincount(np.concatenate([tail, head]), minlength=n)
    return label, degree, _first_of(label, -degree, np.arange(n))


def _both(tail: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([tail, head]), np.concatenate([head, tail])


def _cut_off(tail: np.ndarray, head: np.ndarray, n: int) -> np.ndarray:
    """Nodes that the root of their component no longer reaches once its best linked neighbour is gone."""
    label, degree, roots = _rooted(tail, head, n)
    tail, head = _both(tail, head)
    from_root = np.isin(tail, roots) & (tail != head)
    a, b = tail[from_root], head[from_root]
    failed = np.zeros(n, dtype=bool)
    failed[b[_first_of(label[a], -degree[b], b)]] = True
    safe = ~(failed[tail] | failed[head])
    after = _levels(tail[safe], head[safe], roots[~failed[roots]], n, None)
    return np.flatnonzero((after < 0) & ~failed)


def _edges_of(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    scope, a, b = (_text(table, c) for c in ("scope", "a", "b"))
    names, (tail, head) = _numbered(pc.binary_join_element_wise(scope, a, _SEP), pc.binary_join_element_wise(scope, b, _SEP))
    return names, tail, head


def survey(edges: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(scope, node, component, degree, root, hops) of all nodes of edges (scope, a, b): what ``components``, ``degrees``, ``roots`` and ``reach`` tell, whatever the directions, in one pass over each scope."""
    small, large, total = _split(stage(edges.filter("a is not null and b is not null").select("scope", "a", "b")), block_rows)

    def run(table: pa.Table) -> pa.Table:
        names, tail, head = _edges_of(table)
        n = len(names)
        label, degree, roots = _rooted(tail, head, n)
        root_of = np.zeros(n, dtype=np.int64)
        root_of[label[roots]] = roots
        hops = _levels(*_both(tail, head), roots, n, None)
        parts = pc.split_pattern(names, _SEP, max_splits=1)
        scope, node = pc.list_element(parts, 0), pc.list_element(parts, 1)
        return pa.table([scope, node, node.take(pa.array(label)), pa.array(degree.astype(np.int64)), node.take(pa.array(root_of[label])), pa.array(hops.astype(np.int32))], names=["scope", "node", "component", "degree", "root", "hops"])

    found = _whole(small, total, block_rows, run, "scope string, node string, component string, degree long, root string, hops int")
    if large is None:
        return found
    large = stage(large)
    parts = stage(components(large, block_rows))
    degree = stage(degrees(large, parts.select("scope", "node")))
    starts = stage(roots(degree, parts))
    hops = reach(both_ways(large), starts.select("scope", "node"), block_rows=block_rows)
    named = parts.join(starts.withColumnRenamed("node", "root"), ["scope", "component"]).join(degree, ["scope", "node"]).join(hops, ["scope", "node"])
    return found.unionByName(named.select("scope", "node", "component", F.col("degree").cast("long").alias("degree"), "root", "hops"))


def root_failures(edges: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(scope, node): what the root of each component of edges (scope, a, b) no longer reaches when its neighbour of most edges (the least among equals) fails, whatever the directions."""
    small, large, total = _split(stage(edges.filter("a is not null and b is not null").select("scope", "a", "b")), block_rows)

    def run(table: pa.Table) -> pa.Table:
        names, tail, head = _edges_of(table)
        parts = pc.split_pattern(names.take(pa.array(_cut_off(tail, head, len(names)))), _SEP, max_splits=1)
        return pa.table([pc.list_element(parts, 0), pc.list_element(parts, 1)], names=["scope", "node"])

    found = _whole(small, total, block_rows, run, "scope string, node string")
    if large is None:
        return found
    large = stage(large)
    known = stage(survey(large, block_rows))
    arcs = stage(both_ways(large).distinct())
    start = known.filter("node = root").select("scope", F.col("node").alias("a"), "component")
    near = arcs.filter("a != b").join(start, ["scope", "a"]).select("scope", "component", F.col("b").alias("node")).join(known.select("scope", "node", "degree"), ["scope", "node"])
    failed = near.groupBy("scope", "component").agg(F.min(F.struct((-F.col("degree")).alias("d"), "node")).alias("m")).select("scope", F.col("m.node").alias("node"))
    return found.unionByName(impact(arcs, start.select("scope", F.col("a").alias("node")), stage(failed), block_rows))


# --- what is built on them ------------------------------------------------------


def roots(degree: DataFrame, parts: DataFrame, preferred: Column | None = None) -> DataFrame:
    """(scope, component, node): one root a component: preferred nodes first, then by degree, then by id."""
    joined = parts.join(degree, ["scope", "node"])
    rank = F.struct(*([(~F.coalesce(preferred, F.lit(False))).alias("p")] if preferred is not None else []), (-F.col("degree")).alias("d"), F.col("node").alias("n"))
    return joined.groupBy("scope", "component").agg(F.min(rank).alias("r")).select("scope", "component", F.col("r.n").alias("node"))


def tainted(directed: DataFrame, undirected: DataFrame, starts: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(scope, node) reached from the starts through at least one undirected edge.

    Each node exists twice, before and after the first undirected edge; that
    turns the question into one of reach.
    """
    arcs = both_ways(undirected)
    before, after = (lambda c: F.concat(F.lit("0"), c)), (lambda c: F.concat(F.lit("1"), c))
    layer = lambda rows, f, t: rows.select("scope", f(F.col("a")).alias("a"), t(F.col("b")).alias("b"))
    doubled = layer(directed, before, before).unionByName(layer(directed, after, after)).unionByName(layer(arcs, before, after)).unionByName(layer(arcs, after, after))
    found = reach(doubled, starts.select("scope", before(F.col("node")).alias("node")), block_rows=block_rows)
    return found.filter(F.substring("node", 1, 1) == "1").select("scope", F.expr("substring(node, 2)").alias("node"))


def without(arcs: DataFrame, failed: DataFrame) -> DataFrame:
    """Arcs (scope, a, b) that touch no failed node (scope, node)."""
    for end in ("a", "b"):
        arcs = arcs.join(failed.select("scope", F.col("node").alias(end)), ["scope", end], "left_anti")
    return arcs


def impact(arcs: DataFrame, starts: DataFrame, failed: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(scope, node): what the starts reach, but no longer once the failed nodes are gone; the failed ones themselves are left out."""
    arcs = stage(arcs.select("scope", "a", "b").distinct())
    before = reach(arcs, starts, block_rows=block_rows)
    after = reach(without(arcs, failed), starts.join(failed, ["scope", "node"], "left_anti"), block_rows=block_rows)
    return before.select("scope", "node").join(after.select("scope", "node"), ["scope", "node"], "left_anti").join(failed, ["scope", "node"], "left_anti")


def shortest_paths(arcs: DataFrame, starts: DataFrame, most: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(scope, node, hops, before): the fewest hops from the starts, and the least node one hop before on such a path (null at a start)."""
    arcs = stage(arcs.filter("a is not null and b is not null").select("scope", "a", "b").distinct())
    hops = stage(reach(arcs, starts, most, block_rows))
    from_, to = hops.select("scope", F.col("node").alias("a"), F.col("hops").alias("h")), hops.select("scope", F.col("node").alias("b"), F.col("hops").alias("k"))
    steps = lookup(stage(lookup(arcs, from_, ["scope", "a"], "inner")), to, ["scope", "b"], "inner").filter("k = h + 1")
    before = steps.groupBy("scope", F.col("b").alias("node")).agg(F.min("a").alias("before"))
    return hops.join(before, ["scope", "node"], "left").select("scope", "node", "hops", "before")


def collapse(attached: DataFrame, joints: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(scope, a, b, cable, n_lines): devices that follow each other along a cable, as direct edges.

    ``attached`` (scope, line, place, device) says what a line meets, in order
    of ``place`` from its start; ``joints`` (scope, a, b, a_end, b_end) which
    ends (``start`` or ``end``) of two lines run on into each other; without
    a_end and b_end the end of a runs into the start of b. Lines joined make
    one cable, named by its least line. Behind the last device of a line comes
    the first one that is met across a joint, through lines without devices if
    need be; where a cable forks, the first one of each branch. Each pair of
    devices has one edge, by the cable of fewest lines, then of the least name.
    Devices of a cable are linked one to the next, not each to all.
    """
    if "a_end" not in joints.columns:
        joints = joints.withColumn("a_end", F.lit("end")).withColumn("b_end", F.lit("start"))
    joints = stage(joints.select("scope", "a", "a_end", "b", "b_end").dropna())
    cables = components(joints, block_rows).withColumnRenamed("node", "line").withColumnRenamed("component", "cable")
    met = stage(attached.filter("line is not null and device is not null").join(cables, ["scope", "line"], "left").withColumn("cable", F.coalesce("cable", "line")))
    order = Window.partitionBy("scope", "line").orderBy("place", "device")
    following = met.withColumn("next", F.lead("device").over(order)).select("scope", "cable", "device", "next").unionByName(_across(met, joints)).filter("next is not null and next != device")
    sizes = met.groupBy("scope", "cable").agg(F.count_distinct("line").alias("n_lines"))
    pairs = following.join(sizes, ["scope", "cable"]).groupBy("scope", F.least("device", "next").alias("a"), F.greatest("device", "next").alias("b")).agg(F.min(F.struct("n_lines", "cable")).alias("m"))
    return pairs.select("scope", "a", "b", "m.cable", "m.n_lines")


def _across(met: DataFrame, joints: DataFrame) -> DataFrame:
    """(scope, cable, device, next): the outermost device at an end of a line, and each that is met first beyond it; a round for each line without devices between."""
    there = [F.struct(F.col(x).alias("line"), F.col(f"{x}_end").alias("side"), F.col(y).alias("to"), F.col(f"{y}_end").alias("to_side")) for x, y in (("a", "b"), ("b", "a"))]
    over = stage(joints.select("scope", F.inline(F.array(*there))).distinct())
    place = F.struct("place", "device")
    outer = met.join(over.select("scope", "line").distinct(), ["scope", "line"], "left_semi").groupBy("scope", "cable", "line").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    sides = [F.struct(F.lit(s).alias("side"), F.col(f"{c}.device").alias("device")) for s, c in (("start", "low"), ("end", "high"))]
    tips = stage(outer.select("scope", "cable", "line", F.inline(F.array(*sides))))
    met_at = tips.select("scope", "line", "side", F.col("device").alias("next"))
    step = lambda rows: rows.join(over, ["scope", "line", "side"]).select("scope", "cable", "origin", "device", F.col("to").alias("line"), F.col("to_side").alias("side")).distinct()
    front = stage(step(tips.withColumn("origin", F.struct("line", "side"))))
    seen = front
    while front.take(1):
        bare = front.join(met_at, ["scope", "line"], "left_anti").withColumn("side", F.when(F.col("side") == "start", "end").otherwise("start"))
        front = stage(step(bare).join(seen.select("scope", "origin", "line", "side"), ["scope", "origin", "line", "side"], "left_anti"))
        seen = stage(seen.unionByName(front))
    return seen.join(met_at, ["scope", "line", "side"]).select("scope", "cable", "device", "next")


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The induced subgraph: edges (scope, a, b, ...) with both ends among nodes (scope, node)."""
    for end in ("a", "b"):
        edges = edges.join(nodes.select("scope", F.col("node").alias(end)), ["scope", end], "left_semi")
    return edges
