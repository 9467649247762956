"""Parent-child links to full hierarchies.

Method: tree contraction. Leaves are raked off and chains of nodes with one
child are compressed (of two neighbours at most one, by a coin), in turn, until
nothing but roots is left; each removal is recorded. Read backwards, the record
gives every node its root, depth and path from the node it was removed onto. A
cycle never ends that way: it contracts to a node linked to itself, which marks
all that hang on it.

Where: groups of up to ``block_rows`` nodes (a version's links) are contracted
whole inside a task, many groups to a partition, in numpy. A larger group (one
may hold a third of all rows) is contracted across the cluster, one join per
half round on the node's own unique key, each round written to the shared
folder, until its core fits a task; the number of rounds grows with the
logarithm of the group. A parent with very many children is joined by
broadcasting that one parent, see ``plans.lookups``.

Defined results: a link to a node that the group does not hold is no link; a
node without a link is its own root at level 0; a node on a cycle or leading
into one has root ``cycle``, level -1 and no path. A node that occurs twice
counts once, with its least link. No scope equals the scope ``''``; rows
without a node id are no nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lookups import HOT_ROWS, apart, lookup
from ..plans.staging import partitions_for, stage

BLOCK_ROWS = 250_000
CYCLE = "cycle"
_SEP = "\x1f"


def contract(link: np.ndarray, weight: np.ndarray | None = None, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(root, depth) of each node; ``link`` is the parent's index or -1. Root -2 and depth -1: a cycle."""
    n = len(link)
    link, weight = link.copy(), np.ones(n, dtype=np.int64) if weight is None else weight.astype(np.int64)
    root, depth = np.where(link < 0, np.arange(n), -2), np.where(link < 0, 0, -1)
    active, record, coins = np.flatnonzero(link >= 0), [], np.random.default_rng(seed)
    while len(active):
        active = active[link[active] != active]  # a node linked to itself is what is left of a cycle
        children = np.bincount(link[active], minlength=n)
        leaf = children[active] == 0
        if leaf.any():
            raked = active[leaf]
            record.append((raked, link[raked].copy(), weight[raked].copy()))
            active = active[~leaf]
            children = np.bincount(link[active], minlength=n)
        only = np.full(n, -1)
        only[link[active]] = active
        coin = coins.random(n) < 0.5
        picked = active[(children[active] == 1) & coin[active] & ~coin[link[active]]]
        if len(picked):
            record.append((picked, link[picked].copy(), weight[picked].copy()))
            child = only[picked]
            link[child], weight[child] = link[picked], weight[child] + weight[picked]
            gone = np.zeros(n, dtype=bool)
            gone[picked] = True
            active = active[~gone[active]]
    for nodes, onto, far in reversed(record):
        root[nodes] = root[onto]
        depth[nodes] = np.where(root[onto] == -2, -1, depth[onto] + far)
    return root, depth


def _solve(table: pa.Table, core: bool, paths: bool) -> pa.RecordBatch:
    """Contract all groups of a partition; ``core``: what is left of larger groups, with weights and skipped nodes."""
    group, node, parent = (table.column(c).combine_chunks() for c in ("g", "node", "parent"))
    own = pc.binary_join_element_wise(group, node, _SEP)
    index = pc.index_in(pc.binary_join_element_wise(group, parent, _SEP), value_set=own)
    link = index.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    weight = table.column("w").combine_chunks().to_numpy().astype(np.int64) if core else np.ones(len(link), dtype=np.int64)
    root, depth = contract(link, weight)
    names, ends = np.array(node.to_pylist(), dtype=object), np.array(parent.to_pylist(), dtype=object)
    tops = np.where(root >= 0, names[np.maximum(root, 0)], CYCLE) if len(root) else np.array([], dtype=object)
    if core and len(root):  # a core's link to a node outside it leads to a root
        ok = root >= 0
        top = np.maximum(root, 0)
        tops = np.where(ok, ends[top], CYCLE)
        depth = np.where(ok, depth + weight[top], -1)
    out = [group, node, pa.array(tops, pa.string()), pa.array(depth.astype(np.int32))]
    if paths:
        via = table.column("via").to_pylist() if core else None
        found: list = [None] * len(link)
        for i in np.argsort(depth, kind="stable"):
            if root[i] >= 0:
                before = found[link[i]] if link[i] >= 0 else [ends[i]] if core else []
                found[i] = [*before, *(via[i] if core else ()), names[i]]
        out.append(pa.array(found, pa.list_(pa.string())))
    return pa.RecordBatch.from_arrays(out, ["g", "node", "root", "level", *["path"] * paths])


def _in_tasks(df: DataFrame, rows: int, block_rows: int, core: bool, paths: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            done = _solve(pa.Table.from_batches(held), core, paths)
            for at in range(0, done.num_rows, 50_000):
                yield done.slice(at, 50_000)

    return df.repartition(partitions_for(df.sparkSession, rows, block_rows), "g").mapInArrow(run, "g string, node string, root string, level int" + ", path array<string>" * paths)


def _across(nodes: DataFrame, block_rows: int, paths: bool, hot_rows: int) -> DataFrame:
    """Contraction of large groups by joins; ``nodes`` has g, node, parent."""
    held = nodes.select("g", F.col("node").alias("parent"), F.lit(True).alias("held"))
    joined = lookup(nodes, held, ["g", "parent"], "left", hot_rows)
    linked = stage(joined.select("g", "node", F.when(F.col("held"), F.col("parent")).alias("parent")))
    ends = linked.filter("parent is null").select("g", "node", F.col("node").alias("root"), F.lit(0).alias("level"), *[F.array("node").alias("path")] * paths)
    current = linked.filter("parent is not null").withColumn("w", F.lit(1)).withColumn("via", F.array().cast("array<string>"))
    record, done, turn = [], [ends], 0
    while True:
        turn += 1
        # Rake: nodes on which no other node hangs.
        hung = current.filter("parent != node").select("g", F.col("parent").alias("node")).distinct().withColumn("hung", F.lit(True))
        raked = stage(current.join(hung, ["g", "node"], "left"))
        record.append(raked.filter("hung is null and parent != node").drop("hung"))
        done.append(raked.filter("hung is null and parent = node").select("g", "node", F.lit(CYCLE).alias("root"), F.lit(-1).alias("level"), *[F.lit(None).cast("array<string>").alias("path")] * paths))
        current = raked.filter("hung is not null").drop("hung")
        largest = current.groupBy("g").count().agg(F.max("count")).first()[0] or 0
        if largest <= block_rows:
            break
        # Compress: nodes with one child, if their coin shows heads and their parent's tails.
        coin = lambda c, t=turn: F.pmod(F.xxhash64("g", c, F.lit(t)), F.lit(2)) == 0
        kids = current.filter("parent != node").groupBy("g", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("child"))
        judged = stage(current.join(kids, ["g", "node"], "left").withColumn("picked", F.coalesce((F.col("n") == 1) & (F.col("parent") != F.col("node")) & coin("node") & ~coin("parent"), F.lit(False))).drop("n"))
        picked = judged.filter("picked")
        record.append(picked.drop("picked", "child"))
        skipped = picked.select("g", F.col("child").alias("node"), F.col("parent").alias("up"), F.col("w").alias("w2"), F.concat("via", F.array("node")).alias("via2"))
        current = (
            judged.filter("not picked")
            .drop("picked", "child")
            .join(skipped, ["g", "node"], "left")
            .select("g", "node", F.coalesce("up", "parent").alias("parent"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), F.when(F.col("up").isNull(), F.col("via")).otherwise(F.concat("via2", "via")).alias("via") if paths else F.col("via"))
        )
    rows = current.count()
    if rows:
        done.append(stage(_in_tasks(current, rows, block_rows, True, paths)))
    # Backwards: what was removed last is found first.
    for removed in reversed(record):
        known = done[0]
        for part in done[1:]:
            known = known.unionByName(part)
        above = known.select("g", F.col("node").alias("parent"), "root", F.col("level").alias("above"), *[F.col("path").alias("before")] * paths)
        back = lookup(removed, above, ["g", "parent"], "inner", hot_rows).select(
            "g", "node", "root", F.when(F.col("root") == CYCLE, F.lit(-1)).otherwise(F.col("above") + F.col("w")).cast("int").alias("level"), *[F.concat("before", "via", F.array("node")).alias("path")] * paths
        )
        done.append(stage(back))
    known = done[0]
    for part in done[1:]:
        known = known.unionByName(part)
    return known


def resolve(links: DataFrame, by: list[str], paths: bool = False, block_rows: int = BLOCK_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(by..., node, root, level[, path]) of ``links`` (by..., node, parent); the columns of ``by`` are texts."""
    group = F.concat_ws(_SEP, *[F.coalesce(F.col(c), F.lit("")) for c in by])
    nodes = stage(links.filter("node is not null").select(group.alias("g"), "node", "parent").groupBy("g", "node").agg(F.min("parent").alias("parent")))
    rows = nodes.count()
    small, large = apart(nodes, "g", block_rows) if rows > block_rows else (nodes, None)
    parts = [_in_tasks(small, rows, block_rows, False, paths)]
    if large is not None:
        parts.append(_across(stage(large), block_rows, paths, hot_rows))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    split = F.split("g", _SEP, -1)
    return found.select(*[split[i].alias(c) for i, c in enumerate(by)], "node", "root", "level", *["path"] * paths)


def descendants(resolved: DataFrame, by: list[str]) -> DataFrame:
    """(by..., ancestor, node, levels): every node below every node, from the paths."""
    return resolved.filter("path is not null").select(*by, F.posexplode("path").alias("at", "ancestor"), "node", "level").filter("ancestor != node").select(*by, "ancestor", "node", (F.col("level") - F.col("at")).cast("int").alias("levels"))
