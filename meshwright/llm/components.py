"""Consolidating pairwise matches into groups.

Method: a two-dimensional grid. Vertices are hashed into blocks; the cell of a
pair is that of its two blocks, so the pairs of one vertex, were they a third
of all, lie in a whole row of cells. Every cell runs a local union-find and
sends the representative it found for each vertex; the least over a vertex's
row and column becomes its parent, and the other representatives are tied to it
by new pairs. Rounds go on over these, ever fewer, pairs until no vertex has
two representatives; then the parents of the rounds are composed backwards.

Where: a cell holds about ``cell_pairs`` pairs; a fuller one is split at
random, which union-find doesn't mind. Only counts reach the driver. Each round
is a table in the shared folder.

Defined results: a group is named by its least member. A pair of a vertex with
itself makes a group of one; pairs with a null on either side are no pairs;
repeated pairs count once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lookups import HOT_ROWS, lookup
from ..plans.staging import BROADCAST_ROWS, stage

CELL_PAIRS = 100_000


def union_find(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least vertex linked to each of 0..n-1, by hooking onto lesser roots and halving paths, all pairs at once."""
    parent = np.arange(n)
    while len(a):
        x, y = parent[a], parent[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        open_ = low != high
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(parent, high, low)
        while True:
            above = parent[parent]
            if (above == parent).all():
                break
            parent = above
    return parent


def _cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    both = pa.chunked_array([*table.column("a").chunks, *table.column("b").chunks]).combine_chunks()
    coded = both.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    names = coded.dictionary.take(pa.array(order))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[coded.indices.to_numpy(zero_copy_only=False)]
    root = union_find(codes[: table.num_rows], codes[table.num_rows :], len(order))
    for at in range(0, len(order), 100_000):
        yield pa.RecordBatch.from_arrays([names.slice(at, 100_000), names.take(pa.array(root[at : at + 100_000]))], ["v", "r"])


def components(pairs: DataFrame, cell_pairs: int = CELL_PAIRS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(v, group) of pairs (a, b) of texts."""
    current = stage(pairs.filter("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds = []
    while True:
        n = current.count()
        side = max(1, math.ceil(math.sqrt(n / cell_pairs)))
        block = lambda c, side=side: F.pmod(F.xxhash64(c), F.lit(side))
        cells = current.withColumn("cell", F.least(block("a"), block("b")) * side + F.greatest(block("a"), block("b")))
        parts = side * (side + 1) // 2
        full = stage(cells.groupBy("cell").count().filter(F.col("count") > 2 * cell_pairs).select("cell", F.ceil(F.col("count") / (2 * cell_pairs)).alias("salts")))  # cells with a hot vertex only
        salted = cells.join(F.broadcast(full) if full.count() <= BROADCAST_ROWS else full, "cell", "left") if full.take(1) else cells.withColumn("salts", F.lit(None).cast("long"))
        spread = salted.withColumn("salt", F.pmod(F.xxhash64("b", "a"), F.coalesce("salts", F.lit(1))))
        found = spread.repartition(parts, "cell", "salt").select("a", "b").mapInArrow(_cell, "v string, r string")
        joined = stage(found.groupBy("v").agg(F.array_sort(F.collect_set("r")).alias("rs")))
        rounds.append(joined.select("v", F.col("rs")[0].alias("p")))
        several = joined.filter(F.size("rs") > 1)
        current = stage(several.select(F.col("rs")[0].alias("a"), F.explode(F.slice("rs", 2, F.size("rs"))).alias("b")).distinct())
        if not current.take(1):
            break
    result = rounds[-1].withColumnRenamed("p", "group")
    for earlier in reversed(rounds[:-1]):
        later = result.select(F.col("v").alias("p"), "group")
        result = stage(lookup(earlier, later, ["p"], "left", hot_rows).select("v", F.coalesce("group", "p").alias("group")))
    return result
