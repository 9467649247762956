"""References to records that do not exist.

Method: the parents' keys are partitioned into ranges of their 64-bit hashes
and stored, range by range, as arrays sorted by hash (a written table in the
shared folder); batches of references meet the range they fall into and are
probed by binary search, all of a batch at once, equal hashes being settled by
the keys themselves; the misses are aggregated.

Hashes are spread evenly and of one width however long a key is, so the range
of a key is arithmetic: no bounds are sampled, and no directory of ranges passes
through the driver or to the tasks.

Skew: parents are unique, so ranges are even. A key that a third of all
references names makes one range hot; its references are spread over as many
groups as ``batch_rows`` asks for and the range's arrays go to each of them.
No group holds more than about ``batch_rows`` references and one range.

Defined results: a reference without a value is no reference; no scope equals
the scope ``''``; a reference without a time is missing only if its target has
no time at all or does not exist; a parent without a time is there always.
Repeated parents count once, with their least time. Extra columns of the
references pass through untouched, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import BROADCAST_ROWS, partitions_for, stage

#: Unit separator between the parts of a composed key.
SEP = "\x1f"
RANGE_ROWS = 65_536
BATCH_ROWS = 131_072

ALWAYS = -(2**63)
NEVER = 2**63 - 1


def _range_of(hashed: str, ranges: int) -> Column:
    """The number of the range, of ``ranges`` equal ones, that a hash lies in."""
    return F.expr(f"least(cast(floor((cast({hashed} as double) / 18446744073709551616D + 0.5D) * {ranges}) as bigint), {ranges - 1}L)")


def sorted_ranges(parents: DataFrame, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, int]:
    """(block, hashes, keys, times): parents (key, available_at) as arrays sorted by hash, of about ``range_rows`` each; and the number of ranges."""
    unique = stage(parents.select("key", F.coalesce(F.unix_micros("available_at"), F.lit(ALWAYS)).alias("t")).groupBy("key").agg(F.min("t").alias("t")).selectExpr("xxhash64(key) as h", "key", "t"))
    ranges = max(1, math.ceil(unique.count() / range_rows))
    packed = unique.groupBy(_range_of("h", ranges).alias("block")).agg(F.expr("array_sort(collect_list(struct(h, key, t)))").alias("e"))
    return stage(packed.selectExpr("block", "e.h as hashes", "e.key as keys", "e.t as times")), ranges


def _search(hashes: np.ndarray, keys: pa.Array, wanted_hashes: np.ndarray, wanted: pa.Array) -> np.ndarray:
    """Place of each wanted key, -1 where there is none."""
    at, found = np.searchsorted(hashes, wanted_hashes), np.full(len(wanted_hashes), -1)
    open_ = np.arange(len(wanted_hashes))
    while len(open_):  # once, but where different keys have one hash
        open_ = open_[at[open_] < len(hashes)]
        open_ = open_[hashes[at[open_]] == wanted_hashes[open_]]
        same = pc.equal(keys.take(pa.array(at[open_])), wanted.take(pa.array(open_))).to_numpy(zero_copy_only=False).astype(bool)
        found[open_[same]] = at[open_[same]]
        open_ = open_[~same]
        at[open_] += 1
    return found


def find_orphans(references: DataFrame, parents: DataFrame, range_rows: int = RANGE_ROWS, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """The rows of ``references`` (ref_key, ref_at, any others) without a parent (key, available_at) in time."""
    spark = references.sparkSession
    stored, ranges = sorted_ranges(parents, range_rows)
    names = references.columns
    # Fields are carried under positions, so no name of theirs can clash with ours.
    carried = references.filter(F.col("ref_key").isNotNull()).select(*[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(names)], F.col("ref_key").alias("_k"), F.unix_micros("ref_at").alias("_t"))
    routed = stage(carried.withColumn("_h", F.expr("xxhash64(_k)")).withColumn("_block", _range_of("_h", ranges)))
    total = routed.count()
    # How many groups each hot range's references fill; never more such ranges than may be broadcast.
    each = max(batch_rows, math.ceil(total / BROADCAST_ROWS))
    hot = F.broadcast(routed.groupBy("_block").count().filter(F.col("count") > each).select("_block", F.ceil(F.col("count") / each).cast("int").alias("_n")))
    parts = partitions_for(spark, total, each)
    others = ", ".join(c for c in carried.columns if c != "_k")
    salted = routed.join(hot, "_block", "left").withColumn("_salt", F.expr(f"cast(pmod(xxhash64({others}), coalesce(_n, 1)) as int)")).drop("_n").repartition(parts, "_block", "_salt")
    copies = stored.withColumnRenamed("block", "_block").join(hot, "_block", "left").withColumn("_salt", F.expr("explode(sequence(0, coalesce(_n, 1) - 1))")).drop("_n").repartition(parts, "_block", "_salt")

    def probe(refs: pa.Table, held: pa.Table) -> pa.Table:
        fields = refs.select([f"f{i}" for i in range(len(names))])
        if not refs.num_rows or not held.num_rows:
            return fields
        hashes, keys, times = (held.column(c).combine_chunks().flatten() for c in ("hashes", "keys", "times"))
        at = _search(hashes.to_numpy(), keys, refs.column("_h").to_numpy(), refs.column("_k").combine_chunks())
        since = refs.column("_t").fill_null(NEVER).to_numpy()
        return fields.filter(pa.array((at < 0) | (times.to_numpy()[at] > since)))

    found = (
        salted.groupBy("_block", "_salt")
        .cogroup(copies.groupBy("_block", "_salt"))
        .applyInArrow(probe, ", ".join(f"f{i} {f.dataType.simpleString()}" for i, f in enumerate(references.schema)))
    )
    return found.toDF(*names)


def count_orphans(orphans: DataFrame, references: DataFrame, by: list[str]) -> DataFrame:
    """Orphans and references per group; groups without orphans count 0."""
    total = references.groupBy(*by).agg(F.count(F.lit(1)).alias("n_references"))
    missing = orphans.groupBy(*by).agg(F.count(F.lit(1)).alias("n_orphans"))
    pairs = [F.col(f"t.{c}").eqNullSafe(F.col(f"m.{c}")) for c in by]
    condition = pairs[0]
    for p in pairs[1:]:
        condition = condition & p
    return total.alias("t").join(missing.alias("m"), condition, "left").select(*[f"t.{c}" for c in by], "n_references", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"))
