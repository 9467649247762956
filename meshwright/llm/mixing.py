"""Mixing sources to target weights.

Method: each source of a mix shall give its share of the largest total that the
caps allow, so each of its texts is wanted c = share * total / size of the
source times, c <= max_repeats. The whole part of c is given; the fractions are
rounded by the pivotal method: two texts with fractional probabilities trade
mass (size times probability), in a direction drawn at random so that no
expectation changes, until one of them is decided; it leaves, the other meets
the next text. The size of each source is thereby kept but for one text.

Where: every task rounds the texts it holds and passes on at most one undecided
text per mix and source; those meet in a reduction tree of fan-in ``FAN``, each
level a table in the shared folder, until one text per mix and source is left,
which is drawn by its probability. No source is gathered anywhere, so a source
may hold any part of the rows.

Defined results: texts of no tokens are used 0 times; a source without tokens
or with weight 0 gives nothing, and a mix's total is set by its other sources;
``max_repeats`` below 1 means the source isn't used. Draws depend on ``seed``,
the mix and the two documents only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import trimmed
from ..plans.staging import stage

FAN = 16
#: Rows of the table of targets that may reach the driver.
TARGET_ROWS = 100_000
_MASK = (1 << 64) - 1


def draw(*parts: int) -> float:
    """A number in [0, 1) from whole numbers (splitmix64)."""
    x = 0
    for p in parts:
        x = (x ^ (p & _MASK)) + 0x9E3779B97F4A7C15 & _MASK
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK
        x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
        x ^= x >> 31
    return (x >> 11) / 2**53


def trade(p: float, s: float, q: float, t: float, u: float) -> tuple[float, float]:
    """New probabilities of two texts of sizes s and t after one trade; p s + q t stays, one becomes 0 or 1."""
    up, down = min(1 - p, q * t / s), min(p, (1 - q) * t / s)
    if u * (up + down) < down:
        return (1.0, q - (1 - p) * s / t) if 1 - p <= q * t / s else (p + q * t / s, 0.0)
    return (0.0, q + p * s / t) if p <= (1 - q) * t / s else (p - (1 - q) * t / s, 1.0)


class Rounder:
    """Undecided texts by (mix, source); gives out decided ones."""

    def __init__(self, seed: int):
        self.seed, self.open, self._hashes = seed, {}, {}

    def hashed(self, key: tuple[str, str]) -> tuple[int, int]:
        """Hashes of a target's names: there are few."""
        found = self._hashes.get(key)
        if found is None:
            found = self._hashes[key] = hash_text(key[0]), hash_text(key[1])
        return found

    def add(self, key: tuple[str, str], doc: int, size: int, base: int, p: float) -> Iterator[tuple]:
        eps = 1e-9
        if p <= eps or p >= 1 - eps:
            yield (*key, doc, size, base + (p > 0.5), None)
            return
        other = self.open.pop(key, None)
        if other is None:
            self.open[key] = (doc, size, base, p)
            return
        d, s, b, q = other
        q, p = trade(q, s, p, size, draw(self.seed, *self.hashed(key), d, doc))
        for one in ((d, s, b, q), (doc, size, base, p)):
            if one[3] <= eps or one[3] >= 1 - eps:
                yield (*key, one[0], one[1], one[2] + (one[3] > 0.5), None)
            else:
                self.open[key] = one

    def rest(self) -> Iterator[tuple]:
        for key, (doc, size, base, p) in self.open.items():
            yield (*key, doc, size, base, p)


def hash_text(text: str) -> int:
    x = 1469598103934665603
    for b in text.encode():
        x = (x ^ b) * 1099511628211 & _MASK
    return x


_SCHEMA = "mix_id string, source string, doc_id long, n_tokens long, copies long, p double, task long"


def _rounding(seed: int, task_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rounder, out = task_of(), Rounder(seed), []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([*(pa.array(list(c), k) for c, k in zip(columns, kinds)), pa.array([task] * len(rows), pa.int64())], ["mix_id", "source", "doc_id", "n_tokens", "copies", "p", "task"])

        for rows in batches:
            for mix, source, doc, size, copies, p in zip(*(rows.column(c).to_pylist() for c in ("mix_id", "source", "doc_id", "n_tokens", "copies", "p"))):
                out += rounder.add((mix, source), doc, size, copies, p)
            if len(out) > 50_000:
                yield batch(out)
                out = []
        out += rounder.rest()
        yield batch(out)

    return run


def _last(seed: int):
    """Task that draws the texts that are left by their probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = [int(draw(seed, hash_text(m), hash_text(s), d) < p) for m, s, d, p in zip(*(batch.column(c).to_pylist() for c in ("mix_id", "source", "doc_id", "p")))]
            copies = pc.add(batch.column("copies"), pa.array(drawn, pa.int64()))
            yield batch.set_column(batch.schema.get_field_index("copies"), "copies", copies)

    return run


def plan(sizes: DataFrame, targets: DataFrame) -> list[tuple]:
    """(mix_id, source, share, max_repeats, tokens of the source, wanted tokens) of each target."""
    rows = targets.limit(TARGET_ROWS + 1).collect()
    if len(rows) > TARGET_ROWS:
        raise ValueError(f"more than {TARGET_ROWS} targets")
    total = {r["source"]: r["tokens"] for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").collect()}
    out = []
    for mix in sorted({r["mix_id"] for r in rows}):
        own = [r for r in rows if r["mix_id"] == mix]
        weight = sum(max(0.0, r["weight"] or 0.0) for r in own)
        share = [max(0.0, r["weight"] or 0.0) / weight if weight else 0.0 for r in own]
        most = [max(0, r["max_repeats"] or 0) * (total.get(r["source"]) or 0) / s if s else math.inf for r, s in zip(own, share)]
        possible = min((m for m in most if 0 < m < math.inf), default=0.0)
        for r, s, m in zip(own, share, most):
            out.append((mix, r["source"], s, max(0, r["max_repeats"] or 0), int(total.get(r["source"]) or 0), s * possible if m else 0.0))
    return out


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 20240601) -> tuple[DataFrame, DataFrame]:
    """(uses, wanted): uses (mix_id, source, doc_id, n_tokens, copies) of every text of a mix's sources, sizes (doc_id, source, n_tokens) given.

    ``sizes`` should be a staged table; ``wanted`` has each target's share and tokens.
    """
    spark = sizes.sparkSession
    sizes = sizes.withColumn("source", trimmed("source"))
    targets = targets.select(F.coalesce("mix_id", F.lit("")).alias("mix_id"), trimmed("source").alias("source"), "weight", "max_repeats").filter("source is not null")
    targets = targets.groupBy("mix_id", "source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    planned = plan(sizes, targets)
    wanted = spark.createDataFrame(planned, "mix_id string, source string, target_share double, max_repeats int, available_tokens long, wanted_tokens double")
    rates = spark.createDataFrame([(m, s, min(float(cap), w / t) if t else 0.0) for m, s, _, cap, t, w in planned], "mix_id string, source string, rate double")
    each = sizes.join(F.broadcast(rates), "source").select(
        "mix_id", "source", "doc_id", "n_tokens", F.when(F.col("n_tokens") > 0, F.floor("rate")).otherwise(0).cast("long").alias("copies"), F.when(F.col("n_tokens") > 0, F.col("rate") - F.floor("rate")).otherwise(0.0).alias("p")
    )
    level = stage(each.mapInArrow(_rounding(seed, lambda: TaskContext.get().partitionId()), _SCHEMA))
    decided = [level.filter("p is null")]
    while True:
        open_ = level.filter("p is not null")
        tasks = (open_.agg(F.max("task")).first()[0] or 0) + 1
        most = open_.groupBy("mix_id", "source").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            break
        groups = -(-tasks // FAN)
        near = open_.withColumn("task", F.floor(F.col("task") / FAN)).repartitionByRange(groups, "task").sortWithinPartitions("task", "mix_id", "source", "doc_id")
        level = stage(near.mapInArrow(_rounding(seed + 1, lambda: TaskContext.get().partitionId()), _SCHEMA))
        decided.append(level.filter("p is null"))
    decided.append(open_.mapInArrow(_last(seed), _SCHEMA))  # at most one row per target
    uses = decided[0]
    for part in decided[1:]:
        uses = uses.unionByName(part)
    return uses.drop("p", "task"), wanted


def shares(uses: DataFrame, wanted: DataFrame) -> DataFrame:
    """What each source of each mix gives, and the share reached."""
    used = uses.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.sum((F.col("copies") > 0).cast("long")).alias("n_texts"), F.max("copies").alias("most_copies"))
    total = used.groupBy("mix_id").agg(F.sum("used_tokens").alias("mix_tokens"))
    full = wanted.join(used, ["mix_id", "source"], "left").join(total, "mix_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return full.select("mix_id", "source", "target_share", "max_repeats", "available_tokens", zero("used_tokens"), zero("n_texts"), zero("most_copies"), F.coalesce(F.col("used_tokens") / F.nullif("mix_tokens", F.lit(0)), F.lit(0.0)).alias("reached_share"))
