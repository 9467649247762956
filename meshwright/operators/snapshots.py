"""What changed between full snapshots.

Method: every row gets the hash of its canonical form; the rows of a snapshot
and those of the one before it meet in a full outer join on the primary key.
A missing side is an addition or a removal, unequal hashes are a change, whose
fields are then compared one by one. Rows of equal hash go no further.

Both sides are joined on (series, pair of snapshots, key), which no key can
skew; the small table of snapshots is joined by ``plans.lookups`` as one
snapshot may hold a third of all rows.

Defined results: snapshots follow each other by time, then by id; those without
a time come first. Texts are compared trimmed with letter case, null like
empty; numbers with a tolerance differ from it on; null differs from a value.
Rows without a key are no records. The first delivery of a repeated row counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import text_or_empty
from ..plans.lookups import HOT_ROWS, lookup
from ..plans.records import first_deliveries
from ..plans.staging import stage


@dataclass(frozen=True)
class Fields:
    """The compared fields: texts, numbers with the difference that counts, and values compared as they are."""

    texts: tuple[str, ...] = ()
    numbers: tuple[tuple[str, float], ...] = ()
    exact: tuple[str, ...] = ()

    @property
    def names(self) -> list[str]:
        return [*self.texts, *(n for n, _ in self.numbers), *self.exact]

    def canonical_hash(self) -> Column:
        """Equal hashes: no field differs. Numbers enter rounded to their tolerance, so that noise seldom gives unequal ones."""
        absent = F.lit("\x00")
        return F.xxhash64(
            *[text_or_empty(t) for t in self.texts],
            *[F.coalesce(F.round(F.col(n) / t).cast("decimal(38,0)").cast("string"), F.col(n).cast("string"), absent) for n, t in self.numbers],
            *[F.coalesce(F.col(e).cast("string"), absent) for e in self.exact],
        )

    def differing(self, before: str, after: str) -> Column:
        """The names of the fields that differ, as an array."""
        tests = [(t, text_or_empty(f"{before}.{t}") != text_or_empty(f"{after}.{t}")) for t in self.texts]
        for n, tolerance in self.numbers:
            a, b = F.col(f"{before}.{n}"), F.col(f"{after}.{n}")
            # The least difference that counts, less what floating point may lose of it.
            tests.append((n, ~a.eqNullSafe(b) & (a.isNull() | b.isNull() | (F.abs(a - b) >= tolerance * (1 - 1e-6)))))
        tests += [(e, ~F.col(f"{before}.{e}").eqNullSafe(F.col(f"{after}.{e}"))) for e in self.exact]
        return F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in tests]), lambda x: x.isNotNull())


def diff_snapshots(rows: DataFrame, fields: Fields, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(series, snapshot, key, before_ref, after_ref, field_name) of rows (series, snapshot, at, key, ref, received, fields...)."""
    rows = first_deliveries(rows.filter("key is not null and snapshot is not null"), ["series", "snapshot", "key"], "received")
    rows = stage(rows.withColumn("hash", fields.canonical_hash()).drop("received"))
    in_order = Window.partitionBy("series").orderBy(F.col("at").asc_nulls_first(), "snapshot")
    snapshots = rows.groupBy("series", "snapshot").agg(F.min("at").alias("at")).select("series", "snapshot", F.lead("snapshot").over(in_order).alias("next"), (F.row_number().over(in_order) == 1).alias("first"))
    placed = lookup(rows.drop("at"), stage(snapshots), ["series", "snapshot"], "inner", hot_rows)
    value = F.struct("ref", "hash", *fields.names)
    after = placed.filter("not first").select("series", F.col("snapshot").alias("pair"), "key", value.alias("a"))
    before = placed.filter("next is not null").select("series", F.col("next").alias("pair"), "key", value.alias("b"))
    joined = before.join(after, ["series", "pair", "key"], "full_outer").filter("a is null or b is null or a.hash != b.hash")
    changed = F.when(F.col("a").isNull() | F.col("b").isNull(), F.array(F.lit(""))).otherwise(fields.differing("b", "a"))
    return joined.select(
        "series", F.col("pair").alias("snapshot"), "key", F.coalesce("b.ref", F.lit("")).alias("before_ref"), F.coalesce("a.ref", F.lit("")).alias("after_ref"), F.explode(changed).alias("field_name")
    )
