"""Stable ids of objects: given ones, those of a registry, made ones.

Precedence: an id that the object carries; else the one registry entry that its
match keys lead to; several different ones are a conflict; none gives an id
made from dataset, kind of match and value. Keys are unpivoted and joined once,
however many kinds there are; each object's hits are aggregated, not gathered.

Defined results: blank ids and keys are none; an object without any key gets no
id (status ``unidentified``); repeated registry entries count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import trimmed


def made_id(dataset, kind, value):
    """``AUTO-`` and 24 upper-case hex digits of the SHA-256 of dataset, kind and value."""
    return F.concat(F.lit("AUTO-"), F.upper(F.substring(F.sha2(F.concat_ws("|", dataset, kind, value), 256), 1, 24)))


def assign_ids(objects: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    """(object_id, stable_id, status) of objects (object_id, dataset, given_id, keys...) by registry (dataset, key_kind, key_value, stable_id); ``keys`` in order of weight."""
    each = F.array(*[F.struct(F.lit(i).alias("weight"), F.lit(k).alias("key_kind"), trimmed(k).alias("key_value")) for i, k in enumerate(keys)])
    flat = objects.select("object_id", F.coalesce("dataset", F.lit("")).alias("dataset"), trimmed("given_id").alias("given_id"), F.inline(each))
    known = registry.filter("stable_id is not null and key_value is not null").select(F.coalesce("dataset", F.lit("")).alias("dataset"), "key_kind", trimmed("key_value").alias("key_value"), "stable_id").groupBy("dataset", "key_kind", "key_value").agg(F.min("stable_id").alias("low"), F.max("stable_id").alias("high"))
    met = flat.join(known, ["dataset", "key_kind", "key_value"], "left")
    first = F.min(F.when(F.col("key_value").isNotNull(), F.struct("weight", "dataset", "key_kind", "key_value")))
    told = met.groupBy("object_id").agg(F.min("given_id").alias("given_id"), F.min("low").alias("low"), F.max("high").alias("high"), first.alias("first"))
    made = F.when(F.col("first").isNotNull(), made_id(F.col("first.dataset"), F.col("first.key_kind"), F.col("first.key_value")))
    status = F.when(F.col("given_id").isNotNull(), "given").when(F.col("low") != F.col("high"), "conflict").when(F.col("low").isNotNull(), "registry").when(F.col("first").isNotNull(), "made").otherwise("unidentified")
    found = F.when(F.col("given_id").isNotNull(), F.col("given_id")).when(F.col("low") == F.col("high"), F.col("low")).when(F.col("low").isNull(), made)
    return told.select("object_id", found.alias("stable_id"), status.alias("status"))
