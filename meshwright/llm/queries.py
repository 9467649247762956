"""Queries p6 to p10: groups of matches, canonical values, token ids, mixes and pieces of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog.tables import read
from ..functions.ids import id_or_empty, norm_id, trimmed
from ..plans.staging import stage
from . import bpe, components, mixing, sizes, splitting, vocabulary

_SEP = "\x1f"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    scoped = lambda c: F.concat(id_or_empty("dataset_version_id"), F.lit(_SEP), norm_id(c))
    confirmed = read(spark, d, "topology_candidates").filter(F.lower(trimmed("candidate_status")) == "confirmed").select(scoped("source_endpoint_id").alias("a"), scoped("target_asset_id").alias("b"))
    edges = read(spark, d, "graph_edges").filter(F.lower(trimmed("store")) == "postgres").select(scoped("source_node_id").alias("a"), scoped("target_node_id").alias("b"))
    return confirmed.unionByName(edges)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = components.components(_pairs(spark, d))
    v, g = F.split("v", _SEP), F.split("group", _SEP)
    return found.select(v[0].alias("dataset_version_id"), v[1].alias("record_id"), g[1].alias("group_id"))


FIELDS = ["asset_type", "category", "jb_profile_id"]


def _terms(spark: SparkSession, d: str) -> DataFrame:
    names = F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))
    return read(spark, d, "vocabulary_terms").filter("canonical_value is not null").select("field_name", "canonical_value", names.alias("names"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "classified_objects").select(id_or_empty("classified_object_id").alias("id"), F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in FIELDS])))
    found = vocabulary.map_values(rows, _terms(spark, d), known=((), ()))
    return found.select(F.col("id").alias("classified_object_id"), "field_name", "canonical_value")


def p7_exact(spark: SparkSession, d: str) -> DataFrame:
    """What the operator finds for values that are an entry, its label or an alias, whatever their letter case."""
    rows = read(spark, d, "classified_objects").select(id_or_empty("classified_object_id").alias("id"), F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in FIELDS])))
    names = _terms(spark, d).select("field_name", F.explode(F.concat(F.array("canonical_value"), F.col("names"))).alias("name")).select("field_name", F.lower("name").alias("name")).distinct()
    named = rows.withColumn("name", F.lower(trimmed("value"))).join(F.broadcast(names), ["field_name", "name"], "left_semi").select("id", "field_name", "value").distinct()
    return vocabulary.map_values(named, _terms(spark, d)).select(F.col("id").alias("classified_object_id"), "field_name", "canonical_value")


TOKENIZER = "byte_bpe_50k"


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(read(spark, d, "documents"), sizes.ranks_path(TOKENIZER))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = stage(sizes.with_sizes(read(spark, d, "documents").select("doc_id", "source", "text"), sizes.ranks_path(TOKENIZER)))
    return mixing.mix(sized, read(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """How often each text of a mix's sources is used."""
    return _mixed(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached."""
    uses, wanted = _mixed(spark, d)
    return mixing.shares(uses, wanted)


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(read(spark, d, "documents"), read(spark, d, "split_limits"))


QUERIES = {"p6_found": p6_found, "p7_found": p7_found, "p7_exact": p7_exact, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_pieces": p10_pieces}

_WS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(8195) || chr(12288)"


def _id(column: str) -> str:
    return f"nullif(lower(trim({column}, {_WS})), '')"


SQL = {
    "p7_exact": f"""
with v as (
  select distinct coalesce({_id('classified_object_id')}, '') as id, f as field_name, value from (select classified_object_id, unnest([{{'f': 'asset_type', 'value': asset_type}}, {{'f': 'category', 'value': category}}, {{'f': 'jb_profile_id', 'value': jb_profile_id}}], recursive := true) from classified_objects)
), n as (
  select field_name, lower(unnest([canonical_value, label] || coalesce(aliases, []))) as name, canonical_value from vocabulary_terms where canonical_value is not null
), t as (select field_name, name, min(canonical_value) as canonical_value from n where name is not null group by all)
select v.id as classified_object_id, v.field_name, t.canonical_value from v join t on t.field_name = v.field_name and t.name = lower(trim(v.value, {_WS})) where v.value not in (select canonical_value from vocabulary_terms x where x.field_name = v.field_name and canonical_value is not null)""",
    "p6_found": f"""
with recursive pairs as (
  select coalesce({_id('dataset_version_id')}, '') as dv, {_id('source_endpoint_id')} as a, {_id('target_asset_id')} as b from topology_candidates where lower(trim(candidate_status)) = 'confirmed'
  union select coalesce({_id('dataset_version_id')}, ''), {_id('source_node_id')}, {_id('target_node_id')} from graph_edges where lower(trim(store)) = 'postgres'
), e as (
  select dv, a, b from pairs where a is not null and b is not null union select dv, b, a from pairs where a is not null and b is not null
), reach as (
  select distinct dv, a as v, a as r from e union select reach.dv, e.b, reach.r from reach join e on e.dv = reach.dv and e.a = reach.v where reach.r < e.b
)
select dv as dataset_version_id, v as record_id, min(r) as group_id from reach group by all""",
}
