"""Writers and stores: versioned tables, upserts, logs, metrics."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.staging import stage

#: The column that names the folder of a version, and how many folders a table of versions has.
FOLDER, FOLDERS = "version_folder", 64
#: Attribute names that a log must not hold.
SECRET = r"(?i)(password|secret|token|authorization|cookie|api_?key)"


def replace_versions(rows: DataFrame, path: str, by: str = "dataset_version_id") -> None:
    """Replace just the versions that ``rows`` holds, in a table that keeps its versions in folders by hash.

    A version lies in one folder whole, so files are as many as folders (more for
    large ones), however many versions there are and however ``rows`` is spread.
    Folders of the versions replaced are written anew, with the other versions in them.
    """
    spark = rows.sparkSession
    rows = stage(rows.withColumn(FOLDER, F.expr(f"pmod(hash(`{by}`), {FOLDERS})")))
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    at = [f"{path.rstrip('/')}/{FOLDER}={r[0]}" for r in rows.select(FOLDER).distinct().collect()]
    held = [f for f in at if system.exists(spark._jvm.org.apache.hadoop.fs.Path(f))]
    if held:
        old = spark.read.option("basePath", path).option("mergeSchema", "true").parquet(*held)
        given = rows.select(F.col(by).alias("_given")).distinct()
        rows = rows.unionByName(old.join(given, F.col(by).eqNullSafe(F.col("_given")), "left_anti"), allowMissingColumns=True)
    rows.hint("rebalance", FOLDER).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(FOLDER).parquet(path)


def upsert(current: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """``current`` with rows of the same key replaced by ``changes`` and new ones added; null keys match each other."""
    condition = None
    for k in key:
        same = F.col(f"c.{k}").eqNullSafe(F.col(f"n.{k}"))
        condition = same if condition is None else condition & same
    kept = current.alias("c").join(changes.select(*key).distinct().alias("n"), condition, "left_anti")
    return kept.unionByName(changes, allowMissingColumns=True)


def merge_documents(frames: list[DataFrame], key: list[str]) -> DataFrame:
    """Parsed documents in the order given; the first record of a key stays."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("_doc", F.lit(k)) for k, f in enumerate(frames)])
    order = Window.partitionBy(*key).orderBy("_doc")
    return every.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_doc")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one a file, by a given schema; broken ones have nulls."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """JSON lines, appended; values of attributes with secret names are masked."""
    masked = [F.transform_values(c, lambda k, v: F.when(k.rlike(SECRET), "***").otherwise(v)).alias(c) if t.startswith("map<string,string>") else F.lit("***").alias(c) if re.search(SECRET, c) else F.col(c) for c, t in rows.dtypes]
    rows.select(*masked).write.mode("append").json(path)


def prometheus(metrics: DataFrame) -> DataFrame:
    """Lines of text exposition of metrics (metric, labels map<string,string>, value)."""
    clean = lambda v: F.regexp_replace(F.regexp_replace(F.coalesce(v, F.lit("")), r"\\", r"\\\\"), '"', r'\\"')
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), clean(e["value"]), F.lit('"'))), ",")
    number = F.when(F.col("value") == F.floor("value"), F.col("value").cast("long").cast("string")).otherwise(F.col("value").cast("string"))
    return metrics.select(F.concat(F.col("metric"), F.when(F.size("labels") > 0, F.concat(F.lit("{"), labels, F.lit("}"))).otherwise(F.lit("")), F.lit(" "), number).alias("line"))
