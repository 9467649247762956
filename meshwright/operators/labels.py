"""Label joins: which devices a line's name speaks of.

The names by which a device may be called are looked up among the runs of
words in the lines' names, as an equi-join on (scope, run of words), never
line by line against device by device. A run that names more than one device
stands for none of them; of names found at overlapping places the longer wins.

Defined results: names without words match nothing; a line that names the same
device twice has it once, at its first place. Runs are as long as the longest
name by which a device of the scope may be called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label_aliases, label_tokens, token_text
from ..plans.staging import stage


def runs(most, words: str = "words"):
    """array<struct(at, n, run)>: all runs of up to ``most`` words."""
    one = lambda i, n: F.struct(i.alias("at"), n.alias("n"), F.array_join(F.slice(words, i + 1, n), " ").alias("run"))
    places = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)))
    each = F.transform(places, lambda i: F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.lit(most), F.size(words) - i), F.lit(1))), lambda n: one(i, n)))
    return F.filter(F.flatten(each), lambda r: r["run"] != "")


def match_labels(lines: DataFrame, devices: DataFrame, extra_words: int = 0) -> DataFrame:
    """(scope, line_id, device_id, at, label) of lines (scope, line_id, name) and devices (scope, device_id, name).

    ``extra_words``: also call a device by the last so many words of its name.
    """
    words = lambda df: df.withColumn("t", token_text(F.col("name"))).withColumn("words", label_tokens(F.col("t")))
    own = words(devices)
    names = label_aliases(F.col("words"), F.col("t"))
    if extra_words:
        names = F.array_union(names, F.when(F.size("words") > extra_words, F.array(F.slice("words", -extra_words, extra_words))).otherwise(F.array().cast("array<array<string>>")))
    called = stage(own.select("scope", "device_id", F.explode(F.transform(names, lambda a: F.array_join(a, " "))).alias("run")))
    longest = called.groupBy("scope").agg(F.max(F.size(F.split("run", " "))).alias("longest"))
    known = called.groupBy("scope", "run").agg(F.min("device_id").alias("device_id"), F.max("device_id").alias("other")).filter("device_id = other").drop("other")
    found = words(lines).join(longest, "scope").select("scope", "line_id", F.inline(runs(F.col("longest")))).join(known, ["scope", "run"])
    wider = Window.partitionBy("scope", "line_id")
    every = F.collect_list(F.struct("at", "n", "device_id")).over(wider)  # a name has few words
    inside = F.exists(every, lambda o: (o["at"] <= F.col("at")) & (o["at"] + o["n"] >= F.col("at") + F.col("n")) & (o["n"] > F.col("n")))
    first = Window.partitionBy("scope", "line_id", "device_id").orderBy("at", F.desc("n"))
    return found.withColumn("inside", inside).filter("not inside").withColumn("_k", F.row_number().over(first)).filter("_k = 1").select("scope", "line_id", "device_id", "at", F.col("run").alias("label"))
