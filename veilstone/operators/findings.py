"""Findings: matches grouped by value, layers merged by priority, placeholders numbered.

A finding is a distinct (category, normalized) of a document. All steps group or rank
within a document, so nothing larger than one document's findings meets in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.validators import CATEGORIES

#: Layers in the order in which the first record of a value wins.
LAYERS = {"rules": 1, "patterns": 2, "filename": 3, "fields": 4, "entities": 5, "literals": 6}


def prefix_of(category):
    out = F.lit("CUSTOM")
    for name, prefix in CATEGORIES.items():
        out = F.when(category == name, prefix).otherwise(out)
    return out


def aggregate_findings(matches: DataFrame, layer: str = "patterns", confidence: str = "exact") -> DataFrame:
    """Findings of one layer, ordered by first appearance: count is the number of hits."""
    place = F.struct("unit_ix", "start")
    grouped = matches.groupBy("doc_id", "category", "normalized").agg(
        F.min_by("raw", place).alias("value"), F.count(F.lit(1)).alias("count"), F.min(place).alias("first"), F.array_sort(F.collect_set("raw")).alias("variants")
    )
    return grouped.select(
        "doc_id", F.lit(LAYERS[layer]).alias("layer"),
        F.row_number().over(W.partitionBy("doc_id").orderBy("first", "category", "normalized")).alias("ord"),
        "category", "normalized", "value", "variants", "count", F.lit(confidence).alias("confidence"),
        F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("replacement"),
    )


FINDING = ["doc_id", "layer", "ord", "category", "normalized", "value", "variants", "count", "confidence", "score", "replacement"]


def merge_layers(*layers: DataFrame) -> DataFrame:
    """One finding for each value: the record of its first layer (count too), variants of all, the best score."""
    every = layers[0].select(*FINDING)
    for layer in layers[1:]:
        every = every.unionByName(layer.select(*FINDING))
    order = F.struct("layer", "ord")
    first = F.min_by(F.struct("layer", "ord", "value", "count", "confidence", "replacement"), order).alias("kept")
    merged = every.groupBy("doc_id", "category", "normalized").agg(
        first, F.array_sort(F.array_distinct(F.flatten(F.collect_list("variants")))).alias("variants"), F.max("score").alias("score")
    )
    return merged.select("doc_id", "category", "normalized", "variants", "score", "kept.*").withColumn(
        "ord", F.row_number().over(W.partitionBy("doc_id").orderBy("layer", "ord", "category", "normalized"))
    )


def number_placeholders(merged: DataFrame) -> DataFrame:
    """placeholder of every finding: a rule's own replacement, else [PREFIX_n] by merged order.

    Numbers whose label some rule of the document uses as its replacement are passed over:
    the rank moves up by one for each reserved number, in order, that it reaches.
    """
    reserved = merged.filter("replacement is not null").select("doc_id", F.regexp_extract("replacement", r"^\[([A-Z_]+)_([0-9]{1,8})\]$", 1).alias("prefix"), F.regexp_extract("replacement", r"^\[([A-Z_]+)_([0-9]{1,8})\]$", 2).alias("n"))
    reserved = reserved.filter("prefix <> ''").groupBy("doc_id", "prefix").agg(F.array_sort(F.collect_set(F.col("n").cast("int"))).alias("taken"))
    auto = F.col("replacement").isNull()
    ranked = merged.withColumn("prefix", prefix_of(F.col("category"))).withColumn(
        "rank", F.sum(F.when(auto, 1).otherwise(0)).over(W.partitionBy("doc_id", "category").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)).cast("int")
    )
    joined = ranked.join(reserved, ["doc_id", "prefix"], "left")
    number = F.aggregate(F.coalesce("taken", F.array().cast("array<int>")), F.col("rank"), lambda n, r: F.when(r <= n, n + 1).otherwise(n))
    label = F.when(auto, F.concat(F.lit("["), "prefix", F.lit("_"), number.cast("string"), F.lit("]"))).otherwise(F.col("replacement"))
    identity = F.concat_ws("_", F.col("layer").cast("string"), F.substring(F.sha2(F.concat_ws("\0", "category", "normalized"), 256), 1, 12))
    return joined.withColumn("placeholder", label).withColumn("finding_id", identity).drop("prefix", "rank", "taken")


def select_findings(findings: DataFrame, selection: DataFrame) -> DataFrame:
    """The findings chosen by selection(doc_id, finding_id)."""
    return findings.join(selection, ["doc_id", "finding_id"], "left_semi")
