"""A bounded sample of labelled texts for the two classifiers.

``limit`` is the documented bound: at most so many labelled rows, those with the least
hash of doc_id, are used for learning; so the sample is the same on every run, the
labels join by broadcast and no text is shuffled. Null labels and ids are left out, an
id labelled twice takes its larger label, and of equal texts one is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import work

LIMIT = 20_000


def remainder(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, limit: int = LIMIT) -> DataFrame:
    """text, y of at most ``limit`` labelled rows whose remainder is not ``held_out``; written to the shared folder."""
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder(modulus) != held_out))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col(label).cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    chosen = work.written(chosen, f"{label}-labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").withColumn("same", F.xxhash64("text"))
    found = work.written(found, f"{label}-texts")
    first = found.groupBy("same").agg(F.min("doc_id").alias("doc_id"))  # at most ``limit`` rows
    kept = found.join(F.broadcast(first), ["same", "doc_id"])
    return kept.select("text", "y")
