"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words (weights, bounded by ``most_copies`` times
what it has, the excess reshared by weight). Each document of a source then expects
target / source words copies; the expected copies are prefix-summed within the source,
one random offset is added, and a copy is emitted for each integer boundary crossed.
Documents stand in order of size, so that rounding up and down evens out among
documents of about the same size and the words taken come within one document's size
of the target.

No task holds a source: the prefix sum runs over ranges of (source, size, hash, id)
that are dealt by sampled bounds, as (rows before the range) + (place within the range).

Defined results: a null text has size 0; a null source is a source of its own and comes
last; a null doc_id is the smallest id; repeated rows are sampled one by one; an empty
table gives no rows; the random numbers come from MD5 of the seed, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import work

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def _uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long").cast("double") / F.lit(4294967296.0)


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """origin, source_size, target of every source, by water filling.

    The level at which k sources are full is (budget - their bounds) / (weight of the
    rest); the first source, in order of bound / weight, that is not below its own level
    fixes the level for it and all after it. Works on one row per source.
    """
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    per = sized.groupBy("origin").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy("origin"))
    per = per.withColumn("place", place).withColumn("weight", F.get(pattern, (F.col("place") - 1) % len(weights)))
    per = per.withColumn("bound", F.col("source_size").cast("double") * most)
    every, before = W.partitionBy(), W.orderBy(F.col("bound") / F.col("weight"), "place").rowsBetween(W.unboundedPreceding, -1)
    per = (
        per.withColumn("budget", F.sum(F.col("source_size")).over(every).cast("double") * share)
        .withColumn("weights", F.sum("weight").over(every))
        .withColumn("full", F.coalesce(F.sum("bound").over(before), F.lit(0.0)))
        .withColumn("used", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("full")) / (F.col("weights") - F.col("used")))
    )
    per = per.withColumn("fixed", F.min(F.when(F.col("level") * F.col("weight") <= F.col("bound"), F.struct(F.col("bound") / F.col("weight"), "place", "level"))).over(every))
    return per.select(
        "origin", "source_size",
        F.coalesce(F.least("bound", F.col("fixed.level") * F.col("weight")), F.col("bound")).alias("target"),
    )


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """doc, origin, size, source_size, target, copies: one row for each row of docs.

    origin is the source behind a mark that puts null last; doc is doc_id or the least long.
    """
    sized = work.written(
        docs.select(
            work.id_or_least().alias("doc"),
            F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source")).alias("origin"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ).withColumn("at", F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc").cast("string")))),
        "mix-sizes",
    )
    aims = work.written(targets(sized, weights, share, most), "mix-targets")
    dealt = work.written(
        sized.repartitionByRange("origin", "size", "at", "doc").withColumn("part", F.spark_partition_id()), "mix-ranges"
    )
    counts = dealt.groupBy("origin", "part").agg(F.count(F.lit(1)).alias("n"))
    ahead = F.coalesce(F.sum("n").over(W.partitionBy("origin").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = work.written(counts.withColumn("ahead", ahead).join(aims, "origin").drop("n"), "mix-starts")
    within = F.row_number().over(W.partitionBy("origin", "part").orderBy("size", "at", "doc"))
    ranked = dealt.withColumn("within", within).join(starts, ["origin", "part"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = (F.col("ahead") + F.col("within")).cast("double")
    offset = _uniform(F.concat(F.lit(f"{seed}:offset:"), "origin"))
    crossed = F.floor(rate * rank + offset) - F.floor(rate * (rank - 1) + offset)
    return ranked.select("doc", "origin", "size", "source_size", "target", F.least(crossed, F.lit(most)).cast("long").alias("copies"))


def mix_report(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs."""
    return plan(docs, **settings).select(
        work.id_or_null("doc").alias("doc_id"),
        F.when(F.col("origin") != "1", F.substring("origin", 2, 2**31 - 1)).alias("source"),
        "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"),
    )


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs, each as often as the plan takes it, with ``copy`` from 1 on (in place of a column of that name)."""
    planned = plan(docs, **settings)
    key = ["doc", "origin", "size"]
    planned = work.written(planned.withColumn("turn", F.row_number().over(W.partitionBy(*key).orderBy("copies"))), "mix-plan")
    several = planned.filter("turn > 1").limit(1).count() > 0
    docs = docs.drop("copy")
    names = work.free_names(docs, *key, "turn", "copies")
    doc, origin, size, order, copies = names
    mine = docs.withColumns({
        doc: work.id_or_least(),
        origin: F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source")),
        size: F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
    })
    turn = F.row_number().over(W.partitionBy(doc, origin, size).orderBy("text")) if several else F.lit(1)
    chosen = planned.filter("copies > 0").select(*[F.col(c).alias(n) for c, n in zip((*key, "turn", "copies"), names, strict=True)])
    joined = mine.withColumn(order, turn).join(work.broadcast_if(chosen, work.BROADCAST_ROWS), [doc, origin, size, order])
    return joined.select(*work.own_columns(docs), F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias("copy"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return report.select("doc_id", "size", "source_size", "target", "taken")


ORACLE = """
WITH sized AS (
  SELECT doc_id, text, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS origin,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents
), per AS (
  SELECT origin, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY origin) AS place FROM sized GROUP BY origin
), weighed AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         2.0::DOUBLE * source_size AS bound FROM per
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(bound) OVER before, 0::DOUBLE))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0::DOUBLE)) AS level
  FROM weighed WINDOW before AS (ORDER BY bound / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), aims AS (
  SELECT origin, source_size,
         least(bound, weight * coalesce(first_value(CASE WHEN level * weight <= bound THEN level END IGNORE NULLS)
               OVER (ORDER BY bound / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 1e300)) AS target
  FROM levels
), ranked AS (
  SELECT s.*, a.source_size, a.target,
         CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0::DOUBLE END AS rate,
         row_number() OVER (PARTITION BY origin ORDER BY size, md5('mix-1:' || coalesce(doc_id, -9223372036854775808)), doc_id NULLS FIRST)::DOUBLE AS place,
         ('0x' || substr(md5('mix-1:offset:' || origin), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start
  FROM sized s JOIN aims a USING (origin)
)
SELECT doc_id, size, source_size, target,
       (size * least(floor(rate * place + start) - floor(rate * (place - 1) + start), 2))::BIGINT AS taken
FROM ranked
"""
