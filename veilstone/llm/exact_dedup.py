"""Exact dedup over a persistent digest index.

The index is a table bucketed and sorted by SHA-256 digest. A batch is reduced to
one row per digest (partial aggregation first, so a text that fills a third of the
rows leaves each task as one row), anti-joined to the index by sort-merge, and what
is new is appended. The index side of that join is read by bucket, without a shuffle.

Within a batch the row with the largest doc_id stays; across batches the digest that
is in the index already stays. Defined results: a null text counts as empty; a null
doc_id is the smallest id; rows that repeat both doc_id and text share one decision
(``keep_rows`` then keeps one of them); an empty table gives no rows; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import work

#: Name of the file that notes the number of buckets, before that number; readers pass over names that begin so.
NOTE = "_buckets-"
INDEX_SCHEMA = T.StructType(
    [T.StructField("digest", T.BinaryType()), T.StructField("keep_id", T.LongType())]
)


def text_digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


class DigestIndex:
    """A persistent index of digests: external bucketed Parquet table at ``path``.

    Its number of buckets is set when it is made and stands in a file beside the data;
    a later opening takes it from there, whatever the settings are by then.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = self._stored_buckets(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.name = f"digest_index_{hashlib.md5(path.encode()).hexdigest()[:12]}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def _stored_buckets(self, wanted: int) -> int:
        """The number of buckets of the files at the path; the wanted one, which is then noted, where there are none."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(conf)
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        noted = [int(n.removeprefix(NOTE)) for n in names if n.startswith(NOTE)]
        if len(noted) == 1:
            return noted[0]
        if noted or any(n.startswith("part-") for n in names):
            raise ValueError(f"{self.path} holds an index whose number of buckets can't be told")
        fs.create(jvm.org.apache.hadoop.fs.Path(folder, f"{NOTE}{wanted}")).close()
        return wanted

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def forget(self) -> None:
        """Takes the table out of the catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def new_groups(self, batch: DataFrame) -> DataFrame:
        """One row for each digest of batch(digest, doc) that the index lacks."""
        # written, because the optimizer would move the anti-join below the aggregation, where a repeated text still has all its rows
        groups = work.written(batch.groupBy("digest").agg(F.max("doc").alias("keep_id")), "batch-groups")
        return groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        (
            groups.select("digest", "keep_id")
            .repartition(self.buckets, "digest")
            .write.format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.path)
            .mode("append")
            .saveAsTable(self.name)
        )
        self.spark.catalog.refreshTable(self.name)


def digests_of(docs: DataFrame) -> DataFrame:
    """(doc, digest) of every row, written once: all later joins move 40 bytes a row, never a text."""
    return work.written(docs.select(work.id_or_least().alias("doc"), text_digest().alias("digest")), "digests")


def ingest(docs: DataFrame, index: DigestIndex, batches: int = 2) -> DataFrame:
    """Deduplicates docs into the index in batches of descending doc_id; returns decisions.

    Columns: doc (doc_id, null as the least long), digest, keep_id, group_size, kept.
    Descending order makes the largest doc_id of all batches the one that stays.
    """
    digests = digests_of(docs)
    low, high = digests.filter(F.col("doc") != work.NO_ID).agg(F.min("doc"), F.max("doc")).first()
    low, high = (low or 0), (high or 0)
    cuts = [work.NO_ID] + [low + (high - low + 1) * k // batches for k in range(1, batches)] + [None]
    for lower, upper in reversed(list(zip(cuts, cuts[1:], strict=False))):
        batch = digests.filter(F.col("doc") >= lower)
        if upper is not None:
            batch = batch.filter(F.col("doc") < upper)
        index.append(index.new_groups(batch))
    sizes = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = work.written(sizes.join(index.rows().hint("merge"), "digest"), "digest-groups")
    return digests.join(groups, "digest").withColumn("kept", F.col("doc") == F.col("keep_id"))


def _decisions(docs: DataFrame, index_path: str | None) -> DataFrame:
    """``ingest`` into the index at the path, or into one of its own that leaves the catalogue afterwards."""
    index = DigestIndex(docs.sparkSession, index_path or work.fresh_path(docs.sparkSession, "digest-index"))
    decided = ingest(docs, index)  # reads written tables only, not the index
    if index_path is None:
        index.forget()
    return decided


def exact_duplicates(docs: DataFrame, index_path: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    return _decisions(docs, index_path).select(
        work.id_or_null("doc").alias("doc_id"),
        work.id_or_null("keep_id").alias("keep_id"),
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_rows(docs: DataFrame, index_path: str | None = None) -> DataFrame:
    """The rows of docs that stay, with docs' own columns."""
    decided = work.written(_decisions(docs, index_path), "decisions")
    dropped = work.written(decided.filter(~F.col("kept")).select("doc", "digest").distinct(), "dropped")
    kept = work.without(docs, {"doc": work.id_or_least(), "digest": text_digest()}, dropped)
    repeated = decided.filter("kept").groupBy("digest").count().filter("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept  # rows that repeat both doc_id and text: one of them stays


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
