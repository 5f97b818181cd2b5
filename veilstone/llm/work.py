"""Shared plumbing: the shared working folder, written tables, row identity, batch sizes."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id, so that joins and orderings treat it as the smallest id.
NO_ID = -(2**63)
#: Rows in one Arrow batch sent to Python. Texts can be long, so batches are short.
ARROW_ROWS = 256
#: The same for rows of a few numbers.
NUMBER_ROWS = 32_768
#: Keys of a few numbers are broadcast up to so many counted rows (some tens of MB); beyond that the join shuffles.
BROADCAST_ROWS = 500_000

_made: list[tuple[SparkSession, str]] = []
_local: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on a local master where that is unset (tests), a fresh one."""
    global _local
    at = spark.conf.get("spark.checkpoint.dir", None) or _local
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = _local = tempfile.mkdtemp(prefix="veilstone-")
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session has ended already; the folder's owner clears it
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut and any executor may be lost afterwards."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a written table that nothing will read again."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        remove(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files behind tables that are written: it does so once the driver's JVM has collected their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def id_or_least(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def id_or_null(column: str) -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column))


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of df by name, whatever characters the names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, lengthened where df has columns so named."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(docs: DataFrame, marks: dict[str, Column], gone: DataFrame) -> DataFrame:
    """The rows of docs whose marks are not in gone, which has a column for each mark; docs' own columns, under any names."""
    names = free_names(docs, *marks)
    marked = docs.withColumns(dict(zip(names, marks.values(), strict=True)))
    keys = gone.select(*[F.col(k).alias(n) for k, n in zip(marks, names, strict=True)])
    return marked.join(broadcast_if(keys, BROADCAST_ROWS), names, "left_anti").select(*own_columns(docs))


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch can hold, since a row can carry a very long text."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(ARROW_ROWS))


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows at most for what is written within."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """Marks df for broadcast when a count shows that it has at most so many rows; else the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
