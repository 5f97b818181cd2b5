"""Session helpers shared by the library, the bench and the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions


def local_session(cores: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with adaptive execution on; a cluster brings its own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("veilstone")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stored(df: DataFrame) -> DataFrame:
    """df computed once for several uses: a reliable checkpoint where the session has a folder for them, else cached."""
    return df.checkpoint() if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df.cache()


#: Bytes in one Arrow batch sent to Python where a row can carry a whole file: ten thousand of them, Spark's own bound, would be held several times.
ARROW_BYTES = 4 * 1024 * 1024


def bound_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the session's Arrow batches; a bound that is set already stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(ARROW_BYTES))


#: Tables of up to so many counted rows are broadcast; longer ones are shuffled.
BROADCAST_ROWS = 500_000


def broadcast_if(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a table for broadcast when a count shows that it has at most so many rows."""
    return functions.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
