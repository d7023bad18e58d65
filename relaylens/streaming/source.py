"""The event log as a stream, and a runner that drains it into a table.

``event_time`` is the instant with the same epoch micro-seconds as the NTZ
``ts`` (a ``timestamp``, as watermarks require), made without a time zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaylens.functions import epoch_micros, micros_to_ts, money
from relaylens.session import scratch_path, table_path

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """The ``events`` table read as a file stream, nulls dropped like A1."""
    # The table may be one Parquet file or a folder of them.  A file stream
    # sets a non-glob path as its base path, which must be a folder; written as
    # a glob that matches exactly the table's name, the base path is its
    # parent folder either way.
    r = spark.readStream.schema(EVENT_SCHEMA).option("basePath", sf_dir)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    s = r.parquet(exact_glob(table_path(sf_dir, "events")))
    return (
        s.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull())
        .withColumn("value", money("value"))
        .withColumn("event_time", F.timestamp_micros(epoch_micros("ts")))
    )


def exact_glob(path: str) -> str:
    """``path`` as a glob pattern matching only itself: the first character of
    its last part in a one-character class (``events`` -> ``[e]vents``)."""
    head, _, last = path.rpartition("/")
    return f"{head}/[{last[0]}]{last[1:]}"


def instant_to_ts(c) -> "F.Column":
    """A ``timestamp`` instant back to the NTZ wall time in UTC, zone-free."""
    return micros_to_ts(F.unix_micros(c))


def drain(df: DataFrame, name: str, output_mode: str = "append", path: str | None = None, state_store: str | None = None) -> DataFrame:
    """Run a streaming query until its input is used up (``availableNow``)
    into a Parquet table, then read that table.

    ``path`` is the caller's folder for the table and its checkpoint: given
    the same one again, the query resumes where it stopped and the table
    grows.  Without it the run gets a fresh folder under the shared one.

    A stateful stream fixes its number of state partitions from
    ``spark.sql.shuffle.partitions`` when it first starts; that is the
    caller's setting.  ``state_store`` names the state store class for this
    query (transformWithState runs on ``ROCKSDB`` alone); the session's own
    setting is put back.
    """
    spark = df.sparkSession
    base = path or scratch_path(spark, f"stream-{name}")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    if state_store:
        spark.conf.set(key, state_store)
    try:
        q = (
            df.writeStream.format("parquet")
            .outputMode(output_mode)
            .option("checkpointLocation", f"{base}/_checkpoint")
            .trigger(availableNow=True)
            .start(f"{base}/table")
        )
        q.awaitTermination()
    finally:
        if state_store:
            spark.conf.set(key, before) if before else spark.conf.unset(key)
    if q.exception() is not None:
        raise q.exception()
    return spark.read.schema(df.schema).parquet(f"{base}/table")
