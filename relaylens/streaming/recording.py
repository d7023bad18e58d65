"""F1's counts recorded as metric rows (E1 fed by a stream).

``foreachBatch`` hands each micro-batch over at least once: after a failure
the same batch comes again.  Rows are written to a Parquet table partitioned
by kind and batch id with dynamic partition overwrite, so a batch that comes
again replaces itself and nothing else.  A window's counts leave F1 once (its
watermark has passed), a day may lie in several batches (windows shorter than
a day): readers add up the batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylens.functions import metric_value
from relaylens.functions.columns import METRIC

KIND = "events"
SCHEMA = f"day date, metric string, dim string, value {METRIC}, kind string, batch_id long"


def step_count_rows(counts: DataFrame) -> DataFrame:
    """F1's rows as metric rows: ``day, metric, dim, value``."""
    day = F.to_date("window_start")
    return (
        counts.groupBy(day.alias("day"), F.col("event_type").alias("dim"))
        .agg(F.sum("n").alias("n"))
        .select("day", F.lit(f"{KIND}_count").alias("metric"), "dim", metric_value(F.col("n")).alias("value"))
    )


def write_batch(path: str) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function for a table at ``path``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = step_count_rows(batch).withColumns({"kind": F.lit(KIND), "batch_id": F.lit(batch_id).cast("long")})
        rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "batch_id").parquet(path)

    return write


def record_stream(counts: DataFrame, path: str) -> None:
    """Drain F1 (``availableNow``) into the metric table at ``path``; given
    the same path again it goes on where it stopped."""
    q = (
        counts.writeStream.foreachBatch(write_batch(f"{path}/table"))
        .outputMode("append")
        .option("checkpointLocation", f"{path}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def read_stream_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The recorded rows, batches added up: ``day, metric, dim, value``."""
    rows = spark.read.schema(SCHEMA).parquet(f"{path}/table")
    return rows.groupBy("day", "metric", "dim").agg(F.sum("value").cast(METRIC).alias("value"))
