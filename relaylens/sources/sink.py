"""Recording the metric table (job E1).

The table is Parquet partitioned by ``kind`` (the first word of the metric:
``cohort``, ``funnel``, ``funds``, ``headline``) and ``day``.  Writing uses
dynamic partition overwrite: a run replaces exactly the (kind, day)
partitions it has rows for and leaves all others alone, so a re-run is safe
after a failure or for late data, and yesterday's whole-history figures
stay as recorded while yesterday's cohort, still open, is replaced.  Days of
a run without movement are written as zeros, so a day whose rows have
vanished is replaced too.

Cohort metrics of a send day keep changing until its conversion window has
closed, so a run rewrites the as-of day and the ``ceil(hours / 24)`` days
before it; the funds days rewritten are as many, by the ledger's own clock.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRIC_SCHEMA = T.StructType(
    [
        T.StructField("metric", T.StringType()),
        T.StructField("dim", T.StringType()),
        T.StructField("value", T.DecimalType(38, 6)),
        T.StructField("kind", T.StringType()),
        T.StructField("day", T.DateType()),
    ]
)


def days_to_rewrite(as_of_day: dt.date, hours: int) -> list[dt.date]:
    """The as-of day and the days whose cohorts may still change."""
    back = math.ceil(hours / 24)
    return [as_of_day - dt.timedelta(days=i) for i in range(back, -1, -1)]


def every_day(rows: DataFrame, days: list[dt.date]) -> DataFrame:
    """One row per day of ``days``, zeros where ``rows`` (a row per day) has
    none: at most a few days."""
    all_days = rows.sparkSession.createDataFrame([(d,) for d in days], "day date")
    cols = [c for c in rows.columns if c != "day"]
    zero = {c: F.lit(0) if t not in ("boolean",) else F.lit(False) for c, t in rows.dtypes}
    kinds = dict(rows.dtypes)
    return all_days.join(rows, "day", "left").select(
        "day", *[F.coalesce(F.col(c), zero[c].cast(kinds[c])).alias(c) for c in cols]
    )


def record(overview: DataFrame, path: str) -> None:
    """Write metric rows, replacing the (kind, day) partitions they have.

    The rows are few (metrics x days), so they are brought to one task per
    partition before writing: one file per partition instead of one per task.
    """
    rows = overview.select("metric", "dim", "value", F.substring_index("metric", "_", 1).alias("kind"), "day")
    (
        rows.repartition("kind", "day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("kind", "day")
        .parquet(path)
    )


def read_recorded(spark: SparkSession, path: str, days: list[dt.date] | None = None) -> DataFrame:
    """Read the metric table back; a ``days`` filter prunes partitions."""
    df = spark.read.schema(METRIC_SCHEMA).parquet(path)
    if days is not None:
        df = df.where(F.col("day").isin(days))
    return df.select("day", "metric", "dim", "value")
