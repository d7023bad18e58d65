"""Parquet inputs.  Every read names its columns so the scan's ReadSchema
holds only what the job uses; filters written after it are pushed into the
Parquet reader by Catalyst."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylens.session import table_path


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def between_days(ts: Column, since: dt.date | None, until: dt.date | None) -> Column:
    """``ts`` (``timestamp_ntz``) on the days ``since`` to ``until``, both
    included; as comparisons with literals, so the scan can skip by them."""
    cond = F.lit(True)
    if since is not None:
        cond = cond & (ts >= F.lit(f"{since} 00:00:00").cast("timestamp_ntz"))
    if until is not None:
        cond = cond & (ts < F.lit(f"{until + dt.timedelta(days=1)} 00:00:00").cast("timestamp_ntz"))
    return cond


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recipient / payer dimension: key, nation, segment."""
    return read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
