"""What every operator here needs from the session: the package on the
Python workers, the partition count, a shared folder and its files."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylens.session import scratch_path, shuffle_partitions

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the Python workers, once per Spark
    application (the same as ``spark-submit --py-files``), so that functions
    run there can import it and keep per-process caches."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="relaylens-src-"), f"relaylens-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, dirs, files in os.walk(root):
            dirs[:] = sorted(d for d in dirs if d != "__pycache__")
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def partitions(spark: SparkSession) -> int:
    return max(1, shuffle_partitions(spark))


def to_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared folder and read it back:
    the work above it runs once and survives a lost executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder that all machines share."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def small(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices, so that what Python makes of them (strings,
    lists) stays small beside the batch."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    return df.select(*columns) if columns else df


def whole_text(column: str = "text"):
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
