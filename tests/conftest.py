import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from relaylens.session import build_session

    s = build_session("relaylens-tests", master="local[*]", shuffle_partitions=8, extra={"spark.sql.maxMetadataStringLength": "4000"})
    yield s
    s.stop()


@pytest.fixture
def events_dir(tmp_path, spark):
    """Write hand-made events as ``events.parquet`` in a fresh folder and
    return the folder, so jobs read them like the driver's tables."""

    def make(rows):
        from pyspark.sql import types as T

        schema = T.StructType(
            [
                T.StructField("event_id", T.LongType()),
                T.StructField("ts", T.TimestampNTZType()),
                T.StructField("user_id", T.LongType()),
                T.StructField("event_type", T.StringType()),
                T.StructField("value", T.DoubleType()),
                T.StructField("props", T.StringType()),
            ]
        )
        d = tmp_path / f"sf{len(list(tmp_path.iterdir()))}"
        d.mkdir()
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(d / "events.parquet"))
        return str(d)

    return make
