"""The signed ledger (A3) on hand-made orders and lines."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import types as T

from relaylens.operators.funds import daily_funds
from relaylens.sources.ledger import load_ledger

D1 = dt.datetime(1998, 1, 2)
D2 = dt.datetime(1998, 1, 5)

ORDERS = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()),
        T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderdate", T.TimestampNTZType()),
        T.StructField("o_orderpriority", T.StringType()),
    ]
)
LINES = T.StructType(
    [
        T.StructField("l_orderkey", T.LongType()),
        T.StructField("l_extendedprice", T.DoubleType()),
        T.StructField("l_discount", T.DoubleType()),
        T.StructField("l_returnflag", T.StringType()),
        T.StructField("l_shipdate", T.TimestampNTZType()),
    ]
)


def tables(spark, tmp_path):
    orders = [(1, 10, "F", 100.25, D1, "1-URGENT"), (2, 20, "O", 50.00, D1, "2-HIGH")]
    lines = [
        (1, 10.10, 0.05, "R", D2),  # 10.10 * 0.95 = 9.595 -> 9.60 (half up)
        (1, 99.00, 0.00, "N", D2),  # not returned: no movement
        (3, 7.00, 0.10, "R", D2),  # order missing: money still moves, party unknown
    ]
    spark.createDataFrame(orders, ORDERS).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, LINES).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_ledger_rows(spark, tmp_path):
    d = tables(spark, tmp_path)
    got = sorted((r.party_id or -1, r.day, r.direction, r.amount) for r in load_ledger(spark, d).collect())
    assert got == sorted(
        [
            (10, D1.date(), "in", Decimal("100.25")),
            (20, D1.date(), "in", Decimal("50.00")),
            (10, D2.date(), "out", Decimal("9.60")),
            (-1, D2.date(), "out", Decimal("6.30")),
        ]
    )


def test_day_level_ledger_needs_no_party(spark, tmp_path):
    d = tables(spark, tmp_path)
    with_party = sorted(map(tuple, daily_funds(load_ledger(spark, d)).collect()))
    without = sorted(map(tuple, daily_funds(load_ledger(spark, d, with_party=False)).collect()))
    assert with_party == without
    assert [(r.day, str(r.net)) for r in sorted(daily_funds(load_ledger(spark, d)).collect())] == [
        (D1.date(), "150.25"),
        (D2.date(), "-15.90"),
    ]
