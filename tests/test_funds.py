"""Funds jobs on hand-made ledgers and their invariants on sf0.01."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaylens.operators import funds
from relaylens.sources.ledger import load_ledger
from relaylens.sources.tables import customers

D = dt.date(2024, 3, 1)
LEDGER = T.StructType(
    [
        T.StructField("party_id", T.LongType()),
        T.StructField("day", T.DateType()),
        T.StructField("direction", T.StringType()),
        T.StructField("amount", T.DecimalType(18, 2)),
    ]
)


def ledger(spark, rows):
    return spark.createDataFrame([(p, d, x, Decimal(a)) for p, d, x, a in rows], LEDGER)


def test_quiet_day_present_with_zero(spark):
    lg = ledger(spark, [(1, D, "in", "10.00"), (1, D + dt.timedelta(days=2), "in", "5.00")])
    rows = funds.funds_trend(funds.daily_funds(lg)).orderBy("day").collect()
    assert [(r.day, str(r.net), str(r.running_net)) for r in rows] == [
        (D, "10.00", "10.00"),
        (D + dt.timedelta(days=1), "0.00", "10.00"),
        (D + dt.timedelta(days=2), "5.00", "15.00"),
    ]


def test_seven_day_sum_and_change(spark):
    lg = ledger(spark, [(1, D + dt.timedelta(days=i), "in", f"{i + 1}.00") for i in range(10)])
    rows = funds.funds_trend(funds.daily_funds(lg)).orderBy("day").collect()
    assert str(rows[6].net_7d) == "28.00"  # 1..7
    assert str(rows[9].net_7d) == "49.00"  # 4..10
    assert rows[6].net_change_7d is None
    assert str(rows[7].net_change_7d) == "7.00"  # 8 - 1


def test_outflow_only_is_negative(spark):
    lg = ledger(spark, [(1, D, "out", "3.50")])
    (r,) = funds.daily_funds(lg).collect()
    assert (str(r.inflow), str(r.outflow), str(r.net)) == ("0.00", "3.50", "-3.50")


def test_top_k_ties_lower_party_first(spark):
    lg = ledger(spark, [(5, D, "in", "10.00"), (3, D, "in", "10.00"), (4, D, "in", "1.00")])
    assert [r.party_id for r in funds.top_parties(lg, 2).collect()] == [3, 5]


def test_month_change_and_month_to_date(spark):
    rows = [(1, dt.date(2024, 1, 5), "in", "10.00"), (1, dt.date(2024, 1, 9), "out", "4.00"), (1, dt.date(2024, 2, 1), "in", "1.00")]
    daily = funds.daily_funds(ledger(spark, rows))
    m = funds.funds_by_month(daily).orderBy("month").collect()
    assert [(str(r.net), r.net_change if r.net_change is None else str(r.net_change)) for r in m] == [
        ("6.00", None),
        ("1.00", "-5.00"),
    ]
    mtd = funds.month_to_date(daily).orderBy("day").collect()
    assert [str(r.mtd_net) for r in mtd] == ["10.00", "6.00", "1.00"]


def test_invariants_on_sf001(spark):
    from tests.conftest import SF01

    lg = load_ledger(spark, SF01)
    head = funds.funds_headline(lg).first()
    # golden values measured for the survey
    assert (str(head.total_in), str(head.total_out), head.payers) == ("3758439620.06", "1012172070.81", 1500)
    counts = {r.direction: r["count"] for r in lg.groupBy("direction").count().collect()}
    assert counts == {"in": 15000, "out": 20046}
    seg = funds.funds_by_segment(lg, customers(spark, SF01))
    grand = seg.where(F.col("level") == 3).first()
    assert grand.net == head.net and grand.entries == head.movements
    daily = funds.daily_funds(load_ledger(spark, SF01, with_party=False))
    trend = funds.funds_trend(daily).orderBy(F.col("day").desc()).first()
    assert trend.running_net == head.net
    assert funds.funds_trend(daily).count() == 2500
    inflow_days = funds.daily_funds(lg.where(F.col("direction") == "in"))
    assert funds.funds_trend(inflow_days).count() == 2405 and inflow_days.count() == 2399
