"""The signed funds ledger (job A3).

Money in is each order's total on its order date; money out is each returned
line's net value (``price * (1 - discount)``, to the cent) on its ship date,
charged to the order's customer.  One row per movement:
``party_id, day, direction, amount``; there is no line key in the inputs, so
a ledger is never deduplicated.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylens.functions import MONEY, money
from relaylens.params import INFLOW, OUTFLOW, RETURN_FLAG
from relaylens.sources.tables import between_days, read_table

LEDGER_COLUMNS = ["party_id", "day", "direction", "amount"]


Days = tuple[dt.date | None, dt.date | None]


def inflow(spark: SparkSession, sf_dir: str, days: Days = (None, None)) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", ["o_custkey", "o_orderdate", "o_totalprice"])
    o = o.where(between_days(F.col("o_orderdate"), *days))
    return o.select(
        F.col("o_custkey").alias("party_id"),
        F.to_date("o_orderdate").alias("day"),
        F.lit(INFLOW).alias("direction"),
        money("o_totalprice").alias("amount"),
    )


def outflow(spark: SparkSession, sf_dir: str, with_party: bool = True, days: Days = (None, None)) -> DataFrame:
    """Returned lines.  ``with_party`` attaches the order's customer with a
    left join on the order key (a sort-merge join, both sides shuffled on the
    key, which is unique in ``orders`` so no key is hot); day-level reports
    pass ``False`` and skip that shuffle entirely."""
    li = read_table(
        spark, sf_dir, "lineitem", ["l_orderkey", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"]
    ).where((F.col("l_returnflag") == RETURN_FLAG) & between_days(F.col("l_shipdate"), *days))
    net = F.round(money("l_extendedprice") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)")), 2).cast(MONEY)
    lines = li.select("l_orderkey", F.to_date("l_shipdate").alias("day"), net.alias("amount"))
    if with_party:
        keys = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
        lines = lines.join(keys, lines.l_orderkey == keys.o_orderkey, "left")
        party = F.col("o_custkey")
    else:
        party = F.lit(None).cast("long")
    return lines.select(party.alias("party_id"), "day", F.lit(OUTFLOW).alias("direction"), "amount")


def load_ledger(spark: SparkSession, sf_dir: str, with_party: bool = True, days: Days = (None, None)) -> DataFrame:
    """A3: inflow and outflow in one DataFrame (a union, no shuffle), of the
    days from and to which ``days`` names (both included; filters reach the
    scans)."""
    return inflow(spark, sf_dir, days).unionByName(outflow(spark, sf_dir, with_party, days))


def signed(amount: str = "amount", direction: str = "direction"):
    """``amount`` with outflow negative."""
    return F.when(F.col(direction) == OUTFLOW, -F.col(amount)).otherwise(F.col(amount))
