"""The overall funds picture (jobs C1 to C6).

Every job starts from the signed ledger (``party_id, day, direction,
amount``) and aggregates before anything else: partial aggregates collapse
hot parties and busy days on the map side, so what crosses a shuffle is one
row per (task, key).  The day- and month-level series after that are
bounded by the calendar (a day per row), not by the data volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaylens.functions import MONEY_TOTAL, rate, sum_money
from relaylens.params import INFLOW, OUTFLOW
from relaylens.sources.ledger import signed


def _zero() -> Column:
    return F.lit(0).cast("decimal(18,2)")


def _in(amount: str = "amount") -> Column:
    return F.when(F.col("direction") == INFLOW, F.col(amount)).otherwise(_zero())


def _out(amount: str = "amount") -> Column:
    return F.when(F.col("direction") == OUTFLOW, F.col(amount)).otherwise(_zero())


def _net(inflow: str = "inflow", outflow: str = "outflow") -> Column:
    return (F.col(inflow) - F.col(outflow)).cast(MONEY_TOTAL)


def daily_funds(ledger: DataFrame) -> DataFrame:
    """Per day: inflow, outflow, net and the number of movements each way."""
    return (
        ledger.groupBy("day")
        .agg(
            sum_money(_in()).alias("inflow"),
            sum_money(_out()).alias("outflow"),
            F.count_if(F.col("direction") == INFLOW).alias("n_in"),
            F.count_if(F.col("direction") == OUTFLOW).alias("n_out"),
        )
        .withColumn("net", _net())
    )


def fill_days(daily: DataFrame) -> DataFrame:
    """Days without movement present with zeros (not missing).

    Each day is followed by the days up to the next one present (a window
    over the day series, one row per calendar day), so ``daily`` is read
    once."""
    cols = [c for c in daily.columns if c != "day"]
    w = daily.withColumn("_next", F.lead("day").over(Window.orderBy("day")))
    last = F.coalesce(F.date_sub(F.col("_next"), 1), F.col("day"))
    j = w.select("day", *cols, F.explode(F.sequence("day", last, F.expr("INTERVAL 1 DAY"))).alias("_day"))
    zero = {c: (F.lit(0).cast(MONEY_TOTAL) if c in ("inflow", "outflow", "net") else F.lit(0).cast("long")) for c in cols}
    own = F.col("_day") == F.col("day")
    return j.select(F.col("_day").alias("day"), *[F.when(own, F.col(c)).otherwise(zero[c]).alias(c) for c in cols])


def funds_trend(daily: DataFrame) -> DataFrame:
    """The gap-filled daily series with the running net, the 7-day net
    and the change of net against the same weekday a week before.

    The window has no partition key, so it runs in one task over the day
    series: one row per calendar day, already aggregated.
    """
    f = fill_days(daily.select("day", "inflow", "outflow", "net"))
    w = Window.orderBy("day")
    return f.select(
        "day",
        "inflow",
        "outflow",
        "net",
        F.sum("net").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast(MONEY_TOTAL).alias("running_net"),
        F.sum("net").over(w.rowsBetween(-6, 0)).cast(MONEY_TOTAL).alias("net_7d"),
        (F.col("net") - F.lag("net", 7).over(w)).cast(MONEY_TOTAL).alias("net_change_7d"),
    )


def funds_by_segment(ledger: DataFrame, customers: DataFrame) -> DataFrame:
    """Totals by customer segment and direction, with a subtotal per
    segment and a grand total (``level`` = ``grouping_id``: 0 detail,
    1 segment, 3 all).  ``amount`` is unsigned, ``net`` signed.

    The ledger is first reduced to one row per party (a partial aggregate,
    hash-partitioned on ``party_id``), which the join to the customer
    dimension on the same key reuses: only the customer side is shuffled,
    or broadcast when AQE measures it small.  The per-party row is then
    split back into one row per direction, row-locally.
    """
    per_party = ledger.groupBy("party_id").agg(
        sum_money(_in()).alias("inflow"),
        sum_money(_out()).alias("outflow"),
        F.count_if(F.col("direction") == INFLOW).alias("n_in"),
        F.count_if(F.col("direction") == OUTFLOW).alias("n_out"),
    )
    cust = customers.select("c_custkey", F.col("c_mktsegment").alias("segment"))
    j = per_party.join(cust, per_party.party_id == cust.c_custkey, "left")
    legs = F.array(
        F.struct(F.lit(INFLOW).alias("direction"), F.col("inflow").alias("amount"), F.col("n_in").alias("n")),
        F.struct(F.lit(OUTFLOW).alias("direction"), F.col("outflow").alias("amount"), F.col("n_out").alias("n")),
    )
    long = j.select("segment", F.inline(legs)).where(F.col("n") > 0)
    # reduced to segments and directions before the rollup triples the rows
    small = long.groupBy("segment", "direction").agg(sum_money(F.col("amount")).alias("amount"), F.sum("n").cast("long").alias("n"))
    return small.rollup("segment", "direction").agg(
        sum_money(F.col("amount")).alias("amount"),
        sum_money(signed()).alias("net"),
        F.sum("n").cast("long").alias("entries"),
        F.grouping_id().cast("int").alias("level"),
    )


def funds_headline(ledger: DataFrame, daily: DataFrame | None = None) -> DataFrame:
    """C4: one row: total in, out, net, movements, distinct payers and
    average inflow per payer.

    Payers are the distinct parties of inflow rows: the filter on the
    ``direction`` literal prunes the outflow branch of the ledger union, so
    no outflow party (and no join) is needed.  ``count(DISTINCT)`` is planned
    as a two-level aggregate (by party, then global) and enters as a scalar
    subquery.  Given ``daily`` (C1 on the same ledger), the totals are the
    sums of its days instead of a second pass over the ledger.
    """
    payers = ledger.where(F.col("direction") == INFLOW).agg(F.count_distinct("party_id")).scalar()
    if daily is None:
        g = ledger.agg(
            sum_money(_in()).alias("total_in"),
            sum_money(_out()).alias("total_out"),
            F.count(F.lit(1)).alias("movements"),
        )
    else:
        g = daily.agg(
            sum_money(F.col("inflow")).alias("total_in"),
            sum_money(F.col("outflow")).alias("total_out"),
            (F.sum("n_in") + F.sum("n_out")).cast("long").alias("movements"),
        )
    # the subquery is referenced once; the next projection reads its column
    g = g.select("total_in", "total_out", "movements", payers.alias("payers"))
    return g.select(
        "total_in",
        "total_out",
        _net("total_in", "total_out").alias("net"),
        "movements",
        "payers",
        rate(F.col("total_in"), F.col("payers"), 4).alias("avg_in_per_payer"),
    )


def top_parties(ledger: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` parties with the largest net, lower ``party_id`` first on
    ties.  ``orderBy + limit`` plans as TakeOrderedAndProject: each task keeps
    its own top ``k``, so only ``k`` rows per task reach the final merge."""
    per_party = ledger.where(F.col("party_id").isNotNull()).groupBy("party_id").agg(
        sum_money(_in()).alias("inflow"), sum_money(_out()).alias("outflow")
    )
    return (
        per_party.withColumn("net", _net())
        .orderBy(F.col("net").desc(), F.col("party_id").asc())
        .limit(k)
    )


def funds_by_month(daily: DataFrame) -> DataFrame:
    """Per month: inflow, outflow, net, days with movement, and the
    change of net against the month before (null for the first month)."""
    m = daily.groupBy(F.trunc("day", "month").alias("month")).agg(
        sum_money(F.col("inflow")).alias("inflow"),
        sum_money(F.col("outflow")).alias("outflow"),
        F.count(F.lit(1)).alias("active_days"),
    )
    m = m.withColumn("net", _net())
    w = Window.orderBy("month")
    prev = F.lag("net").over(w)
    return m.select("month", "inflow", "outflow", "net", "active_days", (F.col("net") - prev).cast(MONEY_TOTAL).alias("net_change"))


def month_to_date(daily: DataFrame) -> DataFrame:
    """Per day, the month-to-date inflow, outflow and net.  The window
    is partitioned by month, so months run in parallel."""
    d = daily.withColumn("month", F.trunc("day", "month"))
    w = Window.partitionBy("month").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return d.select(
        "day",
        "month",
        "net",
        F.sum("inflow").over(w).cast(MONEY_TOTAL).alias("mtd_in"),
        F.sum("outflow").over(w).cast(MONEY_TOTAL).alias("mtd_out"),
        F.sum("net").over(w).cast(MONEY_TOTAL).alias("mtd_net"),
    )
