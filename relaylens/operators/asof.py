"""Skew-safe as-of lookups: for each query row, the first event of the same
user strictly after (or the last strictly before) its time.

A window partitioned by user puts a user's whole time line in one task.
Here every user's rows are cut into time slices of ``slice_us``, a fixed
parameter, the same for all users and at every data size; nothing is copied
between slices.

1. A query is answered inside its own (user, slice) window partition when an
   event follows it there.
2. Otherwise the answer is the earliest event in a later slice of the same
   user: a per-(user, slice) summary (the earliest event per slice, then a
   window over the user's slices, one row per slice), placed into the slice
   as a row past its end.

Each window partition holds one slice of one user; a user's summary holds
one row per slice, bounded by the time span of the data.  All of it is
built-in aggregates and windows; ties are broken by value (``min`` /
``max``), so a recomputed task gives the same answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaylens.functions import floor_div

DEFAULT_SLICE_US = 24 * 3_600_000_000  # one day


def _slice(us: Column, slice_us: int) -> Column:
    return floor_div(us, slice_us)


def next_after(
    queries: DataFrame,
    events: DataFrame,
    q_time: str,
    value: Column,
    slice_us: int = DEFAULT_SLICE_US,
    out: str = "nxt",
    forward: bool = True,
) -> DataFrame:
    """For every row of ``queries`` (``user_id, <q_time>`` and any other
    columns) add ``out``: ``min(value)`` over the events of the same user
    strictly after ``q_time`` (``forward``), or ``max(value)`` over those
    strictly before.  ``events`` has ``user_id, us``; ``value`` is an
    expression over it whose ordering follows ``us`` (``us`` itself, or a
    struct starting with it), so min / max pick the nearest event.
    """
    agg = F.min if forward else F.max
    q = queries.select(
        "user_id",
        _slice(F.col(q_time), slice_us).alias("_slice"),
        F.col(q_time).alias("_t"),
        F.struct(*[F.col(c) for c in queries.columns]).alias("_q"),
    )
    e = events.select(
        "user_id", _slice(F.col("us"), slice_us).alias("_slice"), F.col("us").alias("_t"), value.alias("_v")
    )
    vtype = e.schema["_v"].dataType
    qtype = q.schema["_q"].dataType
    # Summary: the nearest value per slice, then the nearest over all later
    # (earlier) slices of the same user.  Slices holding only queries take
    # part, so every query slice has its row.
    s_e = e.select("user_id", "_slice", "_v")
    s_q = queries.select("user_id", _slice(F.col(q_time), slice_us).alias("_slice"), F.lit(None).cast(vtype).alias("_v"))
    s = s_e.unionByName(s_q).groupBy("user_id", "_slice").agg(agg("_v").alias("_m"))
    ws = Window.partitionBy("user_id").orderBy(F.col("_slice").desc() if forward else F.col("_slice").asc())
    s = s.withColumn("_beyond", agg("_m").over(ws.rowsBetween(Window.unboundedPreceding, -1)))
    # placed just past the slice's end (before its start, going backwards)
    edge = (F.col("_slice") + 1) * F.lit(slice_us) if forward else F.col("_slice") * F.lit(slice_us) - 1
    tail = s.where(F.col("_beyond").isNotNull()).select("user_id", "_slice", edge.alias("_t"), F.col("_beyond").alias("_v"))

    no_q = F.lit(None).cast(qtype).alias("_q")
    rows = (
        q.select("user_id", "_slice", "_t", F.lit(None).cast(vtype).alias("_v"), "_q")
        .unionByName(e.select("user_id", "_slice", "_t", "_v", no_q))
        .unionByName(tail.select("user_id", "_slice", "_t", "_v", no_q))
    )
    order = F.col("_t").desc() if forward else F.col("_t").asc()
    w = Window.partitionBy("user_id", "_slice").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(out, agg("_v").over(w))
    return rows.where(F.col("_q").isNotNull()).select("_q.*", out)
