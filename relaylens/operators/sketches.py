"""Mergeable sketches: distinct payers (HLL) and quantiles (KLL) per day.

The exact forms (C4's distinct count, B5's histogram) read all rows of the
span they report.  A sketch per day is a few kilobytes whatever the day
holds, and sketches merge, so any span of days comes from as many small rows:
that is what the recorded history keeps (``relaylens.sources.history``).

* Payers: DataSketches HLL with ``2**LG_K`` registers.  Standard error
  ``1.04 / sqrt(2**LG_K)`` (0.8 %); up to ``2**(LG_K - 3)`` distinct parties
  the sketch still lists them and the estimate is exact once rounded.
* Seconds to convert: DataSketches KLL with parameter ``KLL_K``.  A reported
  quantile is an actual value whose rank is off by about
  ``2.3 / KLL_K**0.9`` of n at 99 % confidence (0.13 %); up to ``KLL_K``
  values the sketch keeps all of them and the quantile is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaylens.operators.funnel import durations
from relaylens.params import INFLOW, FunnelSpec

LG_K = 14
KLL_K = 4_096
PROBS = (0.5, 0.9)


def payers_by_day(ledger: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """``day, payers_sketch``: the parties of inflow movements of each day
    (a partial aggregate: one sketch per task and day is shuffled)."""
    paid = ledger.where((F.col("direction") == INFLOW) & F.col("party_id").isNotNull())
    return paid.groupBy("day").agg(F.hll_sketch_agg("party_id", F.lit(lg_k)).alias("payers_sketch"))


def payers_of(sketches: DataFrame, *by) -> DataFrame:
    """Distinct payers per ``by`` (of all days without), from day sketches."""
    merged = F.hll_union_agg("payers_sketch", F.lit(True))
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(merged).cast("long").alias("payers"))


def durations_by_day(funnel: DataFrame, spec: FunnelSpec = FunnelSpec(), k: int = KLL_K) -> DataFrame:
    """Per send day, later step and measure (``from_prev``, ``from_send``):
    how many sends got there and a sketch of their whole seconds.  ``funnel``
    is B1 with micro-seconds."""
    long = durations(funnel, spec, F.to_date("send_ts").alias("day"))
    sketch = F.kll_sketch_agg_bigint("secs", F.lit(k)).alias("secs_sketch")
    return long.groupBy("day", "step_index", "step", "measure").agg(F.count(F.lit(1)).alias("n"), sketch)


def time_to_convert_of(sketches: DataFrame, probs: Sequence[float] = PROBS) -> DataFrame:
    """B5 from day sketches: ``step_index, step, measure, n`` and a quantile
    ``p<100*p>_secs`` per probability (an actual value, not interpolated)."""
    merged = sketches.groupBy("step_index", "step", "measure").agg(
        F.sum("n").cast("long").alias("n"), F.kll_merge_agg_bigint("secs_sketch").alias("_all")
    )
    outs = [F.kll_sketch_get_quantile_bigint("_all", F.lit(float(p))).cast("long").alias(f"p{int(round(p * 100))}_secs") for p in probs]
    return merged.select("step_index", "step", "measure", "n", *outs)
