"""Exact quantiles of integer values from a bounded domain.

``percentile`` keeps every value of a group in one aggregation buffer, so a
group holding a third of the data holds a third of the data in one task.
When the values are integers from a domain bounded by a parameter (seconds
inside a conversion window), the exact answer needs only the histogram:

1. ``groupBy(keys, value).count()`` — a partial aggregate, so the shuffle
   carries at most one row per (task, key, value); the output has at most
   ``|keys| * |domain|`` rows whatever the input size.
2. A window per key over the histogram ordered by value gives the cumulative
   count; the value at 0-based rank ``r`` is the smallest value whose
   cumulative count exceeds ``r``.
3. Linear interpolation between ranks ``floor(p * (n - 1))`` and
   ``ceil(p * (n - 1))`` — the continuous definition used by
   ``percentile`` and by SQL ``quantile_cont``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], digits: int = 3
) -> DataFrame:
    """Per ``keys``: ``n`` and one column ``p<100*p>`` per probability."""
    keys = list(keys)
    hist = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_cnt"))
    cum = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    allw = Window.partitionBy(*keys)
    h = hist.withColumn("_cum", F.sum("_cnt").over(cum)).withColumn("_n", F.sum("_cnt").over(allw))
    aggs = [F.first("_n").alias("n")]
    for p in probs:
        pos = F.lit(float(p)) * (F.col("_n") - 1).cast("double")
        lo, hi = F.floor(pos), F.ceil(pos)
        tag = f"{int(round(p * 100))}"
        aggs += [
            F.min(F.when(F.col("_cum") > lo, F.col(value))).alias(f"_lo{tag}"),
            F.min(F.when(F.col("_cum") > hi, F.col(value))).alias(f"_hi{tag}"),
            F.first(pos - lo).alias(f"_fr{tag}"),
        ]
    g = h.groupBy(*keys).agg(*aggs)
    outs = []
    for p in probs:
        tag = f"{int(round(p * 100))}"
        lo, hi, fr = F.col(f"_lo{tag}").cast("double"), F.col(f"_hi{tag}").cast("double"), F.col(f"_fr{tag}")
        outs.append(F.round(lo + (hi - lo) * fr, digits).alias(f"p{tag}"))
    return g.select(*keys, F.col("n").cast("long").alias("n"), *outs)
