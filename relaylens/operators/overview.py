"""One long metric table from both halves (job D2).

``day, metric, dim, value``: counts, rates and money share one
``decimal(38,6)`` column (``double`` would lose cents on large totals).
Undated metrics (the whole-funnel summary, the headline) take the as-of day.
Every part is reshaped row-locally (``inline`` of an array of structs) and
the parts are unioned: no shuffle beyond those of the inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaylens.functions import metric_value
from relaylens.operators.funnel import reached_col
from relaylens.params import FunnelSpec

METRIC_COLUMNS = ["day", "metric", "dim", "value"]
FUNDS_METRICS = [("in", "inflow"), ("out", "outflow"), ("net", "net"), ("moves_in", "n_in"), ("moves_out", "n_out")]


def _long(df: DataFrame, day: Column, items: list[tuple[str, Column, Column]]) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(m).alias("metric"), d.alias("dim"), metric_value(v).alias("value")) for m, d, v in items])
    return df.select(day.alias("day"), F.inline(arr))


def overview(
    summary: DataFrame,
    by_day: DataFrame | None,
    daily: DataFrame | None,
    headline: DataFrame,
    as_of_day: Column,
    spec: FunnelSpec = FunnelSpec(),
) -> DataFrame:
    """B2 (funnel summary), B3 (funnel by send day), C1 (daily funds) and
    C4 (headline) as rows of one table."""
    step = F.col("step")
    parts = [
        _long(
            summary,
            as_of_day,
            [
                ("funnel_reached", step, F.col("reached")),
                ("funnel_rate_prev", step, F.col("rate_prev")),
                ("funnel_rate_send", step, F.col("rate_send")),
            ],
        ),
        _long(
            headline,
            as_of_day,
            [
                ("headline_in", F.lit("all"), F.col("total_in")),
                ("headline_out", F.lit("all"), F.col("total_out")),
                ("headline_net", F.lit("all"), F.col("net")),
                ("headline_movements", F.lit("all"), F.col("movements")),
                ("headline_payers", F.lit("all"), F.col("payers")),
                ("headline_avg_in_per_payer", F.lit("all"), F.col("avg_in_per_payer")),
            ],
        ),
    ]
    if daily is not None:
        items = [(f"funds_{m}", F.lit("all"), F.col(c)) for m, c in FUNDS_METRICS]
        parts.append(_long(daily, F.col("day"), items))
    if by_day is not None:
        items = [("cohort_reached", F.lit(spec.send), F.col("sends"))]
        items += [("cohort_reached", F.lit(s), F.col(reached_col(s))) for s in spec.later]
        items += [("cohort_open_sends", F.lit("all"), F.col("open_sends"))]
        parts.append(_long(by_day, F.col("day"), items))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
