"""Which send earns the credit for a payment (B6), and the money credited
per send (D1).

B6 is an as-of join (each conversion to the latest earlier send of the same
user) written as a window, like the funnel: sends and conversions share one
exchange on ``(user_id, slice)``, and ``max(struct(time, id))`` of the sends
over the frame "every row strictly earlier" finds the latest send.  A send at ``a``
can be credited by conversions in ``(a, a + window]``, so it is copied into
slices ``floor(a / split)`` to ``floor((a + window) / split)``; a conversion
sits in its own slice only.  No pair of (send, conversion) is ever built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relaylens.functions import epoch_micros, floor_div, micros_to_ts, rate, sum_money
from relaylens.params import FunnelSpec
from relaylens.sources.events import campaign_in


def _touch_frame(events: DataFrame, anchor: str, target: str, hours: int, split_hours: int | None) -> DataFrame:
    """Anchor and target rows, each target carrying ``_touch``: the latest
    strictly earlier anchor of its user in its slice.  ``_home`` marks the
    copy of a row that sits in its own slice (anchors are also copied
    forward)."""
    if anchor == target:
        raise ValueError("anchor and target must differ")
    spec = FunnelSpec(steps=(anchor, target), hours=hours, split_hours=split_hours)
    is_anchor = F.col("event_type") == anchor
    campaign = F.when(is_anchor, campaign_in(events))
    ev = events.where(F.col("event_type").isin(anchor, target)).select(
        "event_id", "user_id", "event_type", "value", epoch_micros("ts").alias("us"), campaign.alias("campaign_id")
    )
    own = floor_div(F.col("us"), spec.split_us)
    last = floor_div(F.col("us") + F.lit(spec.window_us), spec.split_us)
    ev = ev.withColumn("_own", own).withColumn(
        "slice", F.explode(F.when(is_anchor, F.sequence(own, last)).otherwise(F.array(own)))
    )
    w = Window.partitionBy("user_id", "slice").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    # max over (time, id): the latest earlier send, and of two sends at the
    # same instant the larger id, so a recomputed task credits the same send
    touch = F.when(is_anchor, F.struct(F.col("us").alias("us"), F.col("event_id").alias("id"), "campaign_id"))
    ev = ev.withColumn("_touch", F.max(touch).over(w))
    hit = (
        (F.col("event_type") == target)
        & F.col("_touch").isNotNull()
        & (F.col("us") - F.col("_touch.us") <= F.lit(spec.window_us))
    )
    return ev.withColumn("_hit", hit).withColumn("_home", F.col("slice") == F.col("_own"))


def last_touch(
    events: DataFrame,
    anchor: str = "view",
    target: str = "purchase",
    hours: int = 72,
    split_hours: int | None = None,
) -> DataFrame:
    """Every ``target`` event with the latest ``anchor`` event of the same
    user strictly before it and at most ``hours`` before it.

    A conversion is credited once, to one send; a conversion with no send in
    its window is not in the output.  Output: ``conversion_id, user_id,
    conversion_ts, amount, send_id, send_ts, campaign_id``.
    """
    ev = _touch_frame(events, anchor, target, hours, split_hours)
    return ev.where(F.col("_hit")).select(
        F.col("event_id").alias("conversion_id"),
        "user_id",
        micros_to_ts(F.col("us")).alias("conversion_ts"),
        F.col("value").alias("amount"),
        F.col("_touch.id").alias("send_id"),
        micros_to_ts(F.col("_touch.us")).alias("send_ts"),
        F.col("_touch.campaign_id").alias("campaign_id"),
    )


def last_touch_skew_safe(
    events: DataFrame,
    anchor: str = "view",
    target: str = "purchase",
    hours: int = 72,
    slice_hours: float = 24.0,
) -> DataFrame:
    """B6 for data where single users hold a large share of the events: the
    same output as ``last_touch`` from one backward as-of lookup
    (``relaylens.operators.asof``): every user's time is cut into
    ``slice_hours`` slices, nothing is copied, and the latest earlier send
    comes from the conversion's own slice or from a per-slice summary of the
    earlier ones."""
    from relaylens.operators.asof import next_after
    from relaylens.session import materialize

    if anchor == target:
        raise ValueError("anchor and target must differ")
    window_us = hours * 3_600_000_000
    is_anchor = F.col("event_type") == anchor
    campaign = F.when(is_anchor, campaign_in(events))
    ev = events.where(F.col("event_type").isin(anchor, target)).select(
        "event_id", "user_id", "event_type", "value", epoch_micros("ts").alias("us"), campaign.alias("campaign_id")
    )
    ev = materialize(ev)
    conv = ev.where(F.col("event_type") == target).select("event_id", "user_id", "us", "value")
    sends = ev.where(is_anchor).select("user_id", "us", "event_id", "campaign_id")
    touch = F.struct(F.col("us").alias("us"), F.col("event_id").alias("id"), "campaign_id")
    hit = next_after(conv, sends, "us", touch, int(slice_hours * 3_600_000_000), out="_touch", forward=False)
    ok = F.col("_touch").isNotNull() & (F.col("us") - F.col("_touch.us") <= F.lit(window_us))
    return hit.where(ok).select(
        F.col("event_id").alias("conversion_id"),
        "user_id",
        micros_to_ts(F.col("us")).alias("conversion_ts"),
        F.col("value").alias("amount"),
        F.col("_touch.id").alias("send_id"),
        micros_to_ts(F.col("_touch.us")).alias("send_ts"),
        F.col("_touch.campaign_id").alias("campaign_id"),
    )


def funds_per_send(
    events: DataFrame,
    anchor: str = "view",
    target: str = "purchase",
    hours: int = 72,
    split_hours: int | None = None,
) -> DataFrame:
    """Per send day and campaign: sends, conversions credited (B6),
    money credited and money per send.

    One pass: the B6 window frame holds every send (in its own slice) and
    every credited conversion (with the send it credits), so both are mapped
    to the send's (day, campaign) and summed in one aggregate — partial per
    task, so hot keys collapse on the map side.  Money is never summed over
    the funnel rows of B1, where one conversion can follow several sends.

    A conversion without an amount counts as a conversion and adds nothing.
    """
    ev = _touch_frame(events, anchor, target, hours, split_hours)
    is_send = (F.col("event_type") == anchor) & F.col("_home")
    hit = F.col("_hit")
    rows = ev.where(is_send | hit)
    rows = rows.select(
        F.to_date(micros_to_ts(F.when(is_send, F.col("us")).otherwise(F.col("_touch.us")))).alias("day"),
        F.when(is_send, F.col("campaign_id")).otherwise(F.col("_touch.campaign_id")).alias("campaign_id"),
        is_send.alias("is_send"),
        hit.alias("hit"),
        F.when(hit, F.col("value")).alias("credit"),
    )
    g = rows.groupBy("day", "campaign_id").agg(
        F.count_if("is_send").alias("sends"),
        F.count_if("hit").alias("conversions"),
        F.coalesce(sum_money(F.col("credit")), F.lit(0).cast("decimal(38,2)")).alias("credited"),
    )
    return g.select("day", "campaign_id", "sends", "conversions", "credited", rate(F.col("credited"), F.col("sends"), 4).alias("credited_per_send"))
