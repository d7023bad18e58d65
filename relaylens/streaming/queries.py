"""Streaming jobs as named queries, and their DuckDB checks.

Each query drains the ``events`` table as a stream (``availableNow``) into a
table under the shared folder and returns that table.  Fed in one batch,
the final watermark is ``max(ts)`` (in whole milliseconds) minus the delay,
so the batch equivalent is: windows ending at or before it; sends whose
window ends before it (an event exactly at the watermark could still come).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylens.plans.oracle import events_cte, funnel_ctes
from relaylens.params import FunnelSpec
from relaylens.plans.queries import SPEC
from relaylens.operators.funnel import ordered_funnel
from relaylens.session import materialize, scratch_path
from relaylens.sources.events import as_of_value, ntz_literal, step_events
from relaylens.streaming.jobs import open_sends_at, stream_dedupe, stream_funnel, stream_send_to_click, stream_step_counts
from relaylens.streaming.recording import read_stream_metrics, record_stream
from relaylens.streaming.source import ROCKSDB, drain, event_stream

DELAY_MS = 3_600_000  # the 1 hour DEFAULT_DELAY
# each send matched to its first click within 24 hours, unmatched kept.
SEND_TO_CLICK = FunnelSpec(steps=("view", "click"), hours=24)


def step_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1."""
    return drain(stream_step_counts(event_stream(spark, sf_dir)), "step-counts")


def dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3."""
    return drain(stream_dedupe(event_stream(spark, sf_dir)), "dedupe")


def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4."""
    return drain(stream_funnel(event_stream(spark, sf_dir), SPEC), "funnel", state_store=ROCKSDB)


def send_to_click_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 as a stream-stream left outer join on the interval, then the first
    click of each send."""
    sends, clicks = event_stream(spark, sf_dir), event_stream(spark, sf_dir)
    return drain(stream_send_to_click(sends, clicks, SEND_TO_CLICK.hours), "send-to-click-join", state_store=ROCKSDB)


def send_to_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 on F4's state (two steps): the first click after each send within
    24 hours, and sends without one, emitted as their window closes."""
    return drain(stream_funnel(event_stream(spark, sf_dir), SEND_TO_CLICK), "send-to-click", state_store=ROCKSDB)


def funnel_from_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 started from B1: the batch funnel up to ten days before the last
    event, then the stream of the events after it, which begins with the
    batch's open sends.  Sends the batch had closed and sends the stream
    closes make one table."""
    last = as_of_value(spark, sf_dir)
    if last is None:
        return funnel(spark, sf_dir)
    return funnel_after(spark, sf_dir, SPEC, last - dt.timedelta(days=10))


def funnel_after(spark: SparkSession, sf_dir: str, spec: FunnelSpec, cut: dt.datetime, **how) -> DataFrame:
    """B1 of the sends closed before ``cut`` and F4 from there on."""
    at = ntz_literal(cut)
    cut_us = (cut - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    before = step_events(spark, sf_dir, spec.steps).where(F.col("ts") < at)
    known = materialize(ordered_funnel(before, spec, with_micros=True))
    closed = known.where(F.col("send_us") + F.lit(spec.window_us) < F.lit(cut_us))
    after = event_stream(spark, sf_dir, **how).where(F.col("ts") >= at)
    streamed = drain(
        stream_funnel(after, spec, open_sends=open_sends_at(known, spec, cut_us)), "funnel-after", state_store=ROCKSDB
    )
    return closed.select(*streamed.columns).unionByName(streamed)


def recorded_step_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 fed by F1: the closed days' event counts as metric rows, written
    batch by batch and read back."""
    path = scratch_path(spark, "stream-metrics")
    record_stream(stream_step_counts(event_stream(spark, sf_dir)), path)
    return read_stream_metrics(spark, path)


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "stream_step_counts": step_counts,
        "stream_send_to_click": send_to_click,
        "stream_send_to_click_join": send_to_click_join,
        "stream_dedupe": dedupe,
        "stream_funnel": funnel,
        "stream_funnel_from_history": funnel_from_history,
        "stream_recorded_counts": recorded_step_counts,
    }


_WATERMARK_US = f"((SELECT epoch_ms(max(ts)) FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL) - {DELAY_MS}) * 1000"


def _closed_funnel_sql(spec: FunnelSpec) -> str:
    later = ", ".join(f"{s}_ts" for s in spec.later)
    return f"""WITH {funnel_ctes(spec)}
SELECT send_id, user_id, campaign_id, send_ts, {later}, depth FROM f
WHERE epoch_us(send_ts) + {spec.window_us} < {_WATERMARK_US}"""


def oracle() -> dict[str, str]:
    return {
        "stream_step_counts": f"""
SELECT window_start, window_end, event_type, CAST(count(*) AS BIGINT) AS n
FROM (SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type
      FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)
WHERE epoch_us(window_end) <= {_WATERMARK_US}
GROUP BY window_start, window_end, event_type""",
        "stream_dedupe": f"WITH {events_cte(SPEC, types=False)} SELECT event_id, user_id, ts, event_type, value, props FROM ev",
        "stream_send_to_click": _closed_funnel_sql(SEND_TO_CLICK),
        "stream_send_to_click_join": _closed_funnel_sql(SEND_TO_CLICK),
        "stream_funnel": _closed_funnel_sql(SPEC),
        "stream_funnel_from_history": _closed_funnel_sql(SPEC),
        "stream_recorded_counts": f"""
SELECT CAST(ts AS DATE) AS day, 'events_count' AS metric, event_type AS dim, CAST(count(*) AS DECIMAL(38,6)) AS value
FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
  AND epoch_us(date_trunc('day', ts) + INTERVAL 1 DAY) <= {_WATERMARK_US}
GROUP BY 1, 3""",
    }
