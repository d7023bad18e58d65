"""The event log: sends and the steps after them (jobs A1, A2, A4)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylens.functions import money
from relaylens.params import CAMPAIGN_JSON_PATH
from relaylens.sources.tables import between_days, read_table

EVENT_COLUMNS = ["event_id", "user_id", "ts", "event_type", "value", "props"]


def load_events(
    spark: SparkSession,
    sf_dir: str,
    steps: Iterable[str] | None = None,
    since: dt.date | None = None,
    until: dt.date | None = None,
) -> DataFrame:
    """A1: events with a user and a time, optionally only the given types
    and the days ``since`` to ``until``, both included.

    The filters and the null checks reach the Parquet scan as pushed
    filters.  ``value`` becomes exact cents.
    """
    ev = read_table(spark, sf_dir, "events", EVENT_COLUMNS)
    cond = F.col("user_id").isNotNull() & F.col("ts").isNotNull()
    if steps is not None:
        cond = cond & F.col("event_type").isin(list(steps))
    return ev.where(cond & between_days(F.col("ts"), since, until)).withColumn("value", money("value"))


def campaign_of(props: str = "props"):
    """The campaign id carried in the JSON ``props`` column; null when it is
    missing or not an integer (one bad row must not fail a job)."""
    return F.get_json_object(F.col(props), CAMPAIGN_JSON_PATH).try_cast("int")


def campaign_in(events: DataFrame):
    """The campaign id of an event row, from whichever column carries it."""
    if "campaign_id" in events.columns:
        return F.col("campaign_id")
    return campaign_of() if "props" in events.columns else F.lit(None).cast("int")


def with_campaign(events: DataFrame) -> DataFrame:
    """A2: add ``campaign_id`` parsed from ``props``."""
    return events.withColumn("campaign_id", campaign_of())


def dedupe_events(events: DataFrame) -> DataFrame:
    """A4: one row per event: ``(event_id, event_type)``.

    Repeated deliveries are usually identical; when copies differ, the copy
    with the smallest ``(ts, user_id, campaign, value, props)`` is kept, so
    the result does not depend on partitioning.  The type is part of the
    identity, so filtering types before or after gives the same rows, and
    the order of columns means a job that reads fewer of them keeps the same
    copies.  Rows without an id cannot be told apart by it: those equal in
    every column count once, all others stay.

    ``min`` is a partial aggregate: copies collapse on the map side before
    the shuffle, so a single event delivered millions of times costs one row
    per map task, and rows without an id are spread by their content.
    """
    key = ["event_id", "event_type"]
    rest = [c for c in events.columns if c not in key]
    first = [c for c in ["ts", "user_id", "campaign_id", "value", "props"] if c in rest]
    order = [F.col(c) for c in first + [c for c in rest if c not in first]]
    if "props" in rest and "campaign_id" not in rest:
        order.insert(sum(c in rest for c in ("ts", "user_id")), campaign_of().alias("_campaign"))
    no_id = F.when(F.col("event_id").isNull(), F.struct(*rest)).alias("_no_id")
    best = F.min(F.struct(*order)).alias("best")
    return events.groupBy(*key, no_id).agg(best).select(*[F.col(c) if c in key else F.col(f"best.{c}").alias(c) for c in events.columns])


def step_events(
    spark: SparkSession,
    sf_dir: str,
    steps: Iterable[str],
    value: bool = False,
    since: dt.date | None = None,
    until: dt.date | None = None,
) -> DataFrame:
    """The events of ``steps`` as the funnel jobs use them, one row each:
    ``event_id, user_id, ts, event_type, campaign_id`` and, if asked for,
    ``value``.  Projected before deduplicating, so neither the raw ``props``
    nor an unused ``value`` reaches the shuffle."""
    ev = load_events(spark, sf_dir, steps, since, until)
    columns = ["event_id", "user_id", "ts", "event_type", campaign_of().alias("campaign_id")]
    return dedupe_events(ev.select(*columns, *(["value"] if value else [])))


def as_of_ts(spark: SparkSession, sf_dir: str):
    """The latest event time over all events, as a scalar-subquery column.

    Taken before any type filter.  A scalar subquery is evaluated once and
    used as a literal by the outer plan (no join).
    """
    return read_table(spark, sf_dir, "events", ["ts"]).agg(F.max("ts")).scalar()


def as_of_value(spark: SparkSession, sf_dir: str, until: dt.date | None = None):
    """The same value fetched once as a job parameter (one scalar: a
    one-column scan with a partial ``max`` per task); None without events."""
    ts = read_table(spark, sf_dir, "events", ["ts"]).where(between_days(F.col("ts"), None, until))
    return ts.agg(F.max("ts")).first()[0]


def ntz_literal(value) -> "F.Column":
    """A Python ``datetime`` as a ``timestamp_ntz`` literal, without passing
    through a session time zone."""
    if value is None:
        return F.lit(None).cast("timestamp_ntz")
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
