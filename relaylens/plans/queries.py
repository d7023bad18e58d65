"""Every job as a named query: ``(spark, sf_dir) -> DataFrame``.

Parameters are the defaults of ``FunnelSpec`` (steps view -> click ->
signup -> purchase, 72 hours), last-touch view -> purchase in 72 hours and
the top 10 parties.  Every query reads the whole tables.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylens.operators import attribution, funds, funnel, overview, sketches
from relaylens.params import INFLOW, FunnelSpec
from relaylens.session import materialize, scratch_path
from relaylens.sources import sink
from relaylens.sources.events import as_of_value, dedupe_events, load_events, ntz_literal, step_events, with_campaign
from relaylens.sources.ledger import LEDGER_COLUMNS, load_ledger
from relaylens.sources.tables import customers

SPEC = FunnelSpec()
ANCHOR, TARGET = "view", "purchase"
TOP_K = 10
FUNNEL_COLUMNS = ["send_id", "user_id", "campaign_id", "send_ts"] + [funnel.step_col(s) for s in SPEC.later] + ["depth"]


class Inputs:
    """The shared inputs of one query, built lazily from ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str, spec: FunnelSpec = SPEC, until: dt.date | None = None):
        """``until``: the last day that counts, in events and ledger alike."""
        self.spark, self.sf_dir, self.spec, self.until = spark, sf_dir, spec, until

    @cached_property
    def events(self) -> DataFrame:
        """Funnel-step events, one row each."""
        return step_events(self.spark, self.sf_dir, self.spec.steps, until=self.until)

    @cached_property
    def touch_events(self) -> DataFrame:
        """Sends and payments only, with amounts, one row each."""
        return step_events(self.spark, self.sf_dir, (ANCHOR, TARGET), value=True, until=self.until)

    @cached_property
    def as_of_value(self):
        """Latest event time, fetched once per query as a parameter."""
        return as_of_value(self.spark, self.sf_dir, self.until)

    @cached_property
    def as_of(self):
        return ntz_literal(self.as_of_value)

    @cached_property
    def funnel(self) -> DataFrame:
        """B1 as the jobs built on it use it: the window plan."""
        return funnel.ordered_funnel(self.events, self.spec, with_micros=True)

    @cached_property
    def touches(self) -> DataFrame:
        return attribution.last_touch(self.touch_events, ANCHOR, TARGET, self.spec.hours, self.spec.split_hours)

    @cached_property
    def ledger(self) -> DataFrame:
        return load_ledger(self.spark, self.sf_dir, days=(None, self.until))

    @cached_property
    def ledger_days(self) -> DataFrame:
        """The ledger without the party: day-level reports skip the join."""
        return load_ledger(self.spark, self.sf_dir, with_party=False, days=(None, self.until))

    @cached_property
    def daily(self) -> DataFrame:
        return funds.daily_funds(self.ledger_days)

    @cached_property
    def customers(self) -> DataFrame:
        return customers(self.spark, self.sf_dir)

    def overview(self) -> DataFrame:
        """D2 with one pass over the events and one over the ledger.

        The per-day cohort counts (B3) and the daily funds (C1) are small
        (a row per day) and feed two parts each: the whole-funnel summary is
        the sum of the cohorts, the headline totals the sum of the days.  Both
        are checkpointed to the shared folder, so each full pass runs once
        instead of once per consumer.  Distinct payers read the inflow only.
        """
        by_day = materialize(funnel.funnel_by_day(self.funnel, self.spec, self.as_of))
        daily = materialize(self.daily)
        return overview.overview(
            funnel.summarize_counts(by_day, self.spec),
            by_day,
            daily,
            funds.funds_headline(self.ledger_days, daily),
            F.to_date(self.as_of),
            self.spec,
        )

    def as_of_day(self) -> dt.date | None:
        """The day of the latest event; None without events."""
        return self.as_of_value.date() if self.as_of_value else None

    def ledger_day(self) -> dt.date | None:
        """The day of the latest movement; None without movements."""
        return self.ledger_days.agg(F.max("day")).first()[0]

    def first_seen(self, since: dt.date) -> DataFrame:
        """Funnel-step events from ``since`` on whose first copy is not from
        before it: a scan cut to those days, less the ids that a narrow scan
        of the days before has."""
        recent = step_events(self.spark, self.sf_dir, self.spec.steps, since=since, until=self.until)
        before = load_events(self.spark, self.sf_dir, self.spec.steps, until=since - dt.timedelta(days=1))
        key = ["event_id", "event_type"]
        return recent.join(before.select(*key), key, "left_anti").select(recent.columns)

    def to_record(self) -> tuple[DataFrame | None, list[dt.date]]:
        """E1's rows for this run and the days they cover.

        Open cohorts and the last funds days come from scans cut to those
        days (and, of the days before, the ids of events, so that a later
        copy counts where the first one did); the whole-history figures of the as-of day from all of it."""
        event_day, ledger_day = self.as_of_day(), self.ledger_day()
        as_of_day = event_day or ledger_day
        if as_of_day is None:
            return None, []
        by_day = daily = None
        days: list[dt.date] = []
        if event_day:
            open_days = sink.days_to_rewrite(event_day, self.spec.hours)
            recent = self.first_seen(open_days[0])
            by_day = funnel.funnel_by_day(funnel.ordered_funnel(recent, self.spec), self.spec, self.as_of)
            by_day = sink.every_day(by_day, open_days)
            days += open_days
        if ledger_day:
            funds_days = sink.days_to_rewrite(ledger_day, self.spec.hours)
            recent = load_ledger(self.spark, self.sf_dir, with_party=False, days=(funds_days[0], funds_days[-1]))
            daily = sink.every_day(funds.daily_funds(recent), funds_days)
            days += funds_days
        rows = overview.overview(
            funnel.funnel_summary(self.funnel, self.spec),
            by_day,
            daily,
            funds.funds_headline(self.ledger_days),
            F.lit(as_of_day),
            self.spec,
        )
        return rows, sorted(set(days))


def _q(fn: Callable[[Inputs], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Inputs(spark, sf_dir))

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def events_steps(i: Inputs) -> DataFrame:
    """A1: funnel-step events."""
    return load_events(i.spark, i.sf_dir, i.spec.steps).select("event_id", "user_id", "ts", "event_type", "value")


def events_campaign(i: Inputs) -> DataFrame:
    """A2: every event with its campaign id."""
    return with_campaign(load_events(i.spark, i.sf_dir)).select("event_id", "event_type", "campaign_id")


def ledger(i: Inputs) -> DataFrame:
    """A3: the signed ledger."""
    return i.ledger.select(*LEDGER_COLUMNS)


def events_dedup(i: Inputs) -> DataFrame:
    """A4: all events, one row per event id and type."""
    return dedupe_events(load_events(i.spark, i.sf_dir))


def funnel_sends(i: Inputs) -> DataFrame:
    """B1 by the window plan."""
    return funnel.ordered_funnel(i.events, i.spec)


def funnel_summary(i: Inputs) -> DataFrame:
    """B2."""
    return funnel.funnel_summary(i.funnel, i.spec)


def funnel_by_day(i: Inputs) -> DataFrame:
    """B3."""
    return funnel.funnel_by_day(i.funnel, i.spec, i.as_of)


def funnel_by_segment(i: Inputs) -> DataFrame:
    """B4."""
    return funnel.funnel_by_segment(i.funnel, i.customers, i.spec)


def time_to_convert(i: Inputs) -> DataFrame:
    """B5."""
    return funnel.time_to_convert(i.funnel, i.spec)


def last_touch(i: Inputs) -> DataFrame:
    """B6."""
    return i.touches


def funnel_sends_skew_safe(i: Inputs) -> DataFrame:
    """B1 by the skew-safe plan: as-of rounds over time slices."""
    return funnel.ordered_funnel_skew_safe(i.events, i.spec).select(*FUNNEL_COLUMNS)


def last_touch_skew_safe(i: Inputs) -> DataFrame:
    """B6 by the skew-safe plan."""
    return attribution.last_touch_skew_safe(i.touch_events, ANCHOR, TARGET, i.spec.hours)


def drop_off(i: Inputs) -> DataFrame:
    """B7."""
    return funnel.drop_off(i.funnel, i.spec, i.as_of)


def daily_funds(i: Inputs) -> DataFrame:
    """C1."""
    return i.daily


def funds_trend(i: Inputs) -> DataFrame:
    """C2 on the whole ledger."""
    return funds.funds_trend(i.daily)


def funds_trend_inflow(i: Inputs) -> DataFrame:
    """C2 on inflow alone, whose days have gaps to fill."""
    return funds.funds_trend(funds.daily_funds(i.ledger_days.where(F.col("direction") == INFLOW)))


def funds_by_segment(i: Inputs) -> DataFrame:
    """C3."""
    return funds.funds_by_segment(i.ledger, i.customers)


def funds_headline(i: Inputs) -> DataFrame:
    """C4 (needs no outflow party, so no join)."""
    return funds.funds_headline(i.ledger_days)


def top_parties(i: Inputs) -> DataFrame:
    """C5."""
    return funds.top_parties(i.ledger, TOP_K)


def funds_by_month(i: Inputs) -> DataFrame:
    """C6, month level."""
    return funds.funds_by_month(i.daily)


def month_to_date(i: Inputs) -> DataFrame:
    """C6, month to date per day."""
    return funds.month_to_date(i.daily)


def funds_per_send(i: Inputs) -> DataFrame:
    """D1."""
    return attribution.funds_per_send(i.touch_events, ANCHOR, TARGET, i.spec.hours, i.spec.split_hours)


def metrics_overview(i: Inputs) -> DataFrame:
    """D2."""
    return i.overview()


def recorded_metrics(i: Inputs) -> DataFrame:
    """Record the days that can still change into a fresh table under the
    shared folder, then read them back (partition-pruned)."""
    path = scratch_path(i.spark, "metrics")
    rows, days = i.to_record()
    if rows is None:
        return i.overview().where(F.lit(False))
    sink.record(rows, path)
    return sink.read_recorded(i.spark, path, days)


def recorded_incrementally(i: Inputs) -> DataFrame:
    """E1 by daily runs over a kept history: a first run two days before the
    last day of events, then one that reads the open days alone; the days of
    the second run read back."""
    from relaylens.plans.incremental import record_daily

    out, state = scratch_path(i.spark, "metrics"), scratch_path(i.spark, "history")
    day = i.as_of_day() or i.ledger_day()
    if day is None:
        return i.overview().where(F.lit(False))
    record_daily(i.spark, i.sf_dir, f"{out}-before", state, i.spec, until=day - dt.timedelta(days=2))
    days = record_daily(i.spark, i.sf_dir, out, state, i.spec)
    return sink.read_recorded(i.spark, out, days)


def payers_by_month_sketched(i: Inputs) -> DataFrame:
    """C4's distinct payers per month, merged from a sketch per day."""
    days = sketches.payers_by_day(i.ledger_days)
    return sketches.payers_of(days, F.trunc("day", "month").alias("month"))


def time_to_convert_sketched(i: Inputs) -> DataFrame:
    """B5 from a quantile sketch per send day, step and measure."""
    return sketches.time_to_convert_of(sketches.durations_by_day(i.funnel, i.spec))


BATCH = {
    "events_steps": events_steps,
    "events_campaign": events_campaign,
    "ledger": ledger,
    "events_dedup": events_dedup,
    "funnel_sends": funnel_sends,
    "funnel_sends_skew_safe": funnel_sends_skew_safe,
    "funnel_summary": funnel_summary,
    "funnel_by_day": funnel_by_day,
    "funnel_by_segment": funnel_by_segment,
    "time_to_convert": time_to_convert,
    "last_touch": last_touch,
    "last_touch_skew_safe": last_touch_skew_safe,
    "drop_off": drop_off,
    "daily_funds": daily_funds,
    "funds_trend": funds_trend,
    "funds_trend_inflow": funds_trend_inflow,
    "funds_by_segment": funds_by_segment,
    "funds_headline": funds_headline,
    "top_parties": top_parties,
    "funds_by_month": funds_by_month,
    "month_to_date": month_to_date,
    "funds_per_send": funds_per_send,
    "metrics_overview": metrics_overview,
    "recorded_metrics": recorded_metrics,
    "recorded_incrementally": recorded_incrementally,
    "payers_by_month_sketched": payers_by_month_sketched,
    "time_to_convert_sketched": time_to_convert_sketched,
}


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _q(fn) for name, fn in BATCH.items()}
