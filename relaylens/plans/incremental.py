"""E1 kept incrementally: a daily run reads the days that can still change
and folds the rest from the recorded history.

A send day is *closed* once its window lies behind the as-of day by
``days_to_rewrite``; the same span of days, by the ledger's own clock, closes
ledger days.  With ``start`` the first day not closed by the run before:

1. Step events from ``start`` on are read (a filter on ``ts`` that reaches the
   scan), deduplicated, and those whose first copy lies before ``start`` are
   dropped by the seen-event index; the funnel runs on them alone.  Every
   event a send of these days can reach is among them.
2. Days closed by this run go into the history: their counts, sketches and
   event ids.
3. Whole-history figures are sums of closed days plus the days just read; the
   distinct payers are those first seen on each day, found by the seen-payer
   index, so they add up too and stay exact.
4. The metric rows of open days and of the as-of day are recorded like a full
   run's, then the history is advanced.

So a run's scans and shuffles follow the open days; what grows with the
history is a row per day and the part of the indexes that the open days' ids
reach into.  A closed day's inputs are not read again: an event that arrives
after its day has closed is not counted (a full run or a fresh history does).
The first run reads everything.  ``--as-of`` before the last run works from the days closed
before it.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylens.functions import MONEY_TOTAL, rate
from relaylens.operators import funds, funnel, overview, sketches
from relaylens.params import INFLOW, FunnelSpec
from relaylens.session import materialize
from relaylens.sources import sink
from relaylens.sources.events import ntz_literal, step_events
from relaylens.sources.history import History
from relaylens.sources.ledger import inflow, load_ledger
from relaylens.sources.tables import between_days, read_table

DAY = dt.timedelta(days=1)


class DailyRun:
    def __init__(
        self, spark: SparkSession, sf_dir: str, history: History, spec: FunnelSpec = FunnelSpec(), until: dt.date | None = None
    ):
        self.spark, self.sf_dir, self.history, self.spec, self.until = spark, sf_dir, history, spec, until
        self.last = history.progress()

    def _from(self, closed: dt.date | None) -> dt.date | None:
        """Where the clock is looked up: from the open days on."""
        if closed is None or self.until is None:
            return closed
        return min(closed, sink.days_to_rewrite(self.until, self.spec.hours)[0])

    def _clock(self, read, closed, known):
        """The latest value of ``read(since)``: in the open days, else as the
        last run knew it, else over all days."""
        since = self._from(closed)
        found = read(since)
        if found is None and since is not None:
            day = known.date() if isinstance(known, dt.datetime) else known
            found = known if day and (self.until is None or day <= self.until) else read(None)
        return found

    @cached_property
    def as_of_value(self):
        def latest(since):
            ts = read_table(self.spark, self.sf_dir, "events", ["ts"]).where(between_days(F.col("ts"), since, self.until))
            return ts.agg(F.max("ts")).first()[0]

        return self._clock(latest, self.last and self.last.closed_until, self.last and self.last.as_of)

    @cached_property
    def ledger_day(self) -> dt.date | None:
        def latest(since):
            days = load_ledger(self.spark, self.sf_dir, with_party=False, days=(since, self.until))
            return days.agg(F.max("day")).first()[0]

        return self._clock(latest, self.last and self.last.funds_until, self.last and self.last.ledger_day)

    @cached_property
    def open_days(self) -> list[dt.date]:
        return sink.days_to_rewrite(self.as_of_value.date(), self.spec.hours) if self.as_of_value else []

    @cached_property
    def funds_days(self) -> list[dt.date]:
        return sink.days_to_rewrite(self.ledger_day, self.spec.hours) if self.ledger_day else []

    @cached_property
    def start(self) -> dt.date | None:
        """The first send day to work out; None: all of them."""
        closed = self.last and self.last.closed_until
        return min(closed, self.open_days[0]) if closed else None

    @cached_property
    def funds_start(self) -> dt.date | None:
        closed = self.last and self.last.funds_until
        return min(closed, self.funds_days[0]) if closed else None

    def step_events(self) -> DataFrame:
        """Step events from ``start`` on that were not first seen before."""
        recent = step_events(self.spark, self.sf_dir, self.spec.steps, since=self.start, until=self.until)
        if self.start is None:
            return recent
        return self.history.events.unseen(recent, self.start)

    @cached_property
    def events(self) -> DataFrame:
        return materialize(self.step_events())

    @cached_property
    def funnel(self) -> DataFrame:
        return materialize(funnel.ordered_funnel(self.events, self.spec, with_micros=True))

    @cached_property
    def by_day(self) -> DataFrame:
        """B3 of the days worked out: a row per day."""
        return materialize(funnel.funnel_by_day(self.funnel, self.spec, ntz_literal(self.as_of_value)))

    @cached_property
    def new_payers(self) -> DataFrame:
        """Parties whose first inflow day is among the days worked out."""
        paid = inflow(self.spark, self.sf_dir, (self.funds_start, self.until)).where(F.col("party_id").isNotNull())
        first = paid.groupBy("party_id").agg(F.min("day").alias("day"))
        return materialize(first if self.funds_start is None else self.history.payers.unseen(first, self.funds_start))

    @cached_property
    def daily(self) -> DataFrame:
        """C1 of the days worked out, with the payers new on each day and a
        sketch of each day's payers."""
        rows = load_ledger(self.spark, self.sf_dir, with_party=False, days=(self.funds_start, self.until))
        new = self.new_payers.groupBy("day").agg(F.count(F.lit(1)).alias("new_payers"))
        sketch = sketches.payers_by_day(rows.where(F.col("direction") == INFLOW))
        daily = funds.daily_funds(rows).join(new, "day", "left").join(sketch, "day", "left")
        return materialize(daily.withColumn("new_payers", F.coalesce("new_payers", F.lit(0).cast("long"))))

    def summary(self) -> DataFrame:
        """B2 over the whole history."""
        names = self.history.count_columns
        rows = self.history.cohorts(self.start).select(*names)
        none = self.spark.range(1).select(*[F.lit(0).cast("long").alias(n) for n in names])
        rows = rows.unionByName(self.by_day.select(*names) if self.open_days else none)
        return funnel.summarize_counts(rows, self.spec)

    def headline(self) -> DataFrame:
        """C4 over the whole history."""
        names = ["inflow", "outflow", "n_in", "n_out", "new_payers"]
        rows = self.history.funds(self.funds_start).select(*names)
        if self.funds_days:
            rows = rows.unionByName(self.daily.select(*names))
        whole = lambda c: F.sum(c).cast(MONEY_TOTAL)
        g = rows.agg(
            whole("inflow").alias("total_in"),
            whole("outflow").alias("total_out"),
            F.coalesce(F.sum("n_in") + F.sum("n_out"), F.lit(0)).cast("long").alias("movements"),
            F.coalesce(F.sum("new_payers"), F.lit(0)).cast("long").alias("payers"),
        )
        net = (F.col("total_in") - F.col("total_out")).cast(MONEY_TOTAL)
        return g.select(
            "total_in", "total_out", net.alias("net"), "movements", "payers",
            rate(F.col("total_in"), F.col("payers"), 4).alias("avg_in_per_payer"),
        )

    def payers_estimate(self) -> DataFrame:
        """Distinct payers of the whole history from the days' sketches."""
        rows = self.history.funds(self.funds_start).select("payers_sketch")
        return sketches.payers_of(rows.unionByName(self.daily.select("payers_sketch")))

    def time_to_convert(self) -> DataFrame:
        """B5 over the whole history from the days' sketches."""
        here = sketches.durations_by_day(self.funnel, self.spec)
        return sketches.time_to_convert_of(self.history.durations(self.start).unionByName(here))

    def metrics(self) -> tuple[DataFrame | None, list[dt.date]]:
        """The metric rows of this run and the days they cover, as a full
        run's."""
        as_of_day = self.as_of_value.date() if self.as_of_value else self.ledger_day
        if as_of_day is None:
            return None, []
        by_day = daily = None
        if self.open_days:
            by_day = sink.every_day(self.by_day.where(F.col("day") >= F.lit(self.open_days[0])), self.open_days)
        if self.funds_days:
            rows = self.daily.drop("new_payers", "payers_sketch").where(F.col("day") >= F.lit(self.funds_days[0]))
            daily = sink.every_day(rows, self.funds_days)
        rows = overview.overview(self.summary(), by_day, daily, self.headline(), F.lit(as_of_day), self.spec)
        return rows, sorted({*self.open_days, *self.funds_days})

    def _closing(self, rows: DataFrame, first: dt.date | None, end: dt.date) -> DataFrame:
        """The rows of days closed by this run."""
        day = F.col("day") if "day" in rows.columns else F.to_date("send_ts")
        return rows.where((day < F.lit(end)) & (F.lit(True) if first is None else day >= F.lit(first)))

    def close_days(self) -> None:
        """Put the days this run closes into the history.  Days without rows
        are written too where an earlier, unfinished run may have left some."""
        h = self.history
        if self.open_days and self.start != self.open_days[0]:
            end = self.open_days[0]
            counts = self._closing(self.by_day.select(*h.count_columns, "day"), self.start, end)
            ids = self.events.select("event_id", "event_type", F.to_date("ts").alias("day"))
            h.events.add(self._closing(ids, self.start, end).dropDuplicates(["event_id", "event_type"]))
            h.keep("durations", sketches.durations_by_day(self._closing(self.funnel, self.start, end), self.spec), self.start)
            h.keep("cohorts", self._filled(counts, self.start, end), self.start)
        if self.funds_days and self.funds_start != self.funds_days[0]:
            end = self.funds_days[0]
            h.payers.add(self._closing(self.new_payers, self.funds_start, end))
            names = ["inflow", "outflow", "n_in", "n_out", "new_payers", "payers_sketch", "day"]
            closing = self._filled(self._closing(self.daily.select(*names), self.funds_start, end), self.funds_start, end)
            h.keep("funds", closing, self.funds_start)

    def _filled(self, rows: DataFrame, first: dt.date | None, end: dt.date) -> DataFrame:
        if first is None:
            return rows
        sketched = [c for c in rows.columns if c == "payers_sketch"]
        days = [first + i * DAY for i in range((end - first).days)]
        full = sink.every_day(rows.drop(*sketched), days)
        return full.join(rows.select("day", *sketched), "day", "left") if sketched else full

    def finish(self) -> None:
        last = self.last
        closed = self.open_days[0] if self.open_days else last and last.closed_until
        closed_funds = self.funds_days[0] if self.funds_days else last and last.funds_until
        self.history.advance(closed, closed_funds, self.as_of_value, self.ledger_day)


def record_daily(
    spark: SparkSession, sf_dir: str, out: str, state: str, spec: FunnelSpec = FunnelSpec(), until: dt.date | None = None
) -> list[dt.date]:
    """One daily run: record the metric rows in ``out``, keep the history in
    ``state``; returns the days recorded."""
    run = DailyRun(spark, sf_dir, History(spark, state, spec), spec, until)
    rows, days = run.metrics()
    if rows is None:
        return []
    run.close_days()
    sink.record(rows, out)
    run.finish()
    return days
