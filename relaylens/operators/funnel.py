"""The conversion funnel after each send (jobs B1 to B5, B7).

B1 is the one plan with a real physical decision.  The direct form, joining
every send to the later events of its user on a time range, fans out (every
send meets every later step inside the window).  Here it is a window plan
instead:

1. Keep only step types.  ``us`` is the event time in microseconds.
2. Cut each user's time line into slices of ``split_us``.  A send belongs to
   its own slice only.  A later-step event at ``t`` is copied into every
   slice a send in ``[t - window, t)`` can sit in, i.e. slices
   ``floor((t - window) / split)`` to ``floor(t / split)``.  Each slice is
   then self-contained for its own sends, and one user with a third of all
   events becomes many window partitions rather than one task.
3. Window ``partitionBy(user_id, slice).orderBy(us desc)`` with the range
   frame ``(unboundedPreceding, -1)``: in descending order that frame is
   "every row strictly later than this one", so ``last(..., ignorenulls)``
   returns the nearest strictly later row carrying a value.
4. From the last step back to the first, each step row carries a struct of
   its own time plus the chain found after it; the send row picks up the
   chain of the nearest later first step.  Taking the earliest possible next
   step never makes a later step unreachable, so this finds an ordered chain
   whenever one exists.
5. A step counts when its time is at most send + window.

One exchange (on ``user_id, slice``, after the one that deduplicates), one
sort and one window operator per later step; the frame starts at unbounded preceding, so it grows in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaylens.functions import epoch_micros, floor_div, micros_to_ts, rate
from relaylens.operators.quantiles import exact_quantiles
from relaylens.params import FunnelSpec
from relaylens.sources.events import campaign_in


def step_col(step: str) -> str:
    return f"{step}_ts"


def reached_col(step: str) -> str:
    return f"reached_{step}"


def micros_col(name: str) -> str:
    return f"{name}_us"


def ordered_funnel(events: DataFrame, spec: FunnelSpec = FunnelSpec(), with_micros: bool = False) -> DataFrame:
    """B1: one row per send with the time each later step was reached.

    Input: ``event_id, user_id, ts, event_type`` and optionally
    ``campaign_id`` or ``props`` — event ids unique (see ``dedupe_events``).
    Output: ``send_id, user_id, campaign_id, send_ts, <step>_ts..., depth``,
    where ``<step>_ts`` is null unless the step was reached in order within
    the window and ``depth`` counts the steps reached after the send.
    ``with_micros`` also keeps ``send_us`` and ``<step>_us`` (epoch
    micro-seconds) for jobs that compute durations.
    """
    later = list(spec.later)
    k = len(later)
    is_send = F.col("event_type") == spec.send
    us = epoch_micros("ts")
    campaign = F.when(is_send, campaign_in(events))

    ev = events.where(F.col("event_type").isin(list(spec.steps))).select(
        F.col("event_id"), F.col("user_id"), F.col("event_type"), us.alias("us"), campaign.alias("campaign_id")
    )
    own = floor_div(F.col("us"), spec.split_us)
    first = floor_div(F.col("us") - F.lit(spec.window_us), spec.split_us)
    slices = F.when(F.col("event_type") == spec.send, F.array(own)).otherwise(F.sequence(first, own))
    ev = ev.withColumn("slice", F.explode(slices))

    w = Window.partitionBy("user_id", "slice").orderBy(F.col("us").desc()).rangeBetween(Window.unboundedPreceding, -1)
    nxt = None
    for j in range(k, 0, -1):
        fields = [F.col("us").alias(f"u{j}")]
        if nxt is not None:
            fields += [F.col(nxt).getField(f"u{m}").alias(f"u{m}") for m in range(j + 1, k + 1)]
        here = F.when(F.col("event_type") == later[j - 1], F.struct(*fields))
        name = f"_chain{j}"
        ev = ev.withColumn(name, F.last(here, ignorenulls=True).over(w))
        nxt = name

    end = F.col("us") + F.lit(spec.window_us)
    sends = ev.where(is_send)
    outs, micros, reached = [], [], []
    for j, step in enumerate(later, start=1):
        u = F.col(nxt).getField(f"u{j}")
        ok = u.isNotNull() & (u <= end)
        reached.append(ok)
        outs.append(F.when(ok, micros_to_ts(u)).alias(step_col(step)))
        micros.append(F.when(ok, u).alias(micros_col(step)))
    depth = sum((F.when(ok, 1).otherwise(0) for ok in reached), F.lit(0))
    extra = [F.col("us").alias(micros_col("send")), *micros] if with_micros else []
    return sends.select(
        F.col("event_id").alias("send_id"),
        "user_id",
        "campaign_id",
        micros_to_ts(F.col("us")).alias("send_ts"),
        *outs,
        depth.cast("int").alias("depth"),
        *extra,
    )


def ordered_funnel_skew_safe(
    events: DataFrame,
    spec: FunnelSpec = FunnelSpec(),
    slice_hours: float = 24.0,
    with_micros: bool = False,
) -> DataFrame:
    """B1 for data where single users hold a large share of the events.

    Same output as ``ordered_funnel``; another physical plan.  The window
    plan needs, per partition, a slice plus one whole window of a user's
    events; here nothing is copied and no partition holds more than
    ``slice_hours`` of one user:

    * the step events are reduced to ``user_id, us, step, event_id,
      campaign_id`` and checkpointed to the shared folder, since every round
      reads them;
    * one round per later step: for every send, the first event of that step
      strictly after the step before (``relaylens.operators.asof``), kept
      when within the window.  Each round's result is checkpointed, because
      a lookup reads its queries twice: so the shuffles are the same few per
      step, however many steps there are.

    Which plan runs is the caller's choice, never the data's.
    """
    from relaylens.operators.asof import next_after
    from relaylens.session import materialize

    slice_us = int(slice_hours * 3_600_000_000)
    step_index = F.lit(None).cast("int")
    for i, st in enumerate(spec.steps):
        step_index = F.when(F.col("event_type") == st, F.lit(i)).otherwise(step_index)
    campaign = F.when(F.col("event_type") == spec.send, campaign_in(events))
    ev = events.where(F.col("event_type").isin(list(spec.steps))).select(
        "event_id", "user_id", epoch_micros("ts").alias("us"), step_index.alias("step"), campaign.alias("campaign_id")
    )
    ev = materialize(ev)

    cur = ev.where(F.col("step") == 0).select(
        F.col("event_id").alias("send_id"),
        "user_id",
        "campaign_id",
        F.col("us").alias("u0"),
        F.col("us").alias("_at"),
        F.lit(True).alias("_alive"),
    )
    end = F.col("u0") + F.lit(spec.window_us)
    for j in range(1, len(spec.steps)):
        if j > 1:
            cur = materialize(cur)
        ej = ev.where(F.col("step") == j).select("user_id", "us")
        cur = next_after(cur, ej, "_at", F.col("us"), slice_us, out=f"_n{j}")
        ok = F.col("_alive") & F.col(f"_n{j}").isNotNull() & (F.col(f"_n{j}") <= end)
        # a send that stopped keeps querying from its own time (its answer is
        # ignored), so every round carries every send and no join is needed
        cur = cur.select(
            *[c for c in cur.columns if c not in ("_at", "_alive", f"_n{j}")],
            F.when(ok, F.col(f"_n{j}")).alias(f"u{j}"),
            F.when(ok, F.col(f"_n{j}")).otherwise(F.col("u0")).alias("_at"),
            ok.alias("_alive"),
        )
    later = list(spec.later)
    depth = sum((F.when(F.col(f"u{j}").isNotNull(), 1).otherwise(0) for j in range(1, len(later) + 1)), F.lit(0))
    extra = (
        [F.col("u0").alias(micros_col("send")), *[F.col(f"u{j}").alias(micros_col(st)) for j, st in enumerate(later, start=1)]]
        if with_micros
        else []
    )
    return cur.select(
        "send_id",
        "user_id",
        "campaign_id",
        micros_to_ts(F.col("u0")).alias("send_ts"),
        *[micros_to_ts(F.col(f"u{j}")).alias(step_col(st)) for j, st in enumerate(later, start=1)],
        depth.cast("int").alias("depth"),
        *extra,
    )


def _reach_counts(spec: FunnelSpec) -> list[Column]:
    return [F.count(F.lit(1)).alias("sends")] + [
        F.count_if(F.col("depth") >= j).alias(reached_col(s)) for j, s in enumerate(spec.later, start=1)
    ]


def funnel_summary(funnel: DataFrame, spec: FunnelSpec = FunnelSpec()) -> DataFrame:
    """B2: one row per step: how many sends reached it, the rate against the
    step before and against the sends.  One global aggregate (partial per
    task, one final row), then a row-local reshape."""
    return _summary_rows(funnel.agg(*_reach_counts(spec)), spec)


def summarize_counts(counts: DataFrame, spec: FunnelSpec = FunnelSpec()) -> DataFrame:
    """B2 from any table of reach counts (``sends``, ``reached_<step>``), e.g.
    B3's per-day rows: the sum of the cohorts is the whole funnel."""
    names = ["sends"] + [reached_col(s) for s in spec.later]
    return _summary_rows(counts.agg(*[F.sum(n).cast("long").alias(n) for n in names]), spec)


def _summary_rows(counts: DataFrame, spec: FunnelSpec) -> DataFrame:
    names = ["sends"] + [reached_col(s) for s in spec.later]
    rows = []
    for i, step in enumerate(spec.steps):
        cur = F.col(names[i])
        prev = F.col(names[i - 1]) if i else cur
        rows.append(
            F.struct(
                F.lit(i).alias("step_index"),
                F.lit(step).alias("step"),
                cur.alias("reached"),
                rate(cur, prev).alias("rate_prev"),
                rate(cur, F.col("sends")).alias("rate_send"),
            )
        )
    return counts.select(F.inline(F.array(*rows)))


def with_open_flag(funnel: DataFrame, spec: FunnelSpec, as_of: Column) -> DataFrame:
    """Mark sends whose window has not closed by ``as_of`` (the latest event
    time seen): their counts can still grow."""
    return funnel.withColumn("is_open", F.timestamp_add("HOUR", F.lit(spec.hours), F.col("send_ts")) > as_of)


def funnel_by_day(funnel: DataFrame, spec: FunnelSpec, as_of: Column) -> DataFrame:
    """The funnel per send day, with the sends still open and a flag for
    days whose cohort is not final."""
    f = with_open_flag(funnel, spec, as_of)
    return (
        f.groupBy(F.to_date("send_ts").alias("day"))
        .agg(*_reach_counts(spec), F.count_if("is_open").alias("open_sends"))
        .withColumn("is_open", F.col("open_sends") > 0)
    )


def funnel_by_segment(funnel: DataFrame, customers: DataFrame, spec: FunnelSpec = FunnelSpec()) -> DataFrame:
    """The funnel by customer segment and campaign, with subtotals per
    segment and a grand total (``level`` is ``grouping_id``: 0 detail,
    1 segment subtotal, 3 grand total).

    Sends are first counted per (user, campaign): a partial aggregate, so a
    hot user costs one row per task and per campaign.  The customer
    dimension is not broadcast by hint, since it grows with the data; AQE
    broadcasts it when its measured size is under the threshold and
    sort-merges on the user key otherwise.
    """
    names = ["sends"] + [reached_col(s) for s in spec.later]
    per_user = funnel.groupBy("user_id", "campaign_id").agg(*_reach_counts(spec))
    cust = customers.select(F.col("c_custkey"), F.col("c_mktsegment").alias("segment"))
    joined = per_user.join(cust, per_user.user_id == cust.c_custkey, "left")
    # reduced to segments and campaigns before the rollup triples the rows
    small = joined.groupBy("segment", "campaign_id").agg(*[F.sum(n).cast("long").alias(n) for n in names])
    return small.rollup("segment", "campaign_id").agg(
        *[F.sum(n).cast("long").alias(n) for n in names], F.grouping_id().cast("int").alias("level")
    )


def durations(funnel: DataFrame, spec: FunnelSpec = FunnelSpec(), *columns: Column) -> DataFrame:
    """Whole seconds from the step before, and from the send, to each later
    step a send reached: ``step_index, step, measure, secs`` and ``columns``."""
    names = ["send"] + list(spec.later)
    if all(micros_col(n) in funnel.columns for n in names):
        us = funnel.select(*[micros_col(n) for n in names], *columns)
    else:
        ts = ["send_ts"] + [step_col(s) for s in spec.later]
        us = funnel.select(*[epoch_micros(t).alias(micros_col(n)) for t, n in zip(ts, names)], *columns)
    extra = us.columns[len(names) :]
    parts = []
    for j, step in enumerate(spec.later, start=1):
        t = F.col(micros_col(step))
        for measure, base in (("from_prev", F.col(micros_col(names[j - 1]))), ("from_send", F.col(micros_col("send")))):
            # durations are never negative, so truncation is the floor
            secs = ((t - base) / F.lit(1_000_000)).cast("long")
            parts.append(
                F.struct(
                    F.lit(j).alias("step_index"),
                    F.lit(step).alias("step"),
                    F.lit(measure).alias("measure"),
                    secs.alias("secs"),
                )
            )
    return us.select(*extra, F.explode(F.array(*parts)).alias("p")).select(*extra, "p.*").where(F.col("secs").isNotNull())


def time_to_convert(funnel: DataFrame, spec: FunnelSpec = FunnelSpec(), probs=(0.5, 0.9)) -> DataFrame:
    """Exact median and 90th percentile of whole seconds from the step
    before, and from the send, to each later step (sends that reached it).
    One row per (step, measure), ``measure`` being ``from_prev`` or
    ``from_send``.

    Seconds lie in ``[0, hours * 3600]``, so the quantiles are computed from a
    histogram whose size is bounded by the window, not by the data: a
    partial aggregate per (step, measure, second), then a window over at most
    ``hours * 3600 + 1`` rows per group.  See ``exact_quantiles``.
    """
    q = exact_quantiles(durations(funnel, spec), ["step_index", "step", "measure"], "secs", probs)
    return q.select(
        "step_index", "step", "measure", "n", *[F.col(f"p{int(round(p * 100))}").alias(f"p{int(round(p * 100))}_secs") for p in probs]
    )


def drop_off(funnel: DataFrame, spec: FunnelSpec, as_of: Column) -> DataFrame:
    """Sends whose window has closed without reaching the last step,
    with the last step they did reach (the send itself when none)."""
    last = F.element_at(F.array(*[F.lit(s) for s in spec.steps]), F.col("depth") + 1)
    f = with_open_flag(funnel, spec, as_of)
    return f.where(~F.col("is_open") & (F.col("depth") < len(spec.later))).select(
        "send_id", "user_id", "campaign_id", "send_ts", "depth", last.alias("last_step")
    )
