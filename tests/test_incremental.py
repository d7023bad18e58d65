"""Daily runs over a kept history against runs over everything."""

import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from relaylens.params import FunnelSpec
from relaylens.plans import incremental
from relaylens.plans.incremental import DailyRun, record_daily
from relaylens.plans.queries import Inputs
from relaylens.session import scratch_path
from relaylens.sources.history import History, SeenIndex
from relaylens.sources.sink import read_recorded, record
from tests.test_record import at, folder

SPEC = FunnelSpec(hours=24)
STEPS = ("view", "click", "signup", "purchase", "error")


def tables(seed, days=9):
    """Events with copies hours and days apart, movements with gaps."""
    r = random.Random(seed)
    events = []
    for i in range(30 * days):
        t = at(1) + dt.timedelta(minutes=r.randrange(days * 24 * 60))
        e = (r.randrange(30 * days) if r.random() < 0.9 else None, t, r.randrange(5), r.choice(STEPS))
        events.append(e)
        if r.random() < 0.2:  # delivered again, as it was or later
            late = t + dt.timedelta(hours=r.choice([0, 0, 5, 30, 70]))
            if late < at(1 + days):
                events.append((e[0], late, e[2], e[3]))
    orders = [(i, at(1 + r.randrange(days)), float(r.randrange(1, 50))) for i in range(40)]
    lines = [(r.randrange(40), at(1 + r.randrange(days)), float(r.randrange(1, 9))) for _ in range(25)]
    return events, orders, lines


def parties(spark, d):
    """Orders of several parties (``folder`` gives them all to one)."""
    path = os.path.join(d, "orders.parquet")
    rows = spark.read.parquet(path).withColumn("o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 11))
    rows = rows.collect()
    spark.createDataFrame(rows, spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)
    return d


def recorded(spark, path, days):
    return sorted((r.day, r.metric, r.dim, str(r.value)) for r in read_recorded(spark, path, days).collect())


def full(spark, d, until, spec=SPEC):
    """What a run over all the tables records."""
    rows, days = Inputs(spark, d, spec, until).to_record()
    path = scratch_path(spark, "full")
    record(rows, path)
    return recorded(spark, path, days)


def same(got, want):
    """All of a full run's rows, and beside them nothing but earlier runs'
    whole-history figures, which stay under their own day."""
    as_of = max((d for d, m, *_ in want if m.startswith(("funnel", "headline"))), default=None)
    assert [r for r in want if r not in got] == []
    assert [r for r in got if r not in want and not (r[1].startswith(("funnel", "headline")) and r[0] != as_of)] == []
    return bool(want)


def test_daily_runs_equal_full_runs(spark, tmp_path):
    d = parties(spark, folder(spark, tmp_path, "t", *tables(1)))
    out, state = scratch_path(spark, "daily"), scratch_path(spark, "state")
    # with days on which nothing ran, the same day once more, and an earlier one
    wanted = {day: full(spark, d, at(day).date()) for day in (5, 9)}
    for day in (5, 9, 9, 5):
        days = record_daily(spark, d, out, state, SPEC, at(day).date())
        assert same(recorded(spark, out, days), wanted[day])


def by_days(spark, d):
    """The tables with a file per day; returns the files by day."""
    files = {}
    for name, ts in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate")):
        path = os.path.join(d, f"{name}.parquet")
        rows = spark.read.parquet(path).collect()
        schema = spark.read.parquet(path).schema
        spark.createDataFrame(rows, schema).limit(0).write.mode("overwrite").parquet(path)
        for day in sorted({r[ts].date() for r in rows}):
            part = [r for r in rows if r[ts].date() == day]
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
            new = set(glob.glob(f"{path}/part-*.parquet")) - set().union(*files.values())
            files.setdefault(day, set()).update(new)
    return files


def test_closed_days_are_not_read_again(spark, tmp_path):
    """With the files of all closed days gone, a daily run still records what
    a run over everything did."""
    d = parties(spark, folder(spark, tmp_path, "t", *tables(3)))
    files = by_days(spark, d)
    out, state = scratch_path(spark, "daily"), scratch_path(spark, "state")
    record_daily(spark, d, out, state, SPEC, at(8).date())
    want = full(spark, d, at(9).date())
    gone = [f for day, names in files.items() if day < at(7).date() for f in names]  # open: 7th and 8th
    assert len(gone) > 10
    for f in gone:
        os.rename(f, str(tmp_path / os.path.basename(f)))
    spark.catalog.clearCache()
    days = record_daily(spark, d, out, state, SPEC, at(9).date())
    assert same(recorded(spark, out, days), want)


def test_scans_are_cut_and_the_index_is_read_in_part(spark, tmp_path):
    d = folder(spark, tmp_path, "t", *tables(4))
    state = scratch_path(spark, "state")
    record_daily(spark, d, scratch_path(spark, "daily"), state, SPEC, at(8).date())
    run = DailyRun(spark, d, History(spark, state, SPEC), SPEC, at(9).date())
    assert run.start == at(7).date()
    plan = run.step_events()._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    events = [s for s in scans if "events.parquet" in s]
    assert len(events) == 1 and "GreaterThanOrEqual(ts,2024-01-07" in events[0]
    index = [s for s in scans if "events-32" in s]
    assert len(index) == 1 and "PartitionFilters: [bucket" in index[0] and "GreaterThanOrEqual(event_id," in index[0]


def test_index_reads_matching_buckets_only(spark, tmp_path):
    index = SeenIndex(spark, str(tmp_path / "seen"), {"event_id": "long", "event_type": "string"}, buckets=8)
    keys = spark.range(1000).select(F.col("id").alias("event_id"), F.lit("view").alias("event_type"), F.lit(at(1).date()).alias("day"))
    index.add(keys)
    index.add(keys.where("event_id < 10"))  # an unfinished run's rows once more
    asking = spark.createDataFrame([(5, "view"), (5, "click"), (2000, "view"), (None, "view")], "event_id long, event_type string")
    met = index.matching(asking.where("event_id = 5"), at(2).date())
    assert met.select("bucket").distinct().count() == 1 and {r.event_id for r in met.collect()} == {5}
    (bucket,) = {r.bucket for r in met.collect()}
    for other in set(range(8)) - {bucket}:  # reading another bucket would fail
        (tmp_path / "seen-8" / f"bucket={other}").mkdir(exist_ok=True)
        (tmp_path / "seen-8" / f"bucket={other}" / "part-bad.parquet").write_bytes(b"not parquet")
    assert {r.event_id for r in index.matching(asking.where("event_id = 5"), at(2).date()).collect()} == {5}
    assert index.unseen(asking.where("event_id = 5"), at(2).date()).count() == 1
    for other in set(range(8)) - {bucket}:
        (tmp_path / "seen-8" / f"bucket={other}" / "part-bad.parquet").unlink()
    left = sorted(map(tuple, index.unseen(asking, at(2).date()).collect()), key=str)
    assert left == [(2000, "view"), (5, "click"), (None, "view")]
    assert index.unseen(asking, at(1).date()).count() == 4  # rows of that day on do not count
    assert SeenIndex(spark, str(tmp_path / "none"), index.key).unseen(asking, at(2).date()).count() == 4


def test_runs_that_die_change_nothing_for_the_next(spark, tmp_path, monkeypatch):
    """Lost while days are closed, before the rows are recorded, and before
    the history is advanced."""
    d = parties(spark, folder(spark, tmp_path, "t", *tables(5)))
    out, state = scratch_path(spark, "daily"), scratch_path(spark, "state")
    record_daily(spark, d, out, state, SPEC, at(5).date())

    def die(*a, **k):
        raise RuntimeError("lost")

    for target in ((History, "keep"), (incremental.sink, "record"), (History, "advance")):
        with monkeypatch.context() as m, pytest.raises(RuntimeError):
            m.setattr(*target, die)
            record_daily(spark, d, out, state, SPEC, at(8).date())
    days = record_daily(spark, d, out, state, SPEC, at(9).date())
    assert same(recorded(spark, out, days), full(spark, d, at(9).date()))


def test_quiet_days_and_missing_sides(spark, tmp_path):
    events, orders, lines = tables(6, days=4)
    d = folder(spark, tmp_path, "t", events, orders, lines)
    out, state = scratch_path(spark, "daily"), scratch_path(spark, "state")
    for until in (at(4).date(), at(20).date()):  # nothing new after the 4th
        days = record_daily(spark, d, out, state, SPEC, until)
    assert same(recorded(spark, out, days), full(spark, d, None))
    none = folder(spark, tmp_path, "none", [])
    assert record_daily(spark, none, scratch_path(spark, "o"), scratch_path(spark, "s"), SPEC) == []
    for name, parts in (("funds", ([], orders, lines)), ("events", (events, [], []))):
        d = folder(spark, tmp_path, name, *parts)
        out, state = scratch_path(spark, "daily"), scratch_path(spark, "state")
        days = record_daily(spark, d, out, state, SPEC, until := at(4).date())
        assert same(recorded(spark, out, days), full(spark, d, until))


def test_sketches_of_the_history(spark, tmp_path):
    """Payers and seconds to convert folded from closed days and open ones:
    exact at this size."""
    from relaylens.operators.funnel import durations, ordered_funnel
    from relaylens.sources.events import step_events

    d = parties(spark, folder(spark, tmp_path, "t", *tables(7)))
    state = scratch_path(spark, "state")
    for day in (3, 6):
        record_daily(spark, d, scratch_path(spark, "daily"), state, SPEC, at(day).date())
    run = DailyRun(spark, d, History(spark, state, SPEC), SPEC, at(9).date())
    paid = spark.read.parquet(f"{d}/orders.parquet").agg(F.count_distinct("o_custkey")).first()[0]
    assert run.payers_estimate().first()[0] == paid
    funnel = ordered_funnel(step_events(spark, d, SPEC.steps), SPEC, with_micros=True)
    want = durations(funnel, SPEC).groupBy("step_index", "step", "measure").agg(
        F.count(F.lit(1)), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY secs)"),
        F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY secs)"),
    )
    got = sorted(tuple(r) for r in run.time_to_convert().collect())
    assert got == sorted(tuple(int(v) if isinstance(v, float) else v for v in r) for r in want.collect()) and got


def test_the_command_keeps_a_history(spark, tmp_path):
    from relaylens.plans.record_job import run

    d = parties(spark, folder(spark, tmp_path, "t", *tables(8)))
    out, state = scratch_path(spark, "daily"), scratch_path(spark, "state")
    run(spark, d, out, SPEC, at(6).date(), state=state)
    days = run(spark, d, out, SPEC, at(9).date(), state=state)
    assert same(recorded(spark, out, days), full(spark, d, at(9).date()))
    assert History(spark, state, SPEC).progress().closed_until == at(8).date()
