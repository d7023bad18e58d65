"""Streaming jobs against their batch forms, fed in more than one batch."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from relaylens.operators.funnel import ordered_funnel
from relaylens.params import FunnelSpec
from relaylens.sources.events import load_events
from relaylens.streaming.jobs import stream_funnel, stream_step_counts
from relaylens.streaming.source import ROCKSDB, drain, event_stream

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)
H = dt.timedelta(hours=1)


def ev(i, t, typ, user=1):
    return (i, t, user, typ, 1.0, '{"k": 3}')


def batches(spark, tmp_path, *parts):
    """``events.parquet`` as a folder of files, read one file per batch."""
    from relaylens.streaming.source import EVENT_SCHEMA

    import os
    import time

    d = tmp_path / "sf"
    (d / "events.parquet").mkdir(parents=True)
    now = time.time()
    for i, rows in enumerate(parts):
        age, n = 100 * (len(parts) - i), f"f{i}"
        spark.createDataFrame(rows, EVENT_SCHEMA).coalesce(1).write.parquet(str(tmp_path / n))
        part = next((tmp_path / n).glob("part-*.parquet"))
        target = d / "events.parquet" / f"{n}.parquet"
        part.rename(target)
        os.utime(target, (now - age, now - age))  # file streams read oldest first
    return str(d)


def test_late_event_dropped_by_step_counts(spark, tmp_path):
    # Spark drops input older than the watermark of the batch before: the
    # watermark set after batch 0 (50h - 1h) applies to batch 2's input.
    first = [ev(1, T0 + 10 * H, "view"), ev(2, T0 + 50 * H, "view")]
    second = [ev(5, T0 + 51 * H, "click")]
    third = [ev(3, T0 + 11 * H, "view"), ev(4, T0 + 49 * H + 30 * dt.timedelta(minutes=1), "view")]
    d = batches(spark, tmp_path, first, second, third)
    got = drain(stream_step_counts(event_stream(spark, d, files_per_batch=1)), "t-late")
    counts = {r.window_start.date(): r.n for r in got.collect()}
    # Event 3 (11h) is older than the watermark (49h) when it arrives: dropped.
    # Event 4 (49.5h) is not late; its day (day 3) is still open at the end
    # (watermark 50h), so only day 1 and day 2 close, and day 2 has no events.
    assert counts == {T0.date(): 1}


@pytest.mark.parametrize("parts,hours", [(2, 6), (4, 30)])
def test_stream_funnel_equals_batch_on_closed_windows(spark, tmp_path, parts, hours):
    spec = FunnelSpec(hours=hours)
    rows = []
    i = 0
    for day in range(4):
        for u in range(3):
            base = T0 + day * 24 * H + u * H
            for typ, off in (("view", 0), ("click", 1), ("signup", 2), ("view", 3), ("purchase", 5), ("click", 9)):
                rows.append(ev(i, base + off * H, typ, user=u))
                i += 1
    rows.sort(key=lambda r: r[1])
    n = len(rows) // parts + 1
    d = batches(spark, tmp_path, *[rows[i * n : (i + 1) * n] for i in range(parts)])
    got = drain(stream_funnel(event_stream(spark, d, files_per_batch=1), spec), "t-funnel", state_store=ROCKSDB)
    watermark = max(r[1] for r in rows) - H
    batch = ordered_funnel(load_events(spark, d, spec.steps), spec).where(
        F.timestamp_add("HOUR", F.lit(spec.hours), F.col("send_ts")) < F.lit(watermark)
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select(*got.columns).collect()))
    assert got.count() > 0


def test_stream_dedupe_across_batches(spark, tmp_path):
    from relaylens.streaming.jobs import stream_dedupe

    first = [ev(1, T0 + 10 * H, "view"), ev(2, T0 + 11 * H, "click")]
    second = [ev(1, T0 + 10 * H, "view"), ev(3, T0 + 11 * H + 30 * dt.timedelta(minutes=1), "signup")]
    d = batches(spark, tmp_path, first, second)
    got = drain(stream_dedupe(event_stream(spark, d, files_per_batch=1)), "t-dedupe")
    assert sorted(r.event_id for r in got.collect()) == [1, 2, 3]


def _busy_rows():
    """Two users with overlapping sends over ten days: many time slices."""
    rows, i = [], 0
    for day in range(10):
        for u in range(2):
            base = T0 + day * 24 * H + u * H
            for typ, off in (("view", 0), ("view", 1), ("click", 2), ("signup", 3), ("view", 4), ("purchase", 5), ("click", 9)):
                rows.append(ev(i, base + off * H, typ, user=u))
                i += 1
    return sorted(rows, key=lambda r: r[1])


def _closed(spark, d, spec, rows, columns):
    watermark = max(r[1] for r in rows) - H
    batch = ordered_funnel(load_events(spark, d, spec.steps), spec).where(
        F.timestamp_add("HOUR", F.lit(spec.hours), F.col("send_ts")) < F.lit(watermark)
    )
    return sorted(map(tuple, batch.select(*columns).collect()))


@pytest.mark.parametrize("split_hours", [None, 7])
def test_stream_funnel_over_time_slices(spark, tmp_path, split_hours):
    spec = FunnelSpec(hours=30, split_hours=split_hours)
    rows = _busy_rows()
    n = len(rows) // 3 + 1
    d = batches(spark, tmp_path, *[rows[k * n : (k + 1) * n] for k in range(3)])
    got = drain(stream_funnel(event_stream(spark, d, files_per_batch=1), spec), "t-sliced", state_store=ROCKSDB)
    assert got.count() > 0
    assert sorted(map(tuple, got.collect())) == _closed(spark, d, spec, rows, got.columns)


def test_a_stopped_stream_resumes(spark, tmp_path):
    """Batch 1, stop, more files (one user now sends most of all events),
    resume from the same folder: equal to the batch job on all of it."""
    import os

    spec = FunnelSpec(hours=30, split_hours=20)
    rows = _busy_rows()
    extra = [ev(1000 + i, T0 + 5 * 24 * H + i * dt.timedelta(minutes=7), ("view", "click", "signup", "purchase")[i % 4], user=0) for i in range(400)]
    later = sorted([r for r in rows if r[1] >= T0 + 4 * 24 * H] + extra, key=lambda r: r[1])
    first = [r for r in rows if r[1] < T0 + 4 * 24 * H]
    d = batches(spark, tmp_path, first, later)
    late = os.path.join(d, "events.parquet", "f1.parquet")
    aside = str(tmp_path / "f1.parquet")
    os.rename(late, aside)
    path = str(tmp_path / "stream")
    before = drain(stream_funnel(event_stream(spark, d), spec), "t-resume", path=path, state_store=ROCKSDB).count()
    os.rename(aside, late)
    got = drain(stream_funnel(event_stream(spark, d), spec), "t-resume", path=path, state_store=ROCKSDB)
    assert 0 < before < got.count()
    assert sorted(map(tuple, got.collect())) == _closed(spark, d, spec, first + later, got.columns)


def test_the_sessions_state_store_is_put_back(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    d = batches(spark, tmp_path, [ev(1, T0, "view")])
    drain(stream_funnel(event_stream(spark, d), FunnelSpec()), "t-conf", state_store=ROCKSDB)
    assert spark.conf.get(key, None) == before


def test_state_keys_do_not_grow_with_users(spark, tmp_path):
    """Users share state keys: a state call and a timer per bucket and slice,
    not per user; rows and open sends stay each user's own."""
    from relaylens.streaming.jobs import USER_BUCKETS, held_sends

    spec = FunnelSpec(hours=6)
    n = 2 * USER_BUCKETS
    rows = [ev(u, T0 + u % 50 * H / 50, "view", user=u) for u in range(n)]
    rows += [ev(n + u, T0 + (u % 3 + 1) * H, ("click", "signup")[u % 2], user=u) for u in range(n)]
    rows += [ev(2 * n + u, T0 + 9 * H, "view", user=u) for u in range(n)] + [ev(-1, T0 + 12 * H, "error")]
    d = batches(spark, tmp_path, rows)
    path = str(tmp_path / "stream")
    got = drain(stream_funnel(event_stream(spark, d), spec), "t-buckets", path=path, state_store=ROCKSDB)
    assert sorted(map(str, got.collect())) == _closed_text(spark, d, spec, rows, got.columns) and got.count() == n
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, ROCKSDB)
    try:
        held = held_sends(spark, f"{path}/_checkpoint", spec).collect()
        state = spark.read.format("statestore").option("path", f"{path}/_checkpoint").option("operatorId", 0)
        keys = state.option("stateVarName", "timer").load().select("key").distinct().count()
    finally:
        spark.conf.unset(key)
    assert sorted((r.send_id, r.user_id, r.depth) for r in held) == [(2 * n + u, u, 0) for u in range(n)]
    assert keys <= USER_BUCKETS


def _closed_text(spark, d, spec, rows, columns):
    watermark = max(r[1] for r in rows) - H
    batch = ordered_funnel(load_events(spark, d, spec.steps), spec).where(
        F.timestamp_add("HOUR", F.lit(spec.hours), F.col("send_ts")) < F.lit(watermark)
    )
    return sorted(map(str, batch.select(*columns).collect()))


def test_initial_state_in_parts(spark, tmp_path):
    """A key's open sends may come in more than one batch of rows."""
    from relaylens.streaming import queries

    spec = FunnelSpec(hours=30, split_hours=20)
    rows = _busy_rows()
    d = batches(spark, tmp_path, rows)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    try:
        got = queries.funnel_after(spark, d, spec, T0 + 4 * 24 * H + 3 * H)
        assert sorted(map(str, got.collect())) == _closed_text(spark, d, spec, rows, got.columns)
    finally:
        spark.conf.set(key, before)
