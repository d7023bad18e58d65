"""F4 from a batch run's open sends, its state read as a table, and F1's
counts recorded batch by batch."""

import datetime as dt

from pyspark.sql import functions as F

from relaylens.operators.funnel import ordered_funnel
from relaylens.params import FunnelSpec
from relaylens.sources.events import load_events
from relaylens.streaming import queries
from relaylens.streaming.jobs import held_sends, stream_funnel, stream_step_counts
from relaylens.streaming.recording import read_stream_metrics, record_stream, write_batch
from relaylens.streaming.source import ROCKSDB, drain, event_stream
from tests.test_streaming import H, T0, _busy_rows, _closed, batches, ev
from tests.test_streaming_repeats import oracle, rows_of



def test_batch_up_to_a_day_plus_the_stream_after_it(spark, tmp_path):
    """Equal to the batch over all, with sends and chains across the cut, a
    copy delivered on both sides of it, and a send without an id."""
    spec = FunnelSpec(hours=30, split_hours=20)
    rows = _busy_rows()
    cut = T0 + 4 * 24 * H + 3 * H
    rows += [ev(None, cut - 2 * H, "view"), rows[-1], rows[30], ev(99_990, cut, "view"), ev(99_991, cut + H, "click")]
    rows.sort(key=lambda r: r[1])
    n = len(rows) // 2
    d = batches(spark, tmp_path, rows[:n], rows[n:])
    got = queries.funnel_after(spark, d, spec, cut, files_per_batch=1)
    columns, want = oracle(d, queries._closed_funnel_sql(spec))
    assert rows_of(got, columns) == want and len(want) > 30


def test_open_sends_of_a_stopped_stream(spark, tmp_path):
    """The state as a table equals the batch's open sends as of the
    watermark."""
    spec = FunnelSpec(hours=30, split_hours=20)
    rows = _busy_rows()
    d = batches(spark, tmp_path, rows)
    path = str(tmp_path / "stream")
    drain(stream_funnel(event_stream(spark, d), spec), "t", path=path, state_store=ROCKSDB)
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, ROCKSDB)
    try:
        held = held_sends(spark, f"{path}/_checkpoint", spec).collect()
    finally:
        spark.conf.unset(key)
    watermark = max(r[1] for r in rows) - H
    seen = load_events(spark, d, spec.steps).where(F.col("ts") < F.lit(watermark))
    want = ordered_funnel(seen, spec).where(F.timestamp_add("HOUR", F.lit(spec.hours), F.col("send_ts")) >= F.lit(watermark))
    names = spec.steps
    assert sorted((r.send_id, r.user_id, r.send_ts, r.depth, r.last_step) for r in held) == sorted(
        (r.send_id, r.user_id, r.send_ts, r.depth, names[r.depth]) for r in want.collect()
    )
    assert len({r.depth for r in held}) > 1


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    rows = [ev(i, T0 + i * H, ("view", "click")[i % 2]) for i in range(100)]
    d = batches(spark, tmp_path, rows[:40], rows[40:70], rows[70:])
    path = str(tmp_path / "metrics")
    counts = lambda: stream_step_counts(event_stream(spark, d, files_per_batch=1), window="6 hours")
    record_stream(counts(), path)
    first = sorted(map(tuple, read_stream_metrics(spark, path).collect()))
    assert sum(v for *_, v in first) == 96 and len(first) == 8  # windows closed by hour 98
    table = spark.read.parquet(f"{path}/table")
    ids = [r.batch_id for r in table.select("batch_id").distinct().collect()]
    assert len(ids) > 1
    # the same batch handed over again, as after a failure
    again = table.where(F.col("batch_id") == ids[0]).select(
        F.col("day").cast("timestamp_ntz").alias("window_start"), F.col("dim").alias("event_type"), F.col("value").cast("long").alias("n")
    ).collect()
    batch = spark.createDataFrame(again, "window_start timestamp_ntz, event_type string, n long")
    write_batch(f"{path}/table")(batch, ids[0])
    assert sorted(map(tuple, read_stream_metrics(spark, path).collect())) == first
    record_stream(counts(), path)  # resumed with nothing new
    assert sorted(map(tuple, read_stream_metrics(spark, path).collect())) == first


def test_closed_is_what_the_batch_closes(spark, tmp_path):
    spec = FunnelSpec(hours=6)
    rows = [ev(1, T0, "view"), ev(2, T0 + H, "click"), ev(3, T0 + dt.timedelta(days=2), "error")]
    d = batches(spark, tmp_path, rows)
    got = queries.funnel_after(spark, d, spec, T0 + dt.timedelta(minutes=30))
    assert rows_of(got, got.columns) == sorted(_closed(spark, d, spec, rows, got.columns), key=str) and got.count() == 1
