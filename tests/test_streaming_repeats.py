"""Streams on repeated deliveries, quiet streams, and events without ids."""

import datetime as dt
import os

import duckdb
import pytest

from relaylens.params import FunnelSpec
from relaylens.sources.events import dedupe_events, load_events
from relaylens.streaming import queries
from relaylens.streaming.jobs import stream_dedupe, stream_funnel, stream_send_to_click
from relaylens.streaming.source import ROCKSDB, drain, event_stream
from tests.test_streaming import H, T0, batches, ev

M = dt.timedelta(minutes=1)
SPEC = FunnelSpec(hours=6)


def oracle(d, sql):
    """Rows by DuckDB, which reads the same files."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{d}/events.parquet/*.parquet')")
    cur = con.execute(sql)
    return [c[0] for c in cur.description], sorted(map(tuple, cur.fetchall()), key=str)


def rows_of(df, columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def optimized(df, capsys):
    capsys.readouterr()
    df.explain(True)
    return capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]


def funnel(spark, d, path=None, spec=SPEC, **how):
    return drain(stream_funnel(event_stream(spark, d, **how), spec), "t", path=path, state_store=ROCKSDB)


def joined(spark, d, path=None, hours=6, **how):
    sends, clicks = event_stream(spark, d, **how), event_stream(spark, d, **how)
    return drain(stream_send_to_click(sends, clicks, hours), "t", path=path, state_store=ROCKSDB)


CHAIN = [ev(1, T0, "view"), ev(2, T0 + H, "click"), ev(3, T0 + 2 * H, "signup"), ev(4, T0 + 3 * H, "purchase")]
END = [ev(90, T0 + 40 * H, "view", user=9)]
CLICKS = FunnelSpec(steps=("view", "click"), hours=6)


@pytest.mark.parametrize(
    "parts",
    [
        [CHAIN + CHAIN + CHAIN[:1] + END],  # one batch
        [CHAIN[:2] + CHAIN[:1], CHAIN[:1] + CHAIN[1:], CHAIN[2:] + END],  # across batches
        [CHAIN, END, CHAIN],  # after the window has closed: late
    ],
)
def test_a_repeated_send_gives_one_row(spark, tmp_path, parts):
    d = batches(spark, tmp_path, *parts)
    columns, want = oracle(d, queries._closed_funnel_sql(SPEC))
    assert len(want) == 1
    assert rows_of(funnel(spark, d, files_per_batch=1), columns) == want
    columns, want = oracle(d, queries._closed_funnel_sql(CLICKS))
    assert rows_of(joined(spark, d, files_per_batch=1), columns) == want


def test_a_repeat_after_a_restart(spark, tmp_path):
    d = batches(spark, tmp_path, CHAIN[:2], CHAIN[:2] + CHAIN[2:], END)
    held = {}
    for name in ("f1.parquet", "f2.parquet"):
        held[name] = (os.path.join(d, "events.parquet", name), str(tmp_path / f"aside-{name}"))
        os.rename(*held[name])
    f, j = str(tmp_path / "funnel"), str(tmp_path / "joined")
    assert funnel(spark, d, f).count() == 0 and joined(spark, d, j).count() == 0
    for target, aside in held.values():
        os.rename(aside, target)
    columns, want = oracle(d, queries._closed_funnel_sql(SPEC))
    assert rows_of(funnel(spark, d, f), columns) == want and len(want) == 1
    columns, want = oracle(d, queries._closed_funnel_sql(CLICKS))
    assert rows_of(joined(spark, d, j), columns) == want


@pytest.mark.parametrize("last", ["error", "view", "click"])
def test_a_last_event_of_any_type_closes_windows(spark, tmp_path, last):
    """A stream gone quiet on funnel steps: its other events move the
    watermark too."""
    d = batches(spark, tmp_path, CHAIN, [ev(90, T0 + 40 * H, last, user=9)])
    columns, want = oracle(d, queries._closed_funnel_sql(SPEC))
    assert rows_of(funnel(spark, d), columns) == want and len(want) == 1
    columns, want = oracle(d, queries._closed_funnel_sql(CLICKS))
    assert rows_of(joined(spark, d), columns) == want


def test_the_type_filter_stays_above_the_watermark(spark, tmp_path, capsys):
    from relaylens.streaming.jobs import of_types

    d = batches(spark, tmp_path, CHAIN)
    plan = optimized(of_types(event_stream(spark, d), ["view"]), capsys)
    assert plan.index("view") < plan.index("EventTimeWatermark"), plan


def test_dedupe_keeps_what_the_batch_keeps(spark, tmp_path):
    """Shared and null ids: the type is part of the identity, events without
    an id are told apart by their contents."""
    rows = [
        ev(2, T0, "click"), ev(2, T0, "signup"), ev(2, T0, "click"),
        ev(None, T0, "view"), ev(None, T0 + M, "view"), ev(None, T0, "view"), ev(None, T0, "view", user=2), ev(None, T0, "click"),
    ]
    d = batches(spark, tmp_path, rows, rows[::-1], [ev(3, T0 + 2 * M, "view")] + rows[:4])
    got = drain(stream_dedupe(event_stream(spark, d, files_per_batch=1)), "t")
    want = dedupe_events(load_events(spark, d))
    assert rows_of(got, want.columns) == rows_of(want, want.columns) and got.count() == 7


def test_sends_without_an_id(spark, tmp_path):
    rows = [ev(None, T0, "view"), ev(None, T0, "view"), ev(None, T0 + M, "view"), ev(2**60 + 1, T0 + 2 * M, "view"), ev(None, T0 + H, "click")]
    d = batches(spark, tmp_path, rows, rows + END)
    columns, want = oracle(d, queries._closed_funnel_sql(SPEC))
    assert len(want) == 3
    assert rows_of(funnel(spark, d, files_per_batch=1), columns) == want
    columns, want = oracle(d, queries._closed_funnel_sql(CLICKS))
    assert rows_of(joined(spark, d, files_per_batch=1), columns) == want


def test_join_at_the_ends_of_the_interval(spark, tmp_path):
    """The instant of the send does not count, the end of the window does, a
    microsecond later does not; the first of several clicks counts."""
    us = dt.timedelta(microseconds=1)
    rows = [
        ev(1, T0, "view"), ev(2, T0, "click"), ev(3, T0 + 6 * H, "click"),
        ev(4, T0, "view", user=2), ev(5, T0 + 6 * H + us, "click", user=2),
        ev(6, T0, "view", user=3), ev(7, T0 + 2 * H, "click", user=3), ev(8, T0 + H, "click", user=3),
        ev(9, T0 + H / 2, "view", user=3),
    ]
    d = batches(spark, tmp_path, rows, END)
    columns, want = oracle(d, queries._closed_funnel_sql(CLICKS))
    got = joined(spark, d)
    assert rows_of(got, columns) == want and len(want) == 4
    assert {r.send_id: r.depth for r in got.collect()} == {1: 1, 4: 0, 6: 1, 9: 1}


def test_join_has_bounded_state_and_one_aggregate(spark, tmp_path, capsys):
    d = batches(spark, tmp_path, CHAIN)
    plan = optimized(stream_send_to_click(event_stream(spark, d), event_stream(spark, d)), capsys)
    assert plan.count("Join LeftOuter") == 1 and plan.count("Aggregate") == 1 and plan.count("DeduplicateWithinWatermark") == 2

