"""Recording the metric table: re-running days replaces them, others stay."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaylens.params import FunnelSpec
from relaylens.plans.record_job import run
from relaylens.session import scratch_path
from relaylens.sources.sink import days_to_rewrite, read_recorded, record
from tests.conftest import SF001

SCHEMA = T.StructType(
    [
        T.StructField("day", T.DateType()),
        T.StructField("metric", T.StringType()),
        T.StructField("dim", T.StringType()),
        T.StructField("value", T.DecimalType(38, 6)),
    ]
)
D1, D2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)


def table(spark, rows):
    return spark.createDataFrame([(d, m, "all", Decimal(v)) for d, m, v in rows], SCHEMA)


def snapshot(spark, path):
    return sorted((r.day, r.metric, str(r.value)) for r in read_recorded(spark, path).collect())


def test_rerun_replaces_only_its_partitions(spark):
    path = scratch_path(spark, "test-metrics")
    record(table(spark, [(D1, "a_x", "1"), (D2, "a_x", "2"), (D2, "b_y", "3")]), path)
    first = snapshot(spark, path)
    record(table(spark, [(D1, "a_x", "1"), (D2, "a_x", "2"), (D2, "b_y", "3")]), path)
    assert snapshot(spark, path) == first
    record(table(spark, [(D2, "a_x", "5"), (D2, "a_z", "6")]), path)
    assert snapshot(spark, path) == [
        (D1, "a_x", "1.000000"),
        (D2, "a_x", "5.000000"),
        (D2, "a_z", "6.000000"),
        (D2, "b_y", "3.000000"),
    ]


def test_days_to_rewrite():
    assert days_to_rewrite(dt.date(2024, 1, 30), 72) == [dt.date(2024, 1, d) for d in (27, 28, 29, 30)]
    assert days_to_rewrite(dt.date(2024, 1, 30), 1) == [dt.date(2024, 1, 29), dt.date(2024, 1, 30)]


def test_recorded_query_is_stable(spark):
    import __spark_entry__ as E
    from tests.conftest import SF001

    q = E.queries()["recorded_metrics"]
    a = sorted(tuple(r) for r in q(spark, SF001).collect())
    b = sorted(tuple(r) for r in q(spark, SF001).collect())
    assert a == b and len(a) > 0


def folder(spark, tmp_path, name, events, orders=(), lines=()):
    """A tables folder of hand-made rows."""
    d = tmp_path / name
    spark.createDataFrame(
        [(i, t, u, typ, 1.0, '{"k": 1}') for i, t, u, typ in events],
        "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    ).write.parquet(str(d / "events.parquet"))
    spark.createDataFrame(
        [(i, 1, "F", v, t, "1") for i, t, v in orders],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    ).write.parquet(str(d / "orders.parquet"))
    spark.createDataFrame(
        [(i, v, 0.0, "R", t) for i, t, v in lines],
        "l_orderkey long, l_extendedprice double, l_discount double, l_returnflag string, l_shipdate timestamp_ntz",
    ).write.parquet(str(d / "lineitem.parquet"))
    return str(d)


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


EVENTS = [(1, at(8), 1, "view"), (2, at(9), 1, "click"), (3, at(10), 2, "view"), (4, at(10, 2), 2, "click")]
ORDERS = [(1, at(3), 10.0), (2, at(6), 5.0)]
LINES = [(1, at(5), 2.0)]


def test_the_next_days_run_keeps_every_figure(spark, tmp_path):
    """Day N, then day N + 1 with one more event: all that was recorded for
    day N is still there, but for its cohort, which is open."""
    path = scratch_path(spark, "test-history")
    run(spark, folder(spark, tmp_path, "a", EVENTS, ORDERS, LINES), path, FunnelSpec())
    first = snapshot(spark, path)
    kinds = {m.split("_")[0] for d, m, _ in first if d == dt.date(2024, 1, 10)}
    assert kinds == {"cohort", "funnel", "headline"}
    run(spark, folder(spark, tmp_path, "b", EVENTS + [(5, at(11), 1, "view")], ORDERS, LINES), path, FunnelSpec())
    second = snapshot(spark, path)
    fixed = [r for r in first if not r[1].startswith("cohort")]
    assert [r for r in fixed if r not in second] == []
    assert {m.split("_")[0] for d, m, _ in second if d == dt.date(2024, 1, 11)} == {"cohort", "funnel", "headline"}


def test_ledger_days_are_recorded_by_their_own_clock(spark, tmp_path):
    path = scratch_path(spark, "test-ledger-days")
    run(spark, folder(spark, tmp_path, "a", EVENTS, ORDERS, LINES), path, FunnelSpec())
    got = {(d, m): v for d, m, v in snapshot(spark, path) if m.startswith("funds")}
    assert {d for d, _ in got} == {dt.date(2024, 1, d) for d in (3, 4, 5, 6)}
    assert got[dt.date(2024, 1, 3), "funds_in"] == "10.000000"
    assert got[dt.date(2024, 1, 4), "funds_moves_in"] == "0.000000"  # a day without movement
    assert got[dt.date(2024, 1, 5), "funds_net"] == "-2.000000"


def test_as_of_equals_a_run_on_data_cut_at_that_day(spark, tmp_path):
    day = dt.date(2024, 1, 9)
    full = folder(spark, tmp_path, "full", EVENTS, ORDERS + [(3, at(20), 7.0)], LINES)
    cut = folder(spark, tmp_path, "cut", [e for e in EVENTS if e[1].date() <= day], ORDERS, LINES)
    a, b = scratch_path(spark, "as-of-a"), scratch_path(spark, "as-of-b")
    run(spark, full, a, FunnelSpec(), as_of=day)
    run(spark, cut, b, FunnelSpec())
    assert snapshot(spark, a) == snapshot(spark, b) != []
    assert {m.split("_")[0] for d, m, _ in snapshot(spark, a) if d == day} == {"cohort", "funnel", "headline"}


def test_a_day_whose_rows_vanish_is_replaced(spark, tmp_path):
    path = scratch_path(spark, "test-vanish")
    run(spark, folder(spark, tmp_path, "a", EVENTS, ORDERS, LINES), path, FunnelSpec())
    run(spark, folder(spark, tmp_path, "b", EVENTS[2:], ORDERS, []), path, FunnelSpec())
    got = {(d, m, v) for d, m, v in snapshot(spark, path) if d == dt.date(2024, 1, 8) and m.startswith("cohort")}
    assert {v for _, _, v in got} == {"0.000000"}
    assert (dt.date(2024, 1, 5), "funds_out", "0.000000") in snapshot(spark, path)


def test_a_copy_delivered_again_counts_on_its_first_day_only(spark, tmp_path):
    """Copies before and inside the open days (from the 8th): recorded
    cohorts equal those of a run over everything."""
    events = [
        (1, at(5), 1, "view"), (1, at(9), 1, "view"),  # first seen before
        (2, at(9, 2), 1, "click"),
        (3, at(7), 2, "click"), (3, at(10, 3), 2, "click"), (4, at(10), 2, "view"),  # its click is an old one
        (5, at(9), 3, "view"), (5, at(10), 3, "view"), (6, at(9, 5), 3, "click"),  # both inside
        (None, at(7), 4, "view"), (None, at(9), 4, "view"),  # no id: two events
        (7, at(11), 9, "view"),
    ]
    where = folder(spark, tmp_path, "copies", events)
    daily, whole = scratch_path(spark, "copies-daily"), scratch_path(spark, "copies-whole")
    run(spark, where, daily, FunnelSpec())
    run(spark, where, whole, FunnelSpec(), backfill=True)
    cohorts = lambda path: {(d, m): v for d, m, v in snapshot(spark, path) if m.startswith("cohort") and d >= dt.date(2024, 1, 8)}
    a, b = cohorts(daily), cohorts(whole)
    assert b and all(a[key] == v for key, v in b.items())
    assert all(float(v) == 0 for key, v in a.items() if key not in b)


def test_empty_tables(spark, tmp_path):
    path = scratch_path(spark, "test-empty")
    assert run(spark, folder(spark, tmp_path, "none", []), path, FunnelSpec()) == []
    days = run(spark, folder(spark, tmp_path, "funds", [], ORDERS, LINES), path, FunnelSpec())
    assert days[-1] == dt.date(2024, 1, 6)
    only = run(spark, folder(spark, tmp_path, "events", EVENTS), path, FunnelSpec())
    assert only[-1] == dt.date(2024, 1, 10)


def test_scans_are_cut_to_the_days_written(spark):
    from relaylens.plans.queries import Inputs

    rows, days = Inputs(spark, SF001).to_record()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert any("GreaterThanOrEqual(ts," in s for s in scans)
    assert any("GreaterThanOrEqual(o_orderdate," in s for s in scans)
    assert any("GreaterThanOrEqual(l_shipdate," in s for s in scans)
    assert len(days) == 8


def test_backfill_records_the_whole_overview(spark):
    import __spark_entry__ as E

    path = scratch_path(spark, "test-backfill")
    run(spark, SF001, path, FunnelSpec(), backfill=True)
    got = sorted(map(tuple, read_recorded(spark, path).collect()))
    want = sorted(map(tuple, E.queries()["metrics_overview"](spark, SF001).collect()))
    assert got == want and read_recorded(spark, path).agg(F.countDistinct("day")).first()[0] > 1000
